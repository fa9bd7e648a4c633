"""Problem 3: forms of all rows, against the cases p3_found names."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_forms_of_every_row(spark):
    q, sf = entry.queries(), str(SF)
    mdx = spark.read.parquet(f"{SF}/dict_header.parquet").where("kind = 'mdx'").select("dict_id")
    rows = {r["id"]: r for r in spark.read.parquet(f"{SF}/mdx_index.parquet").join(mdx, "dict_id", "left_semi").collect()}
    got = q["p3_forms"](spark, sf).collect()
    form = {r["id"]: (r["text"], r["normalized"]) for r in got}
    assert len(got) == len(form) and set(form) == set(rows)
    restored = {r["row_id"]: r["restored"] for r in q["p4_repaired"](spark, sf).where("src = 'mdx_index'").collect()}
    cases = {(r["id"], r["field"]) for r in q["p3_found"](spark, sf).collect()}
    sound = {i: r for i, r in rows.items() if i not in restored}
    want = {(i, "text") for i, r in sound.items() if r["text"] is not None and form[i][0] != r["text"]}
    want |= {(i, "normalized") for i, r in sound.items() if r["normalized"] is not None and form[i][1] is not None and form[i][1] != r["normalized"]}
    assert want == cases and any(f == "text" for _, f in cases)
    changed = [i for i, t in restored.items() if i in rows and t != rows[i]["text"]]
    assert changed and all(form[i][0] != rows[i]["text"] for i in changed)
