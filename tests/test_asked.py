"""Did-you-mean is asked for what was typed."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_typed_words_are_asked(spark):
    typed = {r["word"] for r in spark.read.parquet(f"{SF}/query_form.parquet").where("word is not null").collect()}
    names = {r["canonical"] for r in spark.read.parquet(f"{SF}/ref_headword.parquet").collect()}
    for name in ("fuzzy_suggest", "fuzzy_cross_dict", "suggest_else_fuzzy"):
        df = entry.queries()[name](spark, str(SF))
        asked = {r[0] for r in df.select("query" if "query" in df.columns else "word").distinct().collect()}
        assert asked <= typed and asked - names, name
