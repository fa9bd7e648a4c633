"""Problem 5: paths and descendants against walking the links one by one."""

import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexloom.operators import hierarchy as Y
from lexloom.plans import references as R

SF = Path("/root/testdata/sf0.001")


def brute_paths(links):
    parent = {}
    for c, p in sorted(links, reverse=True):
        parent[c] = p
    out = {}
    for v in set(parent) | set(parent.values()):
        path = [v]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        out[v] = (0, -1, path) if path[-1] in parent else (path[-1], len(path) - 1, path)
    return out


def joined(rows, block):
    """node -> (root, depth, n_below, path) of the parts, none of which is too long."""
    out = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        assert 0 < len(r["path"]) <= block
        root, depth, below, path = out.setdefault(r["node_id"], (r["root_id"], r["depth"], r["n_below"], []))
        assert (root, depth, below, len(path)) == (r["root_id"], r["depth"], r["n_below"], r["part"] * block)
        path.extend(r["path"])
    return out


def check_paths(spark, links, least=10_000, block=1024):
    found = Y.paths(Y.hierarchy(spark.createDataFrame(links, "child long, parent long"), least), block).cache()
    want = brute_paths(links)
    pairs = sorted((u, v, k) for v, (_, _, path) in want.items() for k, u in enumerate(path) if k)
    below = {u: 0 for u in want}
    for u, _, _ in pairs:
        below[u] += 1
    rows = found.collect()
    assert len({(r["node_id"], r["part"]) for r in rows}) == len(rows)
    assert joined(rows, block) == {v: (root, depth, below[v], path) for v, (root, depth, path) in want.items()}
    assert sorted(tuple(r) for r in Y.descendants(found, block).collect()) == pairs
    found.unpersist()


def test_paths_random(spark):
    rnd = random.Random(11)
    check_paths(spark, [(c, rnd.randrange(1, 80)) for c in rnd.sample(range(1, 80), 70)])
    check_paths(spark, [(c, rnd.randrange(1, c)) for c in range(2, 400)], 100)  # one tree over several ranges


def test_paths_deep_wide_and_endless(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(i, 500) for i in range(600, 700)]
    ring = [(2000 + i * 3 % 20, 2000 + (i + 1) * 3 % 20) for i in range(20)]
    check_paths(spark, chain + star + ring + [(3000 + i, 2000 + i % 4) for i in range(30)] + [(3100, 3000), (3101, 3100), (4000, 4000), (4001, 4000)], block=7)
    assert Y.paths(Y.hierarchy(spark.createDataFrame([], "child long, parent long"))).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_path_queries_cover_the_index(spark):
    links = [tuple(r) for r in R.redirect_links(spark, str(SF)).select("child", "parent").collect()]
    want = brute_paths(links)
    got = joined(entry.queries()["p5_paths"](spark, str(SF)).collect(), Y.BLOCK)
    ids = {r["id"] for r in spark.read.parquet(f"{SF}/mdx_index.parquet").select("id").collect()}
    assert set(got) == ids | set(want)
    assert all((r, d, p) == want.get(v, (v, 0, [v])) for v, (r, d, _, p) in got.items())
    pairs = {(r["node_id"], r["descendant_id"], r["distance"]) for r in entry.queries()["p5_descendants"](spark, str(SF)).collect()}
    assert pairs == {(u, v, k) for v, (_, _, path) in want.items() for k, u in enumerate(path) if k}
