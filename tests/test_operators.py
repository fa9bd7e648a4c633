import random

from pyspark.sql import functions as F

from lexloom.operators import hierarchy as Y
from lexloom.operators import lookup as K
from lexloom.operators import orphans as O
from lexloom.operators import render as R
from lexloom.operators import state as S
from lexloom.operators import suggest as G
from lexloom.operators.skew import join_unique

INDEX = "dict_id string, id long, text string, normalized string"


def index(spark, rows):
    return spark.createDataFrame([("d", i + 1, t, n) for i, (t, n) in enumerate(rows)], INDEX)


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lookup_steps(spark):
    ix = index(spark, [("hello", None), ("Hello", None), ("Café", "cafe"), ("TeSt", None)])
    assert rows(K.lookup_exact(words(spark, "Hello", "x"), ix), "word", "id") == [("Hello", 2)]
    assert rows(K.lookup_cascade(words(spark, "Hello", "test", "cafe", "HELLO"), ix), "word", "kind", "id") == [("HELLO", 1, 1), ("Hello", 0, 2), ("cafe", 2, 3), ("test", 1, 4)]
    assert rows(K.lookup_normalized(words(spark, "CAFÉ", None, ""), ix), "word", "id") == [("CAFÉ", 3)]
    assert K.lookup_cascade(words(spark), ix).count() == 0


def test_entry_lookup_normalizes_first(spark):
    ix = index(spark, [("polish", "polish"), ("Polish", "polish"), ("run", "run"), ("go", "go")])
    got = rows(K.entry_lookup(words(spark, "Polish", "running", "went"), ix), "word", "step", "id")
    assert got == [("Polish", 0, 1), ("running", 1, 3), ("went", 1, 4)]


def test_redirect_limits(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (30, 30)], "child long, parent long")
    start = links.select(F.col("child").alias("node"))
    got = {r["node"]: (r["last"], r["status"]) for r in K.follow_redirects(start, links, 5).collect()}
    assert got[11] == (12, "ok") and got[7] == (12, "ok") and got[6][1] == "too_many_redirects" and got[20][1] == got[30][1] == "too_many_redirects"
    chains = {r["node"]: r for r in K.trace(start, links).collect()}
    assert chains[0]["depth"] == 10 and chains[11]["chain"] == [11, 12] and chains[20]["depth"] == 10


def test_suggest_order(spark):
    ix = index(spark, [("cats", "cats"), ("cat", "cat"), ("Cat", "cat"), ("category", "category"), ("dog", "dog"), ("c" * 60, "c" * 60), ("nul", None)])
    p = spark.createDataFrame([("cat",), ("c",), ("",), (None,)], "prefix string")
    got = [r["text"] for r in G.suggest_prefix(p, ix).where("prefix = 'cat'").orderBy("rank").collect()]
    assert got == ["Cat", "cat", "cats", "category"]
    merged = [r["word"] for r in G.suggest_merged(p, ix).where("prefix = 'cat'").orderBy("place").collect()]
    assert merged[:2] == ["Cat", "cat"] and set(merged) == {"cat", "Cat", "cats", "category"}
    assert G.suggest_merged(p, ix).where("prefix = 'c'").count() == 0  # under two bytes


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))) for _ in range(150)})
    ix = spark.createDataFrame([("d", i, w, w.replace("é", "e")) for i, w in enumerate(vocabulary)], INDEX)
    asked = rnd.sample(vocabulary, 12)
    got = rows(G.fuzzy_suggest(words(spark, *asked), ix, limit=1000), "query", "word", "distance")
    want = []
    for q in asked:
        n = q.replace("é", "e")
        want += [(q, w, d) for w in vocabulary if w.replace("é", "e")[0] == n[0] and (d := brute_distance(n, w.replace("é", "e"))) <= 2]
    assert got == sorted(want)
    one = index(spark, [("Apple", "apple"), ("apple", "apple"), ("cat", "cat"), ("cart", "cart"), ("dog", "dog")])
    assert rows(G.fuzzy_suggest(words(spark, "aple", "ct", "", None), one), "query", "word") == [("aple", "Apple"), ("ct", "cart"), ("ct", "cat")]


def test_bm25_prefers_rare_and_short(spark):
    ix = index(spark, [("help", "help"), ("helper-helper", "x"), ("你好世界", "你好世界"), ("helmet", "helmet")])
    terms = spark.createDataFrame([("help",), ("你",), ("好",)], "term string")
    got = rows(G.fts_bm25(terms, ix), "term", "id")
    assert got == [("help", 1), ("help", 2), ("你", 3)]


def test_styles_first_wins(spark):
    body = "<style>a{}</style><link rel=stylesheet href=x.css><link rel=icon href=y>text"
    s = spark.createDataFrame([("r", 1, "d", body), ("r", 2, "d", body), ("r", 3, "e", body), ("r", 4, "d", None)], "render_id string, ord long, dict_id string, body string")
    got = {r["ord"]: r for r in R.dedup_styles(s).collect()}
    assert "<style>" in got[1]["head"] and "x.css" in got[1]["head"] and got[2]["head"] == "" and got[3]["head"] != ""
    assert got[2]["body"] == "<link rel=icon href=y>text" and got[4]["body"] is None


def test_favorites_and_history(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "word string, added_at long")
    new = spark.createDataFrame([(" a ", 5), ("", 9), (None, 3)], "word string, added_at long")
    assert rows(S.favorites_upsert(old, new), "word", "added_at") == [("a", 5), ("b", 2)]
    assert rows(S.favorites_delete(old, new), "word") == [("b",)]
    h = spark.createDataFrame([("u", w, i) for i, w in enumerate(["Go", "x", "go", "run"])], "user string, word string, ts long")
    assert [(r["word"], r["place"]) for r in S.history(h, "user", "word", "ts").orderBy("place").collect()] == [("run", 1), ("go", 2)]


def test_change_set_and_staleness(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime long")
    new = spark.createDataFrame([("b", 1, 1), ("c", 2, 1), ("d", 1, None)], "path string, size long, mtime long")
    assert rows(S.change_set(old, new), "path", "change") == [("a", "removed"), ("c", "changed"), ("d", "added")]


def test_block_offsets_over_stretches(spark):
    b = spark.range(10_000).select(F.lit("f").alias("p"), F.col("id").alias("no"), (F.col("id") % 7).alias("size"))
    got = S.block_offsets(b, "p", "no", "size").orderBy("no").collect()
    total = 0
    for r in got:
        assert r["offset"] == total
        total += r["size"]


# ---- hierarchies


def brute_tree(links):
    parent = {}
    for c, p in sorted(links, reverse=True):
        parent[c] = p
    out = {}
    for c in parent:
        seen, at = {c}, parent[c]
        n = 1
        while at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
            n += 1
        out[c] = (0, -1) if at in parent else (at, n)
    return out


def check_tree(spark, links, least=10_000):
    df = spark.createDataFrame([(c, p, "x") for c, p in links], "child long, parent long, depth string")
    got = Y.hierarchy(df, least).collect()
    want = brute_tree([x for x in links if None not in x])
    assert {r["node_id"]: (r["root_id"], r["depth"]) for r in got} == want and len(got) == len(want)
    inside = {(r["root_id"], r["node_id"]): (r["entry"], r["exit"]) for r in got if r["depth"] > 0}
    parent = {r["node_id"]: r["parent_id"] for r in got}
    for (root, v), (a, b) in inside.items():
        above = set()
        at = parent[v]
        while at != root:
            above.add(at)
            at = parent[at]
        assert above == {u for (q, u), (x, y) in inside.items() if q == root and x < a and b < y}
    below = {r["node_id"]: r["n_below"] for r in got if r["depth"] > 0}
    for (root, v), (a, b) in inside.items():
        assert below[v] == sum(1 for (q, u), (x, y) in inside.items() if q == root and a < x and y < b)


def test_hierarchy_random(spark):
    rnd = random.Random(5)
    links = [(c, rnd.randrange(0, 60)) for c in rnd.sample(range(60), 45)]
    check_tree(spark, links)
    check_tree(spark, links, 0)  # hot parents and trees apart
    check_tree(spark, [(2 * i + 1, 2 * i) for i in range(100)])


def test_hierarchy_cases(spark):
    assert Y.hierarchy(spark.createDataFrame([], "child long, parent long")).count() == 0
    check_tree(spark, [(1, 2), (1, 2), (2, 1), (3, 1), (4, 4), (5, 6), (None, 3), (7, None)])
    check_tree(spark, [(i, i + 1) for i in range(60)])  # one long chain
    star = [(i, 0) for i in range(1, 100)] + [(1000 + i, 1) for i in range(20)]
    check_tree(spark, star, 10)  # most rows under one


def test_long_chain_and_giant_tree(spark):
    """Long chains, with an end and into a cycle, and a tree with most of its rows under one."""
    n = 30_000
    ids = spark.range(n)
    chain = ids.select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    ring = chain.select(F.col("child") + 10 * n, F.when(F.col("child") == n - 1, 10 * n + n - 3).otherwise(F.col("parent") + 10 * n))
    star = ids.select(F.col("id") + 20 * n, F.when(F.col("id") % 2 == 0, 30 * n).otherwise(F.col("id") + 20 * n - 1))
    got = Y.hierarchy(chain.union(ring).union(star), 1000).cache()
    assert got.count() == 3 * n
    assert got.where(f"node_id < {n} and not (root_id = {n} and depth = {n} - node_id and n_below = node_id)").count() == 0
    assert got.where(f"node_id >= {10 * n} and node_id < {20 * n} and not (root_id = 0 and depth = -1)").count() == 0
    assert {r["node_id"] for r in got.where("on_cycle").collect()} == {11 * n - 3, 11 * n - 2, 11 * n - 1}
    assert got.where(f"node_id >= {20 * n} and not (root_id = {30 * n} and depth = 1 + node_id % 2 and n_below = 1 - node_id % 2)").count() == 0
    got.unpersist()


# ---- orphans


def test_orphan_keys(spark):
    rnd = random.Random(9)
    parents = sorted(set(range(100, 200)) - {150, 151} | {1 << 16, (1 << 16) - 1, 5 << 40, -3})
    refs = [rnd.randrange(90, 210) for _ in range(300)] + [1 << 16, (1 << 16) + 1, (1 << 16) - 1, 5 << 40, (5 << 40) + 1, -3, -2, None] + [150] * 50
    p = spark.createDataFrame([(k, "x") for k in parents + parents[:5] + [None]], "key long, is_ref string")
    r = spark.createDataFrame([(k, "y") for k in refs], "key long, orphan string")
    assert rows(O.orphan_keys(r, "key", p, "key"), "key") == [(k,) for k in sorted({k for k in refs if k is not None} - set(parents))]
    none = spark.createDataFrame([], "key long")
    assert O.orphan_keys(none, "key", p, "key").count() == 0
    assert O.orphan_keys(r, "key", none, "key").count() == len({k for k in refs if k is not None})


def test_orphan_report(spark):
    p = spark.createDataFrame([(1,), (2,)], "key long")
    r = spark.createDataFrame([(1, "a"), (3, "a"), (3, "a"), (None, "a"), (9, "b")], "k long, period string")
    got = rows(O.report_orphans(r, "k", F.col("period"), p, "key", "t"), "period", "table", "references", "orphans", "orphan_keys")
    assert got == [("a", "t", 3, 2, 1), ("b", "t", 1, 1, 1)]


def test_runs_across_partitions_and_blocks(spark):
    rnd = random.Random(12)
    keys = [k + shift for shift in (-(1 << 16) - 50, (1 << 16) - 50, 0) for k in rnd.sample(range(200), 150)] * 2
    rnd.shuffle(keys)
    p = spark.createDataFrame([(k,) for k in keys], "key long").repartition(7)
    r = spark.createDataFrame([(k, "x") for shift in (-(1 << 16) - 50, (1 << 16) - 50, 0) for k in range(shift - 5, shift + 205)], "key long, n string")
    got = rows(O.match_runs(r, p), "key", "orphan")
    assert got == sorted((row["key"], row["key"] not in set(keys)) for row in r.collect())
    s, e = O.runs_of(__import__("numpy").array([5, 3, 4, 4, 9, (1 << 16) - 1, 1 << 16]))
    assert list(zip(s.tolist(), e.tolist())) == [(3, 5), (9, 9), ((1 << 16) - 1, (1 << 16) - 1), (1 << 16, 1 << 16)]


def test_join_unique_splits_hot_keys(spark):
    left = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 999)], "k string, i long")
    right = spark.createDataFrame([("a", 1), ("k0", 2), ("zz", 3)], "k string, v int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = rows(join_unique(left, right, ["k"], counts, 50), "i", "v")
    assert got == sorted((r["i"], {"a": 1, "k0": 2}.get(r["k"])) for r in left.collect())


def test_text_references(spark):
    parents = spark.createDataFrame([("d", 5, "Go", "go"), ("d", 3, "Go", "go"), ("d", 1, "go!", "go"), ("e", 9, "x", None)], "dict string, id long, text string, normalized string")
    parents = parents.withColumn("row", F.struct("id"))
    refs = spark.createDataFrame([("d", "Go", "go"), ("d", "GO", "go"), ("d", "Go", "go"), ("e", "Go", "go"), ("e", "x", ""), ("d", None, None), ("d", "?", "")], "dict string, target string, norm string")
    got = {(r["dict"], r["target"]): r["row"] and r["row"]["id"] for r in O.resolve_text_references(refs, parents).collect()}
    assert got == {("d", "Go"): 3, ("d", "GO"): 1, ("e", "Go"): None, ("e", "x"): 9, ("d", "?"): None}
