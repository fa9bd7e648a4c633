"""Parent-child links to full hierarchies.

1. Peel leaves: rows that are nobody's parent go, and then, with jumps of 1, 2, 4, ... links, all rows from which a jump leads
   beyond an end, until no more go. What is left is on cycles or leads into one, and jumps longer than any way into a cycle end on it.
2. Cut the cycles: a row on a cycle becomes the (endless) root of what leads into it. The rest is a forest.
3. Euler tour: every link gives an arc down and an arc up; each arc knows the next one of its tree's tour.
4. Parallel list ranking: every arc stands for a stretch of its list, and takes over the stretch that follows, round after round;
   stretches double. Arcs that have reached the end, and that none looks at any more, leave the rounds.
5. Positions of the two arcs are the entry and exit of a row; depth is the number of open arcs at its entry.
6. Paths: rows in the order of their trees' tours, cut into ranges; each range first gets the rows whose intervals are open where
   it begins, and one sweep with a stack gives every row its path. Nothing is gathered per tree, whatever its size.

Rounds grow with the logarithm of the longest chain or tour, and are alike at every size. Every round is joins and aggregates on
unique ids, or on keys whose hot values are split (by ``join_unique`` or adaptive execution), and is written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import LEAST, join_unique
from lexloom.session import cut

#: Most rows of a path in one result row.
BLOCK = 1024


def cycle_rows(links: DataFrame) -> DataFrame:
    """Rows on a cycle (child BIGINT) of links(child, parent) with one parent each."""
    inner = links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    state = cut(inner.select("child", F.col("parent").alias("jump")))
    span, left, before = 1, state.count(), None
    # a row from which ``span`` links lead on stays; when none goes, none has an end, and ways into cycles are no longer than ``left``
    while left and (left != before or span < left):
        # many rows may jump to the same one: a skewed join with one row a key, which adaptive execution splits
        then = state.select(F.col("child").alias("jump"), F.col("jump").alias("jump2"))
        state = cut(state.join(then, "jump").select("child", F.col("jump2").alias("jump")))
        span, before, left = span * 2, left, state.count()
    return state.select(F.col("jump").alias("child")).distinct()


def euler_arcs(links: DataFrame) -> DataFrame:
    """arc, next, w of the Euler tour of a forest links(child, parent).

    Arc 2k goes down to child k, arc 2k+1 up from it, with k the child id; w is +1 and -1. next is null at the end of a tour.
    Siblings stand in the order of their ids; the first child and the next sibling come from one range-ordered pass
    (no window over a parent's children, of which there may be any number).
    """
    ordered = links.select("parent", "child").repartitionByRange("parent", "child").sortWithinPartitions("parent", "child")
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    # first row of each partition: as many as there are partitions
    heads = ordered.groupBy("part").agg(F.min(F.struct("parent", "child")).alias("head"))
    heads = heads.select((F.col("part")).alias("p"), F.col("head.parent").alias("hp"), F.col("head.child").alias("hc"))
    after = sorted((r["p"], r["hp"], r["hc"]) for r in heads.collect())
    following = {p: (hp, hc) for (p, *_), (_, hp, hc) in zip(after, after[1:])}
    firsts = {(hp, hc) for _, hp, hc in after}
    # a partition's first row opens its parent's children only if the partition before does not hold that parent
    lasts = {r["part"]: r["m"] for r in ordered.groupBy("part").agg(F.max("parent").alias("m")).collect()}
    order = [p for p, *_ in after]
    continued = {p for q, p in zip(order, order[1:]) if lasts[q] == following[q][0]}
    del firsts

    def siblings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        first = True
        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            opens = np.ones(len(rows), bool)
            p = rows["parent"].to_numpy()
            opens[1:] = p[1:] != p[:-1]
            opens[0] = (not (first and int(rows["part"].iloc[0]) in continued)) if held is None else held_opens
            first = False
            nxt = np.full(len(rows), -1, np.int64)
            c = rows["child"].to_numpy()
            nxt[:-1] = np.where(p[1:] == p[:-1], c[1:], -1)
            held, held_opens = rows.iloc[-1:], bool(opens[-1])
            yield pd.DataFrame({"child": c[:-1], "parent": p[:-1], "sibling": nxt[:-1], "opens": opens[:-1]})
        if held is not None:
            hp, hc = following.get(int(held["part"].iloc[0]), (None, None))
            s = hc if hp == int(held["parent"].iloc[0]) else -1
            yield pd.DataFrame({"child": held["child"].to_numpy(), "parent": held["parent"].to_numpy(), "sibling": [s], "opens": [held_opens]})

    rows = cut(ordered.mapInPandas(siblings, "child long, parent long, sibling long, opens boolean"))
    first_child = rows.where("opens").select(F.col("parent").alias("child"), F.col("child").alias("first"))
    is_link = rows.select(F.col("child").alias("parent"), F.lit(True).alias("inner"))
    down = rows.join(first_child, "child", "left").select(
        (F.col("child") * 2).alias("arc"),
        F.coalesce(F.col("first") * 2, F.col("child") * 2 + 1).alias("next"),
        F.lit(1).cast("long").alias("w"),
    )
    # only the last child of a parent goes up; the others go on to their sibling
    last = rows.where("sibling < 0").join(is_link, "parent", "left").select(
        (F.col("child") * 2 + 1).alias("arc"),
        F.when(F.col("inner"), F.col("parent") * 2 + 1).alias("next"),
        F.lit(-1).cast("long").alias("w"),
    )
    rest = rows.where("sibling >= 0").select((F.col("child") * 2 + 1).alias("arc"), (F.col("sibling") * 2).alias("next"), F.lit(-1).cast("long").alias("w"))
    return down.unionByName(rest).unionByName(last)


def rank_lists(arcs: DataFrame) -> DataFrame:
    """List ranking of arcs(arc, next, w): arc, n and w summed from the arc to the end of its list (inclusive), end = last arc.

    An arc stands for the stretch from itself to before ``next``: n and w are the stretch's sums, end its last arc. In a round it
    takes over the stretch that begins there, by a join on unique ids from either side. An arc without a next one is ranked.
    """
    state = cut(arcs.select("arc", "next", "w", F.lit(1).cast("long").alias("n"), F.col("arc").alias("end")))
    ranked: list[DataFrame] = []
    while state.where("next is not null").limit(1).count():
        moving = state.where("next is not null").select("arc", F.col("next").alias("to"), "w", "n")
        after = state.select(F.col("arc").alias("to"), F.col("next").alias("next2"), F.col("w").alias("w2"), F.col("n").alias("n2"), F.col("end").alias("end2"))
        looked, ended = F.col("arc").isNotNull(), F.col("next2").isNull()
        row = lambda arc, nxt, w, n, done: F.struct(arc.alias("arc"), nxt.alias("next"), w.alias("w"), n.alias("n"), F.col("end2").alias("end"), F.lit(done).alias("done"))
        null = F.lit(None).cast("long")
        rows = F.array(
            F.when(looked, row(F.col("arc"), F.col("next2"), F.col("w") + F.col("w2"), F.col("n") + F.col("n2"), False)),
            F.when(ended & looked, row(F.col("to"), null, F.col("w2"), F.col("n2"), False)),
            F.when(ended & ~looked, row(F.col("to"), null, F.col("w2"), F.col("n2"), True)),
        )
        both = cut(moving.join(after, "to", "full").select(F.explode(F.array_compact(rows)).alias("r")).select("r.*"))
        ranked.append(both.where("done").select("arc", "n", "w", "end"))
        state = both.where("not done").drop("done")
    out = state.select("arc", "n", "w", "end")
    for done in ranked:
        out = out.unionByName(done)
    return out


def hierarchy(links: DataFrame, least: int = LEAST) -> DataFrame:
    """Full hierarchy of links(child BIGINT, parent BIGINT), ids from 0.

    One row per distinct child: node_id, parent_id, root_id, depth, entry, exit, n_below, on_cycle, top_id, level. root_id is the
    row at the end (it has no link itself) and depth the number of links to it; rows on a cycle or leading into one have root_id 0
    and depth -1. top_id is the root or else the first row on a cycle, level the number of links to it. entry and exit are positions in
    the tour of the root's tree: u is above v iff they share the root and entry(u) < entry(v) < exit(u). Null ids are no links; of several parents of a child the lowest counts; a row that is its own
    parent is a cycle; an empty table gives no rows.
    """
    links = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    links = cut(links.select(F.col("child").cast("long"), F.col("parent").cast("long")))
    endless = cut(cycle_rows(links)).withColumn("on_cycle", F.lit(True))
    forest = cut(links.join(endless.select("child"), "child", "left_anti"))
    rank = cut(rank_lists(euler_arcs(forest)))
    child, up = F.shiftright("arc", 1), F.pmod("arc", F.lit(2)) == 1
    # both arcs of a row side by side; n counts arcs to the end, so the tour of a tree is as long as its largest n
    both = cut(rank.groupBy(child.alias("child")).agg(
        F.max(F.when(~up, F.col("n"))).alias("down"),
        F.max(F.when(up, F.col("n"))).alias("up"),
        F.max(F.when(~up, F.col("w"))).alias("w"),
        F.max("end").alias("end"),
    ))
    # the tour ends with the arc up from the root's last child
    last = rank.where("arc = end").select(F.col("end"), F.shiftright("end", 1).alias("last"))
    tops = last.join(forest.withColumnRenamed("child", "last"), "last").select("end", F.col("parent").alias("top"))
    tops = tops.join(endless.select(F.col("child").alias("top"), F.lit(True).alias("bad")), "top", "left")
    length = rank.groupBy("end").agg(F.max("n").alias("len"))
    tops = cut(tops.join(length, "end"))
    # a tree may hold any share of the rows
    got = join_unique(both, tops, ["end"], tops.select("end", F.shiftright("len", 1).alias("n")), least).join(forest, "child")
    ok = F.col("bad").isNull()
    trees = got.select(
        F.col("child").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.when(ok, F.col("top")).otherwise(F.lit(0)).cast("long").alias("root_id"),
        # the arc down and all after it sum to 1 - depth
        F.when(ok, 1 - F.col("w")).otherwise(F.lit(-1)).cast("long").alias("depth"),
        (F.col("len") - F.col("down")).alias("entry"),
        (F.col("len") - F.col("up")).alias("exit"),
        F.shiftright(F.col("down") - F.col("up"), 1).cast("long").alias("n_below"),
        F.lit(False).alias("on_cycle"),
        F.col("top").alias("top_id"),
        (1 - F.col("w")).cast("long").alias("level"),
    )
    null = F.lit(None).cast("long")
    cycles = links.join(endless, "child").select(
        F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), F.lit(0).cast("long").alias("root_id"),
        F.lit(-1).cast("long").alias("depth"), null.alias("entry"), null.alias("exit"), null.alias("n_below"), F.lit(True).alias("on_cycle"),
        F.col("child").alias("top_id"), F.lit(0).cast("long").alias("level"),
    )
    return trees.unionByName(cycles)


def cycle_order(cycles: DataFrame) -> DataFrame:
    """child, head, ahead of the rows of cycles(child, parent): the lowest row of its cycle and the number of links to that.

    Doubling: a row knows the lowest of the next 1, 2, 4, ... rows; when no row learns of a lower one, all have seen their cycle.
    """
    own = F.struct(F.col("child").alias("head"), F.lit(0).cast("long").alias("ahead"))
    state = cut(cycles.select("child", F.col("parent").alias("jump"), own.alias("best")))
    span, moved = 1, state.limit(1).count()
    while moved:
        after = F.struct(F.col("best.head").alias("head"), (F.col("best.ahead") + span).alias("ahead"))
        then = state.select(F.col("child").alias("jump"), F.col("jump").alias("jump2"), after.alias("best2"))
        lower = (F.col("best2.head") < F.col("best.head")).alias("lower")
        state = cut(state.join(then, "jump").select("child", F.col("jump2").alias("jump"), F.least("best", "best2").alias("best"), lower))
        moved, span = state.where("lower").limit(1).count(), span * 2
    return state.select("child", "best.head", "best.ahead")


def _sweep_rows(tree: DataFrame) -> DataFrame:
    """top, pos, exit, level, node, n_below, endless: the rows of hierarchy() in the order of their trees' tours.

    What all of a tree leads to stands before it, at negative positions: its root, or once around the cycle, with the tree's own
    row of the cycle last, at -1. Rows at -1 stand for roots and cycle rows themselves.
    """
    inner = tree.where(~F.col("on_cycle"))
    rows = inner.select(F.col("top_id").alias("top"), F.col("entry").alias("pos"), "exit", "level", F.col("node_id").alias("node"), "n_below", (F.col("root_id") == 0).alias("endless"))
    sizes = cut(inner.groupBy(F.col("top_id").alias("top"), (F.col("root_id") == 0).alias("endless")).agg(F.count(F.lit(1)).alias("below")))
    end, zero = F.lit((1 << 63) - 1).alias("exit"), F.lit(0).cast("long")
    roots = sizes.where(~F.col("endless")).select("top", F.lit(-1).cast("long").alias("pos"), end, zero.alias("level"), F.col("top").alias("node"), F.col("below").alias("n_below"), "endless")
    order = cycle_order(tree.where("on_cycle").select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent")))
    order = order.join(sizes.where("endless").select(F.col("top").alias("child"), "below"), "child", "left")
    rings = order.groupBy("head").agg(F.count(F.lit(1)).alias("length"), F.sum(F.coalesce("below", zero) + 1).alias("members"))
    here = order.join(rings, "head").select("head", F.col("child").alias("top"), F.col("ahead").alias("from"), "length", (F.col("members") - 1).alias("n_below"))
    there = order.select("head", F.col("child").alias("node"), "ahead")
    step = F.pmod(F.col("from") - F.col("ahead"), F.col("length"))
    around = here.join(there, "head").select("top", (-1 - step).alias("pos"), end, zero.alias("level"), "node", "n_below", F.lit(True).alias("endless"))
    return rows.unionByName(roots).unionByName(around)


def paths(tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """Paths of all rows of hierarchy() and of their roots: node_id, root_id, depth, n_below, part, path.

    path leads from the row itself to its root, both included; from a row on a cycle or leading into one it ends before a row would
    come again (root_id 0, depth -1). n_below is the number of other rows whose paths hold the row. A path of more than ``block``
    rows comes in parts of so many, part 0 first. Together the paths are as long as the sum of all depths, which is the result's own size.
    """
    rows = cut(_sweep_rows(tree))
    ordered = rows.repartitionByRange("top", "pos").sortWithinPartitions("top", "pos")
    ordered = cut(ordered.withColumn("range", F.spark_partition_id()))
    # first row of each range: as many as there are partitions
    heads = ordered.groupBy("range").agg(F.min(F.struct("top", "pos")).alias("head"))
    heads = heads.select(F.col("range").alias("into"), F.col("head.top").alias("top"), F.col("head.pos").alias("at"))
    at = sorted((r["top"], r["at"], r["into"]) for r in heads.collect())
    tops, places, into = (np.array(c, np.int64) for c in zip(*at)) if at else (np.zeros(0, np.int64),) * 3

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows once for every range that begins within them."""
        for b in batches:
            top, pos, end = (b.column(i).to_numpy() for i in range(3))
            lo, hi = np.searchsorted(tops, top, "left"), np.searchsorted(tops, top, "right")
            first, after = np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
            for t in np.unique(lo[hi > lo]).tolist():  # trees in which ranges begin, as many as there are partitions at most
                rows = np.flatnonzero((lo == t) & (hi > lo))
                inside = places[t : hi[rows[0]]]
                first[rows], after[rows] = t + np.searchsorted(inside, pos[rows], "right"), t + np.searchsorted(inside, end[rows], "left")
            n = np.maximum(after - first, 0)
            rows = np.repeat(np.arange(len(n)), n)
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            taken = [c.take(pa.array(rows)) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(into[which].astype(np.int32))], names=[*b.schema.names, "range"])

    names = ["top", "pos", "exit", "level", "node", "n_below", "endless"]
    carried = ordered.select(*names).mapInArrow(opened, ordered.select(*names).schema.add("range", "integer")).withColumn("carried", F.lit(True))
    both = ordered.withColumn("carried", F.lit(False)).unionByName(carried)
    both = both.repartition("range").sortWithinPartitions("range", "top", "pos").select("range", "top", "pos", "level", "node", "n_below", "endless", "carried")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, base = None, [], 0
        out: list[tuple] = []
        held = 0
        for b in batches:
            for rng, top, pos, level, node, below, endless, old in zip(*(c.to_pylist() for c in b.columns)):
                if (rng, top) != now:
                    now, stack, base = (rng, top), [], 0
                if pos < 0:
                    stack.append(node)
                    base = len(stack)
                else:
                    del stack[base + level - 1 :]
                    stack.append(node)
                if old or pos < -1:
                    continue
                for part, to in enumerate(range(len(stack), 0, -block)):
                    path = stack[max(0, to - block) : to][::-1]
                    out.append((node, 0 if endless else top, -1 if endless else level, below, part, path))
                    held += len(path)
                    if held > 1 << 16:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return both.mapInArrow(sweep, "node_id long, root_id long, depth long, n_below long, part int, path array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    names = ["node_id", "root_id", "depth", "n_below", "part", "path"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def descendants(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """node_id, descendant_id, distance of paths(): a row for each row that leads to another, so that no list has to be held."""
    steps = found.select(F.col("node_id").alias("descendant_id"), "part", F.posexplode("path").alias("at", "node_id"))
    distance = F.col("part").cast("long") * block + F.col("at")
    return steps.select("node_id", "descendant_id", distance.alias("distance")).where("distance > 0")
