"""Joins of many rows with one row per key, when a single key may hold any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: Most keys that can each have more than one in HOT of the rows, and the fewest rows a key is split for.
HOT, LEAST = 1000, 10_000


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Left join of ``rows`` with ``unique``, which has one row per key; counts(keys, n) says how many rows each key has.

    A key with more than one in ``HOT`` of all rows (there are at most ``HOT`` such keys, hence they may be broadcast) is joined
    where its rows lie; the others are shuffled, none of them with a large share. Rows with a null key meet nothing and stay where
    they are. Columns besides the keys must have different names on both sides.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = cut(counts.where(F.col("n") > max(least, total // HOT)).select(*keys))
    few = unique.join(F.broadcast(hot), keys, "left_semi")
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    split = flagged.where("_hot").drop("_hot").join(F.broadcast(few), keys, "left")
    moved = flagged.where(F.col("_hot").isNull() & ~blank).drop("_hot").join(unique, keys, "left")
    kinds = {f.name: f.dataType for f in unique.schema if f.name not in keys}
    alone = rows.where(blank).withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
    return split.unionByName(moved).unionByName(alone)
