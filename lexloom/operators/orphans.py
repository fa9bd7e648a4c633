"""References to records that do not exist.

1. Within each input partition the parent keys, integers, are sorted and compressed into contiguous runs (start, end): of dense keys
   hardly anything is left to move. References are counted per key and period first, so that a hot key is one row.
2. Runs are cut at blocks of ``1 << BLOCK_BITS`` consecutive integers, and blocks, which no run crosses, are placed whole: ranges of
   keys that know nothing of each other.
3. In a task, runs and references in the order of their keys: each reference is matched as-of to the runs that start at or before
   it, and is an orphan if it lies beyond the end of all of them.

Text keys get integer codes (``resolve_text_references``): 64 bits of a hash of dictionary and word, with 64 more bits to verify a
match. Codes are sparse, so their runs are short and carry the row of the key they stand for; the rest is the same scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
#: Blocks of codes: their highest bits.
CODE_BITS = 44
LOWEST = -(1 << 63)


def runs_of(keys: np.ndarray, bits: int = BLOCK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the contiguous runs of integers, in any order and repeated; none crosses a block."""
    keys = np.unique(keys)
    if not len(keys):
        return keys, keys
    opens = np.ones(len(keys), bool)
    opens[1:] = (keys[1:] != keys[:-1] + 1) | (keys[1:] >> bits != keys[:-1] >> bits)
    at = np.flatnonzero(opens)
    return keys[at], keys[np.append(at[1:], len(keys)) - 1]


def key_runs(keys: DataFrame) -> DataFrame:
    """Runs (start, end) of the keys(key BIGINT) of each partition, by itself; nulls are no keys."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends = [], []
        for b in batches:
            s, e = runs_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts.append(s)
            ends.append(e)
        if starts:
            s, e = np.concatenate(starts), np.concatenate(ends)
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            # runs of different batches that touch or overlap within a block are one
            opens = np.ones(len(s), bool)
            opens[1:] = (s[1:] > e[:-1] + 1) | (s[1:] >> BLOCK_BITS != s[:-1] >> BLOCK_BITS)
            at = np.flatnonzero(opens)
            yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(e[np.append(at[1:], len(s)) - 1])], names=["start", "end"])

    return keys.where("key is not null").mapInArrow(compress, "start long, end long")


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, end (null for references), ... in the order of their keys, runs first: the references, with whether they are orphans."""
    reach = LOWEST
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        is_ref = np.array(b.column(1).is_null())
        end = b.column(1).fill_null(LOWEST).to_numpy(zero_copy_only=False)
        # runs of other partitions may overlap: the furthest end of those that start at or before a key counts
        furthest = np.maximum(np.maximum.accumulate(end), reach) if len(end) else end
        reach = int(furthest[-1]) if len(end) else reach
        mask = pa.array(is_ref)
        rest = [c.filter(mask) for c in b.columns[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(key[is_ref]), *rest, pa.array((key > furthest)[is_ref])], names=["key", *b.schema.names[2:], "orphan"])


def match_runs(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs(key, ...) with ``orphan``: whether no run of parents(key) reaches the key. Null keys are left out."""
    extra = [c for c in refs.columns if c != "key"]
    runs = key_runs(parents).select(F.col("start").alias("key"), "end", *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in extra])
    both = runs.unionByName(refs.where("key is not null").select("key", F.lit(None).cast("long").alias("end"), *extra))
    placed = both.repartition(F.shiftright("key", BLOCK_BITS)).sortWithinPartitions(F.col("key"), F.col("end").desc_nulls_last())
    return placed.mapInArrow(_beyond, refs.select("key", *extra).schema.add("orphan", "boolean"))


def orphan_keys(refs: DataFrame, ref_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Distinct reference keys without a parent: one column ``key`` BIGINT.

    Null references refer to nothing and are not reported; repeated keys on either side count once; an empty parent table
    makes every reference an orphan; other columns and their names do not matter.
    """
    keys = refs.select(F.col(ref_key).cast("long").alias("key")).distinct()
    return match_runs(keys, parents.select(F.col(parent_key).cast("long").alias("key"))).where("orphan").select("key")


def report_orphans(refs: DataFrame, ref_key: str, period: Column, parents: DataFrame, parent_key: str, table: str) -> DataFrame:
    """Orphans per table and period: table, period, references, orphans, orphan_keys. Null references refer to nothing."""
    by_key = refs.groupBy(F.col(ref_key).cast("long").alias("key"), period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    matched = match_runs(by_key, parents.select(F.col(parent_key).cast("long").alias("key")))
    return matched.groupBy("period").agg(
        F.lit(table).alias("table"), F.sum("n").alias("references"),
        F.sum(F.when(F.col("orphan"), F.col("n")).otherwise(0)).alias("orphans"), F.sum(F.when(F.col("orphan"), 1).otherwise(0)).alias("orphan_keys"),
    )


# ---------------------------------------------------------------- text keys

BY_TEXT, BY_NORM = 1, 2


class RowScan:
    """Streaming state of one kind of key: the last run of codes, whose rows are at hand."""

    def __init__(self) -> None:
        self.codes = self.checks = np.zeros(0, np.int64)
        self.rows: pa.RecordBatch | None = None

    def match(self, code: np.ndarray, check: np.ndarray, rows: pa.RecordBatch, parents: np.ndarray, refs: np.ndarray) -> pa.Array:
        """For the references (indices into the batch), the row of the parent with their code: the first there is; null beyond its run."""
        taken = rows.take(pa.array(parents))
        if self.rows is not None:
            taken = pa.Table.from_batches([self.rows, taken]).combine_chunks().to_batches()
            taken = taken[0] if taken else self.rows
        codes, checks = np.concatenate([self.codes, code[parents]]), np.concatenate([self.checks, check[parents]])
        # contiguous runs, each code with its first row
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (checks[1:] != checks[:-1])
        at = np.flatnonzero(first)
        codes, checks, taken = codes[at], checks[at], taken.take(pa.array(at))
        starts, ends = runs_of(codes, 63)
        wanted = code[refs]
        run = np.searchsorted(starts, wanted, side="right") - 1
        inside = np.zeros(len(refs), bool)
        inside[run >= 0] = wanted[run >= 0] <= ends[run[run >= 0]]
        k = np.searchsorted(codes, wanted, side="left")
        # of different words with one code the other bits tell which
        hit = np.full(len(refs), -1)
        for step in range(int(np.max(np.bincount(np.unique(codes, return_inverse=True)[1]), initial=0))):
            j = np.minimum(k + step, max(len(codes) - 1, 0))
            ok = inside & (hit < 0) & (k + step < len(codes)) & (codes[j] == wanted) & (checks[j] == check[refs]) if len(codes) else inside
            hit = np.where(ok, j, hit)
        out = taken.take(pa.array(np.where(hit < 0, None, hit), pa.int64()))
        # what the last code has goes on into the next batch
        keep = np.flatnonzero(codes == codes[-1]) if len(codes) else at
        self.codes, self.checks, self.rows = codes[keep], checks[keep], taken.take(pa.array(keep))
        return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scans = {BY_TEXT: RowScan(), BY_NORM: RowScan()}
    for b in batches:
        if not b.num_rows:
            continue
        code, check, flags = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        is_ref = ~np.array(b.column(4).is_null())
        rows = pa.RecordBatch.from_arrays([b.column(3)], names=["row"])
        for flag, scan in scans.items():
            of = (flags & flag) > 0
            refs = np.flatnonzero(of & is_ref)
            got = scan.match(code, check, rows, np.flatnonzero(of & ~is_ref), refs)
            if len(refs):
                at = pa.array(refs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(4).take(at), b.column(5).take(at), pa.array(np.full(len(refs), flag), pa.int32()), got.column(0)], names=["dict", "target", "kind", "row"]
                )


def resolve_text_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Which record each (dict, target) means.

    refs: dict, target, norm (normalisation of the target); parents: dict, id, text, normalized, and the struct ``row`` whose
    first field is the id. Returns one row per distinct (dict, target): dict, target, ``row`` of the record whose text is the
    target, else of the one whose normalized is ``norm``, lowest id first; ``row`` is null where there is none. Null targets are
    left out; an empty normalisation and a null dict match nothing.
    """
    wanted = refs.where("target is not null").select("dict", "target", "norm").distinct()
    kind = parents.schema["row"].dataType
    whole, norm = F.col("text"), F.when(F.col("normalized") != "", F.col("normalized"))
    keys = lambda a, b: F.array(
        F.when(a.isNotNull(), F.struct(a.alias("word"), F.when(a == b, BY_TEXT | BY_NORM).otherwise(BY_TEXT).alias("flags"))),
        F.when(b.isNotNull() & ~b.eqNullSafe(a), F.struct(b.alias("word"), F.lit(BY_NORM).alias("flags"))),
    )
    nothing = F.lit(None).cast("string")
    sides = parents.where("dict is not null").select("dict", F.explode(F.array_compact(keys(whole, norm))).alias("k"), "row", nothing.alias("d"), nothing.alias("t"))
    asked = F.array_compact(keys(F.col("target"), F.when(F.col("norm") != "", F.col("norm"))))
    sides = sides.unionByName(wanted.where("dict is not null").select("dict", F.explode(asked).alias("k"), F.lit(None).cast(kind).alias("row"), F.col("dict").alias("d"), F.col("target").alias("t")))
    coded = sides.select(F.xxhash64("dict", "k.word").alias("code"), F.xxhash64("k.word", F.lit(1), "dict").alias("check"), F.col("k.flags").alias("flags"), "row", "d", "t")
    # blocks of codes are placed whole; parents come before references, in the order of their ids
    placed = coded.repartition(F.shiftright("code", CODE_BITS)).sortWithinPartitions("code", "check", F.col("t").isNotNull(), "row")
    found = placed.mapInArrow(_resolve, wanted.select("dict", "target").schema.add("kind", "integer").add("row", kind))
    best = found.groupBy("dict", "target").agg(F.min(F.when(F.col("row").isNotNull(), F.struct("kind", "row"))).alias("b")).select("dict", "target", "b.row")
    return best.unionByName(wanted.where("dict is null").select("dict", "target", F.lit(None).cast(kind).alias("row")))
