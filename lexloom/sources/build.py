"""Building indexes of container files: rows and metadata as parquet, only what is stale, with retries, published at once.

An index folder holds ``rows/v=N/`` (one folder per version and dictionary file), ``meta/v=N/`` and ``CURRENT``, a file naming the
version readers see. A build writes a new version beside the old one and then replaces that file, so that readers see all or nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import is_fts_admitted
from lexloom.operators.state import SCHEMA_VERSION, staleness
from lexloom.sources.container import ContainerSource, exists, index_rows, read_text, sizes, write_text

META = "path string, schema_version int, size long, mtime long, has_fts boolean, rows long, error string, attempts int"
# Seconds waited before each attempt after the first.
BACKOFF = (5.0, 20.0)


def current(out: str) -> int | None:
    """The version readers see."""
    return int(read_text(f"{out}/CURRENT")) if exists(f"{out}/CURRENT") else None


def read_meta(spark: SparkSession, out: str) -> DataFrame:
    v = current(out)
    return spark.createDataFrame([], META) if v is None else spark.read.schema(META).parquet(f"{out}/meta/v={v}")


def read_index(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows of the current version, with ``fts`` telling those the text index has; null where nothing was built."""
    v = current(out)
    return None if v is None else spark.read.parquet(f"{out}/rows/v={v}")


def with_retries(files: list[str], attempt: Callable[[list[str]], dict[str, str | None]], wait: Callable[[float], None] = time.sleep) -> dict[str, tuple[str | None, int]]:
    """path -> (error or None, attempts): those that fail are tried again, up to three times, after a while."""
    state: dict[str, tuple[str | None, int]] = {}
    left = list(files)
    for n, pause in enumerate((0.0, *BACKOFF), 1):
        if not left:
            break
        if pause:
            wait(pause)
        got = attempt(left)
        state |= {p: (got.get(p), n) for p in left}
        left = [p for p in left if got.get(p) is not None]
    return state


def build(spark: SparkSession, folder: str, out: str, no_fts: tuple[str, ...] = (), reindex: bool = False, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Brings the index of a folder of containers up to date and returns its metadata.

    Files whose metadata (schema version, size, time) match are kept as they are; removed ones go; files that fail have an error and no
    rows, and the others are built. ``no_fts`` are dictionary files without a text index.
    """
    spark.dataSource.register(ContainerSource)
    scan = spark.createDataFrame(sizes(folder), "path string, size long, mtime long")
    old = read_meta(spark, out)
    state = staleness(scan, old.where("error is null"))
    stale = [r["path"] for r in (state if reindex else state.where("not up_to_date")).select("path").collect()]
    version = (current(out) or 0) + 1

    def attempt(files: list[str]) -> dict[str, str | None]:
        read = spark.read.format("lexicon_container")
        errors: dict[str, str | None] = {}
        for path in files:
            rows = read.load(path).withColumn("file", F.lit(path)).cache()
            bad = rows.where("error is not null").select("error").limit(1).collect()
            errors[path] = bad[0]["error"] if bad else None
            if not bad:
                fts = is_fts_admitted("text") & F.lit(path not in no_fts and not path.lower().endswith(".mdd"))
                built = index_rows(rows).withColumn("fts", F.coalesce(fts, F.lit(False)))
                built.repartitionByRange("normalized", "id").sortWithinPartitions("normalized", "id").write.mode("append").partitionBy("file").parquet(f"{out}/rows/v={version}")
            rows.unpersist()
        return errors

    tried = with_retries(stale, attempt, wait)
    kept = [r["path"] for r in state.where("up_to_date").select("path").collect() if r["path"] not in tried]
    if kept:
        read_index(spark, out).where(F.col("file").isin(kept)).write.mode("append").partitionBy("file").parquet(f"{out}/rows/v={version}")
    empty = not kept and all(e is not None for e, _ in tried.values())
    counts = {} if empty else {r["file"]: r["n"] for r in spark.read.parquet(f"{out}/rows/v={version}").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    tries = spark.createDataFrame([(p, e, n) for p, (e, n) in tried.items()], "path string, error string, attempts int")
    before = old.where(F.col("path").isin(kept)).select("path", F.col("error").alias("e"), F.col("attempts").alias("a"))
    rows = spark.createDataFrame(list(counts.items()), "path string, rows long")
    has = ~F.lower("path").endswith(".mdd") & ~F.col("path").isin(list(no_fts)) if no_fts else ~F.lower("path").endswith(".mdd")
    meta = scan.join(tries, "path", "left").join(before, "path", "left").join(rows, "path", "left").select(
        "path", F.lit(SCHEMA_VERSION).alias("schema_version"), "size", "mtime", (has & F.col("error").isNull()).alias("has_fts"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("error", "e").alias("error"), F.coalesce("attempts", "a").alias("attempts"),
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{out}/meta/v={version}")
    if empty:
        spark.createDataFrame([], index_rows(spark.read.format("lexicon_container").load(folder)).withColumn("fts", F.lit(True)).withColumn("file", F.lit("")).schema).write.mode("overwrite").parquet(f"{out}/rows/v={version}")
    write_text(f"{out}/CURRENT", str(version))
    return read_meta(spark, out)


def status(spark: SparkSession, folder: str, out: str, fts_enabled: dict[str, bool] | None = None) -> DataFrame:
    """path, exists, up_to_date, has_fts, fts_enabled, last_error, attempts of the text dictionaries of a folder."""
    scan = spark.createDataFrame(sizes(folder), "path string, size long, mtime long").where(~F.lower("path").endswith(".mdd"))
    meta = read_meta(spark, out)
    state = staleness(scan, meta.where("error is null"))
    wanted = spark.createDataFrame(list((fts_enabled or {}).items()), "path string, wanted boolean")
    got = state.join(meta.select("path", "has_fts", F.col("error").alias("last_error"), "attempts"), "path", "left").join(wanted, "path", "left")
    none = F.lit(False)
    return got.select("path", "exists", "up_to_date", F.coalesce("has_fts", none).alias("has_fts"), F.coalesce("wanted", F.lit(True)).alias("fts_enabled"), "last_error", F.coalesce("attempts", F.lit(0)).alias("attempts"))
