"""Where dictionaries lie, and plain files beside them."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionary_folder(name: str = "LEXLOOM_DICTIONARIES", environ: dict[str, str] | None = None) -> str:
    """The folder an environment variable names, else ``dict`` beside the program if it is there, else the working folder."""
    environ = os.environ if environ is None else environ
    if environ.get(name):
        return environ[name]
    beside = os.path.join(os.path.dirname(os.path.abspath(sys.argv[0] or ".")), "dict")
    return beside if os.path.isdir(beside) else os.getcwd()


def folder_resources(spark: SparkSession, folder: str, source: str, rank: int) -> DataFrame:
    """source, rank, key, size of the files of a folder and its folders, keyed by their path in it, as resource_query() takes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    root = F.lit("/" + folder.split("://")[-1].strip("/") + "/")
    at = F.instr(F.col("path"), root)
    return files.where(at > 0).select(F.lit(source).alias("source"), F.lit(rank).alias("rank"), F.substring(F.col("path"), at + F.length(root), F.length("path")).alias("key"), "size")
