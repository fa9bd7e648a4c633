"""Sidecar settings of dictionaries: ``<stem>.toml`` beside the container, with ``@file`` references."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("name", "description", "container_class", "css", "js", "fts_tokenizer")
SCHEMA = "path string, " + ", ".join(f"{f} string" for f in FIELDS) + ", fts boolean"
# Tokenizers of the text index.
TOKENIZERS = ("unicode61", "trigram")


def resolve(value: str | None, folder: str) -> str | None:
    """Content of ``@file``; a path that leaves the folder resolves to nothing."""
    if value is None or not value.startswith("@"):
        return value
    name = value[1:].strip()
    if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/"):
        return None
    at = os.path.realpath(os.path.join(folder, name))
    if not at.startswith(os.path.realpath(folder) + os.sep) or not os.path.isfile(at):
        return None
    with open(at, encoding="utf-8", errors="replace") as f:
        return f.read()


def load(path: str) -> dict | None:
    """Settings of one container; None where there are none or they cannot be read."""
    at = os.path.splitext(path)[0] + ".toml"
    try:
        with open(at, "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return None
    folder = os.path.dirname(path)
    out: dict = {k: raw.get(k) if isinstance(raw.get(k), str) else None for k in FIELDS}
    out["css"], out["js"] = resolve(out["css"], folder), resolve(out["js"], folder)
    out["fts"] = raw.get("fts") is not False
    if out["fts_tokenizer"] not in TOKENIZERS:
        out["fts_tokenizer"] = TOKENIZERS[0]
    return out


def configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Settings of the containers that have any; a folder of dictionaries is a small, listed set."""
    rows = [(p, *(c[k] for k in FIELDS), c["fts"]) for p in paths if (c := load(p)) is not None]
    return spark.createDataFrame(rows, SCHEMA)
