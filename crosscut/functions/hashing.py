"""Hashes of tables and files that don't depend on the order of rows or columns."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: Any) -> bytes:
    """JSON with sorted keys and no spaces, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def json_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below path, hashed where it is read. A file is one row's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's values by column name; null and the empty string differ."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def table_hash(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """One hash for each group of `by`: SHA-256 over the sorted row hashes. A group is as long as one symbol's history."""
    hashed = df.select(*by, row_hash(df, columns).alias("__row"))
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("__row")), "\n"), 256).alias("data_hash"))


def whole_hash(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """One row with the hash of a table of any size: rows are hashed into buckets first, then the buckets' hashes."""
    hashed = df.select(row_hash(df).alias("__row")).withColumn("bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    parts = hashed.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__row")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("table_hash"))
