"""Bars and payloads in files, and a catalog of where data sets lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import whole_hash
from ..operators.normalize import canonical_names, require

PAYLOAD = "symbol STRING, empty BOOLEAN, candles ARRAY<STRUCT<datetime: BIGINT, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE>>"


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings as they stand: "NA" is a ticker and "" is empty, not missing."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000").fillna("")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw bar rows with their file; each file must hold one symbol."""
    df = canonical_names(read_text_table(spark, path)).withColumn("file", F.input_file_name())
    require(df, ("timestamp", "symbol"))
    mixed = df.groupBy("file").agg(F.count_distinct(F.upper(F.trim("symbol"))).alias("n")).filter("n <> 1")
    if not mixed.isEmpty():
        raise ValueError("a bar file holds several symbols")
    return df.drop("file")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Nested candle payloads, one JSON document a file."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def read_parquet(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """One scan of a folder of bars or features; with a manifest, of its symbols only."""
    df = spark.read.parquet(path)
    return df if manifest is None else df.join(manifest.select("symbol").distinct(), "symbol", "left_semi")


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a given schema (DDL), read in one pass; a value of another type fails the run."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "errorifexists", kind: str = "parquet") -> str:
    """Write df and return the hash of what was written, read back: of its rows and columns in any order."""
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    reader = df.sparkSession.read.schema(df.schema)
    return whole_hash(reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)).first()["table_hash"]


@dataclass(frozen=True)
class DataSource:
    """Where one provider's bars, references, features and manifest lie."""

    name: str
    root: str

    @property
    def bars(self) -> str:
        return f"{self.root}/bars"

    @property
    def reference(self) -> str:
        return f"{self.root}/reference"

    @property
    def features(self) -> str:
        return f"{self.root}/features"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"


class Catalog:
    def __init__(self, sources: dict[str, str]):
        self._sources = {name: DataSource(name, root.rstrip("/")) for name, root in sources.items()}

    def __getitem__(self, name: str) -> DataSource:
        if name not in self._sources:
            raise ValueError(f"unknown data source {name!r}; known: {', '.join(sorted(self._sources))}")
        return self._sources[name]
