"""Where bars come from: a protocol, in-memory and file-backed providers. Network providers plug in by the protocol."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import bars_of_payloads, canonical_names
from .files import read_payloads


class BarProvider(Protocol):
    def history(self, provider_symbol: str, canonical_symbol: str, period: str = "2y", interval: str = "1d") -> DataFrame:
        """Raw bar rows of one symbol, under its canonical name."""


class UniverseProvider(Protocol):
    def load(self) -> DataFrame:
        """symbol, provider_symbol, name, sector, industry, source."""


class StaticBarProvider:
    """Histories given as DataFrames by vendor symbol."""

    def __init__(self, data: dict[str, DataFrame]):
        self.data = data

    def history(self, provider_symbol: str, canonical_symbol: str, period: str = "2y", interval: str = "1d") -> DataFrame:
        if provider_symbol not in self.data:
            raise KeyError(provider_symbol)
        return canonical_names(self.data[provider_symbol]).withColumn("symbol", F.lit(canonical_symbol.strip().upper()))


class StaticUniverseProvider:
    FIELDS = "symbol string, provider_symbol string, name string, sector string, industry string, source string"

    def __init__(self, spark: SparkSession, securities: list[tuple]):
        self.spark, self.securities = spark, securities

    def load(self) -> DataFrame:
        return self.spark.createDataFrame(self.securities, self.FIELDS)


class PayloadProvider:
    """Stored vendor payloads, a JSON file for each symbol."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def history(self, provider_symbol: str, canonical_symbol: str, period: str = "2y", interval: str = "1d") -> DataFrame:
        bars = bars_of_payloads(read_payloads(self.spark, f"{self.folder}/{provider_symbol}.json"))
        if bars.isEmpty():
            raise ValueError("empty price history")
        return bars.withColumn("symbol", F.lit(canonical_symbol.strip().upper()))
