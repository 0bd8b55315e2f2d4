"""A handle on the core tables, whatever they are read from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import model


class Lake:
    """Core tables by name. Every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame], as_of: str | None = None):
        self.spark, self._load, self._as_of = spark, load, as_of

    @classmethod
    def at(cls, spark: SparkSession, root: str, as_of: str | None = None) -> "Lake":
        """Tables written as ``root/<table>`` Parquet folders."""
        def load(name: str) -> DataFrame:
            return spark.read.schema(model.TABLES[name]).parquet(f"{root}/{name}")
        return cls(spark, load, as_of)

    @classmethod
    def of(cls, spark: SparkSession, as_of: str | None = None, **tables: DataFrame) -> "Lake":
        return cls(spark, tables.__getitem__, as_of)

    def table(self, name: str) -> DataFrame:
        return self._load(name)

    @property
    def as_of(self) -> Column:
        """The day that 'now' means in reports; an argument, never the clock inside a plan."""
        return F.lit(self._as_of).cast("date") if self._as_of else F.current_date()

    @cached_property
    def documents(self) -> DataFrame:
        return self._load("documents")

    @cached_property
    def companies(self) -> DataFrame:
        return self._load("companies")

    @cached_property
    def products(self) -> DataFrame:
        return self._load("products")

    @cached_property
    def invoices(self) -> DataFrame:
        return self._load("invoices")

    @cached_property
    def items(self) -> DataFrame:
        return self._load("invoice_item")

    @cached_property
    def payments(self) -> DataFrame:
        return self._load("payment")

    @cached_property
    def registry(self) -> DataFrame:
        return self._load("gst_companies")
