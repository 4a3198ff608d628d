"""Registered queries of this subpackage and helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word is a run of bytes other than these (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = "[^\\x20\\x09-\\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor reaches."""
    return shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex[:16]}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once, in the shared folder, and read it back.

    Later steps then read the written rows whichever executor is lost.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
