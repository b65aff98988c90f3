"""One row per key, in a total order; semi, anti and for-all joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which must end in a unique column."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, base: str | None = None) -> DataFrame:
    """Rows numbered from 1 in each key, on top of `base` where a table already has versions."""
    rn = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(out, rn if base is None else rn + F.coalesce(F.col(base), F.lit(0)))


def for_all(parents: DataFrame, children: DataFrame, on: str, holds: Column) -> DataFrame:
    """Parents none of whose children break the condition; a parent without children passes."""
    return parents.join(children.filter(~holds).select(on).distinct(), on, "left_anti")


def ordered_list(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Comma-joined values of each key in order; sort keys are made to ascend by the caller."""
    items = F.sort_array(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["_v"]), ",").alias(out))


def prefer_left(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """All of left, and the rows of right whose key left lacks."""
    return left.unionByName(right.join(left.select(on), on, "left_anti"))
