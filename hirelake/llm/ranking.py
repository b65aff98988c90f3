"""Gapless ranks and running sums inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def hash32(key: Column) -> Column:
    """A number of 32 bits, from the md5 of the key's text so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def leading(hash32: Column, n_rows: int, per_task: int = 100_000) -> Column:
    """As many leading bits of a 32-bit hash as there are rows to deal: a tier that keeps the order of the hash, whatever the rows number."""
    return F.shiftright(hash32, 32 - min(32, max(4, (n_rows // per_task).bit_length())))


def rank_in(df: DataFrame, group: list[str], tiers: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Rank from 0 of each row within `group`, ordered by the `tiers`, then by `order`.

    Rows are sorted only inside (group, tiers); the ranks of whole tiers are running sums over a table with one row
    for each tier, the last tier summed within the ones before it, so the largest task holds one tier's rows.
    The group and tier columns must not be null.
    """
    counts = df.groupBy(*group, *tiers).agg(F.count("*").alias("_n"))
    prior = F.lit(0)
    for depth in range(len(tiers)):
        keys = [*group, *tiers[:depth]]
        level = counts.groupBy(*keys, tiers[depth]).agg(F.sum("_n").alias("_n"))
        w = W.Window.partitionBy(*keys).orderBy(tiers[depth]).rowsBetween(W.Window.unboundedPreceding, -1)
        level = level.select(*keys, tiers[depth], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_before{depth}"))
        base = level if depth == 0 else base.join(level, keys)
        prior = prior + F.col(f"_before{depth}")
    base = base.select(*group, *tiers, prior.alias("_before"))
    inside = W.Window.partitionBy(*group, *tiers).orderBy(*order)
    return df.join(base, [*group, *tiers]).withColumn(out, (F.col("_before") + F.row_number().over(inside) - 1).cast("long")).drop("_before")
