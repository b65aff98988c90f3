"""Snapshot merges on immutable tables: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .picks import first_by


def last_in_batch(batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Of the batch's rows for a key, the one that arrived last: duplicates go before the merge, not in it."""
    return first_by(batch, keys, [F.col(arrival).desc()])


def merge(target: DataFrame, batch: DataFrame, keys: list[str], refresh: dict[str, Column] | None = None) -> DataFrame:
    """target after the batch: one full outer join on the keys, with `created` telling inserts from updates.

    Both sides must hold a key at most once. A column is the batch's where the batch has the key, else the target's;
    `refresh` replaces that rule for a column by an expression over t_<column> and b_<column>. Merging the same batch
    again changes nothing.
    """
    columns = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns], F.lit(True).alias("_t"))
    b = batch.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = t.join(b, keys, "full_outer")
    rule = lambda c: (refresh or {}).get(c, F.when(F.col("_b"), F.col(f"b_{c}")).otherwise(F.col(f"t_{c}")))
    state = F.when(F.col("_t").isNull(), "created").when(F.col("_b").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *[rule(c).alias(c) for c in columns], state.alias("state"))


def replace_groups(target: DataFrame, rows: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """target with all rows of the touched keys replaced by `rows`; a touched key without new rows loses its old ones."""
    touched = rows.select(key).distinct() if touched is None else touched.select(key).distinct()
    return target.join(touched, key, "left_anti").unionByName(rows)


def fill_gaps(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field keeps a value that a person edited (<field>_edited), else takes the new one where there is one."""
    n = new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields])
    pick = lambda f: F.when(F.col(f"{f}_edited"), F.col(f)).otherwise(F.coalesce(f"n_{f}", f)).alias(f)
    return old.join(n, key, "left").select(key, *[pick(f) for f in fields])


def forward_only(events: DataFrame, key: str, rank: str, at: str) -> DataFrame:
    """The furthest rank each key has reached, when it first got there, and how many of its events tried to go back."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy(key).orderBy(at)
    run = events.withColumn("_top", F.max(rank).over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    back = F.count_if(F.col(rank) < F.col("_top")).alias("went_back")
    reached = F.min(F.struct((-F.col(rank)).alias("r"), F.col(at).alias("a")))
    return run.groupBy(key).agg(reached.alias("_r"), back).select(key, (-F.col("_r.r")).alias("rank"), F.col("_r.a").alias("reached_at"), "went_back")
