"""The ranked list: filters that keep nulls on purpose, keyset pages with a null tail, facets."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListFilter:
    """What a list shows; every field left at None places no condition."""

    include_filtered: bool = False
    score_min: float | None = None
    score_max: float | None = None
    buckets: tuple[str, ...] = ()
    seniorities: tuple[int, ...] = ()
    city: str | None = None
    company: str | None = None
    country: str | None = None
    currency: str | None = None
    remotes: tuple[str, ...] = ()
    include_spam: bool = True
    salary_min: float | None = None
    include_unpriced: bool = True
    has_salary: bool | None = None
    posted_since: date | None = None

    def __post_init__(self):
        if self.score_min is not None and self.score_max is not None and self.score_min > self.score_max:
            raise ValueError("score_min is above score_max")

    def conditions(self) -> list[Column]:
        """Conjuncts in three-valued logic; a row without a bucket is unscored, not filtered."""
        c = [F.col("is_active")]
        if not self.include_filtered:
            c.append(F.col("bucket").isNull() | (F.col("bucket") != "filtered"))
        if self.score_min is not None:
            c.append(F.col("score") >= self.score_min)
        if self.score_max is not None:
            c.append(F.col("score") <= self.score_max)
        if self.buckets:
            c.append(F.col("bucket").isin(*self.buckets))
        if self.seniorities:
            c.append(F.col("seniority").isin(*self.seniorities))
        if self.city is not None:
            c.append(F.col("city").ilike(self.city))
        if self.company is not None:
            c.append(F.col("company").ilike(f"%{self.company}%"))
        if self.country is not None:
            c.append(F.col("country") == self.country)
        if self.currency is not None:
            c.append(F.col("currency") == self.currency)
        if self.remotes:
            c.append(F.col("remote").isin(*self.remotes))
        if not self.include_spam:
            c.append(~F.col("is_spam"))
        if self.salary_min is not None:
            priced = F.col("salary") >= self.salary_min
            c.append(priced | F.col("salary").isNull() if self.include_unpriced else priced)
        if self.has_salary is not None:
            c.append(F.col("salary").isNotNull() if self.has_salary else F.col("salary").isNull())
        if self.posted_since is not None:
            c.append(F.col("published") >= F.lit(self.posted_since))
        return c

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.conditions():
            df = df.filter(c)
        return df


def picker(df: DataFrame, words: str) -> DataFrame:
    """Active rows, no spam, whose title or company holds the words."""
    like = "%" + words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return df.filter("is_active and not is_spam").filter(F.col("title").ilike(like) | F.col("company").ilike(like))


def bucket_of(score: Column, floors: tuple[float, float, float] = (85, 70, 55)) -> Column:
    """apply, strong, stretch or skip by the score's floors; null where there is no score."""
    high, mid, low = floors
    return F.when(score >= high, "apply").when(score >= mid, "strong").when(score >= low, "stretch").when(score.isNotNull(), "skip")


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the sort value (which may be null) and the id."""

    value: object
    id: int

    def encode(self) -> str:
        kind = "null" if self.value is None else type(self.value).__name__
        raw = json.dumps({"id": self.id, "v": None if self.value is None else str(self.value), "k": kind})
        return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor:
        d = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        read = {"null": lambda v: None, "Decimal": Decimal, "date": date.fromisoformat, "int": int, "float": float, "str": str}
        return cls(read[d["k"]](d["v"]), d["id"])


def keyset_order(value: str, id_: str = "id", descending: bool = True) -> list[Column]:
    """Nulls stand last in both directions; the id follows the direction."""
    if descending:
        return [F.col(value).desc_nulls_last(), F.col(id_).desc()]
    return [F.col(value).asc_nulls_last(), F.col(id_).asc()]


def after(cursor: Cursor, value: str, id_: str = "id", descending: bool = True) -> Column:
    """Rows behind the cursor in keyset order."""
    v, i = F.col(value), F.col(id_)
    beyond = i < cursor.id if descending else i > cursor.id
    if cursor.value is None:
        return v.isNull() & beyond
    further = v < F.lit(cursor.value) if descending else v > F.lit(cursor.value)
    return further | ((v == F.lit(cursor.value)) & beyond) | v.isNull()


def page(df: DataFrame, value: str, size: int = 50, cursor: Cursor | None = None, descending: bool = True, id_: str = "id") -> DataFrame:
    """The next page in keyset order: a filter and a TakeOrderedAndProject, never an offset. Sizes are clamped to 1..200."""
    if cursor is not None:
        df = df.filter(after(cursor, value, id_, descending))
    return df.orderBy(*keyset_order(value, id_, descending)).limit(max(1, min(200, size)))


def numbered_pages(df: DataFrame, value: str, size: int, id_: str = "id", buckets: int = 64) -> DataFrame:
    """Every row with the number of the page that a full walk, downwards, would show it on.

    Quantiles of the value, fixed before, cut the order into tiers; a value that is itself a bound, and the missing one,
    are tiers of their own that quantiles of the id cut further, as only the id orders their rows. Tiers are columns of
    each row, so a repeated task finds the same ones; rows are sorted within a tier and the tiers' sizes are summed.
    """
    from pyspark.sql import window as W

    at = F.unix_date(F.col(value)) if df.schema[value].dataType.typeName() == "date" else F.col(value)
    df = df.withColumn("_v", at.cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx("_v", probs, 100 * buckets).alias("v"), F.percentile_approx(id_, probs, 100 * buckets).alias("i")).first()
    bounds = lambda c: F.array(*[F.lit(x) for x in sorted(set(cuts[c] or []))])
    above = lambda c, x: F.size(F.filter(bounds(c), lambda b: b > x)) if cuts[c] else F.lit(0)
    alone = F.array_contains(bounds("v"), F.col("_v")) if cuts["v"] else F.lit(False)
    tier = F.when(F.col("_v").isNull(), 2 * buckets + 2).otherwise(2 * above("v", F.col("_v")) + F.coalesce(alone, F.lit(False)).cast("int"))
    df = df.withColumn("_t", tier).withColumn("_u", F.when((F.col("_t") % 2 == 1) | F.col("_v").isNull(), above("i", F.col(id_))).otherwise(0))
    counts = df.groupBy("_t", "_u").agg(F.count("*").alias("_n"))  # a few thousand rows at most
    ahead = F.sum("_n").over(W.Window.orderBy("_t", "_u").rowsBetween(W.Window.unboundedPreceding, -1))
    before = counts.select("_t", "_u", F.coalesce(ahead, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.Window.partitionBy("_t", "_u").orderBy(*keyset_order(value, id_)))
    placed = df.withColumn("_k", rank).join(F.broadcast(before), ["_t", "_u"])
    return placed.withColumn("page", F.floor((F.col("_before") + F.col("_k") - 1) / size).cast("long")).drop("_t", "_u", "_v", "_k", "_before")
