"""Interval arithmetic: islands, unions, gaps, covered spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def islands(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 1) -> DataFrame:
    """Merged intervals of each key: one begins where the start lies more than `slack` beyond every earlier end."""
    w = W.Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", (before.isNull() | (F.col(start) > before + slack)).cast("int"))
    numbered = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Units covered by at least one interval, both ends counted."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).cast("long").alias("covered"))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, longer_than: int) -> DataFrame:
    """Uncovered stretches between a key's merged intervals of more than `longer_than` units."""
    w = W.Window.partitionBy(*keys).orderBy(start)
    g = islands(df, keys, start, end).withColumn("gap_from", F.lag(end).over(w)).withColumn("gap", F.col(start) - F.col("gap_from") - 1)
    return g.filter(F.col("gap") > longer_than).select(*keys, "gap_from", F.col(start).alias("gap_to"), F.col("gap").cast("long").alias("gap"))


def outside(points: DataFrame, spans: DataFrame, key: str, at: str, low: str = "low", high: str = "high", width: int = 64) -> DataFrame:
    """Points that no span of their key covers.

    Spans are cut at multiples of `width` so that the anti join has an equality on (key, cell): a hash join whose
    residual is the range, instead of a nested loop over all spans.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    c = cells.select(F.col(key).alias("_key"), "_cell", F.col(low).alias("_low"), F.col(high).alias("_high"))
    p = points.withColumn("_at", F.floor(F.col(at) / width))
    on = (p[key] == c["_key"]) & (p["_at"] == c["_cell"]) & (p[at] >= c["_low"]) & (p[at] <= c["_high"])
    return p.join(c, on, "left_anti").drop("_at")


def runs_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of one value in each key's order: where each begins and how long it is."""
    w = W.Window.partitionBy(*keys).orderBy(order)
    changed = df.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    run = changed.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run", value).agg(F.min(order).alias("begins"), F.count("*").alias("length")).drop("_run")


def read_until_known(items: DataFrame, known: DataFrame, source: str, page: str, key: str, share: float = 0.7) -> DataFrame:
    """source, pages_read, items_read, first_unread: pages are read in order until one has `share` or more of its items in
    `known` (source, key) already; that page is the last. first_unread is null where a source is read to its end.

    Items meet what is known by a semi-join of distinct keys; then one row a page is left, so a source of any length is
    a few aggregates and no window over its items.
    """
    seen = known.select(source, key).distinct().withColumn("_known", F.lit(True))
    pages = items.join(seen, [source, key], "left").groupBy(source, page).agg(F.count("*").alias("_n"), F.count("_known").alias("_k"))
    last = pages.groupBy(source).agg(F.min(F.when(F.col("_k") >= share * F.col("_n"), F.col(page))).alias("_last"))
    both = pages.join(last, source).withColumn("_read", F.col("_last").isNull() | (F.col(page) <= F.col("_last")))
    return both.groupBy(source).agg(F.count_if("_read").alias("pages_read"), F.coalesce(F.sum(F.when(F.col("_read"), F.col("_n"))), F.lit(0)).alias("items_read"), F.min(F.when(~F.col("_read"), F.col(page))).alias("first_unread"))


def read_feed(items: DataFrame, source: str, page: str, at: str, key: str, wanted: Column, limit: int, most_pages: int = 50) -> DataFrame:
    """source, pages, unique, yielded, stop: a paginated feed read from page 1 until a page is empty, adds no key that was not
    seen before, or brings the wanted postings to `limit`; `pages` counts the page that ended it.

    A key counts where it first stands, which one aggregate finds; what is left is one row a page, at most `most_pages` of a
    source. The page that ends the reading counts whole in `unique`.
    """
    seen = items.filter(F.col(page).between(1, most_pages))
    first = seen.groupBy(source, key).agg(F.min_by(F.struct(F.col(page).alias("_page"), F.coalesce(wanted, F.lit(False)).alias("_yes")), F.struct(page, at)).alias("_f"))
    fresh = first.groupBy(source, F.col("_f._page").alias(page)).agg(F.count("*").alias("_fresh"), F.count_if("_f._yes").alias("_yes"))
    pages = seen.select(source, page).distinct().join(fresh, [source, page], "left").na.fill(0, ["_fresh", "_yes"])
    w = W.Window.partitionBy(source).orderBy(page)
    pages = pages.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("_yes").over(w)).withColumn("_unique", F.sum("_fresh").over(w))
    why = F.when(F.col("_n") != F.col(page), "empty").when(F.col("_fresh") == 0, "nothing new").when(F.col("_sum") >= limit, "limit").when(F.col(page) == most_pages, "pages")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    # a page that is not there is known by the one behind it, or by the end of the feed
    ends = pages.select(source, F.col("_n").alias("_at"), why.alias("_why"), F.when(why == "empty", before("_unique")).otherwise(F.col("_unique")).alias("_u"), F.when(why == "empty", before("_sum")).otherwise(F.col("_sum")).alias("_y"))
    last = ends.groupBy(source).agg(F.min(F.when(F.col("_why").isNotNull(), F.struct("_at", "_why", "_u", "_y"))).alias("_s"), F.max(F.struct("_at", "_u", "_y")).alias("_e"))
    done = F.col("_s").isNull()
    return last.select(
        source, F.when(done, F.col("_e._at") + 1).otherwise(F.col("_s._at")).cast("long").alias("pages"), F.when(done, F.col("_e._u")).otherwise(F.col("_s._u")).alias("unique"),
        F.least(F.lit(limit), F.when(done, F.col("_e._y")).otherwise(F.col("_s._y"))).cast("long").alias("yielded"), F.when(done, "empty").otherwise(F.col("_s._why")).alias("stop"),
    )
