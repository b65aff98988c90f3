"""Interval and date arithmetic over periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import intervals as I

PERIOD = "period AS (SELECT company_id, CAST(year(published) * 12 + month(published) AS BIGINT) AS first, CAST(year(published) * 12 + month(published) + seniority * 2 AS BIGINT) AS last FROM posting WHERE published IS NOT NULL)"
ISLANDS = f"""{PERIOD}, flagged AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY company_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM period),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY company_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS isl FROM flagged),
    island AS (SELECT company_id, isl, min(first) AS first, max(last) AS last FROM numbered GROUP BY company_id, isl)"""


def periods(t):
    """Months as one number, so that no day is invented: a period starts when a posting appears and lasts two months a rank."""
    month = (F.year("published") * 12 + F.month("published")).cast("long")
    return t("posting").filter("published is not null").select("company_id", month.alias("first"), (month + F.col("seniority") * 2).alias("last"))


@query(
    "A18 W05 F30 F31 F32",
    f"""WITH {ISLANDS} SELECT company_id, CAST(sum(last - first + 1) AS BIGINT) AS covered, round(CAST(sum(last - first + 1) AS
    DOUBLE) / 12, 1) AS years FROM island GROUP BY company_id""",
)
def interval_union_months(t):
    u = I.union_length(periods(t), ["company_id"], "first", "last")
    return u.withColumn("years", F.round(F.col("covered").cast("double") / 12, 1))


@query(
    "W04",
    f"""WITH {ISLANDS} SELECT company_id, gap_from, first AS gap_to, CAST(first - gap_from - 1 AS BIGINT) AS gap
    FROM (SELECT company_id, first, lag(last) OVER (PARTITION BY company_id
    ORDER BY first) AS gap_from FROM island) WHERE first - gap_from - 1 > 12""",
)
def employment_gaps(t):
    return I.gaps(periods(t), ["company_id"], "first", "last", 12)


@query("F33 F49", f"WITH {PERIOD} SELECT company_id, CAST(max(last) // 12 AS BIGINT) AS last_year, max(last) < 2000 * 12 AS stale FROM period GROUP BY company_id")
def last_used(t):
    return periods(t).groupBy("company_id").agg(F.floor(F.max("last") / 12).cast("long").alias("last_year"), (F.max("last") < 2000 * 12).alias("stale"))


@query(
    "F37",
    """SELECT event_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // 12 AS BIGINT) AS slot, CASE WHEN CAST(ts
    AS TIME) < TIME '09:00:00' THEN CAST(day AS VARCHAR) ELSE CAST(CAST(day + INTERVAL 1 DAY AS DATE) AS VARCHAR) END AS
    next_run FROM event""",
)
def next_run_slots(t):
    early = F.hour("ts") < 9
    slot = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', date_trunc('HOUR', ts))")
    return t("event").select("event_id", F.floor(slot / 12).cast("long").alias("slot"), F.when(early, F.col("day")).otherwise(F.date_add("day", 1)).cast("string").alias("next_run"))


@query("A32", "SELECT kind, round(CAST(median(CAST(value AS DOUBLE)) AS DOUBLE), 6) AS median FROM event GROUP BY kind")
def median_by_kind(t):
    return t("event").groupBy("kind").agg(F.round(F.median(F.col("value").cast("double")), 6).alias("median"))


@query(
    "W06",
    """SELECT user_id, kind, count(*) AS runs, CAST(max(n) AS BIGINT) AS longest
    FROM (SELECT user_id, kind, g, count(*) AS n FROM (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id
    ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS g
    FROM event) GROUP BY user_id, kind, g) GROUP BY user_id, kind""",
)
def kind_runs(t):
    runs = I.runs_of(t("event").select("user_id", "event_id", "kind"), ["user_id"], "event_id", "kind")
    return runs.groupBy("user_id", "kind").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))
