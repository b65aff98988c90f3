"""Merges, snapshots, versions, quotas, state machines and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..operators import intervals as I
from ..operators import merging as M
from ..operators import picks as P

BATCH = "(SELECT * FROM (SELECT posting_id, slug, ext_id, size, row_number() OVER (PARTITION BY posting_id, slug ORDER BY line DESC, ext_id DESC, size DESC) AS rn FROM provenance WHERE line > 3) WHERE rn = 1)"
TARGET = "(SELECT * FROM (SELECT posting_id, slug, ext_id, size, row_number() OVER (PARTITION BY posting_id, slug ORDER BY line DESC, ext_id DESC, size DESC) AS rn FROM provenance WHERE line <= 4) WHERE rn = 1)"


def sides(t):
    p = t("provenance")
    one = lambda df: P.first_by(df, ["posting_id", "slug"], [F.desc("line"), F.desc("ext_id"), F.desc("size")]).select("posting_id", "slug", "ext_id", "size")
    return one(p.filter("line <= 4")), one(p.filter("line > 3"))


@query(
    "K01 W12",
    f"""SELECT coalesce(b.posting_id, a.posting_id) AS posting_id, coalesce(b.slug, a.slug) AS slug, coalesce(b.ext_id,
    a.ext_id) AS ext_id, coalesce(b.size, a.size) AS size FROM {TARGET} a FULL JOIN {BATCH} b ON a.posting_id =
    b.posting_id AND a.slug = b.slug""",
)
def merge_last_wins(t):
    return M.merge(*sides(t), ["posting_id", "slug"]).drop("state")


@query(
    "K01 F51",
    f"""SELECT coalesce(b.posting_id, a.posting_id) AS posting_id, coalesce(b.slug, a.slug) AS slug, least(a.size, b.size) AS
    size FROM {TARGET} a FULL JOIN {BATCH} b ON a.posting_id = b.posting_id AND a.slug = b.slug""",
)
def merge_least_completeness(t):
    return M.merge(*sides(t), ["posting_id", "slug"], {"size": F.least("t_size", "b_size")}).select("posting_id", "slug", "size")


@query(
    "K01 K03",
    f"""SELECT CASE WHEN a.posting_id IS NULL THEN 'created' WHEN b.posting_id IS NULL THEN 'kept' ELSE 'updated' END AS state,
    count(*) AS n FROM {TARGET} a FULL JOIN {BATCH} b ON a.posting_id = b.posting_id AND a.slug = b.slug
    GROUP BY 1""",
)
def merge_created_updated_counts(t):
    return M.merge(*sides(t), ["posting_id", "slug"]).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "K02",
    """SELECT slug, ext_id, posting_id FROM (SELECT *, row_number() OVER (PARTITION BY slug, ext_id
    ORDER BY seen DESC, posting_id DESC, line DESC) AS rn FROM provenance)
    WHERE rn = 1""",
)
def merge_two_keys(t):
    return P.first_by(t("provenance"), ["slug", "ext_id"], [F.desc("seen"), F.desc("posting_id"), F.desc("line")]).select("slug", "ext_id", "posting_id")


@query(
    "K08 K10",
    """SELECT posting_id, skill, line FROM requirement WHERE posting_id % 4 <> 1
    UNION ALL SELECT posting_id, upper(skill), line FROM requirement WHERE posting_id % 4 = 1 AND held""",
)
def replace_group_snapshot(t):
    r = t("requirement").select("posting_id", "skill", "line", "held")
    group = r.filter("posting_id % 4 = 1")
    new = group.filter("held").select("posting_id", F.upper("skill").alias("skill"), "line")
    return M.replace_groups(r.drop("held"), new, "posting_id", touched=group)


@query("K09 F38", "SELECT id, CAST(CASE seniority WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 3.0 WHEN 4 THEN 6.0 END AS DOUBLE) AS min_years FROM posting")
def grouped_update(t):
    years = F.create_map(*[F.lit(x) for pair in ((1, 0.0), (2, 1.0), (3, 3.0), (4, 6.0)) for x in pair])
    return t("posting").select("id", F.try_element_at(years, F.col("seniority")).alias("min_years"))


@query("K11", "SELECT c_custkey, c_custkey = 42 AS is_active FROM customer")
def one_active_switch(t):
    return t("customer").select("c_custkey", (F.col("c_custkey") == 42).alias("is_active"))


@query(
    "K12 K07",
    """SELECT id, CASE WHEN status = 'P' AND published < DATE '1999-01-01' THEN 'failed' ELSE status END AS status, is_active
    AND NOT coalesce(published < DATE '1996-01-01', FALSE) AS is_active
    FROM posting""",
)
def stale_sweep(t):
    stale = (F.col("status") == "P") & (F.col("published") < F.lit("1999-01-01").cast("date"))
    old = F.coalesce(F.col("published") < F.lit("1996-01-01").cast("date"), F.lit(False))
    return t("posting").select("id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), (F.col("is_active") & ~old).alias("is_active"))


@query(
    "K13 W07 A06",
    """SELECT c.conv_id, c.turn, CAST(row_number() OVER (PARTITION BY c.conv_id
    ORDER BY c.turn, c.role) + coalesce(m.v, 0) AS BIGINT) AS version FROM conversations c
    LEFT JOIN (SELECT conv_id, max(turn) AS v FROM conversations WHERE role = 'user'
    GROUP BY conv_id) m ON c.conv_id = m.conv_id WHERE c.role = 'assistant'""",
)
def version_append(t):
    c = t("conversations").select("conv_id", "turn", "role")
    base = c.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("base"))
    return P.numbered(c.filter("role = 'assistant'").join(base, "conv_id", "left"), ["conv_id"], [F.col("turn"), F.col("role")], "version", "base").select("conv_id", "turn", "version")


@query(
    "K18 K06",
    """SELECT a.c_custkey, CASE WHEN a.c_custkey % 4 = 0 THEN a.c_name ELSE coalesce(b.c_name, a.c_name) END AS c_name, CASE
    WHEN a.c_custkey % 6 = 0 THEN a.c_mktsegment ELSE coalesce(b.c_mktsegment, a.c_mktsegment) END AS c_mktsegment
    FROM customer a LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_name) END AS c_name,
    lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""",
)
def fill_gap_merge(t):
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    old = c.withColumn("c_name_edited", F.col("c_custkey") % 4 == 0).withColumn("c_mktsegment_edited", F.col("c_custkey") % 6 == 0)
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.upper("c_name")).alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return M.fill_gaps(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "R06",
    """SELECT user_id, CAST(max(turn) AS BIGINT) AS rank, min(event_id) FILTER (WHERE turn = top) AS reached_at, count(*)
    FILTER (WHERE turn < prev) AS went_back FROM (SELECT *, max(turn) OVER (PARTITION BY user_id) AS top, max(turn) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM event) GROUP BY user_id""",
)
def fold_results_forward_only(t):
    return M.forward_only(t("event").select("user_id", "event_id", F.col("turn").cast("long").alias("turn")), "user_id", "turn", "event_id")


@query(
    "R15",
    """SELECT user_id, event_id, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) AS was FROM event) WHERE was IS NULL OR was <> kind""",
)
def change_stamp(t):
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("event").withColumn("was", F.lag("kind").over(w)).filter("was is null or was <> kind").select("user_id", "event_id", "kind")


LEGAL = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click"), ("purchase", "view"), ("error", "view")]


@query("R16", "SELECT was, kind, count(*) AS n FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM event) WHERE was IS NOT NULL AND (was || '>' || kind) NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in LEGAL) + ") GROUP BY was, kind")
def state_transitions_illegal(t):
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = t("event").withColumn("was", F.lag("kind").over(w)).filter("was is not null")
    legal = t.spark.createDataFrame(LEGAL, "was string, kind string")  # a fixed list
    return moves.join(F.broadcast(legal), ["was", "kind"], "left_anti").groupBy("was", "kind").agg(F.count("*").alias("n"))


@query("R07 K04 F35", "SELECT kind, CAST(day AS VARCHAR) AS day, count(*) AS used, count(*) >= 60 AS exhausted FROM event GROUP BY kind, day")
def quota_daily(t):
    """The same windowed count that the stream keeps; on a table the watermark plays no part."""
    from ..streaming.ingest import daily_quota

    used = daily_quota(t("event").withColumn("ts", F.col("ts").cast("timestamp")))
    return used.select("kind", F.to_date("window.start").cast("string").alias("day"), "used", (F.col("used") >= 60).alias("exhausted"))


@query("R08 P33", "SELECT user_id, max(ts) + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-28 00:00:00' AS due FROM event GROUP BY user_id")
def cooldown_due(t):
    last = F.max("ts")
    return t("event").groupBy("user_id").agg((last + F.expr("INTERVAL 6 HOURS") <= F.expr("TIMESTAMP_NTZ '2024-01-28 00:00:00'")).alias("due"))


@query(
    "A28",
    """SELECT user_id, CASE WHEN max(day) FILTER (WHERE kind = 'click') IS NULL OR date_diff('day', max(day) FILTER (WHERE kind
    = 'click'), DATE '2024-01-31') > 7 THEN 5 ELSE 15 END AS ceiling FROM event
    GROUP BY user_id""",
)
def batch_ceiling(t):
    last = F.max(F.when(F.col("kind") == "click", F.col("day")))
    quiet = last.isNull() | (F.date_diff(F.lit("2024-01-31").cast("date"), last) > 7)
    return t("event").groupBy("user_id").agg(F.when(quiet, 5).otherwise(15).alias("ceiling"))


@query(
    "P34 R05",
    """SELECT page, avg(known) >= 0.7 AS stop FROM (SELECT CAST(floor(event_id / 50) AS BIGINT) AS page, CASE WHEN event_id % 9
    < 6 OR turn = 3 THEN 1.0 ELSE 0.0 END AS known FROM event) GROUP BY page""",
)
def known_share_stop(t):
    known = ((F.col("event_id") % 9 < 6) | (F.col("turn") == 3)).cast("double")
    return t("event").groupBy(F.floor(F.col("event_id") / 50).cast("long").alias("page")).agg((F.avg(known) >= 0.7).alias("stop"))


@query(
    "J18 J19",
    """SELECT event_id FROM event e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, turn * 1000 AS low, turn * 1000 + 350 AS
    high FROM event WHERE event_id % 10 = 0) s WHERE s.user_id = e.user_id AND e.event_id BETWEEN s.low AND s.high)""",
)
def interval_watermark_due(t):
    e = t("event").select("user_id", "event_id", "turn")
    spans = e.filter("event_id % 10 = 0").select("user_id", (F.col("turn") * 1000).cast("long").alias("low"), (F.col("turn") * 1000 + 350).cast("long").alias("high")).distinct()
    return I.outside(e, spans, "user_id", "event_id").select("event_id")


@query(
    "W10 W05",
    """SELECT user_id, count(*) AS spans, CAST(sum(hi - lo + 1) AS BIGINT) AS covered
    FROM (SELECT user_id, isl, min(low) AS lo, max(high) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY user_id
    ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY
    user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 WHEN max(high) OVER
    (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END
    AS new FROM (SELECT DISTINCT user_id, event_id - turn * 9 AS low, event_id + turn * 11 AS high
    FROM event))) GROUP BY user_id, isl) GROUP BY user_id""",
)
def span_collapse(t):
    spans = t("event").select("user_id", (F.col("event_id") - F.col("turn") * 9).alias("low"), (F.col("event_id") + F.col("turn") * 11).alias("high")).distinct()
    merged = I.islands(spans, ["user_id"], "low", "high")
    return merged.groupBy("user_id").agg(F.count("*").alias("spans"), F.sum(F.col("high") - F.col("low") + 1).cast("long").alias("covered"))


@query(
    "A12 A13",
    """SELECT coalesce(kind, '*') AS kind, coalesce(CAST(turn AS VARCHAR), '*') AS turn, CAST(grouping_id(kind, turn) AS
    BIGINT) AS slice, count(*) AS calls, CAST(sum(value) AS DOUBLE) AS cost, round(CAST(sum(value) AS DOUBLE) / count(*)
    * 100, 4) AS per_hundred FROM event GROUP BY GROUPING SETS ((kind), (turn), (kind, turn), ())""",
)
def ledger_grouping_sets(t):
    e = t("event").select("kind", F.col("turn").cast("string").alias("turn"), "value")
    sets = e.groupingSets([[F.col("kind")], [F.col("turn")], [F.col("kind"), F.col("turn")], []], "kind", "turn").agg(F.grouping_id().cast("long").alias("slice"), F.count("*").alias("calls"), F.sum("value").cast("double").alias("cost"))
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return sets.select(star("kind"), star("turn"), "slice", "calls", "cost", F.round(F.col("cost") / F.col("calls") * 100, 4).alias("per_hundred"))


@query(
    "A11 A35",
    """SELECT n_name AS city, CAST(coalesce(f.found, 0) AS BIGINT) AS found, CAST(coalesce(f.late, 0) AS BIGINT) AS late, CASE
    WHEN f.found IS NULL THEN 'unreached' WHEN f.late > 0 THEN 'partial' ELSE 'success' END AS status
    FROM nation n LEFT JOIN (SELECT user_id % 20 AS k, count(*) AS found, count(*) FILTER (WHERE kind = 'error') AS late
    FROM event GROUP BY 1) f ON n.n_nationkey = f.k""",
)
def run_report(t):
    facts = t("event").groupBy((F.col("user_id") % 20).alias("k")).agg(F.count("*").alias("found"), F.count_if(F.col("kind") == "error").alias("late"))
    n = t("nation").join(facts, F.col("n_nationkey") == F.col("k"), "left")
    status = F.when(F.col("found").isNull(), "unreached").when(F.col("late") > 0, "partial").otherwise("success")
    return n.select(F.col("n_name").alias("city"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("late", F.lit(0)).alias("late"), status.alias("status"))


@query(
    "A29 A26",
    """SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, max(CASE WHEN kind = 'error' THEN event_id END)
    AS last_error, first(CASE WHEN ev.event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END
    ORDER BY ev.event_id) FILTER (WHERE ev.event_id % 3 <> 0) AS first_k
    FROM event ev JOIN (SELECT event_id AS eid, props FROM events) x ON ev.event_id = x.eid
    GROUP BY user_id""",
)
def pool_first_non_null(t):
    """The first payload that states a value decides; every third one is silent."""
    e = t("events")
    k = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k"))
    return e.groupBy("user_id").agg(
        F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"),
        F.min(F.when(k.isNotNull(), F.struct("event_id", k.alias("k")))).getField("k").alias("first_k"),
    )


@query("R12", "SELECT n_name, CAST(floor(1000 * (n_regionkey + 1) / CAST((SELECT sum(n_regionkey + 1) FROM nation) AS DOUBLE)) AS BIGINT) AS budget FROM nation")
def budget_by_weight(t):
    n = t("nation").withColumn("w", F.col("n_regionkey") + 1)
    return n.crossJoin(n.agg(F.sum("w").alias("all"))).select("n_name", F.floor(1000 * F.col("w") / F.col("all")).cast("long").alias("budget"))


@query(
    "R03 K05",
    """SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM event) WHERE rn = 1""",
)
def stream_ingest_merge(t):
    from ..streaming.ingest import latest_by_stream

    return latest_by_stream(t.spark, t("event").select("user_id", "event_id", "kind", "ts")).select("user_id", "event_id", "kind")


@query(
    "R02 R03",
    """WITH last AS (SELECT kind, count(*) AS users FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM event) WHERE rn = 1 GROUP BY kind)
    SELECT e.kind, count(*) AS taken, CAST(sum(e.event_id) AS BIGINT) AS id_sum, coalesce(max(users), 0) AS users, (SELECT count(*) FROM event) AS durable
    FROM event e LEFT JOIN last ON last.kind = e.kind GROUP BY e.kind""",
)
def stream_state_and_ledger(t):
    """What each micro-batch did is written with its rows, under one list: rows taken by kind, beside the users whose last event is of that kind."""
    from ..streaming.ingest import ingested

    by_kind = lambda df: df.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    sink, state = ingested(t.spark, t("event").select("user_id", "event_id", "kind", "ts"), derive=by_kind)
    taken = sink.ledger(t.spark, "kind string, n long, ids long").groupBy("kind").agg(F.sum("n").alias("taken"), F.sum("ids").alias("id_sum"))
    users = state.groupBy("kind").agg(F.count("*").alias("users"))
    durable = F.lit(sink.stands(t.spark, sink.last)["durable"]).cast("long")
    return taken.join(users, "kind", "left").select("kind", "taken", "id_sum", F.coalesce("users", F.lit(0)).alias("users"), durable.alias("durable"))


@query(
    "R01",
    """WITH RECURSIVE e AS (SELECT kind, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS rn FROM event),
    s AS (SELECT kind, event_id, us, rn, us AS opened, CAST(0 AS BIGINT) AS number, 1 AS held, FALSE AS closes FROM e WHERE rn = 1
    UNION ALL SELECT e.kind, e.event_id, e.us, e.rn, CASE WHEN s.closes THEN s.us ELSE s.opened END, s.number + CAST(s.closes AS BIGINT), CASE WHEN s.closes THEN 1 ELSE s.held + 1 END,
    CASE WHEN s.closes THEN 1 ELSE s.held + 1 END >= 50 OR e.us - CASE WHEN s.closes THEN s.us ELSE s.opened END >= 64800000000
    FROM s JOIN e ON e.kind = s.kind AND e.rn = s.rn + 1)
    SELECT kind, number, CASE WHEN max(held) >= 50 THEN 'full' WHEN bool_or(closes) THEN 'stale' ELSE 'end' END AS reason, count(*) AS n, arg_min(event_id, rn) AS first_id,
    arg_max(event_id, rn) AS last_id, CAST(sum(event_id) AS BIGINT) AS id_sum, max(rn) AS durable FROM s GROUP BY kind, number""",
)
def write_batches_by_count_or_age(t):
    """Batches of 50 events a source (here the kind), or of 18 hours, from keyed state and timers."""
    from ..streaming.batching import write_batches

    b = write_batches(t("event").select(F.col("event_id").alias("id"), "ts", "kind"), F.col("kind"), most=50, seconds=64_800)
    return b.select(
        F.col("key").alias("kind"), "number", "reason", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"),
        F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), "durable",
    )
