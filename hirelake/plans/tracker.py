"""The tracker: letters, results, journals, confirmations, decisions, watermarks, chains, backlogs, vector caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import tracker as R


def text(c: str):
    """A timestamp without its zone as text, as both engines write it."""
    return F.col(c).cast("string").alias(c)


@query(
    "K14",
    """WITH l AS (SELECT DISTINCT user_id + CASE WHEN user_id % 5 = 0 THEN 100000 ELSE 0 END AS vacancy_id FROM event WHERE kind = 'click'),
    o AS (SELECT vacancy_id, arg_min(id, (created_at, id)) AS id FROM application GROUP BY vacancy_id)
    SELECT a.id, a.vacancy_id, CASE WHEN l.vacancy_id IS NOT NULL THEN coalesce(a.profile_id, 7) ELSE a.profile_id END AS profile_id,
        CASE WHEN l.vacancy_id IS NOT NULL THEN 'new letter ' || CAST(a.vacancy_id AS VARCHAR) ELSE a.cover_letter END AS cover_letter,
        CASE WHEN l.vacancy_id IS NOT NULL THEN 'rules:new' ELSE a.rules_version END AS rules_version, FALSE AS created
    FROM application a LEFT JOIN o ON o.id = a.id LEFT JOIN l ON l.vacancy_id = o.vacancy_id
    UNION ALL SELECT -vacancy_id, vacancy_id, 7, 'new letter ' || CAST(vacancy_id AS VARCHAR), 'rules:new', TRUE FROM l WHERE vacancy_id NOT IN (SELECT vacancy_id FROM o)""",
)
def letters_on_oldest_row(t):
    vacancy = F.col("user_id") + F.when(F.col("user_id") % 5 == 0, 100000).otherwise(0)
    letters = t("event").filter("kind = 'click'").select(vacancy.alias("vacancy_id")).distinct()
    letters = letters.withColumn("text", F.concat(F.lit("new letter "), F.col("vacancy_id").cast("string"))).withColumn("profile_id", F.lit(7).cast("long")).withColumn("rules_version", F.lit("rules:new"))
    return R.save_letters(t("application").drop("status", "sent_at"), letters).drop("created_at")


@query(
    "K15 R06",
    """WITH c AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY vacancy_id ORDER BY stamp, id) AS was FROM report WHERE state IS NOT NULL) WHERE was IS NULL OR was <> state),
    s AS (SELECT vacancy_id, last(state ORDER BY stamp, id) AS last_state, CAST(last(stamp ORDER BY stamp, id) AS VARCHAR) AS last_state_at FROM c GROUP BY vacancy_id)
    SELECT r.*, s.last_state, s.last_state_at FROM (SELECT vacancy_id, CASE WHEN bool_or(status = 'sent') THEN 'sent' ELSE last(status ORDER BY stamp, id) END AS agent_status,
        last(reason ORDER BY stamp, id) FILTER (WHERE reason IS NOT NULL) AS reason, last(warning ORDER BY stamp, id) FILTER (WHERE warning IS NOT NULL) AS warning,
        CAST(min(stamp) FILTER (WHERE status = 'sent') AS VARCHAR) AS sent_at, first(letter ORDER BY stamp, id) FILTER (WHERE status = 'sent' AND letter IS NOT NULL) AS sent_letter
        FROM report WHERE id % 7 <> 4 OR id % 3 = 0 GROUP BY vacancy_id) r LEFT JOIN s ON s.vacancy_id = r.vacancy_id""".replace("FROM report WHERE state", "FROM report WHERE (id % 7 <> 4 OR id % 3 = 0) AND state"),
)
def results_folded(t):
    out = R.fold_results(t("report").filter("id % 7 <> 4 or id % 3 = 0"), order=("stamp", "id"))
    return out.select("vacancy_id", "agent_status", "reason", "warning", text("sent_at"), "sent_letter", "last_state", text("last_state_at"))


_LEGAL = ", ".join(f"'{a}>{b}>{w}'" for (a, b), w in R.MOVES.items())
_OK = f"CASE WHEN j.status IS NULL THEN e.status IN ({', '.join(repr(s) for s in R.INITIAL)}) ELSE j.status = e.status OR concat(j.status, '>', e.status, '>', e.actor) IN ({_LEGAL}) END"


@query(
    "K20 R16",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY stamp, id) AS rn FROM report),
    j AS (SELECT DISTINCT vacancy_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS refused FROM report
        UNION ALL SELECT j.vacancy_id, e.rn, CASE WHEN {_OK} THEN e.status ELSE j.status END, CASE WHEN {_OK} THEN coalesce(e.title, j.title) ELSE j.title END,
            CASE WHEN {_OK} THEN e.reason ELSE j.reason END, j.refused + CASE WHEN {_OK} THEN 0 ELSE 1 END FROM j JOIN e ON e.vacancy_id = j.vacancy_id AND e.rn = j.rn + 1)
    SELECT vacancy_id, status, title, reason, refused FROM (SELECT *, max(rn) OVER (PARTITION BY vacancy_id) AS top FROM j) WHERE rn = top""",
)
def journal_upsert(t):
    return R.journal(t("report"), order=("stamp", "id")).select("vacancy_id", "status", "title", "reason", "refused")


@query(
    "A34",
    """SELECT CAST(CAST(stamp AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER
    (WHERE status = 'sent') >= 3 AS capped FROM report WHERE stamp >= TIMESTAMP '2024-01-10 12:00:00'
    GROUP BY 1""",
)
def sent_since(t):
    """Applications sent since a moment, by day, against a daily cap."""
    r = t("report").filter(F.col("stamp") >= F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'"))
    sent = F.count_if(F.col("status") == "sent")
    return r.groupBy(F.to_date("stamp").cast("string").alias("day")).agg(sent.alias("sent"), (sent >= 3).alias("capped"))


@query("A34", "SELECT id, vacancy_id FROM report WHERE status = 'needs_manual' ORDER BY stamp, id LIMIT 100")
def oldest_needing_a_person(t):
    return t("report").filter("status = 'needs_manual'").orderBy("stamp", "id").limit(100).select("id", "vacancy_id")


_CARD = """sha256('{"id":' || CAST(id AS VARCHAR) || ',"letter":' || coalesce('"' || cover_letter || '"', 'null') || ',"status":"' || status || '","vacancy":"Алматы ' || CAST(vacancy_id AS VARCHAR) || '"}')"""
_STORED = "CASE WHEN id % 3 = 1 THEN 'stale' ELSE {} END"


def _card():
    return R.card_digest(vacancy=F.concat(F.lit("Алматы "), F.col("vacancy_id").cast("string")), id=F.col("id"), status=F.col("status"), letter=F.col("cover_letter"))


@query("F12", f"SELECT id, {_CARD} AS digest FROM application")
def card_digests(t):
    return t("application").select("id", _card().alias("digest"))


@query(
    "P29 F11",
    f"""SELECT id, coalesce(created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR, FALSE) AND {_STORED.format(_CARD)} = {_CARD}
        AND sha256(CASE WHEN id % 4 = 2 THEN 'other' ELSE coalesce(cover_letter, '') END) = sha256(coalesce(cover_letter, '')) AS stands FROM application""",
)
def confirmation_stands(t):
    stored = F.when(F.col("id") % 3 == 1, "stale").otherwise(_card())
    letter = R.digest(F.when(F.col("id") % 4 == 2, "other").otherwise(F.col("cover_letter")))
    stands = R.confirmed(F.col("created_at"), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 72, [(stored, _card()), (letter, R.digest(F.col("cover_letter")))])
    return t("application").select("id", stands.alias("stands"))


def _bit(k: int):
    return F.col("id") % k == 0


@query(
    "P36",
    """SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'skip' WHEN id % 11 = 0 THEN 'manual' ELSE 'proceed' END AS queued,
        CASE WHEN id % 13 = 0 THEN 'manual' WHEN id % 17 = 0 OR id % 5 = 0 OR id % 7 = 0 THEN 'skip' WHEN id % 11 = 0 OR id % 19 = 0 OR id % 3 = 0 OR id % 23 = 0 THEN 'manual'
            WHEN id % 2 = 0 AND id % 4 = 0 THEN 'manual' WHEN id % 2 = 0 AND id % 29 = 0 THEN 'manual' ELSE 'proceed' END AS page FROM posting""",
)
def decision_tables(t):
    applied = F.when(_bit(13), F.lit(None).cast("boolean")).otherwise(_bit(17))
    page = R.decide_page(applied, _bit(5), _bit(7), _bit(11), ~_bit(19), _bit(3), _bit(23), _bit(2), ~_bit(4), ~_bit(29))
    return t("posting").select("id", R.decide_queued(_bit(5), _bit(7), _bit(11)).alias("queued"), page.alias("page"))


@query("K21", "SELECT profile_id, count(*) AS n FROM match WHERE profile_id <> 3 GROUP BY profile_id")
def profile_deleted(t):
    """A profile and, by cascade, its matches."""
    gone = t.spark.createDataFrame([(3,)], "profile_id long")
    return t("match").join(F.broadcast(gone), "profile_id", "left_anti").groupBy("profile_id").agg(F.count("*").alias("n"))


@query("A02", """SELECT count(*) FILTER (WHERE status = 'saved') AS saved, count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status IN ('interview', 'offer')) AS alive,
    count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE sent_at IS NOT NULL) AS sent,
    count(*) FILTER (WHERE status = 'saved' AND sent_at IS NULL AND trim(coalesce(cover_letter, '')) <> '') AS ready FROM application""")  # fmt: skip
def tracker_six_counts(t):
    ready = (F.col("status") == "saved") & F.col("sent_at").isNull() & (F.trim(F.coalesce("cover_letter", F.lit(""))) != "")
    n = lambda s: F.count_if(F.col("status").isin(*s.split()))
    return t("application").agg(
        n("saved").alias("saved"), n("applied").alias("applied"), n("interview offer").alias("alive"), n("rejected").alias("rejected"),
        F.count_if(F.col("sent_at").isNotNull()).alias("sent"), F.count_if(ready).alias("ready"),
    )


@query(
    "P24",
    """SELECT id, status = 'saved' AND sent_at IS NULL AND trim(coalesce(cover_letter, '')) <> '' AS queued, sent_at IS NOT NULL OR status IN ('applied', 'interview', 'offer', 'rejected') AS confirmed FROM application""",
)
def tracker_stages(t):
    queued = (F.col("status") == "saved") & F.col("sent_at").isNull() & (F.trim(F.coalesce("cover_letter", F.lit(""))) != "")
    confirmed = F.col("sent_at").isNotNull() | F.col("status").isin("applied", "interview", "offer", "rejected")
    return t("application").select("id", queued.alias("queued"), confirmed.alias("confirmed"))


_SPAN = "SELECT user_id, event_id - turn * 3 AS low, event_id + turn * 4 AS high FROM event WHERE event_id % 3 <> 1"


@query(
    "R04 U07",
    f"""WITH s AS ({_SPAN}), g AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM s),
    i AS (SELECT user_id, min(low) AS low, max(high) AS high FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY user_id, k),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY low DESC) AS n FROM i) WHERE n <= 4)
    SELECT e.user_id, count(*) AS due FROM event e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND e.event_id BETWEEN c.low AND c.high) GROUP BY e.user_id""",
)
def covered_intervals_due(t):
    """What no kept interval covers stays due; of each user's intervals the four newest are kept here, so older ground falls due again."""
    from ..operators.intervals import outside

    spans = t("event").filter("event_id % 3 <> 1").select("user_id", (F.col("event_id") - F.col("turn") * 3).alias("low"), (F.col("event_id") + F.col("turn") * 4).alias("high"))
    kept = R.keep_spans(spans, "user_id", "low", "high", most=4)
    return outside(t("event"), kept, "user_id", "event_id").groupBy("user_id").agg(F.count("*").alias("due"))


_STEPS = ["crawl", "embed", "match", "notify"]


@query(
    "R14",
    """WITH d AS (SELECT user_id, CASE turn % 4 WHEN 0 THEN 'crawl' WHEN 1 THEN 'embed' WHEN 2 THEN 'match' ELSE 'notify' END AS step, ts, kind <> 'error' AS ok FROM event),
    h AS (SELECT DISTINCT user_id, step FROM d WHERE ok AND ts > TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 12 HOUR)
    SELECT u.user_id, coalesce((SELECT v.step FROM (VALUES (1, 'crawl'), (2, 'embed'), (3, 'match'), (4, 'notify')) v(k, step) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.step = v.step) ORDER BY k LIMIT 1), 'done') AS step
    FROM (SELECT DISTINCT user_id FROM d) u""",
)
def chain_resumes_at(t):
    step = F.element_at(F.array(*[F.lit(s) for s in _STEPS]), (F.col("turn") % 4 + 1))
    done = t("event").select("user_id", step.alias("step"), F.col("ts").alias("at"), (F.col("kind") != "error").alias("ok"))
    return R.next_steps(done, _STEPS, "user_id", F.expr("TIMESTAMP_NTZ '2024-01-20 06:00:00'"))


@query(
    "R09",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY turn, event_id) AS n FROM event WHERE turn < 3),
    s AS (SELECT *, sum(value) OVER (PARTITION BY kind ORDER BY turn, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM b WHERE n <= 40),
    k AS (SELECT kind, count(*) FILTER (WHERE spent <= 1500) AS taken, bool_or(spent > 1500) AS dear FROM s GROUP BY kind)
    SELECT k.kind, z.backlog, k.taken, CASE WHEN k.taken = z.backlog THEN 'drained' WHEN k.dear THEN 'time' ELSE 'rows' END AS stop FROM k JOIN (SELECT kind, count(*) AS backlog FROM b GROUP BY kind) z ON z.kind = k.kind""",
)
def backlog_budgeted(t):
    """Forty rows or 1,500 units of cost from each queue, whichever ends first."""
    backlog = t("event").filter("turn < 3").select("kind", "turn", "event_id", "value")
    return R.drain(backlog, "kind", [F.col("turn"), F.col("event_id")], "value", 40, 1500)


@query(
    "K19",
    "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.doc_id % 6 <> 0 AND sha256('m1' || chr(1) || c.text) = sha256('m1' || chr(1) || d.text))",
)
def vectors_to_compute(t):
    """The cache is keyed by sha256 of model and text; a corrupt entry (here every second) is a miss."""
    key = F.sha2(F.concat(F.lit("m1\u0001"), "text"), 256)
    cached = t("documents").filter("doc_id % 3 = 0").select(key.alias("key"), F.when(F.col("doc_id") % 6 != 0, F.array(F.lit(1.0))).alias("vector"))
    whole = cached.filter("vector is not null").select("key").distinct()
    return t("documents").select("doc_id", key.alias("key")).join(whole, "key", "left_anti").select("doc_id")


def _assembled():
    """`Label: a, b` lines of what is there, with the description cut at 4,000 characters."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))
    return F.concat_ws("\n", line("Title", F.col("title")), line("Company", F.col("company")), line("City", F.col("city")), line("Language", F.col("language")), F.substring(F.repeat("company", 300), 1, 4000))


_ASSEMBLED = "concat_ws(chr(10), 'Title: ' || title, 'Company: ' || company, 'City: ' || city, 'Language: ' || language, substr(repeat(company, 300), 1, 4000))"


@query("F10 P19", f"SELECT id, sha256({_ASSEMBLED}) AS hash FROM vacancy WHERE sha256({_ASSEMBLED}) <> CASE WHEN id % 3 = 0 THEN 'stale' ELSE sha256({_ASSEMBLED}) END")
def assembled_text_changed(t):
    v = t("vacancy").withColumn("hash", F.sha2(_assembled(), 256))
    return v.filter(~F.col("hash").eqNullSafe(F.when(F.col("id") % 3 == 0, "stale").otherwise(F.col("hash")))).select("id", "hash")


@query(
    "P17",
    "SELECT id, id % 4 = 0 AS never, id % 4 <> 0 AND (first_seen > published + 2 OR id % 6 = 1) AS stale FROM vacancy WHERE id % 4 = 0 OR first_seen > published + 2 OR id % 6 = 1",
)
def vectors_never_or_stale(t):
    """Never embedded, or touched after the embedding, or without a hash of what was embedded. Unknown dates do not count as later."""
    v = t("vacancy").select("id", (F.col("id") % 4 != 0).alias("embedded"), F.date_add("published", 2).alias("embedded_on"), "first_seen", (F.col("id") % 6 == 1).alias("unhashed"))
    stale = F.col("embedded") & ((F.col("first_seen") > F.col("embedded_on")) | F.col("unhashed"))
    out = v.select("id", (~F.col("embedded")).alias("never"), stale.alias("stale"))
    return out.filter("never or stale")
