"""Smaller rules of profiles, plans, reports and letters, each as columns over a whole table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..operators import merging as M
from ..operators.contacts import has_link


def pick(values: list, key: str = "id", kind: str = "string") -> Column:
    """One of a few literals by a row's key."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def by_hand(columns: str, rows: list[tuple], table: str = "posting") -> str:
    """Oracle SQL of a table of expected values, dealt to the ids in turn."""
    value = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(value, (i, *r))) + ")" for i, r in enumerate(rows))
    named = ", ".join(f"v.{c.strip()}" for c in columns.split(","))
    return f"SELECT id, {named} FROM {table} JOIN (VALUES {body}) v(k, {columns}) ON id % {len(rows)} = k"


# Parameters whose values are secret, and the shortest path segment that may be a key.
SECRET = ("key", "app_key", "apikey", "api_key", "token", "access_token", "secret")


def redacted(url: Column) -> Column:
    """A URL with the values of secret parameters and key-shaped path segments replaced; a segment is key-shaped where it
    has 16 characters or more and no dot, and is all hex but for hyphens or has no separator.
    """
    parts = F.split(url, r"\?", 2)
    key = F.transform(F.split(F.get(parts, F.lit(0)), "/"), lambda s: F.when(s.rlike(r"^[^.]{16,}$") & (s.rlike(r"^-*[0-9A-Fa-f][0-9A-Fa-f-]*$") | ~s.rlike("[-_]")), "***").otherwise(s))
    head = F.concat(F.array_join(F.slice(F.split(F.get(parts, F.lit(0)), "/"), 1, 3), "/"), F.lit("/"), F.array_join(F.slice(key, 4, 1000), "/"))
    pairs = F.transform(F.split(F.get(parts, F.lit(1)), "&"), lambda p: F.when(F.lower(F.substring_index(p, "=", 1)).isin(*SECRET), F.concat(F.substring_index(p, "=", 1), F.lit("=***"))).otherwise(p))
    return F.when(F.size(parts) > 1, F.concat(head, F.lit("?"), F.array_join(pairs, "&"))).otherwise(head)


_URLS = [
    ("https://x.test/api/0123456789abcdef0123/jobs?page=2&Token=abc", "https://x.test/api/***/jobs?page=2&Token=***"),
    ("https://x.test/senior-python-developer-remote-123", "https://x.test/senior-python-developer-remote-123"),
    ("https://x.test/0a1b2c3d-0a1b-2c3d-4e5f-0a1b2c3d4e5f", "https://x.test/***"),
    ("https://x.test/averylongopaquesegment", "https://x.test/***"), ("https://x.test/sitemap.vacancies.0001.xml?api_key=1", "https://x.test/sitemap.vacancies.0001.xml?api_key=***"), ("https://x.test/", "https://x.test/"),
]


@query("F18", by_hand("safe", [(s,) for _, s in _URLS]))
def urls_redacted(t):
    return t("posting").select("id", redacted(pick([u for u, _ in _URLS])).alias("safe"))


# start, end, current -> first and last month (since year 0), as of July 2024; None where the period is not usable
_NOW = 2024 * 12 + 7
_PERIODS = [
    ("2019-03", "2020-05", False, 2019 * 12 + 3, 2020 * 12 + 5), ("2020-01", None, True, 2020 * 12 + 1, _NOW), ("2020-01", None, False, 2020 * 12 + 1, 2020 * 12 + 1), ("2021-06", "2020-01", False, 2021 * 12 + 6, 2021 * 12 + 6),
    ("2023-01", "2031-01", False, 2023 * 12 + 1, _NOW), ("2023-13", "2024-01", False, None, None), (None, "2024-01", False, None, None), ("1800-01", "1801-01", True, None, None), ("May 2020", "2021-01", False, None, None),
]


def month(c: Column) -> Column:
    """Months since year 0 of a strict YYYY-MM between 1900 and 2200; null for anything else."""
    y, m = F.try_to_number(F.regexp_extract(c, r"^([0-9]{4})-([0-9]{2})$", 1), F.lit("9999")), F.try_to_number(F.regexp_extract(c, r"^([0-9]{4})-([0-9]{2})$", 2), F.lit("99"))
    return F.when(m.between(1, 12) & y.between(1900, 2200), (y * 12 + m).cast("int"))


@query("F30 F31", by_hand("first, last", [(a, b) for *_, a, b in _PERIODS]))
def periods_read(t):
    """No end is one month, an inverted period one month, an end to come is today's; an unusable start drops the period."""
    p = t("posting").select("id", month(pick([x[0] for x in _PERIODS])).alias("first"), month(pick([x[1] for x in _PERIODS])).alias("end"), pick([x[2] for x in _PERIODS], kind="boolean").alias("current"))
    end = F.when(F.col("current"), _NOW).otherwise(F.col("end"))
    last = F.when(F.col("first").isNull(), None).when(end.isNull() | (end < F.col("first")), F.col("first")).otherwise(F.least(end, F.lit(_NOW)))
    return p.select("id", "first", last.alias("last"))


# Words of titles.
LEAD = r"(?iu)\b(?:lead|head\s+of|principal|staff|cto|team\s*lead)\b|тимлид|руководител|начальник"
SENIOR, JUNIOR = r"(?iu)\b(?:senior|sr\.?)\b|ведущ|старш", r"(?iu)\b(?:junior|jr\.?|intern|trainee)\b|стажёр|стажер|младш"
_GRADES = [
    (2.0, "Senior Python Developer", "middle", "working"), (7.0, "Программист", "senior", "expert"), (4.0, "Junior QA", "junior", "strong"), (1.0, "Тимлид", "lead", "working"), (9.0, "Старший инженер", "senior", "expert"),
    (0.5, "Стажёр", "junior", "basic"), (0.0, None, None, "basic"), (3.0, "Head of Data", "lead", "strong"), (None, "Developer", None, "working"),
]


@query("F49", by_hand("seniority, level", [(s, x) for *_, s, x in _GRADES]))
def grades_inferred(t):
    """Years set the grade; a title moves it by a step, a leading one decides it. Without anything dated a skill is `working`."""
    d = t("posting").select("id", pick([g[0] for g in _GRADES], kind="double").alias("y"), pick([g[1] for g in _GRADES]).alias("title"))
    y, title = F.col("y"), F.coalesce("title", F.lit(""))
    base = F.when(y >= 6, 2).when(y >= 3, 1).otherwise(0)
    moved = F.when(title.rlike(SENIOR), F.least(base + 1, F.lit(2))).when(title.rlike(JUNIOR), F.greatest(base - 1, F.lit(0))).otherwise(base)
    ladder = F.array(*[F.lit(x) for x in ("junior", "middle", "senior")])
    unknown = y.isNull() | (F.col("title").isNull() & (y <= 0))
    grade = F.when(unknown, None).when(title.rlike(LEAD), "lead").otherwise(F.get(ladder, moved))
    level = F.when(y.isNull(), "working").when(y < 1, "basic").when(y < 3, "working").when(y < 6, "strong").otherwise("expert")
    return d.select("id", grade.alias("seniority"), level.alias("level"))


@query(
    "J15",
    """WITH k AS (SELECT posting_id, lower(replace(skill, ' ', '')) AS k, skill, min(line) AS line FROM requirement GROUP BY ALL), h AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS k FROM part WHERE p_size < 6)
    SELECT posting_id, coalesce(string_agg(skill, ',' ORDER BY line, skill) FILTER (WHERE h.k IS NOT NULL), '') AS matched, coalesce(string_agg(skill, ',' ORDER BY line, skill) FILTER (WHERE h.k IS NULL), '') AS missing,
        (SELECT count(*) FROM h) - count(DISTINCT h.k) AS other FROM k LEFT JOIN h ON h.k = k.k GROUP BY posting_id""",
)
def overlap_in_order(t):
    """The posting's requirements that the profile holds and lacks, each in the employer's order, and how many more it holds."""
    key = lambda c: F.lower(F.regexp_replace(c, " ", ""))
    held = t("part").filter("p_size < 6").select(key("p_name").alias("k")).distinct()
    size = held.agg(F.count("*").alias("all"))  # one row
    need = t("requirement").groupBy("posting_id", key("skill").alias("k"), "skill").agg(F.min("line").alias("line"))
    both = need.join(held.withColumn("has", F.lit(True)), "k", "left").withColumn("item", F.struct("line", "skill"))
    some = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.col("item")))), lambda x: x["skill"]), ",")
    g = both.groupBy("posting_id").agg(some(F.col("has").isNotNull()).alias("matched"), some(F.col("has").isNull()).alias("missing"), F.count_distinct(F.when(F.col("has"), F.col("k"))).alias("n"))
    return g.crossJoin(F.broadcast(size)).select("posting_id", "matched", "missing", (F.col("all") - F.col("n")).alias("other"))


_PLAN = "a AS (SELECT DISTINCT p_type AS g FROM part), i AS (SELECT g, row_number() OVER (ORDER BY g) AS i FROM a), j AS (SELECT n_name AS b, row_number() OVER (ORDER BY n_name) AS j FROM nation)"


@query(
    "J20",
    f"""WITH {_PLAN}, o AS (SELECT g, b, i, j, CASE WHEN j % 5 = 0 THEN 'everywhere' ELSE b END AS place FROM i, j),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, place ORDER BY i + j, i) AS rn FROM o) WHERE rn = 1)
    SELECT g, place, CAST(n AS BIGINT) AS turn FROM (SELECT *, row_number() OVER (ORDER BY i + j, i) AS n FROM u) WHERE n <= 60""",
)
def plan_deduped_then_cut(t):
    """Groups by placements, equals by rank sum; entries that ask for the same are one before the cut to sixty, never after. Both sides are lists of fixed size."""
    a = t("part").select(F.col("p_type").alias("g")).distinct().withColumn("i", F.row_number().over(W.Window.orderBy("g")))
    b = t("nation").select(F.col("n_name").alias("b")).withColumn("j", F.row_number().over(W.Window.orderBy("b")))
    both = a.crossJoin(F.broadcast(b)).withColumn("place", F.when(F.col("j") % 5 == 0, "everywhere").otherwise(F.col("b")))
    unique = both.groupBy("g", "place").agg(F.min(F.struct((F.col("i") + F.col("j")).alias("s"), "i")).alias("at"))
    turn = F.row_number().over(W.Window.orderBy("at"))
    return unique.orderBy("at").limit(60).select("g", "place", turn.cast("long").alias("turn"))


@query("K07", "SELECT o_orderkey AS id, o_orderkey % 17 <> 0 AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'error') AS is_active FROM orders")
def rows_retired(t):
    """Rows that a source stopped returning, by id."""
    gone = t("event").filter("kind = 'error'").select(F.col("event_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    return t("posting").select("id", "is_active").join(gone, "id", "left").select("id", (F.col("is_active") & F.col("gone").isNull()).alias("is_active"))


@query(
    "K10",
    """WITH l AS (SELECT posting_id, skill AS url, line, line % 3 = 0 AS manual FROM requirement), n AS (SELECT posting_id, skill AS url, min(line) AS line FROM requirement WHERE line <= 2 GROUP BY ALL),
    m AS (SELECT posting_id, url, min(line) AS line FROM l WHERE manual GROUP BY ALL)
    SELECT posting_id, url, TRUE AS manual FROM m UNION ALL SELECT posting_id, url, FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.posting_id = n.posting_id AND m.url = n.url)""",
)
def links_replaced(t):
    """The extracted half of a profile's links is replaced; the half that a person made stays, and an address stands once."""
    old = t("requirement").select("posting_id", F.col("skill").alias("url"), (F.col("line") % 3 == 0).alias("manual"))
    kept = old.filter("manual").distinct()
    new = t("requirement").filter("line <= 2").select("posting_id", F.col("skill").alias("url")).distinct()
    return kept.unionByName(new.join(kept.select("posting_id", "url"), ["posting_id", "url"], "left_anti").withColumn("manual", F.lit(False)))


@query(
    "K18 K06",
    """SELECT c.c_custkey, CASE WHEN c.c_custkey % 4 = 0 THEN c.c_name ELSE coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN upper(c.c_name) END, CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_name END, p.c_name) END AS name
    FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey - 1""",
)
def contacts_carried_forward(t):
    """A field that a person edited stays; else what the résumé says, else what was there, else what the previous profile had."""
    c = t("customer").select("c_custkey", "c_name")
    old = c.select("c_custkey", F.when((F.col("c_custkey") % 4 == 0) | (F.col("c_custkey") % 5 != 0), F.col("c_name")).alias("name"), (F.col("c_custkey") % 4 == 0).alias("name_edited"))
    read = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.upper("c_name")).alias("name"))
    filled = M.fill_gaps(old, read, "c_custkey", ["name"])
    before = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("earlier"))
    return filled.join(before, "c_custkey", "left").select("c_custkey", F.coalesce("name", "earlier").alias("name"))


@query(
    "A11 A35 R12",
    """WITH f AS (SELECT user_id % 20 AS k, count(*) AS found, count(*) FILTER (WHERE kind = 'click') AS new, count(*) FILTER (WHERE kind = 'view') AS duplicates, sum(turn) AS skills, count(*) FILTER (WHERE kind = 'error') AS errors FROM event GROUP BY 1)
    SELECT n_name AS city, coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(duplicates, 0) AS duplicates, CAST(coalesce(skills, 0) AS BIGINT) AS skills, CASE WHEN n_nationkey % 7 = 3 THEN 'partial' WHEN coalesce(errors, 0) = 0 THEN 'success' WHEN found > 40 THEN 'partial' ELSE 'failed' END AS status,
        CASE WHEN n_nationkey % 7 = 3 AND n_nationkey % 2 = 1 THEN 'challenge' WHEN found IS NULL THEN 'not reached' ELSE 'done' END AS stop,
        CAST(floor(1000 * (n_regionkey + 1) / CAST(sum(n_regionkey + 1) OVER () AS DOUBLE)) AS BIGINT) AS budget FROM nation LEFT JOIN f ON n_nationkey = k""",
)
def crawl_summary(t):
    """Sums for each planned city, noughts for those not reached; a challenge makes a run partial whatever it found, and changes the stop reason only where it was not overcome."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    facts = t("event").groupBy((F.col("user_id") % 20).alias("k")).agg(F.count("*").alias("found"), n("click").alias("new"), n("view").alias("duplicates"), F.sum("turn").alias("skills"), n("error").alias("errors"))
    cities = t("nation")
    weight = cities.agg(F.sum(F.col("n_regionkey") + 1).alias("all"))  # one row
    c = cities.crossJoin(F.broadcast(weight)).join(facts, F.col("n_nationkey") == F.col("k"), "left")
    challenged = F.col("n_nationkey") % 7 == 3
    status = F.when(challenged, "partial").when(F.coalesce("errors", F.lit(0)) == 0, "success").when(F.col("found") > 40, "partial").otherwise("failed")
    stop = F.when(challenged & (F.col("n_nationkey") % 2 == 1), "challenge").when(F.col("found").isNull(), "not reached").otherwise("done")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.select(F.col("n_name").alias("city"), zero("found"), zero("new"), zero("duplicates"), zero("skills"), status.alias("status"), stop.alias("stop"), F.floor(1000 * (F.col("n_regionkey") + 1) / F.col("all")).cast("long").alias("budget"))


@query(
    "A28",
    """SELECT user_id, CASE WHEN last IS NULL OR last < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY THEN 5 ELSE 15 END AS ceiling, standing, greatest(0, CASE WHEN last IS NULL OR last < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY THEN 5 ELSE 15 END - standing) AS free
    FROM (SELECT user_id, max(CASE WHEN kind = 'purchase' THEN ts END) AS last, count(*) FILTER (WHERE kind = 'click' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOUR) AS standing FROM event GROUP BY user_id)""",
)
def batch_ceilings(t):
    """How many one confirmation may cover: fifteen, five after seven quiet days, less the confirmations that still stand."""
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    g = t("event").groupBy("user_id").agg(F.max(F.when(F.col("kind") == "purchase", F.col("ts"))).alias("last"), F.count_if((F.col("kind") == "click") & (F.col("ts") >= now - F.expr("INTERVAL 72 HOURS"))).alias("standing"))
    most = F.when(F.col("last").isNull() | (F.col("last") < now - F.expr("INTERVAL 7 DAYS")), 5).otherwise(15)
    return g.select("user_id", most.alias("ceiling"), "standing", F.greatest(F.lit(0), most - F.col("standing")).alias("free"))


@query(
    "A25 O12",
    """WITH s AS (SELECT p_brand AS grp, p_name, max(p_size % 4) AS level, max(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END) AS years, bool_or(p_type LIKE 'S%') AS proven FROM part GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level DESC, coalesce(years, 0) DESC, proven DESC, p_name) AS n FROM s)
    SELECT grp, string_agg(p_name, ',' ORDER BY n) AS top, round(CAST(sum(level + 1) * 2 + sum(coalesce(years, 0)) / CAST(10 AS DOUBLE) AS DOUBLE), 2) AS strength FROM r WHERE n <= 3 GROUP BY grp""",
)
def group_strength(t):
    """A group's three best skills (level, years, proof, name) and its strength: twice the levels, with years to break ties."""
    s = t("part").groupBy(F.col("p_brand").alias("grp"), "p_name").agg(F.max(F.col("p_size") % 4).alias("level"), F.max(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("years"), F.bool_or(F.col("p_type").startswith("S")).alias("proven"))
    w = W.Window.partitionBy("grp").orderBy(F.desc("level"), F.coalesce("years", F.lit(0)).desc(), F.desc("proven"), "p_name")
    best = s.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "p_name"))), lambda x: x["p_name"]), ",")
    strength = F.sum(F.col("level") + 1) * 2 + F.sum(F.coalesce("years", F.lit(0))) / 10.0
    return best.groupBy("grp").agg(top.alias("top"), F.round(strength.cast("double"), 2).alias("strength"))


@query(
    "O13",
    """WITH e AS (SELECT user_id, event_id, turn, CAST(value AS DOUBLE) AS sim, ts, CAST(200 + event_id % 700 AS BIGINT) AS n FROM event WHERE kind <> 'error'),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY turn DESC, sim DESC, ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC, sim DESC, ts DESC, event_id) AS rn FROM e)
    SELECT user_id, event_id, rn FROM r WHERE used <= 1500 AND rn <= 5""",
)
def examples_chosen(t):
    """By grade, likeness and recency, five at most, until the first that goes over the budget of characters."""
    e = t("event").filter("kind <> 'error'").withColumn("n", 200 + F.col("event_id") % 700)
    w = W.Window.partitionBy("user_id").orderBy(F.desc("turn"), F.desc("value"), F.desc("ts"), "event_id")
    few = e.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    used = F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    return few.withColumn("used", used).filter("used <= 1500").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


_LETTERS = [
    (None, "empty"), ("  \n ", "empty"), ("short note to www.x", "contains_link,too_short"), ("write to me＠firm " + "word " * 20, "contains_at_sign"), ("fine " * 30, ""), ("I know ASP.NET and socket.io, " + "long " * 60, "too_long"),
]


@query("T08", by_hand("problems", [(p,) for _, p in _LETTERS]))
def letter_problems(t):
    """Everything wrong with a letter in the order one would fix it; an empty one is that and nothing else."""
    c = F.col("x")
    d = t("posting").select("id", pick([x for x, _ in _LETTERS]).alias("x"))
    flags = [(has_link(c), "contains_link"), (c.rlike("[@＠]"), "contains_at_sign"), (F.length(c) > 300, "too_long"), (F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) < 80, "too_short")]
    empty = c.isNull() | ~c.rlike(r"\S")
    return d.select("id", F.when(empty, "empty").otherwise(F.concat_ws(",", *[F.when(x, n) for x, n in flags])).alias("problems"))


@query(
    "P23 P20",
    """SELECT p.id, EXISTS (SELECT 1 FROM provenance s WHERE s.posting_id = p.id AND slug = 'feed_0') AS on_agent, EXISTS (SELECT 1 FROM report r WHERE r.vacancy_id = p.id AND status = 'skipped') AS skipped,
        EXISTS (SELECT 1 FROM provenance s WHERE s.posting_id = p.id) AND NOT EXISTS (SELECT 1 FROM provenance s WHERE s.posting_id = p.id AND NOT regexp_matches(slug, '_[01]$')) AS seed_only FROM posting p""",
)
def channels(t):
    """A posting's channels: on the agent's source, skipped by it, and of seed rows alone (one without any source is not)."""
    p = t("provenance").groupBy(F.col("posting_id").alias("id")).agg(F.bool_or(F.col("slug") == "feed_0").alias("on"), F.bool_and(F.col("slug").rlike("_[01]$")).alias("seed"))
    s = t("report").filter("status = 'skipped'").select(F.col("vacancy_id").alias("id")).distinct().withColumn("sk", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    return t("posting").select("id").join(p, "id", "left").join(s, "id", "left").select("id", no("on").alias("on_agent"), no("sk").alias("skipped"), no("seed").alias("seed_only"))
