"""Whole scoring passes, the ledger of calls, links in prose, backlog starvation, merges on two keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.contacts import has_link
from ..operators import matching as M
from ..operators import merging

PROFILE = M.Profile(5.0, 3, ("NATION_1", "nation_7"), False, "hybrid", 150000.0, {"en": "C1", "ru": "NATIVE"})
_LANG = [[("Английский", "B2")], [("Английский", "C2"), ("Казахский", "B1"), ("Эльфийский", "A1")], [("Эльфийский", "A1"), ("Русский", "C2"), ("Английский", "c2")], None]


def facts(t):
    """A posting's facts: coverage from its requirements, the rest from its own columns, with gaps everywhere."""
    k = F.col("id")
    r = t("requirement").groupBy(F.col("posting_id").alias("id")).agg((F.sum(F.when(F.col("held"), F.col("weight").cast("double")).otherwise(0.0)) / (F.sum(F.col("weight").cast("double")) + F.avg(F.col("weight").cast("double")))).alias("coverage"))
    kind = "array<struct<name:string,level:string>>"
    lists = [F.lit(None).cast(kind) if x is None else F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("level")) for n, v in x]) for x in _LANG]
    return t("vacancy").join(r, "id", "left").select(
        "id", "coverage", F.when(k % 8 != 0, (k * 37 % 101) / 100.0).alias("similarity"), F.when(k % 9 != 0, (k * 53 % 97) / 97.0).alias("title_similarity"), F.when(k % 6 != 1, F.col("seniority") * 2).alias("min_years"),
        F.when(k % 10 != 3, F.col("seniority")).alias("seniority"), F.when(k % 12 != 5, F.col("city")).alias("city"), "remote", F.col("salary").cast("double").alias("salary"), (k % 13 == 0).alias("closed"),
        F.get(F.array(*lists), (k % 4).cast("int")).alias("languages"),
    )


_FACTS = """WITH r AS (SELECT posting_id, sum(CASE WHEN held THEN w ELSE 0 END) / (sum(w) + avg(w)) AS coverage FROM (SELECT posting_id, held, CAST(weight AS DOUBLE) AS w FROM requirement) GROUP BY posting_id),
    f AS (SELECT id, coverage, CASE WHEN id % 8 <> 0 THEN (id * 37 % 101) / CAST(100 AS DOUBLE) END AS sim, CASE WHEN id % 9 <> 0 THEN (id * 53 % 97) / CAST(97 AS DOUBLE) END AS title, CASE WHEN id % 6 <> 1 THEN seniority * 2 END AS years,
        CASE WHEN id % 10 <> 3 THEN seniority END AS rank, CASE WHEN id % 12 <> 5 THEN city END AS city, remote, CAST(salary AS DOUBLE) AS salary, id % 13 = 0 AS closed, id % 4 AS lang FROM vacancy LEFT JOIN r ON posting_id = id),
    g AS (SELECT *, CASE WHEN years - 5 <= -2 THEN 0.9 WHEN years - 5 <= 0 THEN 1.0 WHEN years - 5 <= 1 THEN 0.8 WHEN years - 5 <= 2 THEN 0.55 WHEN years - 5 <= 4 THEN 0.25 WHEN years IS NOT NULL THEN 0.0 END
            * CASE WHEN rank IS NULL THEN 1.0 ELSE greatest(0.8, 1 - 0.1 * abs(rank - 3)) END AS fit,
        (CASE remote WHEN 'hybrid' THEN 1.0 ELSE 0.5 END + CASE WHEN city IS NULL THEN 0 WHEN near THEN 1.0 ELSE 0.0 END + CASE WHEN salary >= 150000 THEN 1.0 WHEN salary >= 105000 THEN 0.5 ELSE 0.0 END)
            / (1 + CASE WHEN city IS NULL THEN 0 ELSE 1 END + CASE WHEN salary IS NULL THEN 0 ELSE 1 END) AS log
        FROM (SELECT *, coalesce(contains(lower(city), 'nation_1') OR contains(lower(city), 'nation_7') OR contains('nation_1', lower(city)) OR contains('nation_7', lower(city)), FALSE) AS near FROM f)),
    h AS (SELECT *, CASE WHEN closed THEN 'вакансия закрыта для откликов' WHEN lang = 1 THEN 'требуется Казахский' WHEN years - 5 > 4 THEN 'опыт: требуется ' || CAST(years AS VARCHAR) || ', есть 5'
        WHEN city IS NOT NULL AND remote <> 'full' AND NOT near THEN 'локация не совпадает: ' || city END AS reason, CASE lang WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS gaps, coalesce(salary < 105000, FALSE) AS short FROM g)
    """
_LINES = "CASE lang WHEN 1 THEN 'Английский: требуется C2, заявлен C1' WHEN 2 THEN 'язык не распознан: Эльфийский|Английский: требуется C2, заявлен C1' END"


def _bucket(floors):
    return f"CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN score >= {floors[0]} THEN 'apply' WHEN score >= {floors[1]} THEN 'strong' WHEN score >= {floors[2]} THEN 'stretch' ELSE 'skip' END AS bucket"


@query(
    "F46 F43 F45 T12 P25 P26",
    _FACTS + f""", s AS (SELECT *, CAST(round(CAST(100 * (coalesce(title, 0) * 0.7 + coalesce(sim, 0) * 0.3) AS DECIMAL(20,6)), 2) AS DOUBLE) AS score FROM h)
    SELECT id, score, {_bucket(M.TITLE_FLOORS)}, concat_ws('|', {_LINES}, CASE WHEN short THEN 'зарплата ниже минимума более чем на 30%' END) AS flags,
        CASE WHEN reason IS NOT NULL THEN 'отфильтровано: ' || reason WHEN title IS NULL AND sim IS NULL THEN 'нечего сравнивать: ни навыков, ни опыта, ни эмбеддинга'
            ELSE 'считано по: ' || concat_ws(', ', CASE WHEN title IS NOT NULL THEN 'названию' END, CASE WHEN sim IS NOT NULL THEN 'семантике' END) END AS verdict FROM s""",
)
def match_by_title(t):
    s = M.score(facts(t), PROFILE, "title")
    return s.select("id", F.col("score").cast("double").alias("score"), "bucket", F.array_join("flags", "|").alias("flags"), "verdict")


@query(
    "F46 F44 A17",
    _FACTS + f""", s AS (SELECT *, greatest(0, least(100, 100 * (coalesce(coverage, 0) * 0.35 + coalesce(sim, 0) * 0.2 + coalesce(fit, 0) * 0.15 + log * 0.1) / (0.35 + 0.2 + CASE WHEN fit IS NULL THEN 0 ELSE 0.15 END + 0.1) - 8 * gaps - CASE WHEN short THEN 15 ELSE 0 END)) AS x FROM h),
    c AS (SELECT *, CAST(round(CAST(x AS DECIMAL(20,6)), 2) AS DOUBLE) AS score FROM s)
    SELECT id, score, {_bucket(M.FLOORS)}, CAST(CASE WHEN years IS NOT NULL THEN years - 5 END AS DOUBLE) AS gap_years, CAST(round(CAST(fit * 100 AS DECIMAL(20,6)), 2) AS DOUBLE) AS experience, CAST(round(CAST(log * 100 AS DECIMAL(20,6)), 2) AS DOUBLE) AS logistics, CAST(round(CAST(coverage * 100 AS DECIMAL(20,6)), 2) AS DOUBLE) AS skills FROM c""",
)
def match_by_components(t):
    s = M.score(facts(t), PROFILE, "components")
    part = lambda n: F.try_element_at("components", F.lit(n)).cast("double")
    return s.select(
        "id", F.col("score").cast("double").alias("score"), "bucket", F.col("gap_years").cast("double").alias("gap_years"), part("experience_fit").alias("experience"), part("logistics_fit").alias("logistics"), part("skill_coverage_required").alias("skills")
    )


@query(
    "A12 A13",
    """WITH c AS (SELECT kind AS task, CASE turn % 2 WHEN 0 THEN 'api' ELSE 'subscription' END AS accounting, CAST(turn % 3 AS VARCHAR) AS provider, CASE WHEN turn = 6 THEN NULL ELSE 'm' || CAST(turn % 4 AS VARCHAR) END AS model, CASE WHEN turn = 5 THEN NULL ELSE CAST(value AS DOUBLE) END AS cost FROM event)
    SELECT coalesce(accounting, '*') AS accounting, coalesce(provider, '*') AS provider, coalesce(task, '*') AS task, coalesce(model, '*') AS model, count(*) AS calls, round(coalesce(sum(cost), 0), 2) AS cost, bool_or(cost IS NULL) AS unpriced,
        round(CASE WHEN count(cost) = 0 THEN NULL ELSE avg(cost) * 1000 END, 2) AS thousand FROM c GROUP BY GROUPING SETS ((accounting), (provider), (task), (model), (task, accounting)) HAVING NOT (grouping(model) = 0 AND model IS NULL)""",
)
def ledger_slices(t):
    """Five slices of the calls in one aggregate; a slice with a call of unknown cost says so, and what a thousand calls would cost."""
    e = t("event")
    accounting = F.when(F.col("turn") % 2 == 0, "api").otherwise("subscription")
    model = F.when(F.col("turn") != 6, F.concat(F.lit("m"), (F.col("turn") % 4).cast("string")))
    c = e.select(F.col("kind").alias("task"), accounting.alias("accounting"), (F.col("turn") % 3).cast("string").alias("provider"), model.alias("model"), F.when(F.col("turn") != 5, F.col("value").cast("double")).alias("cost"))
    keys = ["accounting", "provider", "task", "model"]
    sets = [[F.col("accounting")], [F.col("provider")], [F.col("task")], [F.col("model")], [F.col("task"), F.col("accounting")]]
    g = c.groupingSets(sets, *keys).agg(
        F.grouping("model").alias("_m"), F.count("*").alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"), F.bool_or(F.col("cost").isNull()).alias("unpriced"), F.round(F.avg("cost") * 1000, 2).alias("thousand")
    )
    g = g.filter("not (_m = 0 and model is null)")
    return g.select(*[F.coalesce(k, F.lit("*")).alias(k) for k in keys], "calls", "cost", "unpriced", "thousand")


_PROSE = [("I write ASP.NET and socket.io", False), ("see socket.io/docs", True), ("asp.net.example.ru is up", True), ("www.x", True), ("почта на сайт.рф", True), ("Node.js, v2.0.com-like", True), ("no address, e.g. none", False), ("", False)]


@query("F15", "SELECT id, link FROM posting JOIN (VALUES " + ", ".join(f"({i}, {str(x).upper()})" for i, (_, x) in enumerate(_PROSE)) + f") v(k, link) ON id % {len(_PROSE)} = k")
def links_in_prose(t):
    texts = F.array(*[F.lit(x) for x, _ in _PROSE])
    return t("posting").select("id", has_link(F.element_at(texts, (F.col("id") % len(_PROSE) + 1).cast("int"))).alias("link"))


@query("R10", """SELECT kind, count(*) FILTER (WHERE turn > 1) AS backlog, count(*) FILTER (WHERE turn = 6) AS never, CASE WHEN count(*) FILTER (WHERE turn > 1) = 0 OR count(*) FILTER (WHERE turn = 6) = 0 THEN 'drained' ELSE 'starved' END AS stop
    FROM event WHERE kind <> 'click' OR turn < 6 GROUP BY kind""")  # fmt: skip
def starved_or_drained(t):
    """A window of rows that need nothing ends a run: starved only where rows without any vector wait behind it."""
    e = t("event").filter("kind <> 'click' or turn < 6")
    g = e.groupBy("kind").agg(F.count_if(F.col("turn") > 1).alias("backlog"), F.count_if(F.col("turn") == 6).alias("never"))
    return g.select("*", F.when((F.col("backlog") == 0) | (F.col("never") == 0), "drained").otherwise("starved").alias("stop"))


@query("U03", "SELECT posting_id AS id FROM provenance WHERE slug = 'feed_1' UNION SELECT posting_id FROM requirement WHERE held")
def ids_of_two_reads(t):
    one = t("provenance").filter("slug = 'feed_1'").select(F.col("posting_id").alias("id"))
    return one.union(t("requirement").filter("held").select("posting_id")).distinct()


@query(
    "K02",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY slug, ext_id ORDER BY seen DESC, posting_id DESC, line DESC) AS rn FROM provenance WHERE line > 3),
    a AS (SELECT *, row_number() OVER (PARTITION BY slug, ext_id ORDER BY seen DESC, posting_id DESC, line DESC) AS rn FROM provenance WHERE line <= 3)
    SELECT coalesce(b.slug, a.slug) AS slug, coalesce(b.ext_id, a.ext_id) AS ext_id, coalesce(b.posting_id, a.posting_id) AS posting_id, CASE WHEN a.slug IS NULL THEN 'created' WHEN b.slug IS NULL THEN 'kept' ELSE 'updated' END AS state
    FROM (SELECT * FROM a WHERE rn = 1) a FULL JOIN (SELECT * FROM b WHERE rn = 1) b ON a.slug = b.slug AND a.ext_id = b.ext_id""",
)
def provenance_merged(t):
    """The second merge of a batch has its own key, by which alone it is deduplicated: a cross-posted job keeps both its sources."""
    p = t("provenance").withColumn("arrival", F.struct("seen", "posting_id", "line"))
    keys = ["slug", "ext_id"]
    one = lambda df: merging.last_in_batch(df, keys, "arrival").select(*keys, "posting_id")
    return merging.merge(one(p.filter("line <= 3")), one(p.filter("line > 3")), keys)


@query(
    "K04",
    """SELECT kind, CAST(day AS VARCHAR) AS day, CAST(count(*) FILTER (WHERE turn < 4) + 2 * count(*) FILTER (WHERE turn >= 4) AS BIGINT) AS used FROM event GROUP BY kind, day""",
)
def quota_incremented(t):
    """Two batches of increments onto the counters of (source, UTC day): the merge adds, whichever day is new."""
    n = lambda cond, by: t("event").filter(cond).groupBy("kind", "day").agg((F.count("*") * by).alias("used"))
    add = {"used": F.coalesce("t_used", F.lit(0)) + F.coalesce("b_used", F.lit(0))}
    return merging.merge(n("turn < 4", 1), n("turn >= 4", 2), ["kind", "day"], add).select("kind", F.col("day").cast("string").alias("day"), F.col("used").cast("long").alias("used"))


@query("J01", "SELECT v.id, CAST(m.score AS DOUBLE) AS score FROM vacancy v LEFT JOIN match m ON m.vacancy_id = v.id AND m.profile_id = 2 WHERE v.is_active")
def list_joins_match(t):
    """The list against one profile's matches: the profile is filtered before the join, so each row meets one match at most."""
    m = t("match").filter("profile_id = 2").select(F.col("vacancy_id").alias("id"), F.col("score").cast("double").alias("score"))
    return t("vacancy").filter("is_active").select("id").join(m, "id", "left")


_STYLES = {"iso": "[0-9]{4}-(?:0[1-9]|1[0-2])", "dotted": "(?:0[1-9]|1[0-2])[.](?:19|20)[0-9]{2}", "slashed": "(?:0[1-9]|1[0-2])/(?:19|20)[0-9]{2}"}


@query(
    "A21",
    """SELECT id, iso, dotted, slashed, CASE id % 4 WHEN 0 THEN TRUE ELSE FALSE END AS mixed
    FROM posting JOIN (VALUES (0, 3, 2, 0), (1, 4, 1, 0), (2, 0, 0, 5), (3, 0, 0, 0)) v(k, iso, dotted, slashed) ON id %
    4 = k""",
)
def date_styles(t):
    """How many dates a document writes in each style; mixed where the second style has two or more."""
    texts = ["2019-01 2020-12 2021-07 01.2019 12.2020", "2019-01 2019-02 2019-03 2019-04 05.2020 13.2020", "01/2019 02/2019 03/2019 04/2019 12/2020", "none"]
    d = t("posting").select("id", F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("id") % 4 + 1).cast("int")).alias("x"))
    n = [F.regexp_count("x", F.lit(p)).alias(s) for s, p in _STYLES.items()]
    d = d.select("id", *n)
    second = F.get(F.sort_array(F.array(*_STYLES), asc=False), F.lit(1))
    return d.withColumn("mixed", second >= 2)
