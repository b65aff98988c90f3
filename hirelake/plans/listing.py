"""Ranked list, filters, joins, picks, facets and counts."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import listing as L
from ..operators import picks as P

AS_OF = date(2000, 1, 1)
BUCKET = """CASE WHEN id % 13 = 0 THEN 'filtered' WHEN score >= 85 THEN 'apply' WHEN score >= 70 THEN 'strong'
            WHEN score >= 55 THEN 'stretch' WHEN score IS NOT NULL THEN 'skip' END"""
LISTED = f"""listed AS (SELECT p.*, {BUCKET} AS bucket, c.company, c.city, c.segment FROM posting p LEFT JOIN company c ON p.company_id = c.company_id)"""
COLUMNS = ["id", "company", "city", "bucket", "seniority"]
OUT = "id, company, city, bucket, seniority, CAST(score AS DOUBLE) AS score, CAST(salary AS DOUBLE) AS salary, CAST(published AS VARCHAR) AS published"


def scored(t):
    return t("posting").withColumn("bucket", F.when(F.col("id") % 13 == 0, "filtered").otherwise(L.bucket_of(F.col("score"))))


def with_company(t, rows):
    return rows.join(t("company").select("company_id", "company", "city", "segment"), "company_id", "left")


def listed(t):
    """Postings with bucket and company, for filters on the company's columns."""
    return with_company(t, scored(t))


def ranked(t, value: str, cursor=None, descending: bool = True):
    """A page whose filters and order read postings alone: at most 200 rows are cut first and meet their companies after."""
    rows = L.page(L.ListFilter().apply(scored(t)), value, cursor=cursor, descending=descending)
    return out(with_company(t, rows).orderBy(*L.keyset_order(value, descending=descending)))


def out(df):
    return df.select(*COLUMNS, F.col("score").cast("double").alias("score"), F.col("salary").cast("double").alias("salary"), F.col("published").cast("string").alias("published"))


BASE = "is_active AND (bucket IS NULL OR bucket <> 'filtered')"


def sql(where: str = "TRUE", order: str = "", select: str = OUT, base: str = BASE) -> str:
    return f"WITH {LISTED} SELECT {select} FROM listed WHERE {base} AND {where} {order}"


DESC = "ORDER BY score DESC NULLS LAST, id DESC LIMIT 50"


@query("J01 P01 P02 P03 O01 O02", sql(order=DESC))
def ranked_page_first(t):
    return ranked(t, "score")


@query("P16 O01 O03", sql("(score < 60.50 OR (score = 60.50 AND id < 5000) OR score IS NULL)", DESC))
def ranked_page_after_value_cursor(t):
    cursor = L.Cursor.decode(L.Cursor(Decimal("60.50"), 5000).encode())
    return ranked(t, "score", cursor)


@query("P16 O01", sql("score IS NULL AND id < 9000", DESC))
def ranked_page_after_null_cursor(t):
    return ranked(t, "score", L.Cursor(None, 9000))


@query("P16 O01", sql("(salary > 150000.00 OR (salary = 150000.00 AND id > 100) OR salary IS NULL)", "ORDER BY salary ASC NULLS LAST, id ASC LIMIT 50"))
def ranked_page_ascending(t):
    return ranked(t, "salary", L.Cursor(Decimal("150000.00"), 100), descending=False)


@query(
    "O01 O02 O03",
    f"""WITH {LISTED} SELECT id, CAST(floor((row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) - 1) / 50) AS BIGINT)
    AS page FROM listed WHERE {BASE}""",
)
def page_walk_complete(t):
    return L.numbered_pages(L.ListFilter().apply(scored(t)).select("id", "score"), "score", 50).select("id", "page")


@query("J01", "SELECT id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS bucket FROM posting WHERE is_active")
def no_profile_left_join(t):
    return t("posting").filter("is_active").select("id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("bucket"))


@query("P03", sql("score IS NULL"))
def filter_keep_unscored(t):
    return out(L.ListFilter().apply(listed(t)).filter("score is null"))


@query("P04", sql("score >= 40 AND score <= 60"))
def filter_score_range(t):
    return out(L.ListFilter(score_min=40, score_max=60).apply(listed(t)))


@query("P05", sql("bucket IN ('apply', 'strong') AND seniority IN (1, 2)"))
def filter_in_lists(t):
    return out(L.ListFilter(buckets=("apply", "strong"), seniorities=(1, 2)).apply(listed(t)))


@query("P09", sql("(salary >= 300000 OR salary IS NULL)"))
def filter_salary_floor_keep_null(t):
    return out(L.ListFilter(salary_min=300000).apply(listed(t)))


@query("P09", sql("salary >= 300000"))
def filter_salary_floor_priced_only(t):
    return out(L.ListFilter(salary_min=300000, include_unpriced=False).apply(listed(t)))


@query("P10", sql("salary IS NULL"))
def filter_has_salary_tri(t):
    return out(L.ListFilter(has_salary=False).apply(listed(t)))


@query("P11 F36", sql("published >= DATE '1999-12-02'"))
def filter_posted_within(t):
    from datetime import timedelta

    return out(L.ListFilter(posted_since=AS_OF - timedelta(days=30)).apply(listed(t)))


@query("P06 P07", sql("city ILIKE 'nation_1%' AND company ILIKE '%0007%'"))
def filter_ilike_city_company(t):
    return out(L.ListFilter(city="nation_1%", company="0007").apply(listed(t)))


@query(
    "P12 F61",
    """SELECT p.id, CAST(coalesce(m.n, 0) AS BIGINT) AS missing FROM posting p
    LEFT JOIN (SELECT posting_id, count(*) AS n FROM requirement WHERE NOT held
    GROUP BY posting_id) m ON p.id = m.posting_id WHERE p.is_active AND coalesce(m.n, 0) <= 2""",
)
def filter_missing_count(t):
    missing = t("requirement").filter("not held").groupBy(F.col("posting_id").alias("id")).agg(F.count("*").alias("missing"))
    return t("posting").filter("is_active").join(missing, "id", "left").select("id", F.coalesce("missing", F.lit(0)).alias("missing")).filter("missing <= 2")


@query("P13 J04", "SELECT id FROM posting WHERE is_active AND EXISTS (SELECT 1 FROM provenance s WHERE s.posting_id = id AND slug = 'feed_1')")
def semi_listed_on(t):
    source = t("provenance").filter("slug = 'feed_1'").select(F.col("posting_id").alias("id"))
    return t("posting").filter("is_active").join(source, "id", "left_semi").select("id")


@query("P15 J05", "SELECT id FROM posting WHERE is_active AND NOT EXISTS (SELECT 1 FROM event e WHERE e.event_id = id AND kind = 'click')")
def anti_not_applied(t):
    applied = t("event").filter("kind = 'click'").select(F.col("event_id").alias("id"))
    return t("posting").filter("is_active").join(applied, "id", "left_anti").select("id")


@query("J06 P20", "SELECT id FROM posting WHERE NOT EXISTS (SELECT 1 FROM provenance s WHERE s.posting_id = id AND s.size < 10)")
def forall_only_large(t):
    return P.for_all(t("posting"), t("provenance").withColumnRenamed("posting_id", "id"), "id", F.col("size") >= 10).select("id")


@query(
    "P23",
    """SELECT posting_id, bool_or(slug = 'feed_0') AS on_a, bool_or(slug = 'feed_1') AS on_b, NOT bool_or(slug = 'feed_0') AS
    skipped FROM provenance GROUP BY posting_id""",
)
def channel_flags(t):
    on = lambda s: F.bool_or(F.col("slug") == s)
    return t("provenance").groupBy("posting_id").agg(on("feed_0").alias("on_a"), on("feed_1").alias("on_b"), (~on("feed_0")).alias("skipped"))


@query(
    "P30 O08",
    """SELECT id, CAST(CASE WHEN n > 0 THEN score END AS DOUBLE) AS shown FROM (SELECT p.id, p.score, (SELECT count(*)
    FROM requirement r WHERE r.posting_id = p.id) AS n FROM posting p) ORDER BY CASE WHEN n > 0 THEN score END DESC
    NULLS LAST, id DESC LIMIT 100""",
)
def mode_rank_unmeasured_last(t):
    has = t("requirement").groupBy(F.col("posting_id").alias("id")).agg(F.count("*").alias("n"))
    shown = t("posting").join(has, "id", "left").select("id", F.when(F.col("n") > 0, F.col("score")).alias("shown"))
    return L.page(shown, "shown", 100).select("id", F.col("shown").cast("double").alias("shown"))


@query(
    "A01 A05",
    """SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE score IS NOT NULL) AS
    scored, count(*) FILTER (WHERE is_active AND score IS NULL) AS needs
    FROM posting""",
)
def filtered_counts_one_pass(t):
    return t("posting").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count("score").alias("scored"), F.count_if(F.col("is_active") & F.col("score").isNull()).alias("needs"))


@query(
    "P22",
    """SELECT kind, count(*) AS n, count(*) FILTER (WHERE turn = 0) AS queued, count(*) FILTER (WHERE turn > 3 OR value > 50)
    AS acted, count(*) FILTER (WHERE NOT (turn > 3 OR value > 50)) AS waiting
    FROM event GROUP BY kind""",
)
def tracker_counts(t):
    acted = (F.col("turn") > 3) | (F.col("value") > 50)
    return t("event").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("turn") == 0).alias("queued"), F.count_if(acted).alias("acted"), F.count_if(~acted).alias("waiting"))


@query(
    "A03 U01 A09 J11",
    f"""WITH {LISTED}, f AS (SELECT * FROM listed WHERE {BASE}) SELECT 'bucket' AS facet, bucket AS value, count(*) AS n
    FROM f WHERE bucket IS NOT NULL GROUP BY bucket UNION ALL SELECT 'city', city, count(*)
    FROM f WHERE city IS NOT NULL GROUP BY city UNION ALL SELECT 'source', slug, count(DISTINCT id)
    FROM f JOIN provenance s ON s.posting_id = id GROUP BY slug""",
)
def facets_union_all(t):
    """One join and one aggregate: a posting's distinct sources are found first, and each of its values becomes a row."""
    slugs = t("provenance").groupBy(F.col("posting_id").alias("id")).agg(F.collect_set("slug").alias("slugs"))
    f = L.ListFilter().apply(listed(t)).select("id", "bucket", "city").join(slugs, "id", "left")
    one = lambda facet, c: F.struct(F.lit(facet).alias("facet"), c.alias("value"))
    own = F.array(one("bucket", F.col("bucket")), one("city", F.col("city")))
    every = F.concat(own, F.transform(F.coalesce("slugs", F.array().cast("array<string>")), lambda s: one("source", s)))
    return f.select(F.inline(every)).filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query(
    "A04 J10 F62",
    """SELECT skill, count(*) AS n FROM requirement r JOIN posting p ON r.posting_id = p.id
    WHERE NOT held AND score >= 55 GROUP BY skill ORDER BY n DESC, skill LIMIT 20""",
)
def skill_gap_top20(t):
    good = t("posting").filter("score >= 55").select(F.col("id").alias("posting_id"))
    missing = t("requirement").filter("not held").join(good, "posting_id", "left_semi")
    return missing.groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(20)


@query(
    "W01 J25",
    """SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM event) WHERE rn = 1""",
)
def latest_event_per_key(t):
    last = F.max(F.struct("ts", "event_id", "kind"))
    return t("event").groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.kind")


@query(
    "W03",
    """SELECT kind, max(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY kind
    ORDER BY ts DESC) AS r FROM event WHERE turn IN (1, 2)) WHERE r = 1
    GROUP BY kind""",
)
def last_success_per_key(t):
    return P.first_by(t("event").filter(F.col("turn").isin(1, 2)), ["kind"], [F.desc("ts"), F.desc("event_id")]).select("kind", "event_id")


@query(
    "W02 J07",
    """SELECT posting_id, slug, ext_id FROM (SELECT *, row_number() OVER (PARTITION BY posting_id
    ORDER BY size DESC, slug, ext_id, line) AS rn FROM provenance) WHERE rn = 1""",
)
def first_source_pick(t):
    return P.first_by(t("provenance"), ["posting_id"], [F.desc("size"), "slug", "ext_id", "line"]).select("posting_id", "slug", "ext_id")


@query(
    "W02 W09",
    """SELECT company_id, id AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY company_id
    ORDER BY published ASC NULLS LAST, id) AS rn FROM posting) WHERE rn = 1""",
)
def oldest_row_pick(t):
    return P.first_by(t("posting"), ["company_id"], [F.col("published").asc_nulls_last(), F.col("id")]).select("company_id", F.col("id").alias("oldest"))


@query("A07", "SELECT posting_id, string_agg(slug, ',' ORDER BY size DESC, slug, ext_id, line) AS slugs FROM provenance GROUP BY posting_id")
def ordered_source_list(t):
    order = [-F.col("size"), F.col("slug"), F.col("ext_id"), F.col("line")]
    return P.ordered_list(t("provenance"), ["posting_id"], order, "slug", "slugs")


@query(
    "J08",
    """SELECT p.id, CAST(coalesce(sum(CASE WHEN slug = 'feed_0' THEN 1 END), 0) AS BIGINT) AS cv_count, CAST(coalesce(sum(CASE
    WHEN slug = 'feed_1' THEN 1 END), 0) AS BIGINT) AS letter_count FROM posting p
    LEFT JOIN provenance s ON s.posting_id = p.id WHERE p.is_active GROUP BY p.id""",
)
def document_candidates_counts(t):
    counts = t("provenance").groupBy(F.col("posting_id").alias("id")).pivot("slug", ["feed_0", "feed_1"]).count()
    n = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return t("posting").filter("is_active").join(counts, "id", "left").select("id", n("feed_0", "cv_count"), n("feed_1", "letter_count"))


@query("J23", "SELECT p.id, CAST(coalesce(e.value, p.score) AS DOUBLE) AS shown FROM posting p LEFT JOIN event e ON e.event_id = p.id AND e.kind = 'purchase'")
def snapshot_else_live(t):
    snap = t("event").filter("kind = 'purchase'").select(F.col("event_id").alias("id"), "value")
    return t("posting").join(snap, "id", "left").select("id", F.coalesce(F.col("value").cast("double"), F.col("score").cast("double")).alias("shown"))


@query(
    "J02 J03 P21 O06 W09",
    """SELECT id, slug FROM (SELECT p.id, s.slug, p.score, row_number() OVER (PARTITION BY p.id
    ORDER BY s.slug, s.line) AS rn FROM posting p JOIN provenance s ON s.posting_id = p.id AND s.slug <> 'feed_3' JOIN
    company c ON c.company_id = p.company_id WHERE c.segment NOT LIKE '%HOUSE%' AND p.score IS NOT NULL)
    WHERE rn = 1 ORDER BY (slug = 'feed_0') DESC, score DESC, id LIMIT 200""",
)
def queue_three_way_join(t):
    source = P.first_by(t("provenance").filter("slug <> 'feed_3'"), ["posting_id"], [F.col("slug"), F.col("line")]).select(F.col("posting_id").alias("id"), "slug")
    company = t("company").filter(~F.col("segment").contains("HOUSE")).select("company_id")
    rows = t("posting").filter("score is not null").join(source, "id").join(company, "company_id", "left_semi")
    return rows.orderBy((F.col("slug") == "feed_0").desc(), F.desc("score"), "id").limit(200).select("id", "slug")


@query("O05 O14", "SELECT id, CAST(score AS DOUBLE) AS score FROM posting ORDER BY score DESC NULLS LAST, id DESC LIMIT 500")
def top_for_profile(t):
    best = t("posting").select("id", "score").orderBy(*L.keyset_order("score")).limit(500)
    return best.select("id", F.col("score").cast("double").alias("score"))


@query(
    "O07 A27",
    """SELECT id, CAST(greatest(coalesce(published, DATE '1990-01-01'), coalesce(day, DATE '1990-01-01')) AS VARCHAR) AS
    activity FROM posting p LEFT JOIN event e ON e.event_id = p.id ORDER BY greatest(coalesce(published, DATE
    '1990-01-01'), coalesce(day, DATE '1990-01-01')) DESC, id LIMIT 100""",
)
def board_by_activity(t):
    zero = F.lit(date(1990, 1, 1))
    at = F.greatest(F.coalesce("published", zero), F.coalesce("day", zero))
    e = t("event").select(F.col("event_id").alias("id"), "day")
    return t("posting").join(e, "id", "left").withColumn("activity", at).orderBy(F.desc("activity"), "id").limit(100).select("id", F.col("activity").cast("string").alias("activity"))


@query(
    "A27",
    """SELECT stage, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM (SELECT *, CASE WHEN kind = 'purchase' THEN 'sent' WHEN turn = 0 THEN 'queued' WHEN value > 20 THEN 'read' ELSE
    'saved' END AS stage FROM event) GROUP BY stage""",
)
def kanban_stage(t):
    stage = F.when(F.col("kind") == "purchase", "sent").when(F.col("turn") == 0, "queued").when(F.col("value") > 20, "read").otherwise("saved")
    return t("event").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("U08", "SELECT p.family, count(DISTINCT p.skill) AS skills, count(DISTINCT p.posting_id) AS postings FROM requirement p WHERE p.held GROUP BY p.family")
def traceable_set(t):
    return t("requirement").filter("held").groupBy("family").agg(F.count_distinct("skill").alias("skills"), F.count_distinct("posting_id").alias("postings"))


@query("J24 U06", "SELECT id, 'left' AS side FROM posting WHERE id % 3 < 2 UNION ALL SELECT id, 'right' FROM posting WHERE id % 3 > 0 AND NOT (id % 3 < 2)")
def prefer_left_union(t):
    p = t("posting").select("id")
    return P.prefer_left(p.filter("id % 3 < 2").withColumn("side", F.lit("left")), p.filter("id % 3 > 0").withColumn("side", F.lit("right")), "id")


@query(
    "O11",
    """SELECT p_partkey, rank FROM (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size % 5 DESC, -p_size, p_brand,
    p_type, length(p_name) DESC, p_name, p_partkey) AS BIGINT) AS rank FROM part)
    WHERE rank <= 300""",
)
def rank_seven_keys(t):
    from pyspark.sql import window as W

    keys = [(F.col("p_size") % 5).desc(), -F.col("p_size"), F.col("p_brand"), F.col("p_type"), F.length("p_name").desc(), F.col("p_name"), F.col("p_partkey")]
    top = t("part").orderBy(*keys).limit(300)
    return top.select("p_partkey", F.row_number().over(W.Window.orderBy(*keys)).cast("long").alias("rank"))


@query("O16", "SELECT p_partkey, CAST((p_partkey + n - 37) % n AS BIGINT) AS turn FROM part, (SELECT count(*) AS n FROM part)")
def rotate_turn(t):
    """The place of each item in a list that starts where the last run stopped."""
    size = t("part").agg(F.count("*").alias("n"))  # one row
    turned = (F.col("p_partkey") + F.col("n") - 37) % F.col("n")
    return t("part").crossJoin(F.broadcast(size)).select("p_partkey", turned.cast("long").alias("turn"))


@query(
    "J20",
    """SELECT a, b, CAST(row_number() OVER (ORDER BY i + j, i) AS BIGINT) AS place
    FROM (SELECT p_brand AS a, row_number() OVER (ORDER BY p_brand) AS i
    FROM (SELECT DISTINCT p_brand FROM part)) CROSS JOIN (SELECT n_name AS b, row_number() OVER (ORDER BY n_name) AS j
    FROM nation) ORDER BY i + j, i LIMIT 60""",
)
def diagonal_plan(t):
    """25 brands by 25 nations: both sides are dimension lists of fixed size."""
    from pyspark.sql import window as W

    a = t("part").select(F.col("p_brand").alias("a")).distinct().withColumn("i", F.row_number().over(W.Window.orderBy("a")))
    b = t("nation").select(F.col("n_name").alias("b")).withColumn("j", F.row_number().over(W.Window.orderBy("b")))
    top = a.crossJoin(F.broadcast(b)).orderBy(F.col("i") + F.col("j"), "i").limit(60)
    return top.select("a", "b", F.row_number().over(W.Window.orderBy(F.col("i") + F.col("j"), "i")).cast("long").alias("place"))


@query("J09", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, min(url) AS url, count(*) AS n FROM pages GROUP BY 1")
def min_url_per_group(t):
    from ..functions.text import url_host

    return t("pages").groupBy(url_host(F.col("url")).alias("host")).agg(F.min("url").alias("url"), F.count("*").alias("n"))
