"""Cascades over the tables of record, the active switch, and reading until a page is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import intervals as I
from ..operators import relations as R
from ..operators import validation as V

_BOTH = """profile AS (SELECT DISTINCT s_suppkey % 10 AS id FROM supplier), contact AS (SELECT c_custkey AS id, c_custkey % 10 AS profile_id FROM customer),
link AS (SELECT o_custkey AS contact_id, o_orderkey AS n FROM orders), experience AS (SELECT s_suppkey % 10 AS profile_id, s_suppkey AS n FROM supplier)"""


def tables(t) -> dict:
    """Tables of record over the given ones; ids are numbers here."""
    return {
        "candidate_profile": t("supplier").select((F.col("s_suppkey") % 10).alias("id")).distinct(), "profile_contact": t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("profile_id")),
        "profile_contact_link": t("orders").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("n")), "profile_experience": t("supplier").select((F.col("s_suppkey") % 10).alias("profile_id"), F.col("s_suppkey").alias("n")),
        "vacancy": t("posting").select("id", "company_id"), "vacancy_skill": t("requirement").select(F.col("posting_id").alias("vacancy_id"), "skill"), "match": t("match").select("profile_id", "vacancy_id"),
        "application": t("application").select("id", "vacancy_id", "profile_id"),
    }


def counted(found: dict):
    """Each table's rows, and those without a profile."""
    one = lambda n, df: df.agg(F.lit(n).alias("table"), F.count("*").alias("n"), (F.count_if(F.col("profile_id").isNull()) if "profile_id" in df.columns else F.lit(0).cast("long")).alias("bare"))
    out = None
    for n, df in found.items():
        out = one(n, df) if out is None else out.unionByName(one(n, df))
    return out


@query(
    "K21",
    f"""WITH {_BOTH} SELECT 'candidate_profile' AS "table", count(*) AS n, 0 AS bare FROM profile WHERE id <> 2
    UNION ALL SELECT 'profile_contact', count(*), 0 FROM contact WHERE profile_id <> 2 UNION ALL SELECT 'profile_contact_link', count(*), 0 FROM link WHERE contact_id % 10 <> 2 OR contact_id NOT IN (SELECT id FROM contact)
    UNION ALL SELECT 'profile_experience', count(*), 0 FROM experience WHERE profile_id <> 2 UNION ALL SELECT 'vacancy', count(*), 0 FROM posting UNION ALL SELECT 'vacancy_skill', count(*), 0 FROM requirement
    UNION ALL SELECT 'match', count(*), 0 FROM match WHERE profile_id <> 2 UNION ALL SELECT 'application', count(*), count(*) FILTER (WHERE profile_id IS NULL OR profile_id = 2) FROM application""",
)
def profile_cascade(t):
    """A profile goes, and what hangs on it; applications stay without it."""
    return counted(R.delete(tables(t), "candidate_profile", F.col("id") == 2))


@query(
    "K21",
    f"""WITH {_BOTH}, gone AS (SELECT id FROM posting WHERE company_id % 4 = 1) SELECT 'candidate_profile' AS "table", count(*) AS n, 0 AS bare FROM profile
    UNION ALL SELECT 'profile_contact', count(*), 0 FROM contact UNION ALL SELECT 'profile_contact_link', count(*), 0 FROM link UNION ALL SELECT 'profile_experience', count(*), 0 FROM experience
    UNION ALL SELECT 'vacancy', count(*), 0 FROM posting WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'vacancy_skill', count(*), 0 FROM requirement WHERE posting_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'match', count(*), 0 FROM match WHERE vacancy_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'application', count(*), count(*) FILTER (WHERE profile_id IS NULL) FROM application WHERE vacancy_id NOT IN (SELECT id FROM gone)""",
)
def vacancies_cascade(t):
    return counted(R.delete(tables(t), "vacancy", F.col("company_id") % 4 == 1))


@query(
    "K11",
    """WITH old AS (SELECT c_custkey AS id, c_nationkey AS nation, c_custkey % 7 = 0 AS is_active FROM customer), keep AS (SELECT nation, max(id) AS id FROM old WHERE nation % 3 <> 0 GROUP BY nation)
    SELECT o.id, CASE WHEN k.id IS NULL THEN o.is_active ELSE o.id = k.id END AS is_active, CASE WHEN k.id IS NOT NULL AND o.is_active <> (o.id = k.id) THEN 2 ELSE 1 END AS stamp FROM old o LEFT JOIN keep k ON k.nation = o.nation""",
)
def active_switched(t):
    """The newest row of a nation is switched on and its others off; nations without one to keep, or whose one is not there, stay."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7 == 0).alias("is_active"), F.lit(1).alias("updated_at"))
    newest = c.filter("nation % 3 <> 0").groupBy("nation").agg(F.max("id").alias("id"))
    absent = c.filter("nation % 3 = 0 AND nation > 0").select("nation", F.lit(-1).cast("long").alias("id")).distinct()
    return R.activate(c, newest.unionByName(absent), "id", "nation", now=F.lit(2)).select("id", "is_active", F.col("updated_at").alias("stamp"))


@query(
    "P34 R05 J19",
    """WITH item AS (SELECT slug, ext_id, posting_id // 40 AS page FROM provenance WHERE line <= 3), known AS (SELECT DISTINCT slug, ext_id FROM provenance WHERE line >= 6),
    p AS (SELECT i.slug, i.page, count(*) AS n, count(k.ext_id) AS k FROM item i LEFT JOIN known k ON k.slug = i.slug AND k.ext_id = i.ext_id GROUP BY 1, 2),
    r AS (SELECT *, coalesce(bool_or(k >= 0.6 * n) OVER (PARTITION BY slug ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS past FROM p)
    SELECT slug, count(*) FILTER (WHERE NOT past) AS pages_read, CAST(coalesce(sum(n) FILTER (WHERE NOT past), 0) AS BIGINT) AS items_read, min(page) FILTER (WHERE past) AS first_unread FROM r GROUP BY slug""",
)
def pages_until_known(t):
    """Pages of 40 postings in order, until six in ten of a page's items are known; the first page that is not read."""
    p = t("provenance")
    items = p.filter("line <= 3").select("slug", "ext_id", F.floor(F.col("posting_id") / 40).alias("page"))
    return I.read_until_known(items, p.filter("line >= 6"), "slug", "page", "ext_id", share=0.6)


_FEED = """feed AS (SELECT o_orderkey % 5 AS source, CASE WHEN o_orderkey % 5 = 2 AND o_custkey % 12 >= 6 THEN 2 + o_custkey % 12 ELSE 1 + o_custkey % 12 END AS page, o_orderkey AS at_,
    CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 61 ELSE o_orderkey // 10 END AS key, o_orderstatus <> 'F' AS wanted FROM orders)"""


@query(
    "S10 S02",
    f"""WITH {_FEED}, first AS (SELECT source, key, min(page) AS page, arg_min(wanted, page * 100000000 + at_) AS yes FROM feed GROUP BY source, key),
    p AS (SELECT f.source, f.page, count(x.key) AS fresh, count(x.key) FILTER (WHERE yes) AS yes FROM (SELECT DISTINCT source, page FROM feed) f LEFT JOIN first x ON x.source = f.source AND x.page = f.page GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS n, sum(yes) OVER w AS got, sum(fresh) OVER w AS seen FROM p WINDOW w AS (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, lag(got, 1, 0) OVER v AS got0, lag(seen, 1, 0) OVER v AS seen0 FROM r WINDOW v AS (PARTITION BY source ORDER BY page)),
    s AS (SELECT source, n, CASE WHEN n <> page THEN 'empty' WHEN fresh = 0 THEN 'nothing new' WHEN got >= (CASE source WHEN 3 THEN 20 ELSE 1000000 END) THEN 'limit' END AS why, CASE WHEN n <> page THEN got0 ELSE got END AS got, CASE WHEN n <> page THEN seen0 ELSE seen END AS seen FROM g),
    k AS (SELECT source, min(n) FILTER (WHERE why IS NOT NULL) AS stop_at, max(n) AS most FROM s GROUP BY source)
    SELECT k.source, CAST(coalesce(stop_at, most + 1) AS BIGINT) AS pages, CAST(s.seen AS BIGINT) AS "unique", CAST(least(s.got, CASE k.source WHEN 3 THEN 20 ELSE 1000000 END) AS BIGINT) AS yielded, coalesce(s.why, 'empty') AS stop
    FROM k JOIN s ON s.source = k.source AND s.n = coalesce(stop_at, most)""",
)
def feeds_read_to_a_stop(t):
    """Five feeds: one with few keys that come again, one with a gap, one read for twenty postings, two read to their end."""
    o = t("orders")
    k, turn = F.col("o_orderkey"), F.col("o_custkey") % 12
    feed = o.select(
        (k % 5).alias("source"), F.when((k % 5 == 2) & (turn >= 6), turn + 2).otherwise(turn + 1).alias("page"), k.alias("at"),
        F.when(k % 5 == 1, k % 61).otherwise(F.floor(k / 10)).alias("key"), (F.col("o_orderstatus") != "F").alias("wanted"),
    )
    read = lambda rows, limit: I.read_feed(rows, "source", "page", "at", "key", F.col("wanted"), limit)
    return read(feed.filter("source <> 3"), 1_000_000).unionByName(read(feed.filter("source = 3"), 20))


@query(
    "P32",
    """SELECT id, concat_ws(',', CASE WHEN salary > high THEN 'pay_range' END, CASE WHEN score < 5 OR score > 95 THEN 'score' END, CASE WHEN NOT regexp_full_match(currency, '[A-Z]{3}') THEN 'currency' END,
    CASE WHEN NOT regexp_full_match(country, '[A-Z]{2}') THEN 'country' END) AS faults
    FROM (SELECT id, salary, score, CASE WHEN id % 13 = 0 THEN salary - 1 ELSE salary_max END AS high, CASE WHEN id % 10 = 1 THEN lower(currency) ELSE currency END AS currency, CASE WHEN id % 9 = 2 THEN country || 'X' ELSE country END AS country FROM vacancy)
    WHERE coalesce(salary > high, FALSE) OR coalesce(score < 5 OR score > 95, FALSE) OR coalesce(NOT regexp_full_match(currency, '[A-Z]{3}'), FALSE) OR coalesce(NOT regexp_full_match(country, '[A-Z]{2}'), FALSE)""",
)
def rows_at_fault(t):
    """Postings with an inverted pay range, a score out of bounds, or a code of the wrong shape; nulls break nothing."""
    k = F.col("id")
    v = t("vacancy").select(
        "id", "salary", "score", F.when(k % 13 == 0, F.col("salary") - 1).otherwise(F.col("salary_max")).alias("high"), F.when(k % 10 == 1, F.lower("currency")).otherwise(F.col("currency")).alias("currency"),
        F.when(k % 9 == 2, F.concat("country", F.lit("X"))).otherwise(F.col("country")).alias("country"),
    )
    rules = {"pay_range": V.ordered(F.col("salary"), F.col("high")), "score": V.within(F.col("score"), 5, 95), "currency": V.shaped(F.col("currency"), V.CURRENCY), "country": V.shaped(F.col("country"), V.COUNTRY)}
    return V.parted(v, rules)[1].select("id", F.array_join("faults", ",").alias("faults"))


@query(
    "S19",
    """SELECT count(*) AS n, 64 AS declared, count(*) FILTER (WHERE vec_id % 7 = 3) AS misfits, min(vec_id) FILTER (WHERE vec_id % 7 = 3) AS first_misfit FROM embeddings""",
)
def vector_widths_declared(t):
    """Vectors against the width that their column declares; every seventh is cut short, every eleventh is null."""
    k = F.col("vec_id")
    e = t("embeddings").select("vec_id", F.when(k % 7 == 3, F.slice("embedding", 1, 32)).when(k % 11 == 0, F.lit(None)).otherwise(F.col("embedding")).alias("embedding"))
    e = V.declare_width(e, "embedding", 64)
    V.verify_width(e, "embedding", 64)
    return e.agg(F.count("*").alias("n"), F.lit(V.declared_width(e, "embedding")).alias("declared"), F.count_if(V.misfits(e, "embedding")).alias("misfits"), F.min(F.when(V.misfits(e, "embedding"), k)).alias("first_misfit"))
