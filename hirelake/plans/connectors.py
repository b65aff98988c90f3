"""Postings read through the connectors' data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import connectors as C

_NUMBER = "regexp_extract(url, '^https?://[^/?#]+/(de|en|es|fr)/([0-9]+)([?#]|$)', {})"
_BARE = "split_part(url, '#', 1)"
_TITLE = "trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'))"
_SITE = f"SELECT 'site_' || {_NUMBER.format(1)} AS slug, {_NUMBER.format(2)} AS external_id, page_id, {_BARE} AS url, {_TITLE} AS title FROM pages WHERE {_NUMBER.format(2)} <> ''"
_PARTNER = f"SELECT 'partner' AS slug, regexp_extract(url, '^https?://(m\\.[^/?#]+)/', 1) || ':' || regexp_extract(split_part({_BARE}, '?', 1), '([^/]*)$', 1) AS external_id, page_id, {_BARE} AS url, {_TITLE} AS title FROM pages WHERE regexp_matches(url, '^https?://m\\.[^/?#]+/')"


def read(t, **options):
    return C.register(t.spark).read.format("postings").options(path=f"{t.sf_dir}/pages.parquet", **options).load()


@query("S01 S02", f"SELECT slug, external_id, min(page_id) AS page_id, arg_min(url, page_id) AS url, arg_min(title, page_id) AS title FROM ({_SITE} UNION ALL {_PARTNER}) WHERE slug <> 'site_de' GROUP BY slug, external_id")
def connector_postings(t):
    """All postings of the sources that run, each once; one is denied, one has its key."""
    return C.once(read(t, deny="site_de", credentials="partner_key"))


@query("S01 S16", f"SELECT slug, page_id, title FROM ({_SITE}) WHERE slug IN ('site_en', 'site_fr') AND page_id >= 20 AND (title ILIKE '%the%' OR title ILIKE '%de%')")
def connector_filters(t):
    """Filters on the slug leave sources out, on the page id row groups; two queries, one of them twice, name what is sought."""
    found = read(t, enable="site_en,site_fr,site_es", queries="the,de,the")
    return found.filter(F.col("slug").isin("site_en", "site_fr") & (F.col("page_id") >= 20)).select("slug", "page_id", "title")


@query(
    "S16",
    f"""SELECT v.slug, v.state, count(p.page_id) AS pages FROM (VALUES ('partner', 'no partner_key'), ('site_de', 'denied'), ('site_en', 'runs'), ('site_es', 'not enabled'), ('site_fr', 'runs')) v(slug, state)
    LEFT JOIN ({_SITE}) p ON p.slug = v.slug AND v.state = 'runs' GROUP BY v.slug, v.state""",
)
def connector_states(t):
    """Why each registered source is idle, and how many pages those that run have."""
    settings = {"enable": "site_de,site_en,site_fr,partner", "deny": "site_de"}
    why = [(s, C.idle_reason(s, settings["enable"].split(","), settings["deny"].split(",")) or "runs") for s in C.REGISTRY]
    pages = read(t, **settings).groupBy("slug").agg(F.count("*").alias("pages"))
    return t.spark.createDataFrame(why, "slug string, state string").join(pages, "slug", "left").select("slug", "state", F.coalesce("pages", F.lit(0)).alias("pages"))
