"""Sources: sitemaps, feeds and their cursors, queue files, payload fields, recomputed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import payloads as L

HOST = "jobs.example.com"


def _index():
    loc = lambda u: f"<sitemap><loc>{u}</loc></sitemap>"
    fixed = loc(f"https://{HOST}/sitemap/resumes1.xml") + loc(f"https://{HOST}/sitemap/vacancies1.xml") + loc("https://evil.example.net/vacancy9.xml")
    own = F.concat(F.lit(f"<sitemap><loc> https://{HOST}/sitemap/vacancy"), F.col("n_nationkey").cast("string"), F.lit(".xml </loc></sitemap>"))
    return F.concat(F.lit("<sitemapindex>"), own, own, F.lit(fixed + "</sitemapindex>"))


@query("S03", f"SELECT n_nationkey, n_nationkey AS number, 'https://{HOST}/sitemap/vacancy' || CAST(n_nationkey AS VARCHAR) || '.xml' AS url FROM nation")
def sitemap_index(t):
    """Each nation's index lists its vacancy file twice, beside résumés, landing pages and a file of another host."""
    return L.sitemap_files(t("nation").select("n_nationkey", _index().alias("body")), "body", HOST)


#: URL pattern ({} is the id), date, and seconds since 1970 where the entry counts.
_ENTRIES = [
    (f"https://{HOST}/vacancy/{{}}", "2026-01-02T10:00:00+05:00", 1767330000), (f"https://{HOST}/vacancy/{{}}/", "2026-01-02T10:00:00", 1767348000),
    (f"https://{HOST}/vacancy/{{}}?from=map", "2026-01-02T10:00:00Z", None), ("https://evil.example.net/vacancy/{}", "2026-01-02T10:00:00Z", None),
    (f"https://{HOST}/vacancy/{{}}", "yesterday", None), (f"https://{HOST}/resume/{{}}", "2026-01-02T10:00:00Z", None),
]


@query(
    "S04",
    f"SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS external_id, 'https://{HOST}/vacancy/' || CAST(c_custkey AS VARCHAR) AS url, CAST(s AS BIGINT) AS seconds FROM customer, (VALUES {', '.join(f'({s})' for *_, s in _ENTRIES if s)}) v(s)",
)
def sitemap_entries(t):
    """Six entries a file: with an offset, without one, with a query string, of another host, undated, and no vacancy."""
    own = F.col("c_custkey").cast("string")
    parts = [F.concat(F.lit("<url><loc>" + u.split("{}")[0]), own, F.lit(u.split("{}")[1] + f"</loc>\n<lastmod>{d}</lastmod></url>")) for u, d, _ in _ENTRIES]
    files = t("customer").select("c_custkey", F.concat(F.lit("<urlset>"), *parts, F.lit("</urlset>")).alias("body"))
    return L.sitemap_entries(files, "body", HOST).select("c_custkey", "external_id", "url", F.unix_seconds("lastmod").alias("seconds"))


@query(
    "S11",
    """SELECT c_custkey AS id, any_value(c_name) AS title FROM customer WHERE c_custkey % 9 <> 0 AND (contains(lower(c_name || ' ' || c_mktsegment), 'build') OR contains(lower(c_name || ' ' || c_mktsegment), '01')) GROUP BY c_custkey""",
)
def feed_document(t):
    """One JSON document a nation, asked for once; jobs without a link go, the keywords of the whole plan decide, an id counts once."""
    link = F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string")))
    job = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("tags"), link.alias("url"))
    doc = t("customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.concat(F.collect_list(job), F.collect_list(job)).alias("jobs"))).alias("body"))
    return L.json_feed(doc, "body", "id bigint, title string, tags string, url string", "id", "url", ("BUILD", "01"), ("title", "tags")).select("id", "title")


_WALK = """WITH p AS (SELECT c_custkey AS id, c_nationkey AS search, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 4 + 1 AS BIGINT) AS page FROM customer),
    l AS (SELECT search, least(max(page), 3) AS last FROM p GROUP BY search),
    s AS (SELECT n_nationkey AS n, n_nationkey AS search, n_nationkey % 3 + 1 AS page, last, (SELECT count(*) FROM range(7, 7 + 40) r(i) WHERE i % 25 = n_nationkey) AS visits FROM nation JOIN l ON search = n_nationkey)
    """


def _walk(t):
    from pyspark.sql import window as W

    w = W.Window.partitionBy("c_nationkey").orderBy("c_custkey")
    pages = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("search"), (F.floor((F.row_number().over(w) - 1) / 4) + 1).alias("page"))
    searches = t("nation").select(F.col("n_nationkey").alias("n"), F.col("n_nationkey").alias("search"), (F.col("n_nationkey") % 3 + 1).alias("page"))
    return L.cursor_walk(searches, pages, offset=7, turns=40, most_pages=3)


@query("S12", _WALK + "SELECT p.search, p.page, p.id FROM p WHERE EXISTS (SELECT 1 FROM s, range(0, 40) r(k) WHERE s.search = p.search AND k < s.visits AND (s.page - 1 + k) % s.last + 1 = p.page)")
def cursor_pages_in_turn(t):
    """Forty pages over twenty-five searches from turn seven on, of three pages each at most."""
    return _walk(t)[0].select("search", "page", "id")


@query("S12 R11", _WALK + "SELECT search, CAST((page - 1 + visits) % last + 1 AS INT) AS page FROM s")
def cursor_state_after(t):
    return _walk(t)[1].select("search", "page")


@query("S10", "SELECT CAST(o_orderkey AS BIGINT) AS id, min(o_custkey) AS company FROM orders WHERE o_orderkey % 31 <> 0 GROUP BY o_orderkey")
def feed_pages_deduped(t):
    """Pages of JSON that overlap by a posting; each posting once, those without a link not at all."""
    o = t("orders")
    link = F.when(F.col("o_orderkey") % 31 != 0, "https://x.test/")
    job = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"), link.alias("url"))
    page = F.floor(F.col("o_orderkey") / 40)
    both = F.array_distinct(F.array(page, F.floor((F.col("o_orderkey") + 1) / 40)))
    pages = o.select(job.alias("job"), F.explode(both).alias("page")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("job").alias("jobs"))).alias("body"))
    return L.json_feed(pages, "body", "id bigint, company bigint, url string", "id", "url").select("id", "company")


@query(
    "S17",
    "SELECT conv_id, 'v' || CAST(conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS vacancy_id, CASE WHEN i % 2 = 0 THEN 'letter' END AS letter FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 3) r(i) WHERE conv_id % 4 > 0",
)
def queue_files(t):
    """Queue files of this contract's version; others, and what is no queue, give no rows."""
    item = lambda i: F.struct(F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(f"-{i}")).alias("vacancy_id"), F.lit("letter" if i % 2 == 0 else None).cast("string").alias("letter"))
    good = F.to_json(F.struct(F.lit(2).alias("version"), F.array(*[item(i) for i in range(3)]).alias("items")))
    body = F.when(F.col("conv_id") % 4 == 0, F.when(F.col("conv_id") % 8 == 0, "[1, 2]").otherwise('{"version": 1, "items": [{"vacancy_id": "old"}]}')).otherwise(good)
    files = t("conversations").select("conv_id").distinct().select("conv_id", F.from_json(body, "version int, items array<struct<vacancy_id:string,letter:string>>").alias("q"))
    return files.filter("q.version = 2").select("conv_id", F.explode("q.items").alias("i")).select("conv_id", "i.vacancy_id", "i.letter")


_PAY = [
    ('{"noCompensation": {}}', "NULL, NULL, NULL, NULL, NULL"), ('{"from": 100, "to": 250.5, "currencyCode": "KZT", "gross": true, "mode": "MONTH"}', "100.0, 250.5, 'KZT', TRUE, 'month'"),
    ('{"from": 7, "currencyCode": "USD", "gross": false, "mode": "HOUR"}', "7.0, NULL, 'USD', FALSE, 'hour'"), ('{"to": 900, "currencyCode": "EUR", "mode": "SHIFT"}', "NULL, 900.0, 'EUR', NULL, NULL"),
    ('{"currencyCode": "EUR", "mode": "MONTH"}', "NULL, NULL, NULL, NULL, NULL"), (None, "NULL, NULL, NULL, NULL, NULL"),
]


@query("F48", "SELECT id, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, currency, gross, period FROM posting JOIN (VALUES " + ", ".join(f"({i}, {v})" for i, (_, v) in enumerate(_PAY)) + ") v(k, lo, hi, currency, gross, period) ON id % 6 = k")
def salary_payload(t):
    body = F.element_at(F.array(*[F.lit(b) for b, _ in _PAY]), (F.col("id") % 6 + 1).cast("int"))
    s = t("posting").select("id", L.salary(body).alias("s"))
    return s.select("id", F.col("s.min").cast("double").alias("low"), F.col("s.max").cast("double").alias("high"), "s.currency", F.col("s.is_gross").alias("gross"), "s.period")


@query(
    "F64 A31",
    "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 10000 WHEN 1 THEN event_id + 1 WHEN 2 THEN least(event_id + 5, 600) ELSE 10000 END AS BIGINT) AS most FROM events",
)
def letter_ceiling(t):
    """The least ceiling that any payload names under either spelling, at most six levels down; below that it is not looked for."""
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    deep = '{"a":[{"b":{"c":{"d":{"e":{"f":{"letterMaxLength": 3}}}}}}]}'
    body = F.when(k == 0, '{"letterMaxLength": true, "x": {"letter_max_length": -4}}').when(k == 1, F.concat(F.lit('{"a": {"b": [{"letterMaxLength": '), (F.col("event_id") + 1).cast("string"), F.lit('}], "note": "'), n, F.lit('"}}')))
    body = body.when(k == 2, F.concat(F.lit('[{"letter_max_length": 600}, {"letterMaxLength": '), (F.col("event_id") + 5).cast("string"), F.lit("}]"))).otherwise(deep)
    found = L.find_keys(("letterMaxLength", "letter_max_length"))
    return t("events").select("event_id", found(body).alias("found")).select("event_id", L.least_positive(F.col("found"), 10000).alias("most"))


@query(
    "F66 J22",
    """WITH b AS (SELECT posting_id, line, ext_id, 'slug' AS name, slug AS value FROM provenance UNION ALL
        SELECT posting_id, line, ext_id, 'ext', CASE WHEN line % 4 = 0 THEN NULL ELSE CAST(ext_id AS VARCHAR) END FROM provenance WHERE line % 2 = 0 UNION ALL
        SELECT posting_id, line, ext_id, 'first', CAST(line AS VARCHAR) FROM provenance WHERE line = 1)
    SELECT posting_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY posting_id, name ORDER BY line DESC, ext_id DESC, value DESC NULLS LAST) AS rn FROM b) WHERE rn = 1""",
)
def blocks_merged(t):
    """A posting's derived blocks laid over one another in order of arrival."""
    odd = F.create_map(F.lit("slug"), F.col("slug"))
    ext = F.create_map(F.lit("ext"), F.when(F.col("line") % 4 != 0, F.col("ext_id").cast("string")))
    one = F.create_map(F.lit("first"), F.col("line").cast("string"))
    block = F.when(F.col("line") % 2 == 0, F.map_concat(odd, ext)).when(F.col("line") == 1, F.map_concat(odd, one)).otherwise(odd)
    return L.merged_blocks(t("provenance").select("posting_id", "line", "ext_id", block.alias("block")), "posting_id", ["line", "ext_id"], "block")


_PLACES = [
    ("Python (Remote)", "Almaty • via Board", False, "full", "Almaty", "kz"), ("Повар", "Алматы,   Казахстан", None, "no", "Алматы,   Казахстан", "kz"), ("Dev", " • via Board", True, "full", None, None),
    ("Инженер, удалённо", None, False, "full", None, None), ("Clerk", "Warsaw, Poland", False, "no", "Warsaw, Poland", "pl"),
]
_COUNTRIES = [("kz", ("Almaty", "Алматы", "Казахстан")), ("pl", ("Poland",))]


@query("F21", "SELECT id, remote, place, country FROM posting JOIN (VALUES " + ", ".join(f"({i}, '{r}', {repr(p) if p else 'NULL'}, {repr(c) if c else 'NULL'})" for i, (*_, r, p, c) in enumerate(_PLACES)) + ") v(k, remote, place, country) ON id % 5 = k")
def location_fields(t):
    at = (F.col("id") % 5 + 1).cast("int")
    pick = lambda i, kind: F.element_at(F.array(*[F.lit(p[i]).cast(kind) for p in _PLACES]), at)
    p = t("posting").select("id", pick(0, "string").alias("title"), pick(1, "string").alias("location"), pick(2, "boolean").alias("flag"))
    p = p.withColumn("place", L.place(F.col("location")))
    return p.select("id", L.looks_remote(F.col("title"), F.col("location"), F.col("flag")).alias("remote"), "place", L.country(F.col("place"), _COUNTRIES).alias("country"))


@query("F22", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'New York' WHEN 1 THEN NULL ELSE substr(repeat('ab', 100), 1, 120) END AS city FROM customer")
def stated_city(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, "  New  \n York ").when(F.col("c_custkey") % 3 == 1, " \t ").otherwise(F.repeat(F.lit("ab"), F.lit(100)))
    return t("customer").select("c_custkey", L.city(raw).alias("city"))


_KEY = "sha1(concat_ws(chr(31), lower(c_mktsegment), 'job ' || CAST(c_custkey % 60 AS VARCHAR), trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'))))"


@query(
    "K23",
    f"""WITH k AS (SELECT c_custkey, c_custkey % 4 = 0 AS fresh, {_KEY} AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, key, (SELECT count(*) FROM k o WHERE o.key = k.key AND NOT o.fresh) > 1 OR EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND o.fresh) AS refused FROM k WHERE NOT fresh""",
)
def keys_recomputed(t):
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    title = F.concat(F.lit("Job, "), (F.col("c_custkey") % 60).cast("string"))
    rows = c.select("c_custkey", "c_mktsegment", title.alias("title"), "n_name", F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(1).alias("version"))
    return L.rekeyed(rows, "c_custkey", ["c_mktsegment", "title", "n_name"], "version", 2)


@query(
    "F60",
    """SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS DECIMAL(12,2)) AS DOUBLE) AS k
    FROM events WHERE CAST(json_extract_string(props, '$.k') AS DECIMAL(12,2)) >= 50""",
)
def json_number(t):
    k = F.get_json_object("props", "$.k").cast("decimal(12,2)")
    return t("events").filter(k >= 50).select("event_id", k.cast("double").alias("k"))


@query(
    "S16",
    """SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'denied' WHEN n_nationkey % 3 = 0 THEN 'not enabled' WHEN n_nationkey
    % 2 = 0 AND n_nationkey % 4 <> 0 THEN 'no key' ELSE 'runs' END AS state
    FROM nation""",
)
def registry_states(t):
    """Why a source is idle: denied, not enabled, or without the key that it needs; the first reason counts."""
    k = F.col("n_nationkey")
    state = F.when(k % 5 == 0, "denied").when(k % 3 == 0, "not enabled").when((k % 2 == 0) & ~(k % 4 == 0), "no key").otherwise("runs")
    return t("nation").select("n_name", state.alias("state"))
