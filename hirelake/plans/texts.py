"""Text analytics over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..functions import text as X

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def normalised(c: str) -> str:
    """Oracle form of the normalised part. The tables hold Latin letters alone, of which only ß folds to others."""
    folded = f"replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss')"
    return f"trim(regexp_replace(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("P14 O14", f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'of')")
def fulltext_all_tokens(t):
    return t("documents").filter(X.has_all_tokens(F.col("text"), "The of")).select("doc_id")


@query(
    "P28",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+(?:/[^/?#]*)*/([^/?#]+)', 1) AS tail, regexp_extract(url,
    '^[a-z]+://[^/?#]+(?:/[^/?#]*)*/([^/?#]+)', 1) = CAST(page_id AS VARCHAR) AS names_id
    FROM pages""",
)
def url_names_id(t):
    tail = X.url_path_tail(F.col("url"))
    return t("pages").select("page_id", tail.alias("tail"), (tail == F.col("page_id").cast("string")).alias("names_id"))


@query(
    "T08 F20",
    """SELECT conv_id, turn, length(text) > 400 AS too_long, regexp_matches(text, '(https?://|www[.])') AS link, contains(text,
    '@') AS at_sign, substr(text, 1, 80) AS clipped FROM conversations WHERE role = 'assistant'""",
)
def letter_guards(t):
    c = F.col("text")
    return t("conversations").filter("role = 'assistant'").select("conv_id", "turn", (F.length(c) > 400).alias("too_long"), c.rlike("(https?://|www[.])").alias("link"), c.contains("@").alias("at_sign"), F.substring(c, 1, 80).alias("clipped"))


@query(
    "A21",
    """SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}')) AS iso, len(regexp_extract_all(text,
    '[0-9]{1,3}[.][0-9]{1,3}')) AS dotted, least(len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}')),
    len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}'))) >= 2 AS mixed
    FROM documents""",
)
def date_style_mix(t):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    iso, dotted = n("[0-9]{4}-[0-9]{2}"), n("[0-9]{1,3}[.][0-9]{1,3}")
    return t("documents").select("doc_id", iso.alias("iso"), dotted.alias("dotted"), (F.least(iso, dotted) >= 2).alias("mixed"))


@query(
    "T04 F14",
    f"""SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS words, CASE WHEN len({WORDS}) < 50 THEN 'short' WHEN len({WORDS}) > 1500
    THEN 'long' ELSE 'fit' END AS verdict FROM documents""",
)
def length_rule(t):
    d = t("documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("words"))
    return d.select("doc_id", "words", F.when(F.col("words") < 50, "short").when(F.col("words") > 1500, "long").otherwise("fit").alias("verdict"))


@query(
    "F19",
    """SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: regexp_matches(x,
    '^[A-Z][^.]{0,30}[.]?$'))) AS BIGINT) AS headings FROM (SELECT doc_id, list_filter(string_split(text, chr(10)),
    lambda x: trim(x) <> '') AS l FROM documents)""",
)
def sections_items(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = t("documents").select("doc_id", lines.alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("lines"), F.size(F.filter("l", lambda x: x.rlike("^[A-Z][^.]{0,30}[.]?$"))).cast("long").alias("headings"))


RULES = [(1, "keyword", "license", 0), (2, "phrase", "of the", 0), (3, "max_length", "", 3000), (4, "min_length", "", 200), (5, "forbidden", "token", 0)]
_RULES = "(VALUES " + ", ".join(f"({i}, '{k}', '{w}', {n})" for i, k, w, n in RULES) + ") r(rule_id, kind, word, size)"


@query(
    "T06 T05",
    f"""SELECT doc_id, rule_id FROM documents, {_RULES} WHERE CASE kind WHEN 'keyword' THEN NOT contains(lower(text), word) WHEN
    'phrase' THEN NOT contains(lower(text), word) WHEN 'max_length' THEN length(text) > size WHEN 'min_length' THEN
    length(text) < size ELSE contains(lower(text), word) END""",
)
def rule_violations(t):
    """Each document against the few rules, which are literals: an array of violated rules, exploded."""
    low, size = F.lower("text"), F.length("text")
    broken = {"keyword": lambda w, n: ~low.contains(w), "phrase": lambda w, n: ~low.contains(w), "max_length": lambda w, n: size > n, "min_length": lambda w, n: size < n, "forbidden": lambda w, n: low.contains(w)}
    found = F.array_compact(F.array(*[F.when(broken[k](w, n), F.lit(i)) for i, k, w, n in RULES]))
    return t("documents").select("doc_id", F.explode(found).alias("rule_id"))

@query(
    "O13 F20",
    """SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id
    ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
    WHERE used <= 1500""",
)
def examples_budgeted(t):
    """Taken in order until the first that does not fit: behind it nothing is taken."""
    w = W.Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(W.Window.unboundedPreceding, 0)
    return t("conversations").withColumn("used", F.sum(F.length("text")).over(w)).filter("used <= 1500").select("conv_id", "turn")


@query("S13", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') AND contains(lower(text), 'version')) OR contains(lower(text), 'token')")
def keyword_any_of_all(t):
    phrases = [["license", "version"], ["token"]]
    low = F.lower("text")
    hit = F.lit(False)
    for words in phrases:
        every = F.lit(True)
        for w in words:
            every = every & low.contains(w)
        hit = hit | every
    return t("documents").filter(hit).select("doc_id")


@query(
    "F02 A30",
    f"""SELECT sha1(concat({normalised('text')}, chr(31), {normalised('lang')})) AS fingerprint, count(*) AS n, min(doc_id) AS
    first_id FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def fingerprint_collisions(t):
    f = X.fingerprint(F.col("text"), F.col("lang"))
    return t("documents").groupBy(f.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    "F01 F02 W09",
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1({normalised('text')})
    ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def fingerprint_dedupe(t):
    return t("documents").groupBy(X.fingerprint(F.col("text")).alias("f")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


#: Names and what is compared of them, written by hand: full width, combining marks, other scripts, case, punctuation.
NAMES = [
    ("Ａcme", "acme"), ("  Data   Engineer ", "data engineer"), ("Пиксель-Мираж", "пиксель мираж"), ("АЛМАТЫ", "алматы"), ("Маи\u0306ор", "майор"), ("Straße, ẞ", "strasse ss"), ("a\u001fb_c", "a b_c"), ("№ 5½", "no 51 2"), (None, ""),
]


@query("F01", "SELECT id, name, sha1(name || chr(31)) AS key FROM posting JOIN (VALUES " + ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(NAMES)) + f") v(k, name) ON id % {len(NAMES)} = k")
def names_normalised(t):
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in NAMES]), (F.col("id") % len(NAMES) + 1).cast("int"))
    return t("posting").select("id", X.normalize_part(raw).alias("name"), X.fingerprint(raw, F.lit(None).cast("string")).alias("key"))


@query("P18", "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END)")
def hash_stale_rows(t):
    stored = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")), 256)
    return t("documents").withColumn("text_hash", F.sha2("text", 256)).filter(F.col("text_hash") != stored).select("doc_id", "text_hash")


@query("F06 F07")
def html_to_text(t):
    """Markup to lines, character references peeled first; their full table is Python's, so tests hold it against plain Python."""
    return t("pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


#: Markup and its prose, written by hand.
MARKUP = [
    ("<p>One&nbsp;two</p><p> three </p>", "One two\nthree"), ("no markup  at all", "no markup  at all"), ("&lt;ul&gt;&lt;li&gt;a&lt;/li&gt;&lt;li&gt;b&lt;/li&gt;&lt;/ul&gt;", "a\nb"), ("R&amp;amp;D <b>team</b>", "R&D team"),
    ("a<br/>b<br>c", "a\nb\nc"), ("x &#1055;&#x440; y", "x Пр y"), ("<span>k</span><span>l</span>", "k l"),
]


@query("F06", "SELECT id, text FROM posting JOIN (VALUES " + ", ".join(f"({i}, '{v}')" for i, (_, v) in enumerate(MARKUP)) + f") v(k, text) ON id % {len(MARKUP)} = k")
def markup_to_prose(t):
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in MARKUP]), (F.col("id") % len(MARKUP) + 1).cast("int"))
    return t("posting").select("id", X.plain_text(raw).alias("text"))


@query("F06", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title_bare(t):
    return t("pages").select("page_id", F.regexp_replace("html", "<[^>]+>", "").alias("bare"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("S09", "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS BIGINT) AS links FROM pages")
def html_distinct_links(t):
    return t("pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).cast("long").alias("links"))


_SAFE = "regexp_replace(url, '([?&](?:ref|utm_[a-z]+|token|key|sid)=)[^&#]*', '\\1***', 'g')"


@query("P28 F18", f"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_SAFE} AS safe, regexp_matches(url, '[?]') AS has_query FROM pages")
def url_parts_tracking(t):
    u = F.col("url")
    return t("pages").select("page_id", X.url_host(u).alias("host"), X.redact_params(u).alias("safe"), u.rlike("[?]").alias("has_query"))


@query("F15", "SELECT doc_id, contains(text, '@') AS at_sign, regexp_matches(text, '(https?://|www[.])') AS has_link FROM documents WHERE contains(text, '@')")
def contact_extract(t):
    return t("documents").filter(F.col("text").contains("@")).select("doc_id", F.col("text").contains("@").alias("at_sign"), F.col("text").rlike("(https?://|www[.])").alias("has_link"))


@query(
    "A20 T04",
    f"""SELECT doc_id, term, n FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS term
    FROM documents) GROUP BY doc_id, term) WHERE n > 12 AND length(term) > 3""",
)
def term_stuffing(t):
    """Within the row: of the sorted words, one that stands where it stood twelve places before is there more than twelve times."""
    words = F.sort_array(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) > 3))
    d = t("documents").select("doc_id", words.alias("w"))
    often = F.array_distinct(F.filter("w", lambda x, i: (i >= 12) & (F.get("w", i - 12) == x)))
    d = d.select("doc_id", "w", F.explode(often).alias("term"))
    return d.select("doc_id", "term", F.size(F.filter("w", lambda x: x == F.col("term"))).cast("long").alias("n"))


_POSITIONS = f"(SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents))"


@query(
    "W06 A20",
    f"""SELECT doc_id, term, CAST(max(n) AS INT) AS longest FROM (SELECT doc_id, term, g, count(*) AS n
    FROM (SELECT doc_id, term, pos - row_number() OVER (PARTITION BY doc_id, term
    ORDER BY pos) AS g FROM {_POSITIONS}) GROUP BY doc_id, term, g) WHERE n >= 4
    GROUP BY doc_id, term""",
)
def run_length(t):
    """Within the row: a word that stands in three places before its own starts or goes on with a run of four; its longest is then counted."""
    d = t("documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    fourth = F.filter("w", lambda x, i: (i >= 3) & (F.get("w", i - 1) == x) & (F.get("w", i - 2) == x) & (F.get("w", i - 3) == x))
    d = d.select("doc_id", "w", F.explode(F.array_distinct(fourth)).alias("term"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, x):
        now = F.when(x == F.col("term"), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return d.select("doc_id", "term", F.aggregate("w", start, step)["most"].alias("longest"))


SKILLS = ["the", "and", "from", "with", "token"]
_SENTENCES = "regexp_split_to_array(regexp_replace(lower(text), '([.!?…])\\s+', '\\1' || chr(10), 'g'), '[\\n;•·]+')"
_VERDICT = "CASE WHEN regexp_matches(sentence, '(^|[^a-z])(not|no|ne|non)([^a-z]|$)') THEN 1 WHEN regexp_matches(sentence, '(^|[^a-z])(that|which)([^a-z]|$)') THEN 2 ELSE 3 END"


@query(
    "F08 T03",
    f"""SELECT doc_id, skill, max(verdict) AS verdict FROM (SELECT doc_id, s.skill, {_VERDICT} AS verdict FROM (SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM documents) d,
    (VALUES ('the'), ('and'), ('from'), ('with'), ('token')) s(skill) WHERE list_contains(regexp_split_to_array(sentence, '[^\\p{{L}}\\p{{N}}]+'), s.skill)) GROUP BY doc_id, skill""",
)
def skill_mentions_verdict(t):
    """negated 1, optional 2, stated 3: the strongest reading of any sentence wins. Within the row, without a shuffle."""
    denied, soft = "(^|[^a-z])(not|no|ne|non)([^a-z]|$)", "(^|[^a-z])(that|which)([^a-z]|$)"
    wanted = F.array(*[F.lit(s) for s in SKILLS])

    def read(x):
        verdict = F.when(x.rlike(denied), 1).when(x.rlike(soft), 2).otherwise(3)
        return F.struct(F.array_intersect(F.split(x, X.TOKEN), wanted).alias("named"), verdict.alias("v"))

    d = t("documents").select("doc_id", F.filter(F.transform(X.sentences(F.lower("text")), read), lambda r: F.size(r["named"]) > 0).alias("r"))
    best = lambda s: F.array_max(F.transform(F.filter("r", lambda r: F.array_contains(r["named"], s)), lambda r: r["v"]))
    each = F.filter(F.array(*[F.struct(F.lit(s).alias("skill"), best(s).alias("verdict")) for s in SKILLS]), lambda x: x["verdict"].isNotNull())
    return d.select("doc_id", F.inline(each))


@query(
    "T03 T10",
    f"""WITH need AS (SELECT item_id, term FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) WHERE length(term) > 6 GROUP BY ALL),
    have AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL), n AS (SELECT item_id, count(*) AS need FROM need GROUP BY item_id)
    SELECT h.doc_id, b.item_id, count(*) AS present, max(n.need) - count(*) AS absent FROM need b JOIN have h ON h.term = b.term JOIN n ON n.item_id = b.item_id GROUP BY h.doc_id, b.item_id""",
)
def requirement_vs_document(t):
    """How many of an item's terms of seven letters or more a document holds."""
    long = lambda df, i: df.select(i, F.explode(F.array_distinct(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) > 6))).alias("term"))
    need = long(t("benchmark"), "item_id")
    size = need.groupBy("item_id").agg(F.count("*").alias("need"))
    both = long(t("documents"), "doc_id").join(need, "term").groupBy("doc_id", "item_id").agg(F.count("*").alias("present"))
    return both.join(size, "item_id").select("doc_id", "item_id", "present", (F.col("need") - F.col("present")).alias("absent"))


@query(
    "A22",
    """SELECT d.doc_id, greatest(0, 100 - CASE WHEN length(text) > 5000 THEN 20 ELSE 0 END - CASE WHEN contains(text, '@') THEN 30 ELSE 0 END - CASE WHEN quality = 0 THEN 60 ELSE 0 END) AS score,
    CASE WHEN quality = 0 THEN 'critical' WHEN contains(text, '@') THEN 'warning' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def audit_score_verdict(t):
    d = t("documents").select("doc_id", (F.length("text") > 5000).alias("long"), F.col("text").contains("@").alias("at")).join(t("labels"), "doc_id", "left")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    penalty = F.when(F.col("long"), 20).otherwise(0) + F.when(F.col("at"), 30).otherwise(0) + F.when(bad, 60).otherwise(0)
    return d.select("doc_id", F.greatest(F.lit(0), 100 - penalty).alias("score"), F.when(bad, "critical").when(F.col("at"), "warning").otherwise("ok").alias("verdict"))


@query(
    "F20",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) AS rn FROM conversations),
    w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, '' AS taken FROM c
        UNION ALL SELECT w.conv_id, c.rn, CASE WHEN w.used + c.n <= 1500 THEN w.used + c.n ELSE w.used END, CASE WHEN w.used + c.n <= 1500 THEN w.taken || CAST(c.turn AS VARCHAR) || ',' ELSE w.taken END
        FROM w JOIN c ON c.conv_id = w.conv_id AND c.rn = w.rn + 1)
    SELECT conv_id, taken FROM (SELECT *, max(rn) OVER (PARTITION BY conv_id) AS top FROM w) WHERE rn = top""",
)
def examples_skipping(t):
    """Taken in order, leaving out what does not fit while later, smaller items still may: an ordered fold per conversation."""
    items = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))

    def step(acc, x):
        fits = acc["used"] + x["n"] <= 1500
        used = F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.when(fits, F.concat(acc["taken"], x["turn"].cast("string"), F.lit(","))).otherwise(acc["taken"]).alias("taken"))

    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("taken"))
    return t("conversations").groupBy("conv_id").agg(items.alias("all")).select("conv_id", F.aggregate("all", start, step)["taken"].alias("taken"))


@query(
    "F13",
    """SELECT conv_id, 'workshop:' || substr(sha256(string_agg(role || '=' || CAST(n AS VARCHAR), chr(10)
    ORDER BY role)), 1, 12) AS version FROM (SELECT conv_id, role, max(length(text)) AS n
    FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
)
def rules_version(t):
    """Twelve hex digits of the sha256 over `key=value` lines in order of their keys."""
    own = t("conversations").groupBy("conv_id", "role").agg(F.max(F.length("text")).alias("n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("role", "n"))), lambda x: F.concat_ws("=", x["role"], x["n"].cast("string")))
    return own.groupBy("conv_id").agg(F.concat(F.lit("workshop:"), F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 12)).alias("version"))
