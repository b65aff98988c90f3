"""Profiles, documents and the full list row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import listing as O
from ..operators import contacts as C
from ..operators import profiles as R
from .folds import by_hand, pick


def chosen(values, key: str, kind: str = "string"):
    """One of a few literals by a row's key."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


@query(
    "J16",
    """WITH s AS (SELECT DISTINCT posting_id % 5 AS profile_id, skill FROM requirement WHERE held),
    p AS (SELECT profile_id, profile_id * 7 % 5 AS born FROM (SELECT DISTINCT posting_id % 5 AS profile_id FROM requirement))
    SELECT skill AS canonical_name, CAST(arg_max(s.profile_id, born) AS BIGINT) AS newest, count(*) AS profiles FROM s JOIN p ON p.profile_id = s.profile_id WHERE s.profile_id <> 2 GROUP BY skill""",
)
def skills_of_other_profiles(t):
    """For each skill on a profile other than 2: the newest such profile, and how many there are."""
    held = t("requirement").filter("held").select((F.col("posting_id") % 5).alias("profile_id"), F.col("skill").alias("canonical_name")).distinct()
    profiles = t("requirement").select((F.col("posting_id") % 5).alias("profile_id")).distinct().withColumn("created_at", F.col("profile_id") * 7 % 5)
    return R.skills_elsewhere(held, profiles, 2).groupBy("canonical_name").agg(F.max_by("profile_id", "created_at").alias("newest"), F.count("*").alias("profiles"))


@query(
    "A19",
    """WITH r AS (SELECT posting_id, family, skill, line, held, posting_id * 31 + line * 7 AS ext FROM requirement),
    n AS (SELECT posting_id, family, string_agg(skill, ',' ORDER BY line, skill) AS raw_names FROM (SELECT posting_id, family, skill, min(line) AS line FROM r GROUP BY ALL) GROUP BY posting_id, family)
    SELECT r.posting_id, r.family, ['basic', 'working', 'strong', 'expert'][max(ext % 5)] AS level, max(CASE WHEN ext % 3 = 0 THEN NULL ELSE ext % 11 END) AS years,
        max(CASE WHEN ext % 4 = 0 THEN NULL ELSE 2000 + ext % 20 END) AS last_used_year, bool_or(held) AS corroborated, bool_and(ext % 2 = 0) AS unknown, any_value(raw_names) AS raw_names
    FROM r JOIN n ON n.posting_id = r.posting_id AND n.family = r.family GROUP BY r.posting_id, r.family""",
)
def skills_merged(t):
    """Spellings of one family as one skill: the strongest claim on every side. A rank of nought is no level."""
    ext = F.col("posting_id") * 31 + F.col("line") * 7
    level = F.get(F.array(*[F.lit(x) for x in R.LEVELS]), ((F.col("ext") % 5) - 1).cast("int"))
    r = t("requirement").withColumn("ext", ext).select(
        "posting_id", "family", F.col("skill").alias("raw_name"), "line", level.alias("level"), F.when(F.col("ext") % 3 != 0, F.col("ext") % 11).alias("years"),
        F.when(F.col("ext") % 4 != 0, 2000 + F.col("ext") % 20).alias("last_used_year"), F.col("held").alias("corroborated"), (F.col("ext") % 2 == 0).alias("unknown"),
    )
    return R.merged_skills(r, ["posting_id", "family"], "line").withColumn("raw_names", F.array_join("raw_names", ","))


_DATES = [("2019-07", 2019 * 12 + 7), ("04.2022", 2022 * 12 + 4), ("апрель 2022", 2022 * 12 + 4), ("Sept. 2020", 2020 * 12 + 9), ("13-2020", "NULL"), ("2022-13", "NULL"), ("foo 2020", "NULL"), ("2020", "NULL"), ("Мая 1999", 1999 * 12 + 5), ("", "NULL")]


@query("F34", "SELECT id, CAST(m AS INT) AS months FROM posting JOIN (VALUES " + ", ".join(f"({i}, {m})" for i, (_, m) in enumerate(_DATES)) + f") v(k, m) ON id % {len(_DATES)} = k")
def dates_as_written(t):
    return t("posting").select("id", R.year_month(chosen([d for d, _ in _DATES], "id")).alias("months"))


_ITEMS = ["the", "License", "of  the", "experience", "zzz", "yyy", "", "and", "qqq1", "qqq2", "qqq3", "qqq4", "qqq5", "qqq6", "qqq7", "qqq8", "qqq9"]
_HEAD = "(?i)\\b(?:experience|employment|work\\s+history|education|degree|skills|technical\\s+skills|stack)\\b|опыт\\s+работы|опыт|образование|навыки|стек"


@query(
    "A24 T05",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND (NOT regexp_matches(x, '{_HEAD}') OR regexp_matches(x, '^(?:{_HEAD})'))) AS lines FROM documents),
    h AS (SELECT doc_id, array_to_string(list_transform(lines, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), ' ') AS hay FROM l),
    n AS (SELECT doc_id, list_filter({[i for i in _ITEMS if i]}, lambda x: NOT contains(hay, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) AS lost FROM h)
    SELECT doc_id, CAST({sum(bool(i) for i in _ITEMS)} AS INT) AS total, CAST({sum(bool(i) for i in _ITEMS)} - len(lost) AS INT) AS recovered, array_to_string(lost[1:10], '|') AS lost FROM n""",
)
def items_recoverable(t):
    """x of y items that survive in the lines a parser files rightly, and the first ten that do not."""
    r = R.recoverable(F.array(*[F.lit(i) for i in _ITEMS]), R.readable_lines(F.col("text")))
    d = t("documents").select("doc_id", r.alias("r"))
    return d.select("doc_id", "r.total", "r.recovered", F.array_join("r.lost", "|").alias("lost"))


@query(
    "F50",
    """SELECT event_id, CAST(turn AS VARCHAR) AS model, CASE turn WHEN 0 THEN (event_id * 3.0 + event_id % 100 * 15.0 + 7 * 0.3 + 9 * 3.75) / 1000000 WHEN 1 THEN (event_id * 0.25 + event_id % 100 * 1.25) / 1000000 END AS cost FROM event""",
)
def token_prices(t):
    """A call's price by its model's sheet; a model without one has no price, not a price of nought."""
    sheet = t.spark.createDataFrame([("0", 3.0, 15.0, 0.3, 3.75), ("1", 0.25, 1.25, 0.0, 0.0)], "model string, inp double, out double, hit double, put double")
    calls = t("event").select("event_id", F.col("turn").cast("string").alias("model"), (F.col("event_id") % 100).alias("written"))
    priced = calls.join(F.broadcast(sheet), "model", "left")
    cost = R.price([(F.col("event_id"), F.col("inp")), (F.col("written"), F.col("out")), (F.lit(7), F.col("hit")), (F.lit(9), F.col("put"))])
    return priced.select("event_id", "model", cost.alias("cost"))


@query("F52", None)
def pseudo_embeddings(t):
    """A vector of each text from its sha256; tests hold it against plain Python."""
    return t("documents").select("doc_id", R.pseudo_vector(64)(F.col("text")).alias("vector"))


@query("F16", None)
def contacts(t):
    """First address and telephone, and the links, of every document that has any; read in Arrow batches, held by the readings below and by tests."""
    return C.contacts(t("documents"), "doc_id", "text").filter("email is not null or phone is not null or size(links) > 0")


#: Texts, and by hand their address, telephone and links.
_CONTACTS = [
    ("Телефон: +7 (701) 555-00-15, почта:k.m@example.com. GitHub github.com/some-one", "k.m@example.com", "+7 (701) 555-00-15", "github https://github.com/some-one"),
    ("сайт https://me.example.org/a?b=1). Telegram: @nick_name", None, None, "website https://me.example.org/a?b=1,telegram https://t.me/nick_name"),
    ("03.2021 - 06.2022, 1 200 000 - 1 500 000; tel 8(700)000-00-15", None, "8(700)000-00-15", ""),
    ("+49 30 1234567 or mobile 0170-1234567", None, "0170-1234567", ""), ("call 555-0100 10:30 or +1 202 555 0100", None, "+1 202 555 0100", ""),
    ("moved linkedin.com/in/x https://www.github.com/y https://u:p@t.me/z", "p@t.me", None, "github https://www.github.com/y,linkedin https://linkedin.com/in/x"),
    ("", None, None, ""), ("ab@c a@b.c1 x@-y.com last.one@mail.co.uk.", "last.one@mail.co.uk", None, ""), ("(github.com/a) tg:@short @other123 tg @abc", None, None, "github https://github.com/a,telegram https://t.me/short"),
    ("12.2020 3-4 1234567890123456-7", None, None, ""),
]


@query("F16", by_hand("email, phone, links", [c[1:] for c in _CONTACTS]))
def contacts_by_hand(t):
    found = C.contacts(t("posting").select("id", pick([c[0] for c in _CONTACTS]).alias("text")), "id", "text")
    return found.select("id", "email", "phone", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["kind"], x["url"])), ",").alias("links"))


RULES = [
    {"id": "r1", "kind": "section_item_count", "severity": "hard", "scope": "any", "section": "Skills", "minimum": 2, "maximum": 3},
    {"id": "r2", "kind": "required_section", "severity": "soft", "scope": "resume", "section": "Education"},
    {"id": "r3", "kind": "required_keyword", "severity": "hard", "scope": "any", "word": "python"},
    {"id": "r4", "kind": "date_format", "severity": "soft", "scope": "any", "pattern": "MM.YYYY"},
    {"id": "r5", "kind": "forbidden_phrase", "severity": "hard", "scope": "any", "word": "Responsible For", "case_sensitive": True},
    {"id": "r6", "kind": "length", "severity": "soft", "scope": "any", "minimum": 10, "maximum": 120},
    {"id": "r7", "kind": "no_links", "severity": "hard", "scope": "any"},
    {"id": "r8", "kind": "no_contact_handles", "severity": "hard", "scope": "any"},
    {"id": "r9", "kind": "required_section", "severity": "hard", "scope": "letter", "section": "Never"},
    {"id": "r10", "kind": "required_section", "severity": "hard", "scope": "any", "section": "Never", "active": False},
]
#: Documents, and the hard and the soft rules that each breaks; written by hand.
_DOCS = [
    ("Skills:\n- Python\n- Spark\nEducation:\n- MSc 09.2020", "", ""),
    ("# Skills\n* Python\nEducation:", "r1", ""),
    ("Python since 2020-09, Responsible For Node.js", "r1,r5", "r2,r4"),
    ("skills:\n1. a\n2) b\n3. c\n- d\nsee example.com or me@x", "r1,r3,r7,r8", "r2"),
    ("x", "r1,r3", "r2,r6"),
    ("Skills:\n- python\n- responsible for www.x\n" + "long " * 30, "r7", "r2,r6"),
]


@query("T06", "SELECT id, hard, soft FROM posting JOIN (VALUES " + ", ".join(f"({i}, '{h}', '{s}')" for i, (_, h, s) in enumerate(_DOCS)) + f") v(k, hard, soft) ON id % {len(_DOCS)} = k")
def rule_engine(t):
    """All eight kinds of rule over résumés; the oracle's verdicts are written by hand."""
    docs = t("posting").select("id", chosen([d for d, *_ in _DOCS], "id").alias("text"))
    return R.broken_rules(docs, "text", RULES, "resume").select("id", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"))


_ROW = "id, title, company, city, country, remote, seniority, salary, salary_max, currency, period, employment_type, language, published, first_seen, score, bucket".split(", ")


@query(
    "P01",
    """WITH s AS (SELECT posting_id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs, arg_min(ext_id, (line, ext_id)) AS first_ext, min(slug) = 'feed_0' AND max(slug) = 'feed_0' AS seed_only FROM provenance GROUP BY posting_id)
    SELECT v.id, title, company, city, country, remote, seniority, CAST(salary AS DOUBLE) AS salary, CAST(salary_max AS DOUBLE) AS salary_max, currency, period, employment_type, language, CAST(published AS VARCHAR) AS published, CAST(first_seen AS VARCHAR) AS first_seen,
        CAST(score AS DOUBLE) AS score, CASE WHEN score >= 85 THEN 'apply' WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'stretch' WHEN score IS NOT NULL THEN 'skip' END AS bucket,
        coalesce(slugs, '') AS slugs, first_ext, coalesce(seed_only, FALSE) AS seed_only, EXISTS (SELECT 1 FROM application a WHERE a.vacancy_id = v.id AND a.status <> 'saved') AS applied
    FROM vacancy v LEFT JOIN s ON s.posting_id = v.id WHERE is_active AND NOT is_spam""",
)
def list_row_full(t):
    """The twenty-one columns that a list shows: four come from the posting's sources and the tracker, each aggregated once."""
    p = t("provenance")
    s = p.groupBy(F.col("posting_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set("slug")), ",").alias("slugs"), F.min(F.struct("line", "ext_id")).getField("ext_id").alias("first_ext"), F.bool_and(F.col("slug") == "feed_0").alias("seed_only")
    )
    applied = t("application").filter("status <> 'saved'").select(F.col("vacancy_id").alias("id")).distinct().withColumn("applied", F.lit(True))
    v = t("vacancy").filter("is_active and not is_spam").withColumn("bucket", O.bucket_of(F.col("score"))).join(s, "id", "left").join(applied, "id", "left")
    as_ = {"salary": "double", "salary_max": "double", "score": "double", "published": "string", "first_seen": "string"}
    columns = [F.col(c).cast(as_[c]).alias(c) if c in as_ else F.col(c) for c in _ROW]
    return v.select(*columns, F.coalesce("slugs", F.lit("")).alias("slugs"), "first_ext", F.coalesce("seed_only", F.lit(False)).alias("seed_only"), F.coalesce("applied", F.lit(False)).alias("applied"))


@query("P08", "SELECT id FROM vacancy WHERE is_active AND country = 'US' AND currency = 'USD' AND remote IN ('full', 'hybrid')")
def filter_country_currency_remote(t):
    v = t("vacancy").withColumn("bucket", O.bucket_of(F.col("score")))
    return O.ListFilter(country="US", currency="USD", remotes=("full", "hybrid")).apply(v).select("id")


@query(
    "P31",
    """SELECT id, title, company FROM vacancy WHERE is_active AND NOT is_spam AND (title ILIKE '%role 1%' OR company ILIKE
    '%role 1%') ORDER BY published DESC NULLS LAST, id LIMIT 20""",
)
def vacancy_picker(t):
    v = O.picker(t("vacancy"), "role 1")
    return v.orderBy(F.col("published").desc_nulls_last(), "id").limit(20).select("id", "title", "company")


@query("O15", "SELECT id FROM vacancy WHERE is_active ORDER BY published DESC NULLS LAST, id DESC LIMIT 500")
def newest_scan(t):
    """The newest five hundred, which is what a truncated scoring pass reads: a top-k, not a sort."""
    return t("vacancy").filter("is_active").orderBy(F.col("published").desc_nulls_last(), F.desc("id")).limit(500).select("id")


@query(
    "A26 A29",
    """SELECT user_id, CAST(min(CASE WHEN turn > 1 THEN event_id END) AS BIGINT) AS first_known, bool_or(kind = 'error') AS failed, max(CASE WHEN kind = 'error' THEN event_id END) AS last_error,
        coalesce(max(CASE WHEN kind = 'error' THEN event_id END) < max(CASE WHEN kind = 'purchase' THEN event_id END), FALSE) AS resolved, min(event_id) AS first_seen, max(event_id) AS last_seen FROM event GROUP BY user_id""",
)
def pooled_signals(t):
    """The first value that any payload states, flags that any sets, and whether what last failed has since been put right."""
    known = F.min(F.when(F.col("turn") > 1, F.col("event_id")))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("event_id")))
    return t("event").groupBy("user_id").agg(
        known.alias("first_known"), F.bool_or(F.col("kind") == "error").alias("failed"), last("error").alias("last_error"), F.coalesce(last("error") < last("purchase"), F.lit(False)).alias("resolved"),
        F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"),
    )
