"""Skills in prose: dictionary, canonical names, extraction, requirements, truthfulness of rules and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import skills as K

#: A small dictionary: canonical name, group, aliases.
DICTIONARY = [
    ("Python", "language", ["py", "питон"]), ("Go", "language", ["Golang"]), ("C", "language", []), ("C++", "language", ["плюсы", "cpp"]),
    ("PostgreSQL", "database", ["postgres", "psql"]), ("Docker Compose", "tool", ["docker-compose"]), ("Docker", "tool", []), ("REST", "api", ["restful"]),
    ("Node.js", "runtime", ["node js", "nodejs"]), ("Kafka", "queue", ["Apache Kafka"]), ("Java", "language", []), ("NextJS", "framework", ["next", "Next.js"]),
]

#: Descriptions and what a reader takes from them: text, required, optional, negated. Written by hand from the rules.
READINGS = [
    ("Нужен Python и Docker. Kafka будет плюсом.", "Python,Docker", "Kafka", ""),
    ("Опыт с Java не требуется; пишем на Go (Golang).", "Go", "", "Java"),
    ("We use node js. The rest of the team likes C-level talks.", "Node.js", "", ""),
    ("C/C++ и REST. Права категории C.", "C,C++,REST", "", ""),
    ("Next steps: read about Next.js 500 py", "NextJS", "", ""),
    ("Not your tech stack? Python, Java, Kafka\nPostgres required", "PostgreSQL", "", ""),
    ("<p>Docker&amp;Compose</p><ul><li>docker-compose</li><li>Java optional</li></ul>", "Docker,Docker Compose", "Java", ""),
    ("Python is a plus. Python обязателен! Java not required", "Python", "", "Java"),
    ("идти в ногу, 500 мл, go home", "", "", ""),
    ("Apache Kafka • PostgreSQL; psql не обязательно", "Kafka,PostgreSQL", "", ""),
    ("", "", "", ""),
]


def _values(rows) -> str:
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def dictionary(t):
    return t.spark.createDataFrame(DICTIONARY, "canonical string, group string, aliases array<string>")


def descriptions(t):
    """A description for each posting, chosen by its id."""
    texts = F.array(*[F.lit(x[0]) for x in READINGS])
    return t("posting").select("id", F.element_at(texts, (F.col("id") % len(READINGS) + 1).cast("int")).alias("text"))


_READ = f"(SELECT p.id, r.* FROM posting p JOIN (SELECT * FROM {_values([(i, *r[1:]) for i, r in enumerate(READINGS)])} v(k, required, optional, negated)) r ON p.id % {len(READINGS)} = r.k)"


@query("T01 F08 U04 U05", f"SELECT id, required, optional, negated FROM {_READ}")
def skill_extraction(t):
    """The oracle's readings are written by hand; the engine reads the text."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return K.skills_in_text(descriptions(t), "text", K.Lexicon(dictionary(t))).select("id", joined("required"), joined("optional"), joined("negated"))


#: The employer's own list by id, over which the text's findings come second.
_STATED = ["Python", "Kafka"]


@query(
    "T02 A33",
    f"""WITH r AS (SELECT * FROM {_READ}),
    e AS (SELECT id, unnest(string_split(required, ',')) AS s, TRUE AS need FROM r WHERE required <> '' UNION ALL SELECT id, unnest(string_split(optional, ',')), FALSE FROM r WHERE optional <> ''),
    f AS (SELECT id, s FROM posting, (VALUES ('Python'), ('Kafka')) v(s) WHERE id % 3 = 0),
    m AS (SELECT id, s, 1 AS w, TRUE AS need FROM f UNION ALL SELECT id, s, 0, need FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = e.id AND f.s = e.s))
    SELECT id, count(*) FILTER (WHERE w = 1) AS from_field, count(*) FILTER (WHERE w = 0) AS from_text, bool_and(w = 0) AS rescued,
        CAST(sum(CASE w WHEN 1 THEN 1.00 ELSE 0.60 END) AS DOUBLE) AS weight, count(*) FILTER (WHERE need) AS required FROM m GROUP BY id""",
)
def requirement_assembly(t):
    """The employer's field first, the text second; counted by provenance. A posting is rescued where only its text names skills."""
    read = K.skills_in_text(descriptions(t), "text", K.Lexicon(dictionary(t))).select("id", "required", "optional")
    stated = t("posting").filter("id % 3 = 0").select("id", F.array(*[F.lit(s) for s in _STATED]).alias("skills"))
    field = F.col("source") == "employer_field"
    return K.requirements(stated, read, "id").groupBy("id").agg(
        F.count_if(field).alias("from_field"), F.count_if(~field).alias("from_text"), F.bool_and(~field).alias("rescued"),
        F.sum("weight").cast("double").alias("weight"), F.count_if("is_required").alias("required"),
    )


@query(
    "S15",
    f"""WITH d AS (SELECT * FROM {_values([(c, a) for c, _, x in DICTIONARY for a in [c, *x]])} v(canonical, spelling) UNION ALL SELECT p_name, p_brand FROM part UNION ALL SELECT p_name, p_name FROM part)
    SELECT regexp_replace(lower(trim(spelling)), '[ ._-]+', '', 'g') AS key, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS claimants
    FROM d GROUP BY 1 HAVING count(DISTINCT canonical) > 1""",
)
def dictionary_conflicts(t):
    """The part table as a dictionary whose aliases, the brands, are claimed by many names."""
    parts = t("part").groupBy(F.col("p_name").alias("canonical")).agg(F.lit("part").alias("group"), F.collect_set("p_brand").alias("aliases"))
    return K.conflicts(dictionary(t).unionByName(parts)).select("key", F.array_join("claimants", "|").alias("claimants"))


_RAW = ["Python", " py ", "POSTGRES", "node js", "NODE.JS", "golang", "Golang", "docker compose", "Cobol-85", "", "C", "c", "плюсы"]
_NAMES = ["Python", "Python", "PostgreSQL", "Node.js", "Node.js", "Go", "Go", "Docker Compose", None, None, "C", "C", "C++"]


@query(
    "J13 F03",
    "SELECT p.id, r.raw, r.name, coalesce(r.folded, '') AS folded FROM posting p JOIN (VALUES "
    + ", ".join(
        f"({i}, '{raw}', " + (f"'{n}'" if n else "NULL") + ", '" + (n or raw.strip()).lower().replace(" ", "").replace(".", "").replace("-", "") + "')" for i, (raw, n) in enumerate(zip(_RAW, _NAMES, strict=True))
    )
    + f") r(k, raw, name, folded) ON p.id % {len(_RAW)} = r.k",
)
def canonical_three_pass(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("id") % len(_RAW) + 1).cast("int"))
    df = K.canonicalise(t("posting").select("id", raw.alias("raw")), "raw", dictionary(t), "name")
    return K.fold(df, "raw", dictionary(t), "folded")


@query(
    "F23",
    """SELECT c_custkey, lower(trim(string_split(s, '—')[1])) AS language, upper(trim(string_split(s, '—')[2])) AS level
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Казахский — b2 — Средне-продвинутый' WHEN 1 THEN 'English — C1' WHEN 2 THEN 'Deutsch' ELSE ' — A1' END AS s FROM customer)
    WHERE len(string_split(s, '—')) >= 2 AND trim(string_split(s, '—')[1]) <> '' AND trim(string_split(s, '—')[2]) <> ''""",
)
def language_strings(t):
    """`name — LEVEL — label`: the first two parts, where both are there."""
    stated = F.element_at(F.array(F.lit("Казахский — b2 — Средне-продвинутый"), F.lit("English — C1"), F.lit("Deutsch"), F.lit(" — A1")), (F.col("c_custkey") % 4 + 1).cast("int"))
    parts = F.transform(F.split(stated, "—"), lambda x: F.trim(x))
    df = t("customer").select("c_custkey", parts.alias("p")).filter("size(p) >= 2 and p[0] <> '' and p[1] <> ''")
    return df.select("c_custkey", F.lower(F.col("p")[0]).alias("language"), F.upper(F.col("p")[1]).alias("level"))


@query(
    "F04 F05",
    """SELECT p_name AS raw, substr(lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')), 1, 100) AS folded,
        coalesce(nullif(trim(regexp_replace(replace(replace(lower(p_name), 'ü', 'u-'), 'ï', 'i-'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug, count(*) AS n FROM
        (SELECT CASE p_partkey % 5 WHEN 0 THEN 'Ünïcode  ' || p_name WHEN 1 THEN 'Приём' WHEN 2 THEN '--' ELSE p_name END AS p_name FROM part) GROUP BY ALL""",
)
def name_folding(t):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("Ünïcode  "), "p_name")).when(k == 1, "Приём").when(k == 2, "--").otherwise(F.col("p_name"))
    names = t("part").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return names.select("raw", X.readable(F.col("raw")).alias("folded"), X.slug(F.col("raw")).alias("slug"), "n")


# How a Cyrillic letter is spelled in Latin ones.
_LATIN = {"щ": "shch", "ж": "zh", "ч": "ch", "ш": "sh", "ю": "yu", "я": "ya", "х": "kh", "ц": "ts", "ё": "e"}
_SINGLE = ("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")


def latin(c):
    """Cyrillic letters in Latin ones: two or more for some, none for the signs."""
    c = F.lower(c)
    for a, b in _LATIN.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(F.regexp_replace(c, "[ъь]", ""), *_SINGLE)


_ROLES = ["Программист", "Щётка и хлеб", "data engineer", "Медсестра в Юрге", "QA"]
_TERMS = ["programm", "qa", "engineer", "ai"]


@query(
    "F09 P35",
    "SELECT p.id, r.slug, r.relevant FROM posting p JOIN (VALUES (0, 'programmist', TRUE), (1, 'shchetka i khleb', FALSE), (2, 'data engineer', TRUE), (3, 'medsestra v yurge', FALSE), (4, 'qa', TRUE)) r(k, slug, relevant) ON p.id % 5 = r.k",
)
def role_relevance(t):
    """A term of under four letters must be a word of the slug; a longer one may be part of one."""
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("id") % 5 + 1).cast("int"))
    df = t("posting").select("id", latin(role).alias("slug"))
    terms = F.array(*[F.lit(x) for x in _TERMS])
    hit = F.exists(terms, lambda x: F.when(F.length(x) < 4, F.array_contains(F.split("slug", "[^a-z0-9]+"), x)).otherwise(F.contains(F.col("slug"), x)))
    return df.select("id", "slug", hit.alias("relevant"))


@query(
    "T07",
    """SELECT p.id, r.s AS canonical_name FROM posting p JOIN (VALUES (0, 'Python'), (0, 'Docker Compose'), (1, 'Kafka'), (1, 'Java'), (2, 'Node.js')) r(k, s) ON p.id % 4 = r.k
    WHERE NOT (p.id % 2 = 0 AND r.s = 'Python' OR p.id % 3 = 0 AND r.s = 'Kafka')""",
)
def rule_truthfulness(t):
    """Skills that a rule's wording names and its profile does not hold."""
    rules = ["mention python and docker compose", "always Apache Kafka, never plain java", "Node JS first", "be polite"]
    k = F.col("id") % 4
    df = t("posting").select("id", F.element_at(F.array(*[F.lit(x) for x in rules]), (k + 1).cast("int")).alias("rule"))
    named = K.named_skills(df, "id", "rule", dictionary(t)).filter("not (canonical_name = 'Docker' and id % 4 = 0)")
    held = t("posting").select("id", F.explode(F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "Python"), F.when(F.col("id") % 3 == 0, "Kafka")))).alias("canonical_name"))
    return K.untruthful(named, held, ["id", "canonical_name"])


@query(
    "T09",
    """WITH doc AS (SELECT DISTINCT posting_id AS id, skill FROM requirement WHERE line <= 3),
    own AS (SELECT DISTINCT posting_id AS id, skill, family FROM requirement WHERE held OR line > 2)
    SELECT d.id, count(*) FILTER (WHERE o.id IS NULL AND f.id IS NULL) AS invented, count(*) FILTER (WHERE o.id IS NULL AND f.id IS NOT NULL) AS renamed
    FROM doc d LEFT JOIN (SELECT DISTINCT id, skill FROM own) o ON o.id = d.id AND o.skill = d.skill
    LEFT JOIN (SELECT DISTINCT id, lower(replace(skill, ' ', '')) AS k FROM (SELECT id, skill FROM own UNION ALL SELECT id, family FROM own)) f ON f.id = d.id AND f.k = lower(replace(d.skill, ' ', ''))
    GROUP BY d.id""",
)
def document_guards(t):
    """A document's skills against its profile's: invented where no fold of them is held, renamed where one is."""
    r = t("requirement")
    doc = r.filter("line <= 3").select(F.col("posting_id").alias("id"), "skill").distinct()
    own = r.filter("held or line > 2").select(F.col("posting_id").alias("id"), "skill", "family")
    exact = own.select("id", "skill").distinct().withColumn("same", F.lit(True))
    key = F.lower(F.regexp_replace("skill", " ", ""))
    folded = own.select("id", "skill").unionByName(own.select("id", F.col("family").alias("skill"))).select("id", key.alias("key")).distinct().withColumn("near", F.lit(True))
    d = doc.withColumn("key", key).join(exact, ["id", "skill"], "left").join(folded, ["id", "key"], "left")
    return d.groupBy("id").agg(F.count_if(F.col("same").isNull() & F.col("near").isNull()).alias("invented"), F.count_if(F.col("same").isNull() & F.col("near").isNotNull()).alias("renamed"))
