"""Requirements against documents, and the guards of generated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evidence as E
from .folds import by_hand, pick
from .skills import dictionary

_SPLIT = r"[^\p{L}\p{N}]+"
_ASKS = f"""ask AS (SELECT item_id, word, min(k) AS position FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS k
    FROM (SELECT item_id, list_slice(list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda x: length(x) > 4), 1, 8) AS w FROM benchmark)) GROUP BY item_id, word),
d AS (SELECT doc_id, doc_id % 40 AS item_id, coalesce(text, '') AS text FROM documents)"""


def benchmark_asks(t):
    """The first eight longer words of each item as a list of requirements."""
    w = F.slice(F.filter(F.split(F.lower("text"), _SPLIT), lambda x: F.length(x) > 4), 1, 8)
    each = t("benchmark").select(F.col("item_id").alias("list_id"), F.posexplode(w).alias("position", "name"))
    return each.select("list_id", (F.col("position") + 1).alias("position"), "name", (F.col("position") % 2 == 0).alias("required"), F.lit("employer").alias("source"))


def documents(t):
    return t("documents").select("doc_id", (F.col("doc_id") % 40).alias("list_id"), (F.col("doc_id") % 40).alias("profile_id"), "text")


@query(
    "T03 F17",
    f"""WITH {_ASKS},
    m AS (SELECT doc_id, position, word, text, length(word) % 2 = 0 AS held, '(^|[^\\p{{L}}\\p{{N}}])(' || word || ')($|[^\\p{{L}}\\p{{N}}])' AS p FROM d JOIN ask ON ask.item_id = d.item_id),
    h AS (SELECT *, regexp_matches(text, p, 'i') AS hit FROM m),
    g AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[+#.][\\p{{L}}\\p{{N}}]+|\\+\\+|#)*') AS w FROM d),
    n AS (SELECT doc_id, list_concat(w, {", ".join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in range(2, 6))}) AS phrases FROM g)
    SELECT h.doc_id, position, word AS requirement, CASE WHEN NOT held THEN 'absent' WHEN hit THEN 'present' ELSE 'unstated' END AS status,
    CASE WHEN hit THEN regexp_extract(text, p, 2, 'i') WHEN held THEN list_filter(phrases, lambda x: regexp_replace(lower(x), '[ ._-]+', '', 'g') = word)[1] END AS found_as,
    CASE WHEN held AND NOT hit THEN word END AS held_as FROM h JOIN n ON n.doc_id = h.doc_id""",
)
def requirements_in_documents(t):
    """Each document against the words of one item; the profile holds those of an even number of letters."""
    asks = benchmark_asks(t)
    held = asks.filter(F.length("name") % 2 == 0).select(F.col("list_id").alias("profile_id"), F.col("name").alias("canonical"), F.array().cast("array<string>").alias("spellings")).distinct()
    return E.requirements(documents(t), asks, held, dictionary(t)).select("doc_id", "position", "requirement", "status", "found_as", "held_as")


@query(
    "T09 T10",
    f"""WITH {_ASKS},
    m AS (SELECT doc_id, position, word, length(word) % 3 <> 0 AS held, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || word || '($|[^\\p{{L}}\\p{{N}}_])', 'i') AS hit FROM d JOIN ask ON ask.item_id = d.item_id),
    pick AS (SELECT doc_id, count(*) FILTER (WHERE held AND hit) AS named, count(*) FILTER (WHERE held AND NOT hit) AS unnamed, count(*) FILTER (WHERE NOT held) AS not_held,
    coalesce(string_agg(word, ',' ORDER BY position) FILTER (WHERE NOT held AND hit), '') AS unsupported FROM m GROUP BY doc_id)
    SELECT d.doc_id, coalesce(named, 0) AS named, coalesce(unnamed, 0) AS unnamed, coalesce(not_held, 0) AS not_held, coalesce(unsupported, '') AS unsupported FROM d LEFT JOIN pick ON pick.doc_id = d.doc_id""",
)
def claims_in_documents(t):
    """What each document names of its list: backed up, missed, or claimed without backing."""
    asks, docs = benchmark_asks(t), documents(t)
    traceable = asks.filter(F.length("name") % 3 != 0).select(F.col("list_id").alias("profile_id"), "name")
    n = lambda c: F.size(c).cast("long").alias(c)
    covered = E.coverage(docs, asks, traceable, dictionary(t)).select("doc_id", n("named"), n("unnamed"), n("not_held"))
    return covered.join(E.unsupported(docs, asks, traceable, dictionary(t)).select("doc_id", F.array_join("names", ",").alias("unsupported")), "doc_id")


#: Text, requirements, what the profile holds (name and its own spelling), and by hand the readings: requirement:status:found:held.
_CASES = [
    ("I write C++ and Go.", "C++|C|Go|Google", "C++>|C>|Go>", "C++:present:C++:|C:present:C:|Go:present:Go:|Google:absent::"),
    ("Worked at Google on postgres.", "Go|PostgreSQL|Postgres", "Go>|PostgreSQL>", "Go:unstated::Go|PostgreSQL:unstated:postgres:PostgreSQL"),
    ("CI / CD with Docker\nCompose; no Kafka", "CI/CD|Docker Compose|Kafka", "CI/CD>|Docker Compose>", "CI/CD:present:CI / CD:|Docker Compose:present:Docker\nCompose:|Kafka:absent:Kafka:"),
    ("питон, node js", "Python|Node.js|Rust", "Python>питон|Node.js>", "Python:unstated:питон:питон|Node.js:unstated:node js:Node.js|Rust:absent::"),
    ("x", "  |one two three four five six|Java", "Java>", "one two three four five six:absent::|Java:unstated::Java"),
    ("", "Java", "", "Java:absent::"),
    ("a_Java_b .NET ASP.NET", "Java|NET|ASP.NET", "Java>|ASP.NET>", "Java:present:Java:|NET:absent:NET:|ASP.NET:present:ASP.NET:"),
]


def _case_tables(t):
    s = t.spark
    asks = [(k, n, name, None, None) for k, (_, names, *_) in enumerate(_CASES) for n, name in enumerate(names.split("|"))]
    held = [(k, x.partition(">")[0], [x.partition(">")[2]]) for k, (_, _, have, _) in enumerate(_CASES) for x in have.split("|") if x]
    docs = t("posting").select(F.col("id").alias("doc_id"), (F.col("id") % len(_CASES)).cast("int").alias("list_id"), (F.col("id") % len(_CASES)).cast("int").alias("profile_id"), pick([c[0] for c in _CASES]).alias("text"))
    return docs, s.createDataFrame(asks, "list_id int, position int, name string, required boolean, source string"), s.createDataFrame(held, "profile_id int, canonical string, spellings array<string>")


@query("T03", by_hand("readings", [(c[3],) for c in _CASES]))
def requirements_by_hand(t):
    """Bounds by hand, separators that stand for each other, other spellings, and gaps that a text names."""
    found = E.requirements(*_case_tables(t), dictionary(t))
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws(":", "requirement", "status", blank("found_as"), blank("held_as"))
    return found.groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("x")))), lambda x: x["x"]), "|").alias("readings"))


@query(
    "T09",
    """WITH jobs AS (SELECT posting_id AS id, line AS ref, skill FROM requirement WHERE line <= 3),
    shown AS (SELECT posting_id AS id, CASE WHEN posting_id % 5 = 0 THEN line + 1 ELSE line END AS ref, skill FROM requirement WHERE line <= 3 OR (line = 4 AND posting_id % 7 = 0)),
    j AS (SELECT s.id, bool_or(r.ref IS NULL) AS unknown_job, bool_or(r.ref IS NOT NULL AND k.ref IS NULL) AS foreign_stack FROM shown s LEFT JOIN (SELECT DISTINCT id, ref FROM jobs) r ON r.id = s.id AND r.ref = s.ref
    LEFT JOIN (SELECT DISTINCT id, ref, lower(replace(skill, ' ', '')) AS skill FROM jobs) k ON k.id = s.id AND k.ref = s.ref AND k.skill = lower(replace(s.skill, ' ', '')) GROUP BY s.id),
    c AS (SELECT r.posting_id AS id, bool_or(NOT r.posting_id % 4 <> 1 OR FALSE) AS renamed, count(*) < 6 AND any_value(n) >= 6 AS too_few FROM requirement r JOIN (SELECT posting_id, count(*) AS n FROM requirement GROUP BY 1) h USING (posting_id)
    WHERE line <= 5 GROUP BY r.posting_id)
    SELECT j.id, unknown_job, foreign_stack, renamed, too_few FROM j JOIN c ON c.id = j.id""",
)
def experience_guards(t):
    """Jobs that the profile does not have, stacks of other jobs, skills under another name, and too few of them."""
    r = t("requirement").select(F.col("posting_id").alias("profile_id"), F.col("line").alias("ref"), "skill")
    jobs = r.filter("ref <= 3").select("profile_id", "ref", F.array("skill").alias("stack"))
    ref = F.when(F.col("profile_id") % 5 == 0, F.col("ref") + 1).otherwise(F.col("ref")).alias("ref")
    shown = r.filter("ref <= 3 OR (ref = 4 AND profile_id % 7 = 0)").select(F.col("profile_id").alias("doc_id"), "profile_id", ref, F.array("skill").alias("stack"))
    name = F.when(F.col("profile_id") % 4 == 1, F.concat(F.lit("not "), "skill")).otherwise(F.upper("skill"))
    choices = r.filter("ref <= 5").select(F.col("profile_id").alias("doc_id"), "profile_id", F.col("skill").alias("canonical"), name.alias("shown_as"))
    skills = r.select("profile_id", F.col("skill").alias("canonical"))
    d = dictionary(t)
    both = E.experience_problems(shown, jobs, d).join(E.skill_problems(choices, skills, d).filter("not invented"), "doc_id")
    return both.select(F.col("doc_id").alias("id"), "unknown_job", "foreign_stack", "renamed", "too_few")


_LONG = "We run Python services. " * 9
#: Text, and by hand its problems; the list asks for Python, Kafka and Go, the profile has Python alone.
_DOCUMENTS = [("", "empty"), ("  \n ", "empty"), ("Python.", "too_short"), (_LONG, ""), (_LONG + " And kafka.", "unsupported_claim"), ("Go", "too_short,unsupported_claim"), (_LONG + " At Google.", "")]


@query("T09", by_hand("problems", [(p,) for _, p in _DOCUMENTS]))
def document_problems(t):
    docs = t("posting").select(F.col("id").alias("doc_id"), F.lit(1).alias("list_id"), F.lit(1).alias("profile_id"), pick([x for x, _ in _DOCUMENTS]).alias("text"))
    asks = t.spark.createDataFrame([(1, n, name, True, "employer") for n, name in enumerate(["Python", "Kafka", "Go"])], "list_id int, position int, name string, required boolean, source string")
    traceable = t.spark.createDataFrame([(1, "py")], "profile_id int, name string")
    return E.document_problems(docs, asks, traceable, dictionary(t)).select(F.col("doc_id").alias("id"), F.array_join("problems", ",").alias("problems"))
