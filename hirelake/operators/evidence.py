"""What a document says of the skills that are asked for, and what it may not say."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .skills import fold, spellings

#: A word of a skill's name, and how many of them a phrase may have. Fixed values.
WORD, MOST_WORDS = r"[^\W_]+(?:[+#.][^\W_]+|\+\+|#)*", 5
_WORD = re.compile(WORD)
#: Letters that match i or s in any case and are not lowered to it alone.
_ODD = re.compile("[\u0130\u0131\u017f]")
LEAST_SKILLS, MOST_SUMMARY, LEAST_DOCUMENT = 6, 600, 180


def mention(name: Column) -> Column:
    """The pattern of a name as a word: as it is written, in any case, with no word character on either side."""
    quoted = F.replace(F.trim(name), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?iU)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)"))


@lru_cache(4096)
def _filter(name: str) -> re.Pattern | None:
    """The pattern of a keyword filter: the name's words in any case, up to three characters of blanks and marks between
    them, with no letter or digit on either side; None for a name without words or with too many.

    The bounds are made by hand, as a word bound stands between C and +.
    """
    parts = _WORD.findall(name)
    if not 1 <= len(parts) <= MOST_WORDS:
        return None
    return re.compile(r"(?<![^\W_])(?:" + r"[\s\W_]{0,3}".join(map(re.escape, parts)) + r")(?![^\W_])", re.I)


def _hit(name: str, text: str, low: str | None) -> re.Match | None:
    """The filter's first hit. Where `low` is the text in lower case, place by place, and the name is ASCII, only places of its first word are tried."""
    pattern = _filter(name)
    if pattern is None or low is None or not name.isascii():
        return pattern and pattern.search(text)
    first = _WORD.search(name)[0].lower()
    at = low.find(first)
    while at >= 0 and not (found := pattern.match(text, at)):
        at = low.find(first, at + 1)
    return found if at >= 0 else None


def _phrase(words: list[str], folded: list[str], keys: set[str]) -> str | None:
    """The first phrase, of the fewest words, whose folded spelling is one of the keys. Of a key only beginnings are followed."""
    best = None
    for at, start in enumerate(folded):
        for key in keys:
            size, rest = 1, key
            while size <= MOST_WORDS and at + size <= len(folded) and rest.startswith(folded[at + size - 1]):
                rest = rest[len(folded[at + size - 1]) :]
                if not rest and start:
                    best = min(best, (size, at)) if best else (size, at)
                    break
                size += 1
    return " ".join(words[best[1] : best[1] + best[0]]) if best else None


READ = "doc_id long, position int, requirement string, status string, found_as string, held_as string, required boolean, source string"


def _read(batches):
    """Each document's few requirements against its text: one pass for its words, and one search for each name."""
    for rb in batches:
        out = []
        for doc, text, asked in zip(*[rb.column(c).to_pylist() for c in ("doc_id", "text", "asked")], strict=True):
            words = folded = joined = None
            low = None if _ODD.search(text) else text.lower()
            for a in asked:
                hit = _hit(a["name"], text, low)
                held, found = a["held_as"], hit[0] if hit else None
                if held is not None and hit is None:
                    if words is None:
                        words = _WORD.findall(text)
                        folded = [w.lower().replace(".", "") for w in words]  # of blanks and marks a word has dots alone
                        joined = "".join(folded)
                    found = _phrase(words, folded, {k for k in a["keys"] if k in joined})
                status = "absent" if held is None else "present" if hit else "unstated"
                out.append((doc, a["position"], a["name"], status, found, held if status == "unstated" else None, True if a["required"] is None else a["required"], a["source"] or "employer"))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def _keys(dictionary: DataFrame) -> DataFrame:
    """For each skill's key, the keys of all its spellings; a small table, as the dictionary is."""
    s = spellings(dictionary).withColumn("of", X.skill_key(F.col("canonical")))
    return F.broadcast(s.groupBy(F.col("of").alias("key")).agg(F.collect_set("key").alias("keys")))


def _asked(docs: DataFrame, asks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, profile_id and each requirement of the document's list once, with its key; spellings of one skill are one requirement, the first."""
    named = asks.withColumn("name", F.trim("name")).filter("name <> ''")
    named = fold(named, "name", dictionary, "key").filter("key <> ''")
    first = named.groupBy("list_id", "key").agg(F.min(F.struct("position", "name", "required", "source")).alias("a")).select("list_id", "key", "a.*")
    return docs.select("doc_id", "list_id", "profile_id").join(first, "list_id")


def _held(held: DataFrame, dictionary: DataFrame) -> DataFrame:
    """profile_id, key, spelling: what each profile holds by the key of any of its names, called as its owner does."""
    own = F.coalesce(F.get(F.filter("spellings", lambda x: F.trim(x) != ""), F.lit(0)), F.col("canonical"))
    each = held.select("profile_id", own.alias("spelling"), F.explode(F.array_union(F.array("canonical"), F.coalesce("spellings", F.array().cast("array<string>")))).alias("name"), F.col("canonical"))
    each = fold(each, "name", dictionary, "key").filter("key <> ''")
    return each.groupBy("profile_id", "key").agg(F.min(F.struct("canonical", "spelling")).getField("spelling").alias("held_as"))


def requirements(docs: DataFrame, asks: DataFrame, held: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, position, requirement, status, found_as, held_as, required, source: each document against its list of requirements.

    docs: doc_id, list_id, profile_id, text. asks: list_id, position, name, required, source. held: profile_id,
    canonical, spellings. present: held, and the text names it as a keyword filter reads it. unstated: held, but named
    otherwise or not at all; found_as is the other spelling. absent: not held, whatever the text says, as a letter may
    name what its writer lacks; found_as is then the filter's hit.

    The lists meet the holdings without the texts; a text is read once, in an Arrow batch, against its own few requirements.
    """
    pairs = docs.groupBy("list_id", "profile_id").agg(F.min(F.struct("list_id", "profile_id")).alias("doc_id"))  # the same requirements for all documents of a pair
    asked = _asked(pairs, asks, dictionary).join(_held(held, dictionary), ["profile_id", "key"], "left").join(_keys(dictionary), "key", "left")
    asked = asked.withColumn("keys", F.array_union(F.array("key"), F.coalesce("keys", F.array().cast("array<string>"))))
    lists = asked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), "name", "required", "source", "held_as", "keys"))).alias("asked"))
    both = docs.select("doc_id", "list_id", "profile_id", F.coalesce("text", F.lit("")).alias("text")).join(lists.select("doc_id.*", "asked"), ["list_id", "profile_id"], "left").filter("asked is not null")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "asked").mapInArrow(_read, READ)


def unsupported(docs: DataFrame, asks: DataFrame, traceable: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, names: requirements that the text mentions and the profile (traceable: profile_id, name) cannot back up, in the list's order; all documents."""
    known = fold(traceable.select("profile_id", "name"), "name", dictionary, "key").select("profile_id", "key").distinct()
    asked = _asked(docs, asks, dictionary).join(known, ["profile_id", "key"], "left_anti")
    lists = asked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("asked"))
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", text.alias("text")).join(lists, "doc_id", "left")
    names = F.transform(F.filter("asked", lambda a: F.call_function("regexp_like", F.col("text"), mention(a["name"]))), lambda a: a["name"])
    return both.select("doc_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))


def coverage(docs: DataFrame, asks: DataFrame, covered: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, named, unnamed, not_held: the list's requirements that the text mentions, that it could and does not, and that the profile lacks."""
    known = fold(covered.select("profile_id", "name"), "name", dictionary, "key").select("profile_id", "key").distinct().withColumn("held", F.lit(True))
    asked = _asked(docs, asks, dictionary).join(known, ["profile_id", "key"], "left")
    lists = asked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "name", "held"))).alias("asked"))
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lists, "doc_id", "left")
    judged = F.transform("asked", lambda a: F.struct(a["name"].alias("name"), F.when(a["held"].isNull(), "not_held").when(F.call_function("regexp_like", F.col("text"), mention(a["name"])), "named").otherwise("unnamed").alias("as")))
    part = lambda k: F.coalesce(F.transform(F.filter(judged, lambda x: x["as"] == k), lambda x: x["name"]), F.array().cast("array<string>")).alias(k)
    return both.select("doc_id", part("named"), part("unnamed"), part("not_held"))


def experience_problems(shown: DataFrame, jobs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, unknown_job, foreign_stack: jobs shown (doc_id, profile_id, ref, stack) that the profile (profile_id, ref, stack)
    does not have, and technologies that it records for another job or none.
    """
    refs = jobs.select("profile_id", "ref").distinct().withColumn("known", F.lit(True))
    own = fold(jobs.select("profile_id", "ref", F.explode("stack").alias("name")), "name", dictionary, "key").select("profile_id", "ref", "key").distinct().withColumn("recorded", F.lit(True))
    each = fold(shown.select("doc_id", "profile_id", "ref", F.explode_outer("stack").alias("name")), "name", dictionary, "key")
    each = each.join(refs, ["profile_id", "ref"], "left").join(own, ["profile_id", "ref", "key"], "left")
    foreign = F.col("known").isNotNull() & F.col("name").isNotNull() & F.col("recorded").isNull()
    return each.groupBy("doc_id").agg(F.bool_or(F.col("known").isNull()).alias("unknown_job"), F.bool_or(foreign).alias("foreign_stack"))


def skill_problems(choices: DataFrame, skills: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, invented, renamed, too_few: skills shown (doc_id, profile_id, canonical, shown_as) that the profile lacks, or that
    are shown under the name of another; too few of them where the profile has enough.
    """
    own = fold(skills.select("profile_id", "canonical"), "canonical", dictionary, "key").filter("key <> ''").select("profile_id", "key").distinct().withColumn("held", F.lit(True))
    enough = skills.groupBy("profile_id").agg(F.count("*").alias("has"))
    each = fold(fold(choices, "canonical", dictionary, "key"), "shown_as", dictionary, "as_key").join(own, ["profile_id", "key"], "left").join(enough, "profile_id", "left")
    renamed = F.col("held").isNotNull() & (F.col("as_key") != F.col("key"))
    few = (F.count("*") < LEAST_SKILLS) & (F.coalesce(F.max("has"), F.lit(0)) >= LEAST_SKILLS)
    return each.groupBy("doc_id").agg(F.bool_or(F.col("held").isNull()).alias("invented"), F.bool_or(renamed).alias("renamed"), few.alias("too_few"))


def document_problems(docs: DataFrame, asks: DataFrame, traceable: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, problems: empty alone, else too_short and unsupported_claim; a summary is held by `summary_problem`."""
    named = unsupported(docs, asks, traceable, dictionary)
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    both = docs.select("doc_id", F.length(body).alias("n")).join(named, "doc_id")
    found = F.array_compact(F.array(F.when(F.col("n") < LEAST_DOCUMENT, "too_short"), F.when(F.size("names") > 0, "unsupported_claim")))
    return both.select("doc_id", F.when(F.col("n") == 0, F.array(F.lit("empty"))).otherwise(found).alias("problems"))


def summary_problem(summary: Column) -> Column:
    return F.coalesce(F.length(summary) > MOST_SUMMARY, F.lit(False))
