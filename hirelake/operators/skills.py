"""Skills: the dictionary and its conflicts, canonical names, skills named in prose, requirements, truthfulness."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Markers that decide how a sentence is read.
OPTIONAL = (
    "будет плюсом", "будет большим плюсом", "плюсом будет", "как плюс", "плюсом", "будет преимуществом", "преимуществом",
    "приветствуется", "желательно", "не обязательно", "необязательно", "опционально", "nice to have", "would be a plus",
    "is a plus", "optional",
)
NEGATION = (
    "не требуется", "не требуются", "не нужен", "не нужна", "не нужно", "не нужны", "не рассматриваем", "не важен",
    "не важно", "без знания", "без опыта работы с", "not required", "no need for",
)
MENU = ("not your tech stack", "we'll match you", "we will match you", "match you with a project")
#: Spellings that are words of ordinary prose, those that must be capitalised, and names that need another skill beside them.
NOT_SEARCHED = ("плюсы", "скала", "экспресс", "next", "nest")
CAPITAL_ONLY = ("rest",)
NEEDS_COMPANY = ("c", "go")
SHORT, FIELD_WEIGHT, TEXT_WEIGHT = 2, 1.00, 0.60


def spellings(dictionary: DataFrame) -> DataFrame:
    """dictionary (canonical, group, aliases) as one row for each spelling: canonical, spelling, alias, key."""
    every = F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = dictionary.select("canonical", F.explode(every).alias("spelling"))
    return each.select("canonical", "spelling", (F.col("spelling") != F.col("canonical")).alias("alias"), X.skill_key(F.col("spelling")).alias("key"))


def conflicts(dictionary: DataFrame) -> DataFrame:
    """Keys that more than one skill claims, with the claimants; a dictionary with any must not be used."""
    claims = spellings(dictionary).groupBy("key").agg(F.sort_array(F.collect_set("canonical")).alias("claimants"))
    return claims.filter(F.size("claimants") > 1)


def canonicalise(df: DataFrame, raw: str, dictionary: DataFrame, out: str = "canonical_name") -> DataFrame:
    """df with the canonical name of `raw`: as a canonical name, else as an alias, else by its folded key; null where none fits.

    The dictionary is small and is broadcast; of each lookup key it holds one row, as it has no conflicts.
    """
    s = spellings(dictionary)
    one = lambda rows, key, name: F.broadcast(rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.min("canonical").alias(f"_by_{name}")))
    text = F.trim(raw)
    df = df.withColumn("_canonical", text).withColumn("_alias", text).withColumn("_key", X.skill_key(F.col(raw)))
    df = df.join(one(s.filter("not alias"), "spelling", "canonical"), "_canonical", "left")
    df = df.join(one(s.filter("alias"), "spelling", "alias"), "_alias", "left").join(one(s, "key", "key"), "_key", "left")
    found = F.when(text != "", F.coalesce("_by_canonical", "_by_alias", "_by_key"))
    return df.withColumn(out, found).drop("_canonical", "_alias", "_key", "_by_canonical", "_by_alias", "_by_key")


def fold(df: DataFrame, raw: str, dictionary: DataFrame, out: str) -> DataFrame:
    """The key that two spellings of one skill share: the canonical name's, or that of the spelling itself."""
    df = canonicalise(df, raw, dictionary, "_name")
    return df.withColumn(out, X.skill_key(F.coalesce("_name", F.trim(raw)))).drop("_name")


class Lexicon:
    """The dictionary as one pattern and one lookup, for reading prose. It is read to the driver: a few thousand spellings."""

    def __init__(self, dictionary: DataFrame, most: int = 50_000):
        rows = spellings(dictionary).filter(~F.lower("spelling").isin(*NOT_SEARCHED)).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} spellings")
        if conflicts(dictionary).take(1):
            raise ValueError("two skills claim one spelling")
        self.canonical = {r["key"]: r["canonical"] for r in rows}
        self.length = {r["key"]: len(r["spelling"]) for r in rows}
        glue = lambda s: r"[\s._\-]+".join(re.escape(p) for p in re.split(r"[\s._\-]+", s.lower()) if p)
        ordered = sorted({r["spelling"].lower() for r in rows}, key=lambda s: (-len(s), s))
        edge = r"[\p{L}\p{N}+#]"
        self.pattern = rf"(?iu)(?<!{edge})(?:{'|'.join(glue(s) for s in ordered)})(?!{edge})"

    def map(self, values: dict) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def _has(sentence: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(sentence)
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def without_menus(text: Column) -> Column:
    """The text with every line blanked that offers other roles."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(_has(F.translate(x, "’", "'"), MENU), "").otherwise(x)), "\n")


def skills_in_text(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """df with `required`, `optional` and `negated`: the skills its text names, each under its strongest reading, in order.

    All within the row: the text becomes sentences, each sentence its matches of the lexicon, longest spelling first.
    Short and ambiguous spellings count only with a capital; a name that is also a word needs another skill beside it, or
    a longer spelling of itself. A sentence with a denial and no softener denies its skills; one with a softener makes
    them optional; any other requires them.
    """
    names, lengths = lexicon.map(lexicon.canonical), lexicon.map(lexicon.length)

    def believed(m):
        key = X.skill_key(m)
        short = (F.try_element_at(lengths, key) <= SHORT) | key.isin(*CAPITAL_ONLY)
        return ~short | (m != F.lower(m))

    def found(sentence):
        written = F.filter(F.regexp_extract_all(sentence, F.lit(lexicon.pattern), F.lit(0)), believed)
        return F.struct(sentence.alias("s"), F.transform(F.transform(written, lambda m: X.skill_key(m)), lambda k: F.struct(F.try_element_at(names, k).alias("name"), (F.try_element_at(lengths, k) > SHORT).alias("long"))).alias("f"))

    def named(x):
        return F.struct(x["s"].alias("s"), F.array_distinct(x["f"]["name"]).alias("some"), F.filter(x["f"], lambda f: f["long"])["name"].alias("long"))

    def read(x):
        kept = F.filter(x["some"], lambda n: ~F.lower(n).isin(*NEEDS_COMPANY) | F.array_contains(x["long"], n) | (F.size(x["some"]) > 1))
        how = F.when(_has(x["s"], OPTIONAL), "optional").when(_has(x["s"], NEGATION), "negated").otherwise("required")
        return F.struct(kept.alias("names"), how.alias("how"))

    plain = X.plain_text(F.coalesce(F.col(text), F.lit("")))
    each = F.filter(F.transform(X.sentences(without_menus(plain)), found), lambda x: F.size(x["f"]) > 0)
    df = df.withColumn("_read", F.transform(F.transform(each, named), read))
    of = lambda how: F.array_distinct(F.flatten(F.transform(F.filter("_read", lambda r: r["how"] == how), lambda r: r["names"])))
    df = df.withColumn("required", of("required")).withColumn("optional", F.array_except(of("optional"), "required"))
    return df.withColumn("negated", F.array_except(F.array_except(of("negated"), F.col("required")), F.col("optional"))).drop("_read")


def requirements(stated: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """One row for each (key, skill): the employer's own list (`skills`) at full weight wins over what the text says.

    A row of either table holds its arrays in order. Columns key, canonical_name, is_required, weight, source.
    """
    row = lambda source, weight, needed: (F.lit(source).alias("source"), F.lit(weight).cast("decimal(3,2)").alias("weight"), F.lit(needed).alias("is_required"))
    field = stated.select(key, F.explode(F.array_distinct("skills")).alias("canonical_name"), F.lit(0).alias("rank"), *row("employer_field", FIELD_WEIGHT, True))
    needed = read.select(key, F.explode("required").alias("canonical_name"), F.lit(1).alias("rank"), *row("description_text", TEXT_WEIGHT, True))
    nice = read.select(key, F.explode("optional").alias("canonical_name"), F.lit(1).alias("rank"), *row("description_text", TEXT_WEIGHT, False))
    every = field.unionByName(needed).unionByName(nice)
    best = F.min(F.struct("rank", "source", "weight", (~F.col("is_required")).alias("nice"))).alias("b")
    return every.groupBy(key, "canonical_name").agg(best).select(key, "canonical_name", (~F.col("b.nice")).alias("is_required"), "b.weight", "b.source")


def named_skills(df: DataFrame, key: str, text: str, dictionary: DataFrame, most_words: int = 3) -> DataFrame:
    """key and canonical_name of the skills that a text names, by its runs of one to three words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}+#]+"), lambda w: w != "")

    def grams(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), ""))
        return F.when(F.size("_w") >= n, runs).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, most_words + 1)])))
    each = df.withColumn("_w", words).select(key, F.explode(every).alias("key"))
    names = F.broadcast(spellings(dictionary).select("key", F.col("canonical").alias("canonical_name")).distinct())
    return each.join(names, "key").select(key, "canonical_name").distinct()


def untruthful(named: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Named skills that the holder does not have."""
    return named.join(held, by, "left_anti")
