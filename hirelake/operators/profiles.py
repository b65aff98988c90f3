"""Profiles and documents: skills of other profiles, merged skills, contacts, dates, coverage, rules, prices."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as X

LEVELS = ("basic", "working", "strong", "expert")


def skills_elsewhere(skills: DataFrame, profiles: DataFrame, profile_id) -> DataFrame:
    """Skills that other profiles list, with the profile and its creation: for each skill the newest profile first."""
    others = skills.filter(F.col("profile_id") != profile_id).join(profiles.select("profile_id", "created_at"), "profile_id")
    return others.select("canonical_name", "profile_id", "created_at")


def merged_skills(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: highest level, most years, latest use, any evidence, unknown only if all are, names in order once."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    names = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, "raw_name"))), lambda x: x["raw_name"]))
    out = df.groupBy(*keys).agg(
        F.max(rank).cast("int").alias("_rank"), F.max("years").alias("years"), F.max("last_used_year").alias("last_used_year"), F.bool_or("corroborated").alias("corroborated"),
        F.bool_and("unknown").alias("unknown"), names.alias("raw_names"),
    )
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("_rank") - 1)
    return out.select(*keys, level.alias("level"), "years", "last_used_year", "corroborated", "unknown", "raw_names")


# Month names by their first three letters.
MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def year_month(token: Column) -> Column:
    """Months since year 0 of a date written as YYYY-MM, MM.YYYY or a month's name and a year; null for anything else."""
    digits = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda x: F.try_to_number(x, F.lit("9999")).cast("int"))
    a, b = F.get(digits, F.lit(0)), F.get(digits, F.lit(1))
    ok = lambda m: (m >= 1) & (m <= 12)
    two = F.when((a > 12) & ok(b), a * 12 + b).when((a <= 12) & (b > 12) & (a >= 1), b * 12 + a)
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.substring(F.lower(F.trim(token)), 1, 3))
    return F.when(F.size(digits) == 2, two).when(F.size(digits) == 1, a * 12 + month)


#: A date as people write it: month and year by numbers either way round, or a month's name and a year.
DATE = r"(?iu)\b(?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}\b|\b(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])\b|\b(?:" + "|".join(MONTHS) + r")[\p{L}]*\.?\s+(?:19|20)[0-9]{2}\b"
#: Headings of a document's sections. Fixed values.
HEADING = r"(?iu)\b(?:experience|employment|work\s+history|education|degree|skills|technical\s+skills|stack)\b|опыт\s+работы|опыт|образование|навыки|стек"


def readable_lines(text: Column, mixed: Column | None = None) -> Column:
    """Lines that a parser files rightly: trimmed, not empty, no mixture of columns, and no heading but at the start."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    if mixed is not None:
        lines = F.filter(lines, lambda x: ~F.array_contains(mixed, x))
    return F.filter(lines, lambda x: ~x.rlike(HEADING) | x.rlike(r"^(?:" + HEADING + ")"))


def recoverable(items: Column, lines: Column) -> Column:
    """total, recovered and the first ten lost of the items that the lines hold, case and blanks apart."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    hay = F.array_join(F.transform(lines, flat), " ")
    named = F.filter(items, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    said = lambda lost: F.struct(F.size(named).alias("total"), (F.size(named) - F.size(lost)).alias("recovered"), F.slice(lost, 1, 10).alias("lost"))
    # bound as the items of arrays of one: the lines are joined once a text, not once an item and use
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return once(hay, lambda h: once(F.filter(named, lambda x: ~F.contains(h, flat(x))), said))


def price(tokens: list[tuple[Column, Column]]) -> Column:
    """Dollars of token counts at prices a million; null where the model has no price."""
    return sum((n * p for n, p in tokens), F.lit(0.0)) / 1_000_000


def pseudo_vector(dim: int):
    """A function of a text column: sha256 of the text expanded into a unit vector, the same for the same text."""

    def one(text):
        if text is None:
            return None
        raw, seed, k = b"", text.encode("utf-8"), 0
        while len(raw) < 4 * dim:
            raw += hashlib.sha256(seed + k.to_bytes(4, "big")).digest()
            k += 1
        v = np.frombuffer(raw[: 4 * dim], ">u4").astype(np.float64) / 2**31 - 1.0
        return (v / np.sqrt((v * v).sum())).tolist()

    @F.pandas_udf(ArrayType(DoubleType()))
    def vector(s: pd.Series) -> pd.Series:
        return s.map(one)

    return vector


# --- document rules ---------------------------------------------------------------------------

NUMERIC_DATE = r"\b(?:\d{1,2}[./-]\d{4}|\d{4}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})\b"
DATE_FORMS = {"MM.YYYY": r"^\d{2}\.\d{4}$", "YYYY-MM": r"^\d{4}-\d{2}$", "DD.MM.YYYY": r"^\d{2}\.\d{2}\.\d{4}$"}
#: A link: an address with its scheme, www, or a bare domain; not the names of technologies that look like one.
LINK = r"(?i)https?://|\bwww\.|\b(?!(?:node|next|vue|react|express|three|d3)\.js\b|asp\.net\b)[a-z0-9-]+\.(?:com|org|net|io|ru|kz|dev|me)\b"
ITEM = r"^\s*(?:[-*•·–]|\d+[.)])\s+"


def sections(text: Column) -> Column:
    """The document's sections in order: heading and number of items. A heading is a line of its own that ends in a colon
    or starts with `#`; items are the list lines up to the next one.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    kind = "struct<title:string,items:int>"

    def step(acc, x):
        head = x.rlike(r"^\s*#+\s*\S") | (x.rlike(r":$") & ~x.rlike(ITEM))
        title = F.lower(F.btrim(F.regexp_replace(x, r"^\s*#+\s*", ""), F.lit(" :")))
        open_ = F.struct(title.alias("title"), F.lit(0).alias("items"))
        last = F.element_at(acc, -1)
        counted = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["title"].alias("title"), (last["items"] + 1).alias("items"))))
        return F.when(head, F.concat(acc, F.array(open_))).when((F.size(acc) > 0) & x.rlike(ITEM), counted).otherwise(acc)

    return F.aggregate(lines, F.array().cast(f"array<{kind}>"), step)


def broken_rules(df: DataFrame, text: str, rules: list[dict], scope: str) -> DataFrame:
    """df with `hard` and `soft`: the ids of the rules of this scope that its text breaks, in the order given.

    A rule is id, kind, severity, scope (or `any`), active, and its kind's parameters. The rules are few and become one
    expression a rule, evaluated beside the text; sections are found once.
    """
    df = df.withColumn("_low", F.lower(text)).withColumn("_sections", sections(F.col(text)))
    c, low = F.col(text), F.col("_low")

    def breaks(r):
        kind = r["kind"]
        if kind in ("section_item_count", "required_section"):
            mine = F.filter("_sections", lambda s: s["title"] == r["section"].lower())
            none = F.size(mine) == 0
            if kind == "required_section":
                return none
            n = F.get(mine, F.lit(0))["items"]
            return none | (n < r.get("minimum", 0)) | (n > r.get("maximum", 1 << 30))
        if kind in ("required_keyword", "forbidden_phrase"):
            word = r["word"] if r.get("case_sensitive") else r["word"].lower()
            has = (c if r.get("case_sensitive") else low).contains(word)
            return ~has if kind == "required_keyword" else has
        if kind == "date_format":
            return F.exists(F.regexp_extract_all(c, F.lit(NUMERIC_DATE), F.lit(0)), lambda d: ~d.rlike(DATE_FORMS[r["pattern"]]))
        if kind == "length":
            return (F.length(c) < r.get("minimum", 0)) | (F.length(c) > r.get("maximum", 1 << 30))
        return c.rlike(LINK) if kind == "no_links" else c.contains("@")

    mine = [r for r in rules if r.get("active", True) and r["scope"] in (scope, "any")]
    found = lambda s: F.array_compact(F.array(*[F.when(breaks(r), r["id"]) for r in mine if r["severity"] == s], F.lit(None).cast("string")))
    return df.withColumn("hard", found("hard")).withColumn("soft", found("soft")).drop("_low", "_sections")
