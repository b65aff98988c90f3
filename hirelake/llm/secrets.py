"""Secret scans: pattern candidates, told apart by how many owners hold the same value across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, text_or_empty, unused

#: kind, pattern, group that holds the value, least length of the value. Fixed values.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\x20\x09-\x0D\\]*(?:[A-Za-z-]+:\x20[^\x20\x09-\x0D\\]*[\x20\x09-\x0D\\]+){0,9}"
#: A key's body with its footer or, where that is missing, the base64 that follows the header: whole lines, and where blanks part
#: them (as in indented lines) up to 60 more runs. Long repeats are of single classes only: Java's patterns recurse on repeated groups.
_BODY = r"([A-Za-z0-9+/=\x20\x09-\x0D\\]+-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/]{16,}[A-Za-z0-9+/=\x0A-\x0D\\]*(?:[\x20\x09]+[A-Za-z0-9+/]{16,}[A-Za-z0-9+/=\x0A-\x0D\\]*){0,60})"
#: Wider candidates that count only where few owners hold the value.
ADDED = [
    ("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("privatekey", _HEAD + _BODY, 1, 27),
]
KINDS = [k for k, *_ in BASE + ADDED]
#: A value is an example where more sources hold it, or two with more texts than these; one owner's key stays live in however many of its texts.
MOST_OWNERS, MOST_REPOSITORIES = 2, 8
#: Values that say of themselves that they are none, and values of fewer distinct characters.
PLACEHOLDER, LEAST_CHARACTERS = r"(?i)example|sample|placeholder|dummy|changeme|change_me|redacted|your[-_.]|x{4}|(?:0123|1234)5678", 2
#: One look over the text decides whether it needs the exact patterns at all.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|eyJ|PRIVATE KEY"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The pattern's leftmost non-overlapping matches with a value of `least` characters or more, as array of
    (start, rank, kind, end, value); offsets are code points, the end exclusive.

    The texts between matches come from a split by the same pattern, so a running sum of lengths gives the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    three = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("whole"), values.alias("value"))
    kind_of = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        kept = F.when(F.length(x["value"]) >= least, F.array(one)).otherwise(F.array().cast(kind_of))
        return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

    walk = F.aggregate(three, F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(kind_of))


def joined(found: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def placeholder(value: Column) -> Column:
    """Whether a value says that it is none, or holds too few distinct characters to be one."""
    distinct = F.size(F.array_remove(F.array_distinct(F.split(value, "")), ""))
    return value.rlike(PLACEHOLDER) | (distinct < LEAST_CHARACTERS)


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source and the candidate spans of each row; value hashes stand for the values."""
    text = text_or_empty()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("owner"), text.alias("text")).withColumn("any", F.col("text").rlike(ANY))
    every = F.concat(*[spans(F.col("text"), *p) for p in BASE + ADDED])
    bare = F.transform(every, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("value"), (~placeholder(x["value"])).alias("real")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,real:boolean>>")
    out = slim.select("doc_id", "owner", F.xxhash64("text").alias("tie"), F.when(F.col("any"), bare).otherwise(none).alias("found"))
    return cut(out.withColumn("rid", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value: the owners and the repositories that hold it, and whether it is few enough to be live.

    An owner is a source, a repository one text of a source: exact copies of a text within a source count once. Both are
    counted over distinct triples, aggregated before each shuffle, so a value copied into a third of all documents does
    not gather in a task. A null owner is one owner.
    """
    held = found.filter(F.size("found") > 0).select("owner", "tie", F.explode("found").alias("f"))
    held = held.select(F.col("f.value").alias("value"), F.coalesce(F.concat(F.lit("s"), "owner"), F.lit("")).alias("owner"), "tie").distinct()
    each = held.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    few = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    return each.withColumn("own", (F.col("owners") == 1) | few)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_added, tie, judged.

    A value is live where one source holds it, in any number of texts, or at most MOST_OWNERS in MOST_REPOSITORIES
    distinct texts, and it does not look like a placeholder; all others are examples. Base matches always stay; a wider candidate (a prefixed key, a
    signed token, a private key's whole block) is added only where its value is live. n_live and n_example count the
    spans by that verdict. `judged` lists the spans with it.

    A null text is empty and has no spans; a null source is one owner; repeated rows each get a row; an empty table
    gives an empty result; texts are scanned whole; further columns are ignored.
    """
    found = candidates(docs)
    own = ownership(found)
    each = found.filter(F.size("found") > 0).select("rid", F.explode("found").alias("f")).withColumn("value", F.col("f.value"))
    each = join_spread(each, own, ["value"], F.col("rid"))
    live = (F.col("own") & F.col("f.real")).alias("live")
    span = F.struct(*[F.col(f"f.{c}").alias(c) for c in ("start", "rank", "kind", "end")], live, F.col("owners"), F.col("repositories"))
    per_row = each.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    kind = "array<struct<start:int,rank:int,kind:string,end:int,live:boolean,owners:bigint,repositories:bigint>>"
    df = found.join(per_row, "rid", "left").withColumn("judged", F.coalesce("judged", F.array().cast(kind)))
    base = F.filter("judged", lambda x: x["rank"] < len(BASE))
    kept = F.filter("judged", lambda x: (x["rank"] < len(BASE)) | x["live"])
    count = lambda a, p: F.size(F.filter(a, p)).cast("long")
    ranked = lambda i: lambda x: x["rank"] == i
    return df.select(
        "doc_id", *[count("judged", ranked(i)).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(kept).alias("spans"),
        count(kept, lambda x: x["live"]).alias("n_live"), count(kept, lambda x: ~x["live"]).alias("n_example"), count(kept, lambda x: x["rank"] >= len(BASE)).alias("n_added"),
        "tie", kept.alias("judged"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking secret replaced by the mark; widely copied examples and clean texts stay as they are.

    Only rows with a live span are joined to their spans; the others pass without a shuffle. n_chars follows the text.
    Further columns may have any name.
    """
    row, judged = unused(docs, "row_", "judged_")
    live = scan(docs).withColumn("judged", F.filter("judged", lambda x: x["live"])).filter(F.size("judged") > 0)
    live = live.groupBy("doc_id", "tie").agg(F.max("judged").alias("judged")).select(F.struct("doc_id", "tie").alias(row), F.col("judged").alias(judged))
    own = docs.columns
    text = text_or_empty()
    suspect = text.rlike(ANY)

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), gap.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1) - acc["at"]))
    clean = F.aggregate(judged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    hit = docs.filter(suspect).withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"))).join(live, row, "left")
    hit = hit.withColumn("text", F.when(F.col(judged).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in own:
        hit = hit.withColumn("n_chars", F.when(F.col(judged).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.filter(~suspect).unionByName(hit.select(*own))
