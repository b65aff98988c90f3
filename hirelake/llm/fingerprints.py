"""Bottom-k fingerprints of documents: the k least hashes of their five-word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import text_or_empty

K = 128
SPACES = r"[\x20\x09-\x0D]+"


def sketch(text: Column, k: int = K, width: int = 5) -> Column:
    """The k least distinct hashes of the text's shingles of `width` words in lower case, ascending, as array<bigint>.

    A text of one to four words is one shingle; a text without words has an empty sketch.
    """
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))

    def least(words: Column) -> Column:
        spans = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
        hashed = F.transform(spans, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(-1, width - 1)]))
        return F.slice(F.sort_array(F.array_distinct(hashed)), 1, k)

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(let(F.split(bare, SPACES), least))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for: associative and commutative."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold. Two empty sketches have 1."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, 1.0).otherwise(both / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, k).cast("double") + 9223372036854775808.0) / 18446744073709551616.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def with_next(docs: DataFrame, order: str, tie: str, carried: list[str], per_bucket: int = 512, most_buckets: int = 65_536) -> DataFrame:
    """docs with next_<c> for each carried column: the values of the row that follows in descending `order`, then `tie`.

    The last row is followed by the first. Rows are dealt into ranges of `order` (bounds from one approximate-quantile
    aggregate), as many as the rows ask for; a value of `order` that fills more than its range is dealt on by `tie`, a
    hash. The first row of each range is also sent to the range before it, so that every row has its follower at hand.
    Rows without an order come last. Repeated rows follow one another.
    """
    docs = docs.withColumn("_at", F.coalesce(F.col(order), F.lit(-(2**63))))
    n = docs.count()
    buckets = max(1, min(most_buckets, -(-n // per_bucket)))
    bounds: list[int] = []
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(docs.agg(F.percentile_approx("_at", probs, max(100_000, 8 * buckets))).first()[0]))
    docs = docs.withColumn("_range", len(bounds) - _bounds_up_to(F.col("_at"), bounds))
    ranges = docs.groupBy("_range").agg(F.max("_at").alias("first"), F.min("_at").alias("last"), F.count("*").alias("n")).collect()  # most_buckets rows at most
    parts, start, at_first, total = {}, {}, {}, 0
    for r in sorted(ranges, key=lambda r: r["_range"]):
        parts[r["_range"]] = -(-r["n"] // per_bucket) if r["first"] == r["last"] and r["n"] > 2 * per_bucket else 1
        start[r["_range"]] = total
        total += parts[r["_range"]]
        at_first[start[r["_range"]]] = (r["first"], None)
    of = F.get(_literal(_spread(parts, len(bounds) + 1)), F.col("_range"))
    place = (F.col(tie).cast("double") / 2.0**64 + 0.5) * of
    within = F.when(of > 1, of - 1 - F.least(of - 1, F.floor(place))).otherwise(0)
    docs = docs.withColumn("_bucket", (F.get(_literal(_spread(start, len(bounds) + 1)), F.col("_range")) + within).cast("int"))
    split = [r for r, k in parts.items() if k > 1]
    if split:
        heavy = docs.filter(F.col("_at").isin([at_first[start[r]][0] for r in split]))
        for r in heavy.groupBy("_bucket").agg(F.max("_at").alias("at"), F.max(tie).alias("tie")).collect():
            at_first[r["_bucket"]] = (r["at"], r["tie"])
    held = sorted(b for b, (_, t) in at_first.items() if t is not None or b not in {start[r] for r in split})
    size = max(held, default=0) + 1
    before = {b: held[i - 1] for i, b in enumerate(held)}
    here = F.col("_bucket")
    ahead = F.get(_literal(_spread(before, size)), here).cast("int")
    leads = F.get(_literal(_spread({b: at_first[b][0] for b in held}, size)), here) == F.col("_at")
    leads = leads & F.coalesce(F.get(_literal(_spread({b: at_first[b][1] for b in held}, size)), here) == F.col(tie), F.lit(True))
    guest = F.when(leads, ahead)
    homes = F.array_compact(F.array(F.struct(here.alias("b"), F.lit(0).alias("g")), F.when(guest.isNotNull(), F.struct(guest.alias("b"), F.lit(1).alias("g")))))
    dealt = docs.withColumn("_home", F.explode(homes)).withColumn("_b", F.col("_home.b")).withColumn("_g", F.col("_home.g")).drop("_home", "_bucket", "_range")
    w = W.Window.partitionBy("_b").orderBy("_g", F.col("_at").desc(), F.col(tie).desc())
    dealt = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return dealt.filter("_g = 0").drop("_b", "_g", "_at")


def _spread(values: dict, size: int) -> list:
    return [values.get(i) for i in range(size)]


def _literal(values: list) -> Column:
    """A constant array, written as one string so that the plan stays small."""
    return F.from_json(F.lit("[" + ",".join("null" if v is None else str(v) for v in values) + "]"), "array<bigint>")


def _bounds_up_to(at: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most `at`, by binary search."""
    if not bounds:
        return F.lit(0)
    table = _literal(bounds)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    taken = lambda n, step: F.when((n + step <= len(bounds)) & (F.get(table, n + step - 1) <= at), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), taken)


def _likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """resemblance(a, b), with the merged sketch as a column of its own so that it is made once."""
    df = df.withColumn("_least", merge(F.col(a), F.col(b)))
    both = F.size(F.array_intersect("_least", F.array_intersect(a, b)))
    return df.withColumn(out, F.when(F.size("_least") == 0, 1.0).otherwise(both / F.size("_least"))).drop("_least")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles.

    The edited text has the document's last floor(n_chars/2) code points replaced by the first as many (or all) of the
    next document in descending doc_id (after the last: the first). near_* are resemblances of the fingerprints.

    A null text counts as empty; two empty fingerprints are alike (1), an empty and another are not (0). Of rows with
    one doc_id the text's hash decides the order; rows without an id come last. A single row is its own next. An empty
    table gives an empty result; further columns are ignored. Texts are taken whole, at any length.
    """
    text = text_or_empty()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), sketch(text).alias("fp"))
    df = with_next(slim, "doc_id", "tie", ["text", "fp"])
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substring("next_text", F.lit(1), F.col("_half"))))
    df = df.select("doc_id", "n_chars", "edited", "fp", "next_fp").withColumn("efp", sketch(F.col("edited")))
    df = _likeness(_likeness(df, "fp", "efp", "near_edited"), "fp", "next_fp", "near_next")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_text(F.col("fp")).alias("fingerprint"), to_text(F.col("efp")).alias("edited_fingerprint"),
        "near_edited", "near_next", distinct_shingles(F.col("fp")).alias("n_shingles"),
    )
