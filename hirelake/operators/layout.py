"""What a page's layout says: bands of words, lines that run over two of them; sections under headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Share of the page's width that parts two bands, share of its words that a band must hold, and points that one visual line spans. Fixed values.
GAP, LEAST_SHARE, LINE = 0.06, 0.08, 3


def bands(words: DataFrame, page: str, width: Column, gap: float = GAP, share: float = LEAST_SHARE) -> DataFrame:
    """page, band, left, right: runs of left edges (x0) that no gap of more than `gap` of the width parts and that hold `share` of the page's words."""
    edges = words.groupBy(page, "x0").agg(F.count("*").alias("_n"))
    w = W.Window.partitionBy(page).orderBy("x0")
    new = (F.col("x0") - F.lag("x0").over(w) > width * gap).cast("int")
    runs = edges.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_run", F.sum("_new").over(w.rangeBetween(W.Window.unboundedPreceding, 0)))
    runs = runs.groupBy(page, "_run").agg(F.min("x0").alias("left"), F.max("x0").alias("right"), F.sum("_n").alias("_n"))
    all_ = W.Window.partitionBy(page)
    kept = runs.withColumn("_all", F.sum("_n").over(all_)).filter(F.col("_n") >= F.col("_all") * share)
    return kept.select(page, F.row_number().over(all_.orderBy("left")).alias("band"), "left", "right")


def lines(words: DataFrame, page: str, width: Column, **options) -> DataFrame:
    """page, line, bands, mixed, text: the lines as a reader sees them, and whether one holds words of two bands.

    words: page, text, x0, top and `at`, a word's place in the text, which orders words of one edge. A word is of the band
    that its edge lies in, give or take a point; one between bands is of none.

    Words are summed up where they are read: to the count of each edge for the bands, of which a page has few, and to the
    edges and text of each line. Only lines meet the bands of their page.
    """
    placed = words.withColumn("line", F.bround(F.col("top") / LINE).cast("long"))
    found = bands(words, page, width, **options).groupBy(page).agg(F.collect_list(F.struct("left", "right")).alias("_bands"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "at", "text"))), lambda x: x["text"]), " ")
    whole = placed.groupBy(page, "line").agg(F.collect_set("x0").alias("_edges"), text.alias("text"))
    holds = lambda b: F.exists("_edges", lambda x: x.between(b["left"] - 1, b["right"] + 1))
    of = F.coalesce(F.size(F.filter("_bands", holds)), F.lit(0)).cast("long")
    both = whole.join(found, page, "left").select(page, "line", of.alias("bands"), "text")
    return both.select(page, "line", "bands", (F.col("bands") >= 2).alias("mixed"), "text")


# --- sections --------------------------------------------------------------------------------

#: The longest heading, in characters and words; what ends a line, a bullet, what parts values on one line.
MOST_CHARS, MOST_WORDS = 70, 6
BREAK, BULLET, BETWEEN = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", r"^\s*(?:[-*•–—·]|[0-9]{1,2}[.)])\s+", r"[,;|•·]"
_STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def fold_heading(c: Column) -> Column:
    """What two spellings of one heading share: no case, blanks, marks or dashes."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s:*#_\-–—]+", ""))


def _let(c: Column, f) -> Column:
    """f of the value of c, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _label(text: Column) -> Column:
    """What stands before a colon, stripped, as a heading, or null where it is a sentence."""
    return F.when((text != "") & (F.size(F.split(text, r"(?U)\s+")) <= MOST_WORDS) & ~text.rlike("[.!?]"), text)


def heading(text: Column) -> Column:
    """The heading that a line, stripped, announces, or null: behind #, in bold, before a colon at its end, or in capitals."""
    bare = lambda c: F.nullif(strip(F.regexp_replace(strip(c), ":+$", "")), F.lit(""))
    found = (
        F.when(text.startswith("#"), bare(F.regexp_replace(text, "^#+", ""))).when(text.rlike(r"(?s)^\*\*.+\*\*$"), bare(F.regexp_extract(text, r"^\*\*(.+?)\*\*$", 1)))
        .when(text.endswith(":"), _let(strip(F.regexp_replace(text, ":$", "")), _label)).when(text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]"), bare(text))
    )
    return F.when((text != "") & (F.length(text) <= MOST_CHARS), found)


def _line(w: Column, n: Column) -> Column:
    """at, heading and body of the n-th line, stripped."""

    def inline(x):
        named = ~w.startswith("#") & (x["tail"] != "") & (F.length(x["head"]) < MOST_CHARS)
        return F.struct(x["tail"].alias("tail"), F.when(named, _label(x["head"])).alias("inline"))

    def read(x):
        return _let(F.coalesce(x["inline"], heading(w)), lambda h: F.struct(n.alias("at"), h.alias("heading"), F.when(x["inline"].isNotNull(), x["tail"]).when(h.isNull(), w).alias("body")))

    parts = F.struct(strip(F.substring_index(w, ":", 1)).alias("head"), strip(F.substr(w, F.locate(":", w) + 1)).alias("tail"))
    return F.when(w.contains(":"), _let(_let(parts, inline), read)).otherwise(_let(heading(w), lambda h: F.struct(n.alias("at"), h.alias("heading"), F.when(h.isNull(), w).alias("body"))))


def _items(filled: Column) -> Column:
    values = F.transform(F.filter(F.split(F.get(filled, F.lit(0)), BETWEEN), lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(F.btrim(x, F.lit(" \t·")), BULLET, "")))
    plain = F.transform(filled, lambda x: strip(F.regexp_replace(x, BULLET, "")))
    return F.when(F.size(filled) == 1, _let(values, lambda v: F.when(F.size(v) > 1, v).otherwise(plain))).otherwise(plain)


def with_sections(docs: DataFrame, text: str, name: str = "sections") -> DataFrame:
    """docs with an array of (section (from 1), heading, items): what stands under each heading of each document; the text before the first is of none.

    A line may carry a heading and, behind its colon, the first of the body. An item is a line without its bullet, or one
    of several values where the body is a single line. All is read inside the row: a section is a slice of the lines.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), BREAK), lambda x: strip(x))
    df = docs.withColumn("_lines", F.transform(lines, _line)).withColumn("_heads", F.filter("_lines", lambda x: x["heading"].isNotNull()))

    def section(h, k):
        end = F.coalesce(F.get("_heads", k + 1)["at"], F.size("_lines"))
        body = F.filter(F.transform(F.slice("_lines", h["at"] + 1, end - h["at"]), lambda x: x["body"]), lambda x: x != "")
        return F.struct((k + 1).cast("int").alias("section"), h["heading"].alias("heading"), _let(body, _items).alias("items"))

    return df.withColumn(name, F.transform("_heads", section)).drop("_lines", "_heads")


def sections(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, section, heading, items: a row for each section; see `with_sections`."""
    return with_sections(docs.select(doc, text), text, "_sections").select(doc, F.explode("_sections").alias("_x")).select(doc, "_x.*")


def named_section(found: Column, name: Column) -> Column:
    """The first section of that name among a document's, however it is spelled; null if there is none. `name` is folded."""
    return F.get(F.filter(found, lambda s: (fold_heading(s["heading"]) == name) & (name != "")), F.lit(0))
