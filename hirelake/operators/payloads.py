"""What sources hand over: sitemaps, JSON feeds and cursors, salary blocks, merged blocks, keys anywhere in a payload."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as X


def sitemap_files(df: DataFrame, body: str, host: str) -> DataFrame:
    """df's other columns with number and url of each vacancy file that an index lists on this host; files of other kinds and hosts go."""
    own = [c for c in df.columns if c != body]
    urls = df.select(*own, F.explode(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    number = F.regexp_extract("url", r"/vacancy([0-9]+)\.xml$", 1)
    return urls.filter((F.try_parse_url("url", F.lit("HOST")) == host) & (number != "")).select(*own, number.cast("int").alias("number"), "url").distinct()


def sitemap_entries(df: DataFrame, body: str, host: str, longest_id: int = 64) -> DataFrame:
    """df's other columns with external_id, url and lastmod of each dated vacancy page in a sitemap file.

    A URL of another host or with a query string goes, as does a date that does not parse; a date without an offset is
    UTC. The URL is rebuilt from the id, so that nothing else of what the file says is fetched.
    """
    own = [c for c in df.columns if c != body]
    pair = r"<url>\s*<loc>\s*([^<\s]+)\s*</loc>\s*<lastmod>\s*([^<\s]+)\s*</lastmod>"
    each = F.arrays_zip(F.regexp_extract_all(body, F.lit(pair), F.lit(1)).alias("loc"), F.regexp_extract_all(body, F.lit(pair), F.lit(2)).alias("mod"))
    rows = df.select(*own, F.explode(each).alias("e")).select(*own, "e.loc", "e.mod")
    external = F.regexp_extract(F.try_parse_url("loc", F.lit("PATH")), r"^/vacancy/([0-9]+)/?$", 1)
    stamp = F.try_to_timestamp(F.when(F.col("mod").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.col("mod")).otherwise(F.concat("mod", F.lit("Z"))))
    rows = rows.withColumn("external_id", external).withColumn("lastmod", stamp)
    ours = (F.try_parse_url("loc", F.lit("HOST")) == host) & F.try_parse_url("loc", F.lit("QUERY")).isNull()
    ours = ours & (F.col("external_id") != "") & (F.length("external_id") <= longest_id) & F.col("lastmod").isNotNull()
    return rows.filter(ours).select(*own, "external_id", F.concat(F.lit(f"https://{host}/vacancy/"), "external_id").alias("url"), "lastmod")


def json_feed(df: DataFrame, body: str, kind: str, id_: str, link: str, keywords: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """The jobs of JSON documents `{"jobs": [...]}` of the given type: those with a link, that name a keyword, each id once."""
    jobs = df.select(F.explode(F.from_json(body, f"jobs array<struct<{kind}>>")["jobs"]).alias("j")).select("j.*")
    jobs = jobs.filter(F.coalesce(F.col(link), F.lit("")) != "")
    if keywords:
        hay = F.lower(F.concat_ws(" ", *texts))
        hit = F.lit(False)
        for k in keywords:
            hit = hit | hay.contains(k.lower())
        jobs = jobs.filter(hit)
    return jobs.dropDuplicates([id_])


def cursor_walk(searches: DataFrame, pages: DataFrame, offset: int, turns: int, most_pages: int) -> tuple[DataFrame, DataFrame]:
    """A metered source's run: `turns` pages dealt to the searches (n, search, page) in turn from `offset`.

    Returns the rows of the pages read (pages: search, page and the rest) and each search's state after the run. A search
    goes on from its saved page and starts at the top again behind its last one.
    """
    last = pages.groupBy("search").agg(F.max("page").alias("last"))
    total = searches.count()
    # turns offset .. offset+turns-1; those of search n are congruent to n
    upto = lambda k: F.floor((F.lit(k) - F.col("n") + (total - 1)) / total) if total else F.lit(0)
    visits = (upto(offset + turns) - upto(offset)).cast("int")
    state = searches.join(last, "search").withColumn("last", F.least("last", F.lit(most_pages))).withColumn("visits", visits)
    at = lambda k: F.pmod(F.col("page") - 1 + k, F.col("last")) + 1
    read = state.filter("visits > 0").select("search", F.explode(F.transform(F.sequence(F.lit(0), F.col("visits") - 1), at)).alias("page")).distinct()
    return pages.join(read, ["search", "page"]), state.select("n", "search", at(F.col("visits")).cast("int").alias("page"))


def salary(block: Column) -> Column:
    """min, max, currency, is_gross and period of a compensation block; null where it says that there is none or names no amount."""
    kind = "from decimal(12,2), to decimal(12,2), currencyCode string, gross boolean, mode string, noCompensation map<string,string>"
    b = F.from_json(block, kind)
    period = F.when(b["mode"].isin("MONTH", "HOUR"), F.lower(b["mode"]))
    value = F.struct(b["from"].alias("min"), b["to"].alias("max"), b["currencyCode"].alias("currency"), b["gross"].alias("is_gross"), period.alias("period"))
    return F.when(b["noCompensation"].isNull() & (b["from"].isNotNull() | b["to"].isNotNull()), value)


def find_keys(keys: tuple[str, ...], depth: int = 6):
    """A function of a JSON column: the values under any of the keys, as JSON texts, at most `depth` levels deep."""

    def search(node, left):
        if left <= 0:
            return
        if isinstance(node, dict):
            for name, value in node.items():
                if name in keys:
                    yield value
                else:
                    yield from search(value, left - 1)
        elif isinstance(node, list):
            for item in node:
                yield from search(item, left - 1)

    def one(raw):
        if raw is None:
            return None
        try:
            return [json.dumps(v, ensure_ascii=False) for v in search(json.loads(raw), depth)]
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(ArrayType(StringType()))
    def found(s: pd.Series) -> pd.Series:
        return s.map(one)

    return found


def least_positive(found: Column, otherwise: int) -> Column:
    """The least whole number above nought among JSON texts, or the default."""
    whole = F.filter(F.transform(F.filter(found, lambda x: x.rlike(r"^[0-9]{1,18}$")), lambda x: x.cast("bigint")), lambda x: x > 0)
    return F.coalesce(F.array_min(whole), F.lit(otherwise))


def merged_blocks(df: DataFrame, key: str, order: list[str], block: str) -> DataFrame:
    """key, name and value of each field of the key's blocks (maps), the last block that has a field deciding, even with null."""
    each = df.select(key, *order, F.explode(block).alias("name", "value"))
    return each.groupBy(key, "name").agg(F.max(F.struct(*order, "value")).getField("value").alias("value"))


# Words that say that a job is remote, and what parts a place from its publisher.
REMOTE = ("remote", "anywhere", "удалён", "удален", "удалённо")
TAIL = "•"


def looks_remote(title: Column, location: Column, flag: Column) -> Column:
    """full where the words or the flag say so, else no."""
    hay = F.lower(F.concat_ws(" ", title, location))
    said = F.coalesce(flag, F.lit(False))
    for word in REMOTE:
        said = said | hay.contains(word)
    return F.when(said, "full").otherwise("no")


def place(location: Column) -> Column:
    """The place before the publisher's tail, or null."""
    return F.nullif(F.trim(F.substring_index(location, TAIL, 1)), F.lit(""))


def city(c: Column, most: int = 120) -> Column:
    """Blanks squeezed, cut, and null where nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, most), F.lit(""))


def country(place_: Column, aliases: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The code of the first country one of whose aliases the place holds."""
    low, out = F.lower(place_), None
    for code, names in aliases:
        hit = F.lit(False)
        for n in names:
            hit = hit | low.contains(n.lower())
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out if out is not None else F.lit(None).cast("string")


def rekeyed(df: DataFrame, id_: str, parts: list[str], version: str, current: int) -> DataFrame:
    """Rows of an older version with their new key, and whether it is refused: two rows claim it or a current row holds it."""
    keyed = df.select(id_, version, X.fingerprint(*[F.col(p) for p in parts]).alias("key"))
    old, held = keyed.filter(F.col(version) < current), keyed.filter(F.col(version) >= current).select("key").distinct()
    shared = old.groupBy("key").agg(F.count("*").alias("claims"))
    out = old.join(shared, "key").join(held.withColumn("_held", F.lit(True)), "key", "left")
    return out.select(id_, "key", ((F.col("claims") > 1) | F.col("_held").isNotNull()).alias("refused"))
