"""Postings read out of pages that carry their state as JSON, in either of two shapes, by VARIANT paths.

The state is a third party's, dozens of keys deep and without a schema, so it is parsed once and read by path; what is
missing, null or of another type reads as null, and what makes a page unusable is a status of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unescape

MOST_TITLE, MOST_COMPANY, MOST_CITY = 300, 200, 120
#: Where the two shapes differ. Fixed values.
VIEW, NESTED, LIFTED = "vacancyView", "vacancyFull.vacancy", "translations"
RENAMED = {"publicationDate": "publicationTimeIso", "validThroughTime": "validToTimeIso"}
REMOTE = {"REMOTE": "full", "HYBRID": "hybrid"}


def path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def at(v: Column, *keys: str, kind: str = "string") -> Column:
    """The value under the keys, or null where it is missing, null or no such thing."""
    return F.try_variant_get(v, path(*keys), kind)


def fields(v: Column, *keys: str) -> Column:
    """An object's fields, or null where there is no object."""
    return at(v, *keys, kind="map<string,variant>")


def unwrapped(v: Column) -> Column:
    """A collection however it is spelled, as an array of variants: null is empty, a list itself, an object of one key what
    that holds (as a list), of more keys empty, a scalar a list of one.
    """
    none = F.array().cast("array<variant>")
    array, object_ = at(v, kind="array<variant>"), fields(v)
    inner = F.get(F.map_values(object_), F.lit(0))
    one = F.coalesce(at(inner, kind="array<variant>"), F.array(inner))
    return F.when(v.isNull() | F.is_variant_null(v), none).when(array.isNotNull(), array).when(F.size(object_) == 1, one).when(object_.isNotNull(), none).otherwise(F.array(v))


def strings(v: Column) -> Column:
    return F.filter(F.transform(unwrapped(v), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull())


def flat_text(c: Column, most: int) -> tuple[Column, Column]:
    """White space made single blanks, and cut; and whether anything was cut."""
    whole = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.substring(whole, 1, most), F.length(whole) > most


def _true(v: Column, *keys: str) -> Column:
    return F.coalesce(at(v, *keys, kind="boolean"), F.lit(False))


def postings(pages: DataFrame, body: str = "body", asked: str = "asked", site_city: str = "site_city", site_country: str = "site_country", marker: str = "InitialState") -> DataFrame:
    """One row per page: its own columns, `status`, and what it says of the posting (null unless the status is ok).

    status: no_state (no template with the marker: the page has changed), bad_json (its content, unescaped, is no JSON
    object), gone (an empty view: the posting no longer exists), bad_shape (a view without a whole-numbered id or a
    name), mismatch (a redirect to another posting), not_live (archived, disabled or not active), untitled, ok.

    The newer shape nests the posting two levels down, renames two dates, leaves the translations one level up and says
    `approved` and `hiddenInArchive` in place of `active`; a key that is there is taken as it is, null included. City:
    the address's, else the area's name, else the site's. A compensation that says `noCompensation` is none.
    """
    own = pages.columns
    block = rf'(?s)<template[^>]*id="[^"]*{marker}"[^>]*>(.*?)</template>'
    df = pages.select("*", F.when(F.col(body).rlike(block), F.regexp_extract(body, block, 1)).alias("_raw"))
    df = df.withColumn("_state", F.try_parse_json(unescape(F.col("_raw"))))
    df = df.withColumn("_outer", F.try_variant_get("_state", path(VIEW), "variant"))
    nested = F.try_variant_get("_outer", path(*NESTED.split(".")), "variant")
    df = df.withColumn("_nested", F.coalesce(F.try_variant_get(nested, "$", "map<string,variant>").isNotNull(), F.lit(False)))
    df = df.withColumn("_v", F.when(F.col("_nested"), nested).otherwise(F.col("_outer"))).withColumn("_keys", F.map_keys(fields(F.col("_v"))))
    v, outer, is_nested = F.col("_v"), F.col("_outer"), F.col("_nested")
    has = lambda k: F.coalesce(F.array_contains("_keys", k), F.lit(False))
    stamp = lambda k: F.try_to_timestamp(F.when(has(k) | ~is_nested, at(v, k)).otherwise(at(v, RENAMED[k])))

    status, keys = fields(v, "status"), F.map_keys(fields(v, "status"))
    shown = _true(v, "status", "approved") & ~_true(v, "status", "hiddenInArchive")
    active = F.when(is_nested & ~F.array_contains(keys, "active"), shown).otherwise(_true(v, "status", "active"))
    live = F.when(status.isNull(), F.lit(True)).otherwise(active & ~_true(v, "status", "archived") & ~_true(v, "status", "disabled"))

    number = at(v, "vacancyId", kind="decimal(38,0)")
    is_whole = at(v, "vacancyId").rlike(r"^-?[0-9]+$")
    name = F.when(F.schema_of_variant(F.try_variant_get(v, path("name"), "variant")) == "STRING", at(v, "name"))
    title, title_cut = flat_text(name, MOST_TITLE)
    company, company_cut = flat_text(F.coalesce(at(v, "company", "visibleName"), at(v, "company", "name")), MOST_COMPANY)
    view, listed = fields(outer), at(outer, kind="array<variant>")
    empty = outer.isNull() | F.is_variant_null(outer) | (F.size(view) == 0) | (F.size(listed) == 0) | F.coalesce(at(outer) == "", F.lit(False))
    verdict = (
        F.when(F.col("_raw").isNull(), "no_state").when(fields(F.col("_state")).isNull(), "bad_json").when(F.coalesce(empty, F.lit(False)), "gone")
        .when(view.isNull() | ~F.coalesce(is_whole, F.lit(False)) | (F.coalesce(F.length(name), F.lit(0)) == 0), "bad_shape").when(number.cast("string") != F.col(asked).cast("string"), "mismatch")
        .when(~live, "not_live").when(title == "", "untitled").otherwise("ok")
    )

    given = at(v, "address", "city")
    city = F.coalesce(F.when(F.trim(given) != "", given), F.nullif(at(v, "area", "name"), F.lit("")), F.col(site_city))
    pays = ~F.coalesce(F.array_contains(F.map_keys(fields(v, "compensation")), "noCompensation"), F.lit(False))
    pay = lambda k, kind: F.when(pays, at(v, "compensation", k, kind=kind))
    formats = strings(F.try_variant_get(v, path("workFormats"), "variant"))
    remote = F.when(F.array_contains(formats, "REMOTE"), REMOTE["REMOTE"]).when(F.array_contains(formats, "HYBRID"), REMOTE["HYBRID"]).otherwise("no")
    roles = F.filter(strings(F.try_variant_get(v, path("professionalRoleIds"), "variant")), lambda x: x.rlike(r"^\s*[0-9]+\s*$"))
    lifted = F.when(is_nested & ~has(LIFTED), at(outer, LIFTED, "workExperience")).otherwise(at(v, LIFTED, "workExperience"))
    said = {
        "found_id": number.cast("long"), "title": title, "title_cut": title_cut, "company": company, "company_cut": company_cut, "city": F.substring(F.trim(city), 1, MOST_CITY),
        "country": F.coalesce(F.nullif(at(v, "area", "@countryIsoCode"), F.lit("")), F.col(site_country)), "remote": remote, "pay_from": pay("from", "decimal(18,2)"), "pay_to": pay("to", "decimal(18,2)"),
        "currency": pay("currencyCode", "string"), "pay_mode": pay("mode", "string"), "gross": pay("gross", "boolean"), "skills": strings(F.try_variant_get(v, path("keySkills"), "variant")), "formats": formats,
        "roles": F.transform(roles, lambda x: F.trim(x).cast("long")), "published": stamp("publicationDate"), "expires": stamp("validThroughTime"), "experience": lifted, "closed": _true(v, "closedForApplicants"),
    }
    df = df.withColumn("status", verdict)
    # the id of a page that answered for another one is worth knowing
    return df.select(*own, "status", *[F.when(F.col("status").isin("ok", "mismatch") if n == "found_id" else F.col("status") == "ok", c).alias(n) for n, c in said.items()])


# --- what a state holds ----------------------------------------------------------------------


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    s = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return F.when(s == "OBJECT", "object").when(s == "ARRAY", "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")


def size_of(v: Column) -> Column:
    """Keys of an object, items of an array, characters of a string; null for anything else."""
    return F.when(kind_of(v) == "string", F.length(at(v))).otherwise(F.coalesce(F.size(fields(v)), F.size(at(v, kind="array<variant>")))).cast("long")


def census(states: DataFrame, state: str = "state") -> DataFrame:
    """The top level of each state: its own columns, `place`, key, kind, size.

    Containers first and the largest first, then the rest, strings by length, and by name; a state that is no object has
    no rows. `place` counts from 1 in that order.
    """
    keep = [c for c in states.columns if c != state]
    items = F.map_entries(fields(F.col(state)))
    rated = F.transform(items, lambda x: F.struct(F.when(kind_of(x["value"]).isin("object", "array"), 0).otherwise(1).alias("rest"), (-F.coalesce(size_of(x["value"]), F.lit(0))).alias("less"), x["key"].alias("key"), kind_of(x["value"]).alias("kind"), size_of(x["value"]).alias("size")))
    return states.select(*keep, F.posexplode(F.array_sort(rated)).alias("n", "x")).select(*keep, (F.col("n") + 1).alias("place"), "x.key", "x.kind", "x.size")


def _exploded(rows: DataFrame, what: str, outer: bool = False) -> DataFrame:
    """rows beside their entries e of the variant in column `_open`."""
    return rows.sparkSession.sql(f"SELECT {what} FROM {{rows}} s, LATERAL variant_explode{'_outer' if outer else ''}(s._open) e", rows=rows)


def descend(states: DataFrame, state: str = "state", most_levels: int = 64, wanted: Column | None = None) -> DataFrame:
    """Every value at any depth: the states' own columns, path, key (of the nearest object; null in a list of the top level), value.

    With `wanted`, a condition on path, key and value, only the values that meet it. The levels are chained in one pass:
    a value found is carried through those below it as it is, and a copy of it is opened. Levels are 4 or twice as many as
    long as some state has values below them, so a state is read twice and its beginning a few times more, whatever its depth.
    """
    keep, states = [c for c in states.columns if c != state], states.filter(F.col(state).isNotNull())
    depth, below = 0, states.select(F.col(state).alias("_open"))
    while True:
        more = min(max(4, 2 * depth), most_levels)
        for _ in range(more - depth):
            below = _exploded(below, "e.value AS _open")
        depth = more
        if _exploded(below, "e.pos").isEmpty():
            break
        if depth == most_levels:
            raise ValueError(f"states of more than {most_levels} levels")
    rows = states.select(*keep, F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"), F.col(state).alias("_open"))
    columns = "".join(f"s.`{c}`, " for c in keep)
    step = f"""{columns}CASE WHEN e.pos IS NULL THEN s.path WHEN e.key IS NULL THEN concat(s.path, '[', e.pos, ']') ELSE concat(s.path, '.', e.key) END AS path,
        CASE WHEN e.pos IS NULL THEN s.key ELSE e.key END AS key, CASE WHEN e.pos IS NULL THEN s.value ELSE e.value END AS value, e.pos IS NOT NULL AS _fresh, s._open IS NULL AS _carried"""
    shut = F.lit(None).cast("variant")
    meets = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    copies = F.when(F.col("_carried"), F.array(shut)).when(F.col("_fresh") & meets, F.array(shut, "value")).when(F.col("_fresh"), F.array("value"))
    for _ in range(depth):
        rows = _exploded(rows, step, outer=True).select(*keep, "path", "key", "value", F.explode(copies).alias("_open"))
    return rows.filter(F.col("_open").isNull()).select(*keep, "path", "key", "value")


def ids_anywhere(states: DataFrame, by: str, state: str = "state", suffix: str = "vacancyId") -> DataFrame:
    """`by`, path, id: whole numbers, or strings of digits, under a key that ends in `suffix` (in any case) at any depth."""
    text = at(F.col("value"))
    ok = F.lower("key").endswith(suffix.lower()) & text.rlike("^[0-9]+$") & kind_of(F.col("value")).isin("number", "string")
    return descend(states.select(by, state), state, wanted=ok).select(by, "path", text.alias("id"))
