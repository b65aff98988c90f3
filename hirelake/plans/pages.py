"""Postings out of page states in two shapes, and what a state holds."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import pages as P
from .folds import by_hand, pick

TEMPLATE = ('<html><head></head><template class="t" id="Page-InitialState">', "</template><p>shown</p></html>")


def page(state) -> str:
    """A page that carries a state, as a site writes it."""
    return TEMPLATE[0] + html.escape(state if isinstance(state, str) else json.dumps(state)) + TEMPLATE[1]


def written(state: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        state = F.replace(state, F.lit(a), F.lit(b))
    return F.concat(F.lit(TEMPLATE[0]), state, F.lit(TEMPLATE[1]))


_KIND = "id % 10"


@query(
    "S05 S06 S07 S08",
    f"""SELECT id, CASE {_KIND} WHEN 3 THEN 'gone' WHEN 4 THEN 'no_state' WHEN 5 THEN 'bad_json' WHEN 6 THEN 'bad_shape' WHEN 7 THEN 'mismatch' WHEN 9 THEN 'untitled'
    WHEN 8 THEN 'not_live' ELSE CASE WHEN is_active THEN 'ok' ELSE 'not_live' END END AS status,
    CASE WHEN {_KIND} = 7 THEN id + 1 WHEN {_KIND} < 3 AND is_active THEN id END AS found_id,
    CASE WHEN {_KIND} < 3 AND is_active THEN title || ' & co' END AS title, CASE WHEN {_KIND} < 3 AND is_active THEN company END AS company,
    CASE WHEN {_KIND} = 2 AND is_active THEN 'Harbour' WHEN {_KIND} < 2 AND is_active THEN city END AS city, CASE WHEN {_KIND} < 3 AND is_active THEN coalesce(country, 'ZZ') END AS country,
    CASE WHEN {_KIND} < 3 AND is_active THEN remote END AS remote, CASE WHEN {_KIND} < 2 AND is_active THEN salary END AS pay_from, CASE WHEN {_KIND} < 2 AND is_active THEN currency END AS currency,
    CASE WHEN {_KIND} < 3 AND is_active THEN CASE {_KIND} WHEN 0 THEN 'a,b' WHEN 1 THEN 'solo' ELSE '' END END AS skills,
    CASE WHEN {_KIND} = 1 AND is_active THEN '1-3' END AS experience, CASE WHEN {_KIND} < 2 AND is_active THEN published END AS published
    FROM vacancy""",
)
def page_postings(t):
    """Each posting as a page: flat with wrapped lists, nested with a scalar, flat with an address and no pay, and seven kinds of page that give no posting."""
    v, k = t("vacancy"), F.col("id") % 10
    name = F.concat(F.lit("  "), F.replace(F.col("title"), F.lit(" "), F.lit(" \n ")), F.lit(" & co "))
    formats = F.when(F.col("remote") == "full", F.array(F.lit("ON_SITE"), F.lit("REMOTE"))).when(F.col("remote") == "hybrid", F.array(F.lit("HYBRID"))).otherwise(F.array(F.lit("ON_SITE")))
    stamp = F.when(F.col("published").isNotNull(), F.concat(F.col("published").cast("string"), F.lit("T05:00:00+05:00")))
    pay = F.struct(F.col("salary").alias("from"), F.col("currency").alias("currencyCode"))
    core = {
        "name": name, "company": F.struct(F.col("company").alias("name")), "area": F.struct(F.col("city").alias("name"), F.col("country").alias("@countryIsoCode")), "workFormats": F.struct(formats.alias("element")), "compensation": pay,
        "status": F.struct(F.col("is_active").alias("active")), "keySkills": F.struct(F.array(F.lit("a"), F.lit("b")).alias("keySkill")), "publicationDate": stamp,
    }

    def view(number=F.col("id"), **other):
        parts = {"vacancyId": number, **core, **other}
        return F.struct(*[c.alias(n) for n, c in parts.items() if c is not None])

    flat = lambda x: F.to_json(F.struct(x.alias(P.VIEW)))
    nest = lambda x: flat(F.struct(F.struct(F.lit("1-3").alias("workExperience")).alias("translations"), F.struct(x.alias("vacancy")).alias("vacancyFull")))
    shown = lambda hidden: F.struct(F.col("is_active").alias("approved"), F.lit(hidden).alias("hiddenInArchive"))
    state = (
        F.when(k == 0, flat(view())).when(k == 1, nest(view(status=shown(False), keySkills=F.lit("solo"), publicationDate=None, publicationTimeIso=stamp)))
        .when(k == 2, flat(view(address=F.struct(F.lit(" Harbour ").alias("city")), compensation=F.struct(F.struct(F.lit(1).alias("x")).alias("noCompensation"), F.lit(5).alias("from")), keySkills=None, publicationDate=F.lit(" "))))
        .when(k == 3, '{"vacancyView":{},"errorCode":404}').when(k == 5, F.substring(flat(view()), 1, 40)).when(k == 6, flat(view(name=None))).when(k == 7, flat(view(F.col("id") + 1)))
        .when(k == 8, nest(view(status=shown(True)))).otherwise(flat(view(name=F.lit(" \t "), status=F.struct(F.lit(True).alias("active")))))
    )
    body = F.when(k == 4, "<html>moved</html>").otherwise(written(state))
    found = P.postings(v.select("id", F.col("id").alias("asked"), body.alias("body"), F.lit("Site").alias("site_city"), F.lit("ZZ").alias("site_country")))
    return found.select("id", "status", "found_id", "title", "company", "city", "country", "remote", "pay_from", "currency", F.array_join("skills", ",").alias("skills"), "experience", F.col("published").cast("date").alias("published"))


_LIVE = {"vacancyId": 5, "name": "A", "status": {"active": True}}
_NEST = {"vacancyId": "5", "name": "A", "status": {"approved": True}}


def _nested(**more):
    return {"vacancyView": {"vacancyFull": {"vacancy": _NEST | more}, "translations": {"workExperience": "up"}}}


#: State, and by hand: status, title, city, skills, roles, pay, experience, published.
_STATES = [
    ({"vacancyView": _LIVE}, "ok", "A", "Site", "", "", None, None, None),
    ({"vacancyView": _LIVE | {"name": 'Q "R" <&>  S'}}, "ok", 'Q "R" <&> S', "Site", "", "", None, None, None),
    ({"vacancyView": _LIVE | {"address": {"city": "  "}, "area": {"name": "Area"}}}, "ok", "A", "Area", "", "", None, None, None),
    ({"vacancyView": _LIVE | {"address": {"city": 7}, "area": None, "keySkills": {"a": [1], "b": [2]}}}, "ok", "A", "7", "", "", None, None, None),
    ({"vacancyView": _LIVE | {"keySkills": {"keySkill": "x"}, "professionalRoleIds": [12, " 7 ", "n", None, 1.5]}}, "ok", "A", "Site", "x", "12,7", None, None, None),
    ({"vacancyView": _LIVE | {"keySkills": None, "professionalRoleIds": {"id": 3}, "compensation": {"from": 10.5}}}, "ok", "A", "Site", "", "3", "10.50", None, None),
    ({"vacancyView": _LIVE | {"compensation": {"noCompensation": {}, "from": 3}, "translations": {"workExperience": "own"}}}, "ok", "A", "Site", "", "", None, "own", None),
    (_nested(publicationTimeIso="2026-10-07T03:00:00+05:00"), "ok", "A", "Site", "", "", None, "up", "2026-10-06"),
    (_nested(publicationDate=None, publicationTimeIso="2026-10-07T03:00:00+05:00", translations=None), "ok", "A", "Site", "", "", None, None, None),
    (_nested(status={"approved": True, "hiddenInArchive": True}), "not_live", None, None, None, None, None, None, None),
    (_nested(status={"approved": "yes"}), "ok", "A", "Site", "", "", None, "up", None),
    (_nested(status={"active": True, "archived": True}), "not_live", None, None, None, None, None, None, None),
    (_nested(status=None), "ok", "A", "Site", "", "", None, "up", None),
    ({"vacancyView": _LIVE | {"status": {}}}, "not_live", None, None, None, None, None, None, None),
    ({"vacancyView": {"vacancyFull": {"vacancy": [1]}}}, "bad_shape", None, None, None, None, None, None, None),
    ({"vacancyView": [1]}, "bad_shape", None, None, None, None, None, None, None),
    ({"vacancyView": {"vacancyId": "x5", "name": "A"}}, "bad_shape", None, None, None, None, None, None, None),
    ({"vacancyView": {"vacancyId": 5, "name": 8}}, "bad_shape", None, None, None, None, None, None, None),
    ({"vacancyView": None}, "gone", None, None, None, None, None, None, None),
    ({"errorCode": 404}, "gone", None, None, None, None, None, None, None),
    ({"vacancyView": _LIVE | {"vacancyId": 6}}, "mismatch", None, None, None, None, None, None, None),
    ("[1]", "bad_json", None, None, None, None, None, None, None),
    ("", "bad_json", None, None, None, None, None, None, None),
]


@query("S05 S06 S07 S08", by_hand("status, title, city, skills, roles, pay, experience, published", [s[1:] for s in _STATES]))
def page_states_by_hand(t):
    rows = t("posting").select("id", F.lit(5).alias("asked"), pick([page(s) for s, *_ in _STATES]).alias("body"), F.lit("Site").alias("site_city"), F.lit("ZZ").alias("site_country"))
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return P.postings(rows).select("id", "status", "title", "city", line("skills"), line("roles"), F.col("pay_from").cast("string").alias("pay"), "experience", F.col("published").cast("date").cast("string").alias("published"))


#: A payload of each event, three levels deep, with every type of value in it; DuckDB's JSON of the same.
_PAYLOAD = """json_object('kind', event_type, 'props', CAST(props AS JSON), 'when', json_object('day', CAST(CAST(ts AS DATE) AS VARCHAR), 'turn', event_id % 7), 'tags', CASE WHEN event_id % 3 = 0 THEN json_array() ELSE
    json_array(event_type, event_id, json_object('userVacancyId', CAST(user_id AS VARCHAR), 'x', NULL)) END, 'vacancyid', CASE WHEN event_id % 4 = 0 THEN event_id END, 'note', repeat('n', CAST(event_id % 5 AS INT)), 'late', event_id % 2 = 0,
    'inner', json_object('list', json_array(json_array(json_object('vacancyId', event_id + 1)))))"""


def payloads(t):
    e = t("events")
    number = F.col("event_id")
    one = F.struct(F.col("user_id").cast("string").alias("userVacancyId"), F.lit(None).cast("string").alias("x"))
    tags = F.when(number % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2), F.lit(","), number.cast("string"), F.lit(","), F.to_json(one, {"ignoreNullFields": "false"}), F.lit("]")))
    rest = F.struct(
        F.col("event_type").alias("kind"), F.struct(F.col("ts").cast("date").cast("string").alias("day"), (number % 7).alias("turn")).alias("when"), F.when(number % 4 == 0, number).alias("vacancyid"),
        F.expr("repeat('n', CAST(event_id % 5 AS INT))").alias("note"), (number % 2 == 0).alias("late"), F.struct(F.array(F.array(F.struct((number + 1).alias("vacancyId")))).alias("list")).alias("inner"),
    )
    text = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"tags":'), tags, F.lit(","), F.to_json(rest, {"ignoreNullFields": "false"}).substr(F.lit(2), F.lit(100_000)))
    return e.select("event_id", F.parse_json(text).alias("state"))


@query(
    "F67",
    f"""WITH p AS (SELECT event_id, {_PAYLOAD} AS j FROM events),
    k AS (SELECT event_id, j.key AS key, j.type AS type, j.value AS value FROM p, json_each(p.j) j),
    s AS (SELECT event_id, key, CASE WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'NULL' THEN 'null' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
    CAST(CASE type WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) WHEN 'VARCHAR' THEN length(value ->> '$') END AS BIGINT) AS size FROM k)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN kind IN ('object', 'array') THEN 0 ELSE 1 END, -coalesce(size, 0), key) AS INT) AS place, key, kind, size FROM s""",
)
def state_census(t):
    """The top level of each payload: key, type and size, containers first and the largest first."""
    return P.census(payloads(t))


@query(
    "F67",
    f"""WITH p AS (SELECT event_id, {_PAYLOAD} AS j FROM events)
    SELECT event_id, t.value ->> '$' AS id, count(*) AS n FROM p, json_tree(p.j) t WHERE lower(t.key) LIKE '%vacancyid' AND regexp_matches(t.value ->> '$', '^[0-9]+$') GROUP BY ALL""",
)
def state_ids_anywhere(t):
    """Ids under a key that ends in vacancyId, in any case and at any depth."""
    return P.ids_anywhere(payloads(t), "event_id").groupBy("event_id", "id").agg(F.count("*").alias("n"))
