"""Pages of null and strange states; the walk over nested ones."""

import json

import pytest
from pyspark.sql import functions as F

from hirelake import catalog
from hirelake.session import ship
from hirelake.sources import pages as P

from .conftest import SF


def test_pages_without_a_usable_state(spark):
    ship(spark)
    template = '<template id="InitialState">{}</template>'
    bodies = [None, "", template.format(""), template.format("null"), template.format("&quot;x&quot;"), template.format('{"vacancyView": 5}'), template.format('{"vacancyView": ""}'), template.format("{&quot;vacancyView&quot;:{&quot;vacancyId&quot;:1,&quot;name&quot;:&quot;&amp;lt;&quot;}}")]
    df = spark.createDataFrame([(i, b, None) for i, b in enumerate(bodies)], "i int, body string, asked string").withColumn("site_city", F.lit(None).cast("string")).withColumn("site_country", F.lit(None).cast("string"))
    got = {r.i: r for r in P.postings(df).collect()}
    assert [got[i].status for i in range(7)] == ["no_state", "no_state", "bad_json", "bad_json", "bad_json", "bad_shape", "gone"]
    assert got[7].title in (None, "<", "&lt;") and got[7].city is None and df.columns == P.postings(df).columns[:5]


def test_one_page_is_not_taken_for_another(spark):
    ship(spark)
    state = '<template id="InitialState">{"vacancyView":{"vacancyId":"007","name":"A"}}</template>'
    df = spark.createDataFrame([(state, a) for a in ("7", "007", "8")], "body string, asked string").withColumns({"site_city": F.lit("C"), "site_country": F.lit("KZ")})
    assert [r.status for r in P.postings(df).collect()] == ["ok", "mismatch", "mismatch"]


def test_walk_and_census(spark):
    states = ['{"a":[[{"xVacancyID":12}],{"vacancyId":"x"}],"b":{"vacancyid":"34","c":{"vacancyId":[5]}},"s":"abc"}', "[1,[2]]", "3", "null", '{"k":{"vacancyId":5}}']
    df = spark.createDataFrame(list(enumerate(states)), "i int, j string").select("i", F.parse_json("j").alias("state"))
    assert sorted((r.i, r.path, r.id) for r in P.ids_anywhere(df, "i").collect()) == [(0, ".a[0][0].xVacancyID", "12"), (0, ".b.vacancyid", "34"), (4, ".k.vacancyId", "5")]
    got = sorted((r.i, r.place, r.key, r.kind, r["size"]) for r in P.census(df).collect())
    assert got == [(0, 1, "a", "array", 2), (0, 2, "b", "object", 2), (0, 3, "s", "string", 3), (4, 1, "k", "object", 1)]
    assert P.descend(df.filter("i = 2")).count() == 0


def python_walk(v, path="", key=None):
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        here = f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]"
        yield here, k if isinstance(v, dict) else None, json.dumps(x, sort_keys=True, separators=(",", ":"))
        yield from python_walk(x, here)


def test_a_walk_is_one_pass_of_any_depth(spark):
    """Levels once read each the states and all levels above anew; the walk must find what a plain one finds."""
    deep = 7
    for i in range(18):
        deep = [deep, {}] if i % 3 else {"myVacancyId": i, "x": deep, "e": []}
    states = [deep, {"a": None, "b": [[], {}, [None]], "vacancyId": "12a"}, [], {}, "vacancyId", {"open": {"VACANCYID": "007", "vacancyId": 1.5}}, None]
    rows = [(i, json.dumps(s)) for i, s in enumerate(states)] + [(99, None)]
    df = spark.createDataFrame(rows, "open int, j string").select("open", F.parse_json("j").alias("state"))
    got = sorted((r.open, r.path, r.key or "", r.v) for r in P.descend(df).select("open", "path", "key", F.to_json("value").alias("v")).collect())
    assert got == sorted((i, p, k or "", v) for i, s in enumerate(states) for p, k, v in python_walk(s))
    ids = sorted((r.open, r.path.rsplit(".", 1)[-1], r.id) for r in P.ids_anywhere(df, "open").collect())
    assert ids == sorted([(0, "myVacancyId", str(i)) for i in range(0, 18, 3)] + [(5, "VACANCYID", "007")])
    most = spark.range(1).select(F.parse_json(F.lit("[" * 65 + "1" + "]" * 65)).alias("state"))
    with pytest.raises(ValueError):
        P.descend(most)
    plan = catalog.queries()["state_ids_anywhere"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
