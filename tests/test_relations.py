"""Cascades leave no orphans; the switch; evidence with nulls."""

from pyspark.sql import functions as F

from hirelake.catalog import Tables
from hirelake.operators import evidence, intervals, relations
from hirelake.plans.relations import tables
from hirelake.session import ship

from .conftest import SF


def test_no_orphans_after_a_cascade(spark):
    held = tables(Tables(spark, SF))
    held = {n: held[n] for n in ("candidate_profile", "profile_contact", "profile_contact_link", "profile_experience", "match", "vacancy", "application")}
    held["match"] = held["match"].join(held["candidate_profile"].withColumnRenamed("id", "profile_id"), "profile_id", "left_semi")
    held["application"] = held["application"].join(held["vacancy"].select(F.col("id").alias("vacancy_id")), "vacancy_id", "left_semi").withColumn("profile_id", F.when(F.col("profile_id") % 2 == 0, F.col("profile_id")))
    before = {(r["table"], r["column"]): r.n for r in relations.orphans(held).collect()}
    for name, gone in (("candidate_profile", F.col("id") < 3), ("vacancy", F.col("id") % 3 == 0), ("profile_contact", F.col("id").isNull())):
        after = relations.delete(held, name, gone)
        assert {(r["table"], r["column"]): r.n for r in relations.orphans(after).collect()} == before
        assert all(after[n].columns == held[n].columns for n in held)
    assert before[("profile_contact", "profile_id")] == 0 and before[("application", "profile_id")] == 0


def test_order_puts_parents_first():
    at = {t: n for n, t in enumerate(relations.order())}
    assert at["candidate_profile"] < at["profile_contact"] < at["profile_contact_link"] and at["vacancy"] < at["match"]


def test_switch_keeps_exactly_one(spark):
    rows = spark.createDataFrame([(1, "a", True, 0), (2, "a", False, 0), (3, "b", True, 0), (4, None, True, 0)], "id long, g string, is_active boolean, updated_at int")
    keep = spark.createDataFrame([("a", 2), ("a", 2), ("b", 99)], "g string, id long")
    got = {r.id: (r.is_active, r.updated_at) for r in relations.activate(rows, keep, "id", "g", now=F.lit(5)).collect()}
    assert got == {1: (False, 5), 2: (True, 5), 3: (True, 0), 4: (True, 0)}


def test_reading_stops_at_the_first_known_page(spark):
    items = spark.createDataFrame([("s", p, f"{p}-{i}") for p in range(4) for i in range(10)] + [("t", 0, "x")], "s string, p int, k string")
    known = spark.createDataFrame([("s", f"{p}-{i}") for p, n in ((0, 6), (1, 7), (2, 10)) for i in range(n)] * 2 + [("u", "x")], "s string, k string")
    got = {r.s: (r.pages_read, r.items_read, r.first_unread) for r in intervals.read_until_known(items, known, "s", "p", "k").collect()}
    assert got == {"s": (2, 20, 2), "t": (1, 1, None)}


def test_evidence_with_nulls_and_unknown_lists(spark):
    ship(spark)
    dictionary = spark.createDataFrame([("PostgreSQL", "db", ["postgres"]), ("Go", "lang", None)], "canonical string, group string, aliases array<string>")
    docs = spark.createDataFrame([(1, 1, 1, None), (2, 1, 2, "We know Postgres, go!"), (3, 9, 1, "x"), (4, None, 1, "x")], "doc_id long, list_id int, profile_id int, text string")
    asks = spark.createDataFrame([(1, 0, "postgres", None, None), (1, 1, "PostgreSQL", True, "text"), (1, 2, "Go", False, "text"), (1, 3, None, True, "text"), (None, 0, "Go", True, "text")], "list_id int, position int, name string, required boolean, source string")
    held = spark.createDataFrame([(2, "PostgreSQL", None), (2, "Go", ["", "golang"])], "profile_id int, canonical string, spellings array<string>")
    got = sorted(map(tuple, evidence.requirements(docs, asks, held, dictionary).collect()))
    assert got == [
        (1, 0, "postgres", "absent", None, None, True, "employer"), (1, 2, "Go", "absent", None, None, False, "text"),
        (2, 0, "postgres", "present", "Postgres", None, True, "employer"), (2, 2, "Go", "present", "go", None, False, "text"),
    ]
    named = {r.doc_id: r.names for r in evidence.unsupported(docs, asks, spark.createDataFrame([(2, "golang"), (2, "go")], "profile_id int, name string"), dictionary).collect()}
    assert named == {1: [], 2: ["postgres"], 3: [], 4: []}
    spans = spark.createDataFrame([("C++", "C++ here", "xC++"), ("R", "R, S", "Rust"), (r"a\E.b", r"see a\E.b", "see a.b")], "n string, yes string, no string")
    hits = spans.select(F.call_function("regexp_like", F.col("yes"), evidence.mention(F.col("n"))).alias("y"), F.call_function("regexp_like", F.col("no"), evidence.mention(F.col("n"))).alias("n")).collect()
    assert all(r.y and not r.n for r in hits)


def plain_feed(rows, limit, most=50):
    seen, got, page = set(), 0, 0
    while page < most:
        page += 1
        entries = sorted((at, k, yes) for p, at, k, yes in rows if p == page)
        if not entries:
            return page, len(seen), got, "empty"
        fresh = [(k, yes) for i, (_, k, yes) in enumerate(entries) if k not in seen and k not in {e[1] for e in entries[:i]}]
        seen |= {k for k, _ in fresh}
        got += sum(bool(y) for _, y in fresh)
        if got >= limit:
            return page, len(seen), limit, "limit"
        if not fresh:
            return page, len(seen), got, "nothing new"
    return page, len(seen), got, "pages"


def test_feeds_stop_as_a_reader_would(spark):
    import random

    rng = random.Random(4)
    feeds = {s: [(rng.randint(1, 6), i, rng.randint(0, 60 if s % 2 else 12), rng.random() < 0.5) for i in range(rng.randint(0, 80))] for s in range(12)}
    rows = [(s, *r) for s, rs in feeds.items() for r in rs]
    df = spark.createDataFrame(rows, "source int, page int, at int, key int, wanted boolean")
    for limit, most in ((10, 50), (1000, 3)):
        got = {r.source: tuple(r)[1:] for r in intervals.read_feed(df, "source", "page", "at", "key", F.col("wanted"), limit, most).collect()}
        assert got == {s: plain_feed(rs, limit, most) for s, rs in feeds.items() if any(p <= most for p, *_ in rs)}


def test_declared_widths_and_ranges(spark):
    import pytest

    from hirelake.operators import validation as V

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "i int, v array<double>")
    with pytest.raises(ValueError, match="declares no width"):
        V.declared_width(df, "v")
    wide = V.declare_width(df, "v", 2)
    assert V.declared_width(wide, "v") == 2 and V.declared_width(wide, "not_there") is None
    assert [r.i for r in wide.filter(V.misfits(wide, "v")).collect()] == [2]
    V.verify_width(wide, "v", 2)
    with pytest.raises(ValueError, match="declared with 2"):
        V.verify_width(wide, "v", 64)
    V.checked_range(None, 3, "score")
    with pytest.raises(ValueError, match="score_min"):
        V.checked_range(4, 3, "score")
