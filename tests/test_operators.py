"""Invariants and example tables of the relational operators."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hirelake.functions import scoring as S
from hirelake.functions import text as X
from hirelake.operators import intervals as I
from hirelake.operators import listing as L
from hirelake.operators import merging as M
from hirelake.operators import picks as P
from hirelake.operators import vectors as V


@pytest.fixture
def ranked(spark):
    rows = [(i, None if i % 6 == 0 else Decimal(i % 9)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, score decimal(5,2)")


@pytest.mark.parametrize("descending", [True, False])
def test_page_walk_shows_each_row_once(ranked, descending):
    seen, cursor = [], None
    while True:
        rows = L.page(ranked, "score", 7, cursor, descending).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        cursor = L.Cursor.decode(L.Cursor(rows[-1].score, rows[-1].id).encode())
    assert len(seen) == 60 and set(seen) == set(range(60))
    assert all(i % 6 == 0 for i in seen[-10:])


def test_page_numbers_match_the_walk(ranked):
    pages = {r.id: r.page for r in L.numbered_pages(ranked, "score", 7, buckets=5).collect()}
    walk = [r.id for r in ranked.orderBy(*L.keyset_order("score")).collect()]
    assert [pages[i] for i in walk] == [k // 7 for k in range(60)]


def test_filters_keep_nulls_on_purpose(spark):
    rows = [(1, True, None, None, 1), (2, True, "filtered", None, 1), (3, True, "skip", Decimal(5), 2), (4, False, "apply", Decimal(9), 2)]
    df = spark.createDataFrame(rows, "id long, is_active boolean, bucket string, salary decimal(12,2), seniority int")
    ids = lambda f: sorted(r.id for r in f.apply(df).collect())
    assert ids(L.ListFilter()) == [1, 3]
    assert ids(L.ListFilter(salary_min=6)) == [1]
    assert ids(L.ListFilter(salary_min=6, include_unpriced=False)) == []
    assert ids(L.ListFilter(has_salary=True)) == [3] and ids(L.ListFilter(has_salary=False)) == [1]
    with pytest.raises(ValueError):
        L.ListFilter(score_min=5, score_max=1)


def test_cursor_kinds():
    for v in (None, Decimal("1.50"), date(2020, 1, 2), 7):
        assert L.Cursor.decode(L.Cursor(v, 3).encode()) == L.Cursor(v, 3)


def test_merge_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = M.merge(target, batch, ["k"])
    assert {r.k: (r.v, r.state) for r in once.collect()} == {1: ("a", "kept"), 2: ("B", "updated"), 3: ("C", "created")}
    twice = M.merge(once.drop("state"), batch, ["k"]).drop("state")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.drop("state").collect()))


def test_replace_group_without_new_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = target.filter("false")
    assert [r.k for r in M.replace_groups(target, new, "k", touched=target.filter("k = 1")).collect()] == [2]


def test_for_all_is_true_of_nothing(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    children = spark.createDataFrame([(1, 5), (2, 20), (2, 3)], "id long, size long")
    assert sorted(r.id for r in P.for_all(parents, children, "id", F.col("size") >= 5).collect()) == [1, 3]


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 3, 4), (1, 6, 8), (1, 30, 31)], "k long, a long, b long")
    assert sorted((r.a, r.b) for r in I.islands(df, ["k"], "a", "b").collect()) == [(1, 8), (30, 31)]
    assert I.union_length(df, ["k"], "a", "b").first().covered == 10
    assert [(r.gap_from, r.gap_to, r.gap) for r in I.gaps(df, ["k"], "a", "b", 12).collect()] == [(8, 30, 21)]


def test_outside_agrees_with_a_plain_check(spark):
    points = spark.createDataFrame([(k, p) for k in (1, 2) for p in range(200)], "k long, p long")
    spans = [(1, 10, 75), (1, 64, 64), (2, 0, 0), (2, 130, 199)]
    got = {(r.k, r.p) for r in I.outside(points, spark.createDataFrame(spans, "k long, low long, high long"), "k", "p").collect()}
    assert got == {(k, p) for k in (1, 2) for p in range(200) if not any(s[0] == k and s[1] <= p <= s[2] for s in spans)}


@pytest.mark.parametrize("k", [10, 700])
def test_early_stop_equals_exhaustive(spark, k):
    rows = [(i, (i * 37 % 101) / 100, (i * 53 % 97) / 97) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t double, s double")
    want = sorted(((0.7 * t + 0.3 * s, i) for i, t, s in rows), key=lambda x: (-x[0], x[1]))[:k]
    assert [r.id for r in V.early_stop_topk(df, "t", "s", "id", k).collect()] == [i for _, i in want]


@pytest.mark.parametrize(("gap", "fit"), [(-3, 0.9), (-2, 0.9), (0, 1.0), (1, 0.8), (2, 0.55), (4, 0.25), (5, 0.0), (None, None)])
def test_experience_ladder(spark, gap, fit):
    assert spark.createDataFrame([(gap,)], "g int").select(S.experience_fit(F.col("g")).alias("f")).first().f == fit


def test_missing_parts_renormalise(spark):
    df = spark.createDataFrame([(0.5, None, 1.0), (None, None, 1.0), (None, 0.5, None)], "a double, b double, c double")
    s = S.renormalised([(F.col("a"), 0.5, True), (F.col("b"), 0.2, False), (F.col("c"), 0.3, False)])
    assert [round(r.s, 6) for r in df.select(s.alias("s")).collect()] == [0.6875, 0.375, round(0.1 / 0.7, 6)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Ｓtraße ①", "<p>A &amp;amp; B<br>c</p>")], "a string, h string")
    r = df.select(X.nfkc_casefold(F.col("a")).alias("a"), X.plain_text(F.col("h")).alias("h"), X.has_all_tokens(F.lit("a b"), " ").alias("n")).first()
    assert r.a == "strasse 1" and r.h == "A & B\nc" and r.n is False
    assert spark.range(1).select(X.has_all_tokens(F.lit("опытный Инженер, Алматы"), "инженер алматы").alias("y")).first().y


@pytest.mark.parametrize(
    ("left", "right"), [("Data Engineer", "  data   engineer  "), ("Пиксель-Мираж", "Пиксель Мираж"), ("Алматы", "алматы"), ("Ａcme", "Acme"), ("Маи\u0306ор", "Майор")]
)
def test_spelling_does_not_split_a_key(spark, left, right):
    a, b = spark.createDataFrame([(left,), (right,)], "x string").select(X.normalize_part(F.col("x")).alias("n")).collect()
    assert a.n == b.n != ""


def test_names_of_other_scripts_differ(spark):
    names = ["Алматы", "Москва", "東京", "Data Engineer", "DataEngineer", ""]
    keys = [r.f for r in spark.createDataFrame([(n,) for n in names], "x string").select(X.fingerprint(F.col("x")).alias("f")).collect()]
    assert len(set(keys)) == len(names)


def test_plain_text_against_python(spark):
    import html
    import re
    import unicodedata

    def plain(text):
        if not re.search(r"<[A-Za-z/!][^>]*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", text):
            return text
        for _ in range(3):
            text = html.unescape(text)
        text = re.sub(r"(?i)<\s*/?\s*(?:br|p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article)\b[^>]*>", "\n", text)
        text = re.sub("<[^>]+>", " ", text).replace("\xa0", " ")
        return "\n".join(x for x in (" ".join(line.split()) for line in re.split(r"\r\n|[\n\r]", text)) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.select("html", X.plain_text(F.col("html")).alias("t")).collect():
        assert r.t == plain(r.html)
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_sentences_do_not_end_at_a_dot_in_a_name(spark):
    text = "Пишем на Node.js и React.js. Второе! • пункт; третий\n\nчетвёртый…  пятый"
    got = spark.createDataFrame([(text,)], "t string").select(X.sentences(F.col("t")).alias("s")).first().s
    assert got == ["Пишем на Node.js и React.js.", "Второе!", "пункт", "третий", "четвёртый…", "пятый"]


def test_contacts_of_documents(spark):
    """What is found stands in the text, in a believable form; the readings by hand are a query."""
    from hirelake.operators import contacts as C
    from hirelake.session import ship

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = C.contacts(docs, "doc_id", "text").collect()
    assert len(got) == len(texts) and sum(r.email is not None for r in got) > 5 and sum(r.phone is not None for r in got) > 5
    for r in got:
        flat = " ".join(texts[r.doc_id].split())
        assert r.email is None or r.email in texts[r.doc_id] and r.email.count("@") == 1
        assert r.phone is None or r.phone in flat and 7 <= sum(c.isdigit() for c in r.phone) <= 15
        assert len(r.links) <= 10 and len({x.url for x in r.links}) == len(r.links)
    assert C.contacts(spark.createDataFrame([(1, None)], "i long, t string"), "i", "t").first()[1:] == (None, None, [])


def test_pseudo_vectors(spark):
    import hashlib

    from hirelake.operators import profiles as R

    rows = [("a",), ("Алматы",), (None,)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(R.pseudo_vector(20)(F.col("t")).alias("v")).collect()]
    for (text,), v in zip(rows[:2], got, strict=False):
        raw = b"".join(hashlib.sha256(text.encode() + k.to_bytes(4, "big")).digest() for k in range(3))
        want = [int.from_bytes(raw[4 * i : 4 * i + 4], "big") / 2**31 - 1 for i in range(20)]
        norm = sum(x * x for x in want) ** 0.5
        assert v == pytest.approx([x / norm for x in want])
    assert got[2] is None


def test_oldest_spans_go_first(spark):
    from hirelake.operators import tracker as R

    spans = spark.createDataFrame([(1, 10 * i, 10 * i + 3) for i in range(700)] + [(2, 1, 5), (2, 6, 9)], "k long, low long, high long")
    kept = R.keep_spans(spans, "k", "low", "high")
    assert kept.filter("k = 1").count() == 512 and kept.filter("k = 1").agg(F.min("low")).first()[0] == 1880
    assert [(r.low, r.high) for r in kept.filter("k = 2").collect()] == [(1, 9)]


def test_journal_refuses(spark):
    from datetime import datetime

    from hirelake.operators import tracker as R

    at = lambda i: datetime(2024, 1, 1, 0, i)
    rows = [
        ("a", at(0), 1, "sent", "agent", None, "no"), ("a", at(1), 2, "queued", "agent", "T", None), ("a", at(2), 3, "confirmed", "agent", "X", "not a person"),
        ("a", at(3), 4, "confirmed", "human", None, "yes"), ("a", at(4), 5, "sent", "agent", None, None), ("a", at(5), 6, "queued", "human", None, "never back"), ("b", at(0), 7, "confirmed", "human", None, None),
    ]
    df = spark.createDataFrame(rows, "vacancy_id string, at timestamp, id long, status string, actor string, title string, reason string")
    got = {r.vacancy_id: (r.status, r.title, r.reason, r.refused) for r in R.journal(df).collect()}
    assert got == {"a": ("sent", "T", None, 3), "b": (None, None, None, 1)}


def test_page_numbers_with_heavy_values(spark):
    rows = [(i, None if i % 3 == 0 else Decimal(5) if i % 3 == 1 else Decimal(i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, score decimal(5,2)").repartition(7)
    pages = {r.id: r.page for r in L.numbered_pages(df, "score", 50, buckets=8).collect()}
    walk = [r.id for r in df.orderBy(*L.keyset_order("score")).collect()]
    assert [pages[i] for i in walk] == [k // 50 for k in range(900)]


def test_schemas_hold_the_tables(spark):
    from hirelake import schemas

    assert len(schemas.TABLES) == 17 and all(schemas.schema(n).fields for n in schemas.TABLES)
    df = spark.createDataFrame([("1", 5, "x")], "vacancy_id string, weight int, other string")
    out = schemas.conform(df, "vacancy_skill")
    assert out.schema == schemas.schema("vacancy_skill") and float(out.first().weight) == 5.0 and out.first().source is None


def test_a_dictionary_with_conflicts_is_refused(spark):
    from hirelake.operators import skills as K

    bad = spark.createDataFrame([("Go", "x", ["golang"]), ("Golang", "x", [])], "canonical string, group string, aliases array<string>")
    assert [(r.key, r.claimants) for r in K.conflicts(bad).collect()] == [("golang", ["Go", "Golang"])]
    with pytest.raises(ValueError, match="two skills"):
        K.Lexicon(bad)


def test_fingerprint_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a b", None), ("a", "b")], "x string, y string")
    a, b = [r.f for r in df.select(X.fingerprint(F.col("x"), F.col("y")).alias("f")).collect()]
    assert a != b


def test_stream_equals_batch(spark):
    from hirelake.streaming.ingest import latest_by_stream

    rows = [(u, u * 100 + i, "k", i) for u in range(5) for i in range(8)]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, kind string, ts long")
    assert {r.user_id: r.event_id for r in latest_by_stream(spark, ev).collect()} == {u: u * 100 + 7 for u in range(5)}
