"""What a task holds or works out again must not follow the size of a table, a row group or a batch."""

import random
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hirelake import catalog
from hirelake.functions import text as X
from hirelake.operators import evidence as E
from hirelake.operators import layout as L
from hirelake.operators import profiles as R
from hirelake.sources import connectors as C

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_groups_are_streamed(tmp_path):
    rng, n = random.Random(1), 3000
    pages = pa.table({"page_id": range(n), "url": [f"https://a.test/en/{i}" for i in range(n)], "html": [rng.randbytes(8000).hex() for _ in range(n)]})
    pq.write_table(pages, tmp_path / "pages.parquet", row_group_size=n, write_batch_size=16)
    del pages
    reader = C.Reader({"path": str(tmp_path / "pages.parquet")})
    (part,), before, most, rows = reader.plan(), pa.total_allocated_bytes(), 0, 0
    for rb in reader.read(part):
        most, rows = max(most, pa.total_allocated_bytes() - before), rows + len(rb)
    assert rows == n and most < 16_000_000  # of 48 MB


def test_bands_are_found_among_counted_edges(spark):
    words = spark.createDataFrame([(1, f"w{i}", float(i % 2 * 300 + i % 3), float(i // 4 * 12), i) for i in range(40)], "page int, text string, x0 double, top double, at long")
    text = plan(L.bands(words, "page", F.lit(600)))
    assert "Aggregate [page" in text.split("Window")[-1].split("\n", 1)[1].split("Relation")[0]
    got = {(r.line, r.bands, r.text) for r in L.lines(words, "page", F.lit(600)).collect()}
    assert len(got) == 10 and {b for _, b, _ in got} == {2} and (0, 2, "w0 w2 w3 w1") in got


def test_sections_need_no_shuffle(spark):
    for name in ("document_sections", "section_by_name"):
        text = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text


def test_lines_are_joined_once_a_text(spark):
    df = spark.createDataFrame([("a b\nskills: c",)], "text string")
    r = R.recoverable(F.array(F.lit("A  b"), F.lit("zz"), F.lit("")), R.readable_lines(F.col("text")))
    got = df.select(r.alias("r")).select("r.total", "r.recovered", "r.lost")
    assert plan(got).count("array_join(") == 1
    assert tuple(got.first()) == (2, 1, ["zz"])


def test_stable_characters_need_no_python(spark):
    texts = ["ÀÉß ǅ", "Straße", "Ünïcode «Жё» – “x” €", "é", "½ ﬁ Ａ", "ΑΣ", "İı", None, "plain", "à" * 50 + "́"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fold = lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold()
    assert [r[0] for r in df.select(X.nfkc_casefold(F.col("t"))).collect()] == [fold(t) for t in texts]
    every = [chr(i) for i in range(1, 0x3000)]
    df = spark.createDataFrame([(c,) for c in every], "t string").filter(F.col("t").rlike(f"[{X.STABLE}]"))
    assert 300 > len(got := [r.t for r in df.collect()]) > 250 and all(fold(c) == c.lower() and not unicodedata.combining(c) for c in got)


def test_places_of_the_first_word_find_what_the_pattern_finds():
    rng = random.Random(5)
    names = ["kit", "C++", "sql", "node js", "asp.net", "is", "ёлка", "a b c d e f", "K8s"]
    for _ in range(4000):
        text = "".join(rng.choice("kitKIT csqlCS+.#_-éİıſKnodejs8 ") for _ in range(rng.randint(0, 40)))
        low = None if E._ODD.search(text) else text.lower()
        for name in names:
            pattern = E._filter(name)
            want, got = pattern and pattern.search(text), E._hit(name, text, low)
            assert (want and want.span()) == (got and got.span()), (name, text)
