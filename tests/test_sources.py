"""Page states, document scans and what sources hand over."""

import io
import zipfile

from pyspark.sql import functions as F

from hirelake.sources import feeds as S


def test_unwrap_shapes(spark):
    df = spark.createDataFrame([(None,), ('["a","b"]',), ('{"k":["c"]}',), ("d",)], "v string")
    assert [r.u for r in df.select(S.unwrap(F.col("v")).alias("u")).collect()] == [[], ["a", "b"], ["c"], ["d"]]


def test_document_encodings(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    for name, raw in {"a.txt": "Привет".encode("cp1251"), "b.md": "hé".encode(), "c.docx": buf.getvalue(), "d.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Привет", "b.md": "hé", "c.docx": "one\ntwo", "d.pdf": None}


def test_requirement_vs_document_claims_only_what_it_holds():
    from hirelake import catalog

    assert catalog.covers()["requirement_vs_document"].split() == ["T03", "T10"]


def test_keys_are_found_at_most_so_deep(spark):
    from hirelake.operators import payloads as L

    rows = [('{"a": {"k": 5, "b": [{"k": "x"}]}}',), ('{"k": {"k": 1}}',), ("not json",), (None,), ("[" * 3000 + "]" * 3000,)]
    df = spark.createDataFrame(rows, "j string")
    got = [r.f for r in df.select(L.find_keys(("k",), 4)(F.col("j")).alias("f")).collect()]
    assert got == [["5", '"x"'], ['{"k": 1}'], None, None, []]
    shallow = [r.f for r in df.select(L.find_keys(("k",), 2)(F.col("j")).alias("f")).limit(2).collect()]
    assert shallow == [["5"], ['{"k": 1}']]


def test_cursor_walk_starts_over(spark):
    from hirelake.operators import payloads as L

    pages = spark.createDataFrame([(s, p, f"{s}{p}") for s in "ab" for p in (1, 2, 3)], "search string, page long, row string")
    searches = spark.createDataFrame([(0, "a", 3), (1, "b", 1)], "n int, search string, page int")
    rows, state = L.cursor_walk(searches, pages, offset=1, turns=5, most_pages=3)
    assert sorted(r.row for r in rows.collect()) == ["a1", "a3", "b1", "b2", "b3"]
    assert {r.search: r.page for r in state.collect()} == {"a": 2, "b": 1}
