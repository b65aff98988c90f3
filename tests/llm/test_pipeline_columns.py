"""Stages keep further columns, whatever their names."""

import pytest

from hirelake.llm import jaccard_join, language, mixing, secrets

from .helpers import CLASHES, clashing


@pytest.mark.parametrize("stage", [language.accept, jaccard_join.keep_one, secrets.redact, mixing.mixed])
def test_clashing_columns_stay(spark, stage):
    docs = clashing(spark)
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"])
def test_operators_ignore_clashing_columns(spark, name):
    from pyspark.sql import functions as F

    from hirelake.llm import centroids, embedding_links, filter_audit, fingerprints, pieces, pii, pitman_yor, sharding, toxicity

    docs = clashing(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), (F.col("doc_id") % 2).alias("quality"))
    vectors = docs.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.rand(1)).cast("array<float>")).drop("doc_id")
    run = {
        "op1": lambda: sharding.shards(docs), "op2": lambda: language.identify(docs), "op3": lambda: pii.find(docs), "op4": lambda: embedding_links.linked(vectors),
        "op5": lambda: jaccard_join.near_duplicates(docs), "op6": lambda: toxicity.score(docs, labels), "op7": lambda: fingerprints.edited_likeness(docs),
        "op8": lambda: pieces.round_trip(docs), "op9": lambda: secrets.scan(docs), "op10": lambda: mixing.copies(docs),
        "op11": lambda: pitman_yor.score(docs), "op12": lambda: filter_audit.audit(docs, labels), "op13": lambda: centroids.clustered(vectors, dim=2),
    }
    assert len(run[name]().collect()) == {"op12": 600 * 3}.get(name, 8)


def test_encoding_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    from hirelake.llm import pieces

    docs = clashing(spark)
    for giant in (20, 10_000):  # by the scan, and whole
        got = pieces.encode(docs.withColumn("ids", F.lit("own ids")), giant=giant, chunk=16)
        assert got.columns == [c for c in docs.columns if c != "text"] + ["ids"]
        rows = got.collect()
        assert len(rows) == 8 and all(r[c] == f"own {c}" for r in rows for c in CLASHES if c != "ids") and sum(len(r["ids"]) > 5 for r in rows) == 7


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from hirelake.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
