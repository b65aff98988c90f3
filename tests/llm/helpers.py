"""Small tables with the awkward rows that every text operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "wort " * 60_000


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and a column whose name clashes."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (None, "alpha beta gamma delta epsilon zeta eta theta", None, "b", 45),
        (None, None, None, None, None),
        (4, LONG, "de", "b", len(LONG)),
        (5, " \n\t ", "fr", "c", 4),
        (6, "ünï \U0001f600 code pöints 12345", "de", "c", 25),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("size", F.lit(-1)).withColumn("key", F.lit(7)).withColumn("rid", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def read(spark, table, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


CLASHES = [
    "row", "tie", "judged", "live", "found", "owner", "rid", "hash", "label", "class_id", "kept", "size", "times", "copies", "copy", "rank", "bucket", "value",
    "row_", "judged_", "times_", "copy_", "rid_", "text_", "_n", "_row", "_copy", "_rid", "_text", "_salt", "_at", "_b", "_g", "key", "sig", "bands", "taken", "target",
]


def clashing(spark):
    """A few plain documents with a further column for every name that a stage uses inside."""
    from pyspark.sql import functions as F

    rows = [(i, f"document {i} " + " ".join(f"w{i}x{j}" for j in range(30)) + f" token={i}f8a7b6c5d4e3f2a1b0c9d8e7", "en", f"s{i % 2}", 1) for i in range(6)]
    rows += [(9, rows[0][1], "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
