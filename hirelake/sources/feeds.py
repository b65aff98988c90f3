"""What pages and files hold: the JSON state of a page, wrapped collections, the text of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- payloads ------------------------------------------------------------------------------

STATE = (
    "view struct<id:bigint,name:string,pay:struct<from:double,cur:string>,active:boolean,skills:string>, "
    "full struct<posting:struct<id:bigint,name:string,pay:struct<from:double,cur:string>,active:boolean,skills:string>>, errorCode int"
)


def page_state(body: Column, marker: str = "STATE") -> Column:
    """The JSON that a page carries behind its marker, or null where there is none."""
    return F.nullif(F.regexp_extract(body, marker + r"=(\{.*\});", 1), F.lit(""))


def postings(df: DataFrame, body: str = "body") -> DataFrame:
    """status (ok, gone, markup_error) and the posting's columns, from either of the two page shapes."""
    df = df.withColumn("_json", page_state(F.col(body))).withColumn("s", F.from_json("_json", STATE))
    pick = lambda f: F.coalesce(F.col(f"s.full.posting.{f}"), F.col(f"s.view.{f}"))
    status = F.when(F.col("_json").isNull() | F.col("s").isNull(), "markup_error").when(pick("id").isNull(), "gone").otherwise("ok")
    return df.select("*", status.alias("status"), pick("id").alias("found_id"), F.substring(pick("name"), 1, 300).alias("title"), pick("pay")["from"].alias("pay_from"), pick("pay")["cur"].alias("currency"), F.coalesce(pick("active"), F.lit(False)).alias("live"), unwrap(pick("skills")).alias("skills")).drop("_json", "s")


def unwrap(c: Column) -> Column:
    """A collection however it is wrapped: null is empty, {"k": [...]} its list, a scalar a list of one."""
    wrapped = F.from_json(c, "map<string,array<string>>")
    plain = F.from_json(c, "array<string>")
    first = F.element_at(F.map_values(wrapped), 1)
    return F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), plain).when(c.startswith("{"), first).otherwise(F.array(c))


def decode_bytes(raw: bytes) -> str | None:
    """Plain text by the first encoding that fits: utf-8, cp1251, latin-1; a zipped document by its text runs."""
    import io
    import re
    import zipfile

    if raw[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                xml = z.read("word/document.xml").decode("utf-8")
        except (KeyError, zipfile.BadZipFile):
            return None
        return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml)).strip()
    if raw[:5] == b"%PDF-":
        return None
    for name in ("utf-8", "cp1251", "latin-1"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def scan_documents(spark: SparkSession, folder: str, most_bytes: int = 10_000_000) -> DataFrame:
    """path and text of every file up to a size; the filter on length keeps larger ones unread."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= most_bytes)

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("path"), pa.array([decode_bytes(x) for x in rb.column("content").to_pylist()], pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
