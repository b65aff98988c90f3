"""Source payloads, JSON shapes, evidence, backlog and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..sources import feeds as S


@query(
    "S05 S06 S07 S08",
    """SELECT id, CASE id % 5 WHEN 3 THEN 'gone' WHEN 4 THEN 'markup_error' ELSE 'ok' END AS status, CASE WHEN id % 5 < 3 THEN
    'posting ' || CAST(id AS VARCHAR) END AS title, CASE WHEN id % 5 < 3 THEN CAST(seniority AS DOUBLE) END AS pay_from,
    CASE WHEN id % 5 < 3 THEN is_active ELSE FALSE END AS live, CAST(CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END
    AS BIGINT) AS n_skills FROM posting""",
)
def page_states(t):
    """Five page bodies: the new shape with a wrapped list, the old one with a scalar, one without skills, an empty view, no state."""
    p = t("posting")
    name = F.concat(F.lit("posting "), F.col("id").cast("string"))
    core = lambda skills: F.struct(F.col("id"), name.alias("name"), F.struct(F.col("seniority").cast("double").alias("from"), F.lit("KZT").alias("cur")).alias("pay"), F.col("is_active").alias("active"), F.lit(skills).cast("string").alias("skills"))
    new = F.to_json(F.struct(F.struct(core('{"k":["a","b"]}').alias("posting")).alias("full")))
    old, bare = F.to_json(F.struct(core("a").alias("view"))), F.to_json(F.struct(core(None).alias("view")))
    k = F.col("id") % 5
    state = F.when(k == 0, new).when(k == 1, old).when(k == 2, bare).when(k == 3, '{"view":{},"errorCode":404}')
    body = F.when(k == 4, "<html>moved</html>").otherwise(F.concat(F.lit("<html><script>STATE="), state, F.lit(";</script>")))
    return S.postings(p.select("id", body.alias("body"))).select("id", "status", "title", "pay_from", "live", F.size("skills").cast("long").alias("n_skills"))


@query(
    "S18 S19",
    """SELECT count(*) AS n, CAST(min(len(embedding)) AS BIGINT) AS low, CAST(max(len(embedding)) AS BIGINT) AS high,
    min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings""",
)
def vector_width_check(t):
    n = F.size("embedding")
    return t("embeddings").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("low"), F.max(n).cast("long").alias("high"), (F.min(n) == F.max(n)).alias("uniform"))


@query(
    "P32",
    """SELECT id, concat_ws(',', CASE WHEN salary < 2000 THEN 'salary' END, CASE WHEN score > 99 THEN 'score' END, CASE WHEN
    published IS NULL THEN 'published' END) AS broken FROM posting WHERE salary < 2000 OR score > 99 OR published IS
    NULL""",
)
def quarantine_rows(t):
    rules = {"salary": F.col("salary") < 2000, "score": F.col("score") > 99, "published": F.col("published").isNull()}
    broken = F.concat_ws(",", *[F.when(c, n) for n, c in rules.items()])
    return t("posting").select("id", broken.alias("broken")).filter("broken <> ''")


@query(
    "K17 F63 F65",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, turn = 0 AS closed, CASE WHEN turn = 0 THEN
    '2024-02-01' END AS rechecked FROM event JOIN (SELECT event_id AS eid, props
    FROM events) ON eid = event_id""",
)
def json_patch(t):
    """The parsed block with two fields added or replaced; the other fields stay."""
    e = t("events").select("event_id", F.from_json("props", "k bigint").alias("d"), (F.col("event_id") % 7 == 0).alias("closed"))
    d = F.col("d").withField("closed", F.col("closed")).withField("rechecked", F.when(F.col("closed"), "2024-02-01"))
    return e.select("event_id", d.alias("d")).select("event_id", "d.k", "d.closed", "d.rechecked")


@query(
    "T14",
    """SELECT user_id, count(*) AS bands FROM (SELECT user_id, b, count(*) AS n, max(total) AS total
    FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS b, count(*)
    OVER (PARTITION BY user_id) AS total FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id
    ORDER BY x, event_id) <= 30 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, (event_id * 7919) % 600 AS x
    FROM event))) GROUP BY user_id, b) WHERE n * 10 >= total GROUP BY user_id""",
)
def column_bands(t):
    """Left edges clustered where no gap exceeds a width; bands with under a tenth of the edges drop out."""
    edges = t("event").select("user_id", ((F.col("event_id") * 7919) % 600).alias("x")).withColumn("x2", F.col("x"))
    total = edges.groupBy("user_id").agg(F.count("*").alias("total"))
    w = W.Window.partitionBy("user_id").orderBy("x")
    new = edges.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) > 30).cast("int"), F.lit(1)))
    banded = new.withColumn("b", F.sum("new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    bands = banded.groupBy("user_id", "b").agg(F.count("*").alias("n")).join(total, "user_id").filter("n * 10 >= total")
    return bands.groupBy("user_id").agg(F.count("*").alias("bands"))


@query("S01 S02", """SELECT 'feed_' || CAST(o_orderkey % 3 AS VARCHAR) AS source_slug, CAST(o_orderkey AS VARCHAR) AS external_id, CAST(min(o_orderkey // 40) AS BIGINT) AS page FROM orders GROUP BY o_orderkey""")
def feed_pages_once(t):
    """Pages of three feeds, each a JSON document whose neighbours overlap: every (source, posting) once, at its first page."""
    o = t("orders").select(F.col("o_orderkey").alias("k"))
    job = F.struct(F.concat(F.lit("feed_"), (F.col("k") % 3).cast("string")).alias("source_slug"), F.col("k").cast("string").alias("external_id"))
    pages = F.array_distinct(F.array(F.floor(F.col("k") / 40), F.floor((F.col("k") + 2) / 40)))
    body = o.select(job.alias("job"), F.explode(pages).alias("page")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("job").alias("jobs"))).alias("body"))
    jobs = body.select("page", F.explode(F.from_json("body", "jobs array<struct<source_slug:string,external_id:string>>")["jobs"]).alias("j"))
    return jobs.groupBy("j.source_slug", "j.external_id").agg(F.min("page").alias("page"))


@query("J17", """SELECT posting_id, count(DISTINCT skill) FILTER (WHERE covered) AS covered, count(DISTINCT skill) FILTER (WHERE NOT covered AND elsewhere) AS elsewhere, count(DISTINCT skill) FILTER (WHERE NOT covered AND NOT elsewhere) AS absent
    FROM (SELECT posting_id, skill, skill IN (SELECT p_name FROM part WHERE p_size < 3) AS covered, skill IN (SELECT p_name FROM part WHERE p_size = 7) AS elsewhere FROM requirement) GROUP BY posting_id""")  # fmt: skip
def evidence_split(t):
    mark = lambda cond, name: t("part").filter(cond).select(F.col("p_name").alias("skill")).distinct().withColumn(name, F.lit(True))
    r = t("requirement").select("posting_id", "skill").join(mark("p_size < 3", "c"), "skill", "left").join(mark("p_size = 7", "e"), "skill", "left")
    kind = F.when(F.col("c"), "covered").when(F.col("e"), "elsewhere").otherwise("absent")
    n = lambda k: F.count_distinct(F.when(F.col("k") == k, F.col("skill"))).alias(k)
    return r.withColumn("k", kind).groupBy("posting_id").agg(n("covered"), n("elsewhere"), n("absent"))


@query("A08", """SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS sent, count(*) FILTER (WHERE kind = 'click' AND turn > 2) AS answered, count(*) FILTER (WHERE kind = 'click' AND turn > 4) AS positive,
    count(*) FILTER (WHERE kind = 'click' AND event_id % 6 = 0) AS text_unknown FROM event GROUP BY user_id""")  # fmt: skip
def outcome_counts(t):
    sent = F.col("kind") == "click"
    n = lambda c: F.count_if(sent & c)
    return t("event").groupBy("user_id").agg(F.count_if(sent).alias("sent"), n(F.col("turn") > 2).alias("answered"), n(F.col("turn") > 4).alias("positive"), n(F.col("event_id") % 6 == 0).alias("text_unknown"))


@query(
    "F53",
    """SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) * 1.0000000001 AS FLOAT) AS
    DOUBLE) - x)) = 0 AS same FROM embeddings""",
)
def float_narrowing(t):
    """Double vectors stored in single precision: what the narrowing keeps of every component."""
    wide = F.transform("embedding", lambda x: x.cast("double") * 1.0000000001)
    back = F.zip_with(wide.cast("array<float>"), "embedding", lambda a, b: a.cast("double") - b.cast("double"))
    return t("embeddings").select("vec_id", (F.aggregate(back, F.lit(0.0), lambda s, x: s + x) == 0).alias("same"))


@query("F17", "SELECT n_name, regexp_matches(n_name, '(^|[^A-Za-z0-9])NATION_1($|[^0-9])') AS is_one FROM nation")
def whole_name_match(t):
    return t("nation").select("n_name", F.col("n_name").rlike("(^|[^A-Za-z0-9])NATION_1($|[^0-9])").alias("is_one"))


@query(
    "T13",
    """SELECT conv_id, string_agg(role || ': ' || replace(replace(text, '<', '('), '>', ')'), chr(10)
    ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id""",
)
def rendered_lines(t):
    """A conversation as lines of prose, with what could open a tag defanged; whole texts."""
    line = F.concat(F.col("role"), F.lit(": "), F.translate("text", "<>", "()"))
    items = F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("l"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: x["l"]), "\n").alias("body"))
