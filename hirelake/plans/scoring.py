"""The scoring pass: coverage, ladders, hard filters, formulas, buckets, vectors, early stop."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as S
from ..operators import vectors as V
from ..operators.listing import bucket_of


@query(
    "A14",
    """SELECT posting_id, CASE WHEN count(*) > 0 THEN round(sum(CASE WHEN held THEN weight ELSE 0 END) / (sum(weight) +
    avg(weight)), 6) END AS coverage FROM (SELECT posting_id, held, CAST(weight AS DOUBLE) AS weight
    FROM requirement) GROUP BY posting_id""",
)
def weighted_coverage_mean_weight(t):
    w = F.col("weight").cast("double")
    r = t("requirement").select("posting_id", "held", w.alias("weight"))
    got = F.sum(F.when(F.col("held"), F.col("weight")).otherwise(0.0)) / (F.sum("weight") + F.avg("weight"))
    return r.groupBy("posting_id").agg(F.round(got, 6).alias("coverage"))


@query(
    "A14 A23",
    """SELECT p.id, coalesce(c.share, 1.0) AS literal_share, coalesce(c.share, 0.0) AS overlap_share
    FROM posting p LEFT JOIN (SELECT posting_id, round(avg(CASE WHEN held THEN 1.0 ELSE 0.0 END), 6) AS share
    FROM requirement WHERE line > 2 GROUP BY posting_id) c ON c.posting_id = p.id""",
)
def coverage_empty_defaults(t):
    share = t("requirement").filter("line > 2").groupBy(F.col("posting_id").alias("id")).agg(F.round(F.avg(F.col("held").cast("double")), 6).alias("share"))
    return t("posting").join(share, "id", "left").select("id", F.coalesce("share", F.lit(1.0)).alias("literal_share"), F.coalesce("share", F.lit(0.0)).alias("overlap_share"))


HELD = "held AS (SELECT p_name AS skill, min(p_brand) AS family, min(p_partkey) AS place FROM part WHERE p_size <= 10 GROUP BY p_name)"


@query(
    "J14",
    f"""WITH {HELD}, near AS (SELECT family, min(place) AS place FROM held GROUP BY family) SELECT r.posting_id, r.line,
    r.skill, CAST(min(CASE WHEN h.skill IS NOT NULL THEN 1.0 WHEN n.place IS NOT NULL THEN 0.25 ELSE 0.0 END) AS DOUBLE)
    AS credit FROM requirement r LEFT JOIN held h ON h.skill = r.skill LEFT JOIN near n ON n.family = r.family
    GROUP BY r.posting_id, r.line, r.skill""",
)
def neighbour_credit(t):
    """Full credit for a held skill, a quarter for the first held neighbour of its family."""
    held = t("part").filter("p_size <= 10").groupBy(F.col("p_name").alias("skill")).agg(F.min("p_brand").alias("hf"), F.min("p_partkey").alias("place"))
    near = held.groupBy(F.col("hf").alias("family")).agg(F.min("place").alias("near"))
    r = t("requirement").join(held.select("skill", "place"), "skill", "left").join(near, "family", "left")
    credit = F.when(F.col("place").isNotNull(), 1.0).when(F.col("near").isNotNull(), 0.25).otherwise(0.0)
    return r.groupBy("posting_id", "line", "skill").agg(F.min(credit).alias("credit"))


PARTS = "(SELECT id, CAST(score AS DOUBLE) / 100 AS a, CAST(salary AS DOUBLE) / 500000 AS b, CASE WHEN seniority < 5 THEN seniority / 5.0 END AS c FROM posting)"


@query(
    "A15 F45",
    f"""SELECT id, round(100 * (coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.2 + coalesce(c, 0) * 0.3) / (0.5 + CASE WHEN b IS NULL
    THEN 0 ELSE 0.2 END + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END), 9) AS score
    FROM {PARTS}""",
)
def renormalised_score(t):
    p = t("posting").select("id", (F.col("score").cast("double") / 100).alias("a"), (F.col("salary").cast("double") / 500000).alias("b"), F.when(F.col("seniority") < 5, F.col("seniority") / 5.0).alias("c"))
    return p.select("id", F.round(100 * S.renormalised([(F.col("a"), 0.5, True), (F.col("b"), 0.2, False), (F.col("c"), 0.3, False)]), 9).alias("score"))


@query(
    "A16 F43",
    """SELECT id, s AS score, CASE WHEN s >= 80 THEN 'apply' WHEN s >= 78 THEN 'strong' WHEN s >= 75 THEN 'stretch' ELSE 'skip'
    END AS bucket FROM (SELECT id, round(coalesce(CAST(score AS DOUBLE), 0) * 0.7 + coalesce(CAST(seniority AS DOUBLE) *
    20, 0) * 0.3, 4) AS s FROM posting)""",
)
def title_score_bucketed(t):
    s = F.round(S.two_signal(F.col("score").cast("double"), F.col("seniority").cast("double") * 20), 4)
    return t("posting").select("id", s.alias("score")).withColumn("bucket", bucket_of(F.col("score"), (80, 78, 75)))


@query(
    "F44 F45",
    """SELECT id, round(greatest(0, least(100, CAST(score AS DOUBLE) - 8 * (seniority % 3) - CASE WHEN salary < 70000 THEN 15
    ELSE 0 END)), 2) AS score FROM posting WHERE score IS NOT NULL""",
)
def penalised_score(t):
    gap, low = 8 * (F.col("seniority") % 3), F.when(F.col("salary") < 70000, 15).otherwise(0)
    return t("posting").filter("score is not null").select("id", S.final_score(F.col("score").cast("double") - gap - low).cast("double").alias("score"))


@query(
    "F41",
    """SELECT id, CAST(CASE WHEN g <= -2 THEN 0.9 WHEN g <= 0 THEN 1.0 WHEN g <= 1 THEN 0.8 WHEN g <= 2 THEN 0.55 WHEN g <= 4
    THEN 0.25 WHEN g IS NOT NULL THEN 0.0 END AS DOUBLE) AS fit FROM (SELECT id, seniority * 2 - company_id % 9 AS g
    FROM posting)""",
)
def experience_ladder(t):
    return t("posting").select("id", S.experience_fit(F.col("seniority") * 2 - F.col("company_id") % 9).alias("fit"))


@query(
    "F42",
    """SELECT id, CAST(CASE WHEN id % 6 = 2 THEN 1.0 ELSE round(greatest(0.8, 1 - 0.1 * abs(seniority - company_id % 5)), 2)
    END AS DOUBLE) AS multiplier FROM posting""",
)
def seniority_multiplier(t):
    """An unknown grade on either side costs nothing."""
    grade = F.when(F.col("id") % 6 != 2, F.col("seniority"))
    return t("posting").select("id", F.round(S.seniority_multiplier(grade, F.col("company_id") % 5).cast("double"), 2).alias("multiplier"))


@query(
    "A17",
    """SELECT id, round(CASE WHEN score IS NULL AND salary IS NULL AND published IS NULL THEN NULL ELSE (coalesce(CAST(score AS
    DOUBLE) / 100, 0) + coalesce(CAST(salary AS DOUBLE) / 500000, 0) + CASE WHEN published IS NULL THEN 0.0 ELSE 1.0
    END) / (CASE WHEN score IS NULL THEN 0 ELSE 1 END + CASE WHEN salary IS NULL THEN 0 ELSE 1 END + CASE WHEN published
    IS NULL THEN 0 ELSE 1 END) END, 9) AS fit FROM posting""",
)
def logistics_mean(t):
    parts = [F.col("score").cast("double") / 100, F.col("salary").cast("double") / 500000, F.when(F.col("published").isNotNull(), 1.0)]
    return t("posting").select("id", F.round(S.mean_of_known(parts), 9).alias("fit"))


@query(
    "P25",
    """SELECT id, CASE WHEN NOT is_active THEN 'closed' WHEN company_id % 10 = 3 THEN 'language' WHEN seniority * 2 -
    company_id % 9 > 4 THEN 'experience' WHEN salary < 20000 THEN 'location' END AS reason
    FROM posting""",
)
def hard_filter_reason(t):
    gap = F.col("seniority") * 2 - F.col("company_id") % 9
    rungs = [(~F.col("is_active"), "closed"), (F.col("company_id") % 10 == 3, "language"), (gap > 4, "experience"), (F.col("salary") < 20000, "location")]
    return t("posting").select("id", S.first_reason(rungs).alias("reason"))


@query(
    "P26",
    """SELECT posting_id, CAST(min(CASE WHEN verdict = 'refused' THEN line END) AS BIGINT) AS refused_at, count(*) FILTER
    (WHERE verdict = 'weak' AND line < stop) AS flags FROM (SELECT *, coalesce(min(CASE WHEN verdict = 'refused' THEN
    line END) OVER (PARTITION BY posting_id), 99) AS stop FROM (SELECT posting_id, line, CASE WHEN family IN ('Brand#1',
    'Brand#2', 'Brand#3') THEN 'refused' WHEN held THEN 'ok' ELSE 'weak' END AS verdict
    FROM requirement)) GROUP BY posting_id""",
)
def language_gate(t):
    """Flags before the first refusal are kept; those behind it are not raised."""
    verdict = F.when(F.col("family").isin("Brand#1", "Brand#2", "Brand#3"), "refused").when(F.col("held"), "ok").otherwise("weak")
    lines = F.sort_array(F.collect_list(F.struct(F.col("line").cast("long").alias("line"), verdict.alias("v"))))
    r = t("requirement").groupBy("posting_id").agg(lines.alias("all"))
    stop = F.array_min(F.transform(F.filter("all", lambda x: x["v"] == "refused"), lambda x: x["line"]))
    r = r.withColumn("refused_at", stop)
    return r.select("posting_id", "refused_at", F.size(F.filter("all", lambda x: (x["v"] == "weak") & (x["line"] < F.coalesce(F.col("refused_at"), F.lit(99))))).cast("long").alias("flags"))


PASS_SQL = """SELECT p.id, round(greatest(0, least(100, 100 * (coalesce(c.cover, 0) * 0.6 + coalesce(CAST(p.score AS DOUBLE) / 100, 0) * 0.4)
    / (CASE WHEN c.cover IS NULL THEN 0 ELSE 0.6 END + 0.4))), 9) AS score, coalesce(c.missing, 0) AS missing,
    CASE WHEN NOT p.is_active THEN 'closed' WHEN p.seniority * 2 - p.company_id % 9 > 4 THEN 'experience' END AS reason
    FROM posting p LEFT JOIN (SELECT posting_id, sum(CASE WHEN held THEN w ELSE 0 END) / (sum(w) + avg(w)) AS cover, count(*) FILTER (WHERE NOT held) AS missing
    FROM (SELECT posting_id, held, CAST(weight AS DOUBLE) AS w FROM requirement) GROUP BY posting_id) c ON c.posting_id = p.id"""


def scoring_pass(t):
    """Every posting's score, missing count and refusal in one job: one aggregate, one join, columns the rest."""
    w = F.col("weight").cast("double")
    r = t("requirement").select(F.col("posting_id").alias("id"), "held", w.alias("w"))
    cover = r.groupBy("id").agg((F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0)) / (F.sum("w") + F.avg("w"))).alias("cover"), F.count_if(~F.col("held")).alias("missing"))
    p = t("posting").join(cover, "id", "left")
    score = 100 * S.renormalised([(F.col("cover"), 0.6, False), (F.col("score").cast("double") / 100, 0.4, True)])
    reason = S.first_reason([(~F.col("is_active"), "closed"), (F.col("seniority") * 2 - F.col("company_id") % 9 > 4, "experience")])
    return p.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 9).alias("score"), F.coalesce("missing", F.lit(0)).alias("missing"), reason.alias("reason"))


@query("F46 J21", PASS_SQL)
def scoring_pass_full(t):
    return scoring_pass(t)


@query(
    "A10",
    f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN score >= 85 THEN 'apply'
    WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'stretch' ELSE 'skip' END AS bucket
    FROM ({PASS_SQL})) GROUP BY bucket""",
)
def bucket_histogram(t):
    s = scoring_pass(t)
    return s.groupBy(F.when(F.col("reason").isNotNull(), "filtered").otherwise(bucket_of(F.col("score"))).alias("bucket")).agg(F.count("*").alias("n"))


QUERY = [math.cos(i) for i in range(64)]
_Q = "[" + ", ".join(repr(x) for x in QUERY) + "]::DOUBLE[]"


@query(
    "J12 F40 O10",
    f"""SELECT vec_id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) + 1) / 2, 6) AS similarity
    FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) DESC, vec_id LIMIT 25""",
)
def cosine_topk_vs_profile(t):
    top = V.nearest(t("embeddings"), "embedding", QUERY, 25, "vec_id")
    return top.select("vec_id", F.round(V.similarity(F.col("cos")), 6).alias("similarity"))


@query(
    "O09 O10",
    f"""SELECT vec_id FROM embeddings ORDER BY (vec_id % 7 = 0) DESC, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 1 -
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) END ASC NULLS LAST, vec_id LIMIT 100""",
)
def nearest_nulls_last(t):
    q = F.array(*[F.lit(x) for x in QUERY])
    distance = F.when(F.col("vec_id") % 5 != 0, 1 - V.cosine(F.col("embedding"), q))
    return t("embeddings").withColumn("d", distance).orderBy((F.col("vec_id") % 7 == 0).desc(), F.col("d").asc_nulls_last(), "vec_id").limit(100).select("vec_id")


@query(
    "W08",
    f"""SELECT vec_id FROM (SELECT vec_id, 0.7 * ((vec_id * 37 % 1001) / 1000.0) + 0.3 * ((list_cosine_similarity(CAST(embedding
    AS DOUBLE[]), {_Q}) + 1) / 2) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 25""",
)
def early_stop_topk(t):
    q = F.array(*[F.lit(x) for x in QUERY])
    df = t("embeddings").select("vec_id", ((F.col("vec_id") * 37 % 1001) / 1000.0).alias("title"), V.similarity(V.cosine(F.col("embedding"), q)).alias("text"))
    return V.early_stop_topk(df, "title", "text", "vec_id", 25).select("vec_id")


@query(
    "U02 J15",
    """SELECT r.posting_id, CAST(count(DISTINCT r.skill) FILTER (WHERE r.held) AS BIGINT) AS matched, CAST(count(DISTINCT
    r.skill) FILTER (WHERE NOT r.held) AS BIGINT) AS missing FROM requirement r
    GROUP BY r.posting_id""",
)
def requirement_overlap(t):
    return t("requirement").groupBy("posting_id").agg(F.count_distinct(F.when(F.col("held"), F.col("skill"))).alias("matched"), F.count_distinct(F.when(~F.col("held"), F.col("skill"))).alias("missing"))


@query(
    "U02",
    """WITH s AS (SELECT posting_id, list_distinct(list(skill)) AS a FROM requirement
    GROUP BY posting_id), q AS (SELECT a FROM s WHERE posting_id = (SELECT min(posting_id)
    FROM s)) SELECT posting_id, round(len(list_intersect(s.a, q.a)) / CAST(len(list_distinct(list_concat(s.a, q.a))) AS
    DOUBLE), 6) AS jaccard FROM s, q WHERE len(list_intersect(s.a, q.a)) / CAST(len(list_distinct(list_concat(s.a,
    q.a))) AS DOUBLE) >= 0.1""",
)
def jaccard_examples(t):
    s = t("requirement").groupBy("posting_id").agg(F.collect_set("skill").alias("a"))
    q = s.agg(F.min_by("a", "posting_id").alias("q"))  # one row
    j = F.size(F.array_intersect("a", "q")) / F.size(F.array_union("a", "q"))
    return s.crossJoin(F.broadcast(q)).withColumn("j", j).filter("j >= 0.1").select("posting_id", F.round("j", 6).alias("jaccard"))


@query(
    "P27 P28",
    """SELECT id, CASE WHEN NOT is_active THEN 'archived' WHEN status = 'F' AND seniority = 5 THEN 'closed' WHEN seniority * 2
    - company_id % 9 > 4 THEN 'experience' WHEN company_id % 10 = 3 THEN 'language' WHEN n IS NULL THEN 'no letter' WHEN
    published < DATE '1996-01-01' THEN 'stale page' ELSE 'ready' END AS verdict
    FROM posting p LEFT JOIN (SELECT posting_id, count(*) AS n FROM provenance
    WHERE slug = 'feed_0' GROUP BY posting_id) s ON s.posting_id = p.id""",
)
def triage_ladder(t):
    letters = t("provenance").filter("slug = 'feed_0'").groupBy(F.col("posting_id").alias("id")).agg(F.count("*").alias("n"))
    rungs = [
        (~F.col("is_active"), "archived"), ((F.col("status") == "F") & (F.col("seniority") == 5), "closed"), (F.col("seniority") * 2 - F.col("company_id") % 9 > 4, "experience"),
        (F.col("company_id") % 10 == 3, "language"), (F.col("n").isNull(), "no letter"), (F.col("published") < F.lit("1996-01-01").cast("date"), "stale page"),
    ]
    return t("posting").join(letters, "id", "left").select("id", S.first_reason(rungs, "ready").alias("verdict"))


@query(
    "T12",
    """SELECT id, concat_ws('; ', CASE WHEN NOT is_active THEN 'closed' END, CASE WHEN score IS NULL THEN 'unscored' END, CASE
    WHEN salary IS NULL THEN 'no pay' END, CASE WHEN published IS NULL THEN 'undated' END) AS blockers
    FROM posting""",
)
def readiness_all_blockers(t):
    flag = lambda c, s: F.when(c, s)
    return t("posting").select("id", F.concat_ws("; ", flag(~F.col("is_active"), "closed"), flag(F.col("score").isNull(), "unscored"), flag(F.col("salary").isNull(), "no pay"), flag(F.col("published").isNull(), "undated")).alias("blockers"))


@query(
    "A25 O12 W11",
    """SELECT p_brand, CAST(sum(p_size) FILTER (WHERE rn <= 3) AS BIGINT) AS strength, max(p_size) AS top, count(*) AS n,
    bool_or(p_type = 'SMALL') AS small FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
    ORDER BY p_size DESC, p_partkey) AS rn FROM part) GROUP BY p_brand""",
)
def group_strength_top3(t):
    from pyspark.sql import window as W

    ranked = t("part").withColumn("rn", F.row_number().over(W.Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")))
    return ranked.groupBy("p_brand").agg(F.sum(F.when(F.col("rn") <= 3, F.col("p_size"))).cast("long").alias("strength"), F.max("p_size").alias("top"), F.count("*").alias("n"), F.bool_or(F.col("p_type") == "SMALL").alias("small"))


@query(
    "F47",
    """SELECT id, round(CAST(salary AS DOUBLE) * CASE seniority WHEN 1 THEN 1.0 WHEN 2 THEN 1.09 WHEN 3 THEN 0.0021 WHEN 4 THEN
    0.25 END * CASE id % 4 WHEN 0 THEN 160 WHEN 1 THEN 21 WHEN 2 THEN 1 ELSE 1 / CAST(12 AS DOUBLE) END, 9) AS monthly
    FROM posting WHERE salary IS NOT NULL""",
)
def salary_monthly(t):
    rate = F.when(F.col("seniority") == 1, 1.0).when(F.col("seniority") == 2, 1.09).when(F.col("seniority") == 3, 0.0021).when(F.col("seniority") == 4, 0.25)
    period = F.when(F.col("id") % 4 == 0, 160.0).when(F.col("id") % 4 == 1, 21.0).when(F.col("id") % 4 == 2, 1.0).otherwise(1 / 12.0)
    return t("posting").filter("salary is not null").select("id", F.round(F.col("salary").cast("double") * rate * period, 9).alias("monthly"))


