"""Registered queries of the text operators, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import centroids, embedding_links, filter_audit, fingerprints, jaccard_join, language, mixing, pieces, pii, pitman_yor, secrets, sharding, toxicity
from .common import documents


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_binary_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.linked(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "kept")


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(documents(spark, sf_dir))


def op8_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("tie", "judged")


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SPACES = r"[\x20\x09-\x0D]+"
_HEX8 = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"

LINKS = """
link AS (SELECT {pairs}),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(v, r) AS (SELECT id, id FROM node UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v AS {id}, min(r) AS {component}, CAST(coalesce(max(degree.n), 0) AS BIGINT) AS n_links, v = min(r) AS kept
FROM reach LEFT JOIN degree ON degree.a = v GROUP BY v"""

OP4 = (
    "WITH RECURSIVE node AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),"
    + LINKS.format(pairs="x.id AS a, y.id AS b FROM node x JOIN node y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.9", id="vec_id", component="component_id")
)

OP5 = (
    f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACES}'), lambda x: x <> '') AS a FROM documents),
node AS (SELECT doc_id AS id FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),"""
    + LINKS.format(pairs="a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9", id="doc_id", component="class_id")
)


def _op9() -> str:
    kinds = secrets.BASE + secrets.ADDED
    quoted = [(i, k, p.replace("'", "''"), g, n) for i, (k, p, g, n) in enumerate(kinds)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, owner, t, {i} AS rank, '{k}' AS kind, {n} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"
        for i, k, p, g, n in quoted
    )
    last = len(secrets.BASE)
    line = "string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, rank)"
    count = lambda name, p: f"CAST(coalesce(x.{name}, 0) AS BIGINT) AS {name}"
    names = {**{f"n_{k}": f"rank = {i}" for i, (k, *_) in enumerate(secrets.BASE)}, "n_live": "live", "n_example": f"NOT live AND rank < {last}", "n_added": f"live AND rank >= {last}"}
    return f"""WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
span AS (SELECT doc_id, owner, t, rank, kind, v[i] AS value, length(m[i]) AS n, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s FROM each WHERE length(v[i]) >= least),
own AS (SELECT value, (count(DISTINCT owner) = 1 OR count(DISTINCT owner) <= {secrets.MOST_OWNERS} AND count(DISTINCT (owner, t)) <= {secrets.MOST_REPOSITORIES})
    AND NOT regexp_matches(value, '{secrets.PLACEHOLDER}') AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_CHARACTERS} AS live FROM span GROUP BY value),
judged AS (SELECT span.*, live FROM span JOIN own ON span.value = own.value),
x AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE {p}) AS {n}" for n, p in names.items())},
    {line} FILTER (WHERE rank < {last}) AS base, {line} FILTER (WHERE live OR rank < {last}) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, {", ".join(count(n, p) for n, p in names.items())}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON x.doc_id = d.doc_id"""


def _op10() -> str:
    place = _HEX8.format("CAST(doc_id AS VARCHAR)")
    u = _HEX8.format("'mix:' || CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END") + " / 4294967296.0::DOUBLE"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w
    WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT coalesce(max(level), 1e300) FROM o WHERE cap / weight > level)) AS target FROM o),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r, {u.replace("source", "d.source")} AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY size, {place}, doc_id) - 1 AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (floor((rank + 1) * r + u) - floor(rank * r + u)) AS BIGINT) AS taken,
    CAST(floor((rank + 1) * r + u) - floor(rank * r + u) AS BIGINT) AS copies FROM k"""


OP12 = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS doc_id FROM d GROUP BY t),
mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(mark.good, false) AS good, coalesce(mark.toxic, false) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
    WHEN 'C' THEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) WHEN 'D' THEN regexp_matches(d.t, '[#$%&*|]') ELSE coalesce(d.doc_id > first.doc_id, false) END) AS fails
    FROM d JOIN first ON first.t = d.t LEFT JOIN mark ON mark.doc_id = d.doc_id),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
turn AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
case_ AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
seen AS (SELECT part, filter_order, s AS step, substr(filter_order, s, 1) AS letter, list_contains(fails, substr(filter_order, s, 1)) AS fails_it, list_has_any(fails, string_split(substr(filter_order, 1, s - 1), '')) AS gone, fails, n, good, toxic
    FROM case_, turn, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS s)),
x AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [letter]), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_it), 0) AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM x"""


def _op13() -> str:
    """Plain rounds, each a statement of its own: all distances, the nearest, the means."""
    near = """a{n} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT))), j := j)) AS best FROM k, c{n} GROUP BY row, vec_id, v)"""
    mean = """s{n} AS (SELECT best.j AS j, i, sum(v[i]) AS total, count(*) AS n FROM a{n}, range(1, 65) r(i) GROUP BY 1, 2),
c{m} AS MATERIALIZED (SELECT j, coalesce((SELECT list(CAST((s{n}.total - (s{n}.total % s{n}.n + s{n}.n) % s{n}.n) // s{n}.n AS BIGINT) ORDER BY i) FROM s{n} WHERE s{n}.j = c{n}.j), m) AS m FROM c{n})"""
    rounds = ",\n".join(near.format(n=n) + ",\n" + mean.format(n=n, m=n + 1) for n in range(centroids.ROUNDS))
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS j, v AS m FROM k WHERE vec_id IS NOT NULL QUALIFY j < 8),
{rounds},
{near.format(n=centroids.ROUNDS)}
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} ON c{centroids.ROUNDS}.j = best.j"""


def oracle_sql() -> dict[str, str]:
    """Operators whose whole result SQL can state; the others are held against plain Python in the tests."""
    return {"op4_binary_code_links": OP4, "op5_ngram_jaccard_join": OP5, "op9_secret_ownership": _op9(), "op10_systematic_mixing": _op10(), "op12_filter_audit": OP12, "op13_hamerly_clusters": _op13()}
