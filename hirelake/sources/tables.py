"""Table scans and the domain views over them, written once in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Domain views; {name} stands for a table. Nulls are derived from key moduli so that both engines see the same ones.
VIEWS = {
    "posting": """
        SELECT o_orderkey AS id, o_custkey AS company_id, o_orderstatus AS status,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS seniority,
               CASE WHEN o_orderkey % 11 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published,
               CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS salary,
               CASE WHEN o_orderkey % 5 = 4 THEN NULL
                    ELSE CAST(CAST((o_orderkey * 37) % 10001 AS DECIMAL(7,0)) * 0.01 AS DECIMAL(5,2)) END AS score,
               o_orderkey % 17 <> 0 AS is_active
        FROM {orders}""",
    "provenance": """
        SELECT l_orderkey AS posting_id, concat('feed_', CAST(l_suppkey % 4 AS VARCHAR(9))) AS slug,
               l_partkey AS ext_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS seen,
               CAST(l_quantity AS BIGINT) AS size
        FROM {lineitem}""",
    "requirement": """
        SELECT l_orderkey AS posting_id, p_name AS skill, p_brand AS family, l_linenumber AS line,
               CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.6 END AS weight,
               l_partkey % 3 = 0 AS held
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "company": """
        SELECT c_custkey AS company_id, c_name AS company, n_name AS city, n_regionkey AS region_id,
               c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(12,2)) AS balance
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "event": """
        SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS kind,
               CAST(value AS DECIMAL(12,2)) AS value, CAST(event_id % 7 AS INT) AS turn
        FROM {events}""",
    "vacancy": """
        SELECT o_orderkey AS id, concat('Role ', CAST(o_orderkey % 50 AS VARCHAR(9))) AS title, c_name AS company, n_name AS city,
               CASE n_regionkey WHEN 0 THEN 'KZ' WHEN 1 THEN 'PL' WHEN 2 THEN NULL ELSE 'US' END AS country,
               CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'hybrid' ELSE 'no' END AS remote,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS seniority,
               CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS salary,
               CASE WHEN o_orderkey % 7 = 3 OR o_orderkey % 3 = 1 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) + 500 AS DECIMAL(12,2)) END AS salary_max,
               CASE o_orderkey % 8 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'KZT' WHEN 3 THEN NULL ELSE 'PLN' END AS currency,
               CASE WHEN o_orderkey % 9 = 4 THEN 'year' ELSE 'month' END AS period,
               CASE WHEN o_orderkey % 6 = 5 THEN 'part_time' ELSE 'full_time' END AS employment_type,
               CASE o_orderkey % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE NULL END AS language,
               CASE WHEN o_orderkey % 11 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published,
               CAST(o_orderdate AS DATE) AS first_seen,
               CASE WHEN o_orderkey % 5 = 4 THEN NULL
                    ELSE CAST(CAST((o_orderkey * 37) % 10001 AS DECIMAL(7,0)) * 0.01 AS DECIMAL(5,2)) END AS score,
               o_orderkey % 17 <> 0 AS is_active, o_orderkey % 23 = 7 AS is_spam
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "application": """
        SELECT event_id AS id, user_id AS vacancy_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS profile_id, ts AS created_at,
               CASE event_id % 6 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'interview' WHEN 3 THEN 'offer'
                    WHEN 4 THEN 'rejected' ELSE 'saved' END AS status,
               CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '  ' ELSE concat('letter ', CAST(event_id AS VARCHAR(9))) END AS cover_letter,
               CASE WHEN event_id % 5 = 0 THEN ts ELSE NULL END AS sent_at,
               CASE WHEN event_id % 5 = 1 THEN 'rules:old' ELSE NULL END AS rules_version
        FROM {events}""",
    "report": """
        SELECT user_id AS vacancy_id, event_id AS id, ts AS stamp,
               CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'failed' WHEN 3 THEN 'needs_manual'
                    WHEN 4 THEN 'sent' WHEN 5 THEN 'skipped' ELSE 'queued' END AS status,
               CASE WHEN event_id % 2 = 0 THEN 'human' ELSE 'agent' END AS actor,
               CASE WHEN event_id % 5 = 1 THEN concat('title ', CAST(event_id AS VARCHAR(9))) ELSE NULL END AS title,
               CASE WHEN event_id % 4 = 1 THEN concat('reason ', CAST(event_id AS VARCHAR(9))) ELSE NULL END AS reason,
               CASE WHEN event_id % 5 = 2 THEN concat('warning ', CAST(event_id AS VARCHAR(9))) ELSE NULL END AS warning,
               CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 < 3 THEN 'RESPONSE' ELSE 'INVITATION' END AS state,
               CASE WHEN event_id % 8 = 4 THEN NULL ELSE concat('letter ', CAST(event_id AS VARCHAR(9))) END AS letter
        FROM {events}""",
    "match": """
        SELECT l_suppkey % 5 AS profile_id, l_orderkey AS vacancy_id, max(CAST(l_quantity AS DECIMAL(5,2))) AS score
        FROM {lineitem} GROUP BY l_suppkey % 5, l_orderkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a domain view over base tables. The scan keeps column pruning and filter pushdown."""
    if name in VIEWS:
        body = VIEWS[name].replace("VARCHAR(9)", "STRING")
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in body}
        return spark.sql(body, **used)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """Oracle SQL with the domain views it names put in front as common table expressions."""
    names = [n for n in VIEWS if f" {n} " in f" {sql.replace(chr(10), ' ').replace('(', ' ').replace(')', ' ').replace(',', ' ')} "]
    views = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
    if not views:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
