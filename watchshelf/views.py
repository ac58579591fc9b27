"""The catalog's tables over the driver's: one SELECT each, in words that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sources.readers import parquet_table

VIEWS: dict[str, str] = {
    "subject": """
        SELECT p_partkey AS id, CAST(p_partkey AS INT) AS bangumi_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' ', p_name) ELSE '' END AS name_cn, p_type AS image,
               CAST(2 AS INT) AS type, CAST(p_size AS INT) AS eps, CAST(p_partkey % 1000 AS INT) AS rank, CAST((p_partkey * 7) % 5000 AS INT) AS collection_total,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS DOUBLE) / 10 END AS score,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT) END AS air_date,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey % 2400) % 7 AS INT) END AS air_weekday, p_size = 50 AS nsfw, CAST(p_size % 2 AS INT) AS import_status
        FROM {part}""",
    "episode": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS subject_id, CAST(CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE 0 END AS INT) AS type,
               CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 2 ELSE l_quantity END AS sort, CAST(l_shipdate AS DATE) AS airdate
        FROM {lineitem}""",
    "subject_tag": """
        SELECT l_partkey * 10 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS id, l_partkey AS subject_id, l_returnflag AS name, CAST(count(*) AS INT) AS count
        FROM {lineitem} GROUP BY l_partkey, l_returnflag""",
    "subject_relation": """
        SELECT CAST(n_nationkey AS BIGINT) AS subject_id, CAST(n_regionkey + 100 AS BIGINT) AS related_subject_id,
               CASE n_regionkey WHEN 0 THEN 'prequel' WHEN 1 THEN 'spin_off' WHEN 2 THEN 'side_story' ELSE 'character' END AS relation
        FROM {nation}""",
    "account": """
        SELECT c_custkey AS id, c_name AS username, concat(lower(c_name), '@example.com') AS email, c_mktsegment AS nickname, CASE WHEN c_custkey % 100 = 0 THEN 'ADMIN' ELSE 'USER' END AS role,
               DATE '2024-01-01' + CAST(c_custkey % 45 AS INT) AS created_at, 'secret' AS password
        FROM {customer}""",
    "user_collection": """
        SELECT o_orderkey AS id, o_custkey AS user_id, (o_orderkey * 7) % 200 AS subject_id, CAST(1 + o_orderkey % 5 AS INT) AS type, CAST(o_orderkey % 11 AS INT) AS rate,
               CAST(o_orderkey % 13 AS INT) AS ep_status, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM {orders}""",
    "import_record": """
        SELECT event_id AS id, event_type AS mode, ts AS started_at, CASE WHEN event_id % 7 = 1 THEN NULL ELSE ts END AS completed_at,
               CASE WHEN event_id % 5 = 0 THEN 'FAILED' WHEN event_id % 7 = 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, CAST(floor(value) AS INT) AS subject_count
        FROM {events} WHERE event_type IN ('signup', 'error')""",
    "operation_log": """
        SELECT event_id AS id, user_id, concat('user', CAST(user_id AS VARCHAR(20))) AS username, CASE WHEN event_type = 'signup' THEN 'LOGIN' ELSE upper(event_type) END AS action,
               CASE WHEN event_id % 2 = 0 THEN 'CLIENT' ELSE 'ADMIN' END AS module, CAST(CASE WHEN event_type = 'error' OR event_id % 10 = 3 THEN 1 ELSE 0 END AS INT) AS status,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms, props AS params, ts AS created_at
        FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    (source,) = re.findall(r"\{(\w+)\}", VIEWS[name])
    return spark.sql(VIEWS[name], **{source: parquet_table(spark, sf_dir, source)})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used)
    return f"WITH {heads}\n{sql}" if not sql.lstrip().startswith("WITH ") else f"WITH {heads},\n{sql.lstrip()[5:]}"
