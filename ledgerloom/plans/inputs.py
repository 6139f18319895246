"""Input views of the registered queries, in SQL that Spark and DuckDB both read. {table} stands for a driver table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "friends": """SELECT event_id AS _seq, user_id AS uid, concat('https://example.org/my_page/', user_id, '/') AS link, ts AS followed_at,
        CASE WHEN event_type = 'error' THEN ts END AS blocked_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_blocked,
        CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat('n', event_id) END AS name,
        CASE WHEN event_id % 2 = 0 THEN concat('v', event_id) END AS view_name,
        CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS landing FROM {events}""",
    "blocks": """SELECT event_id AS _seq, user_id + 50 AS uid, CASE WHEN event_id % 2 = 0 THEN concat('b', event_id) END AS name,
        CASE WHEN event_id % 5 > 0 THEN ts END AS blocked_at FROM {events} WHERE event_type = 'error'""",
    "tags": """SELECT event_id AS _seq, user_id AS uid, CAST(ts AS DATE) AS date, k % 2 = 0 AS v1, k % 3 = 0 AS v2, k % 5 = 0 AS v3, k > 50 AS v4,
        event_type = 'click' AS hope, event_type = 'view' AS attend
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) AS e""",
    "leads": """SELECT o_orderkey AS _seq, o_orderdate AS followed_at, o_orderpriority AS referrer, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE '' END AS consult,
        CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 150000) THEN 'y' ELSE ' ' END AS contract, c_name AS name,
        CASE WHEN o_orderkey % 3 = 0 THEN '◯' ELSE '' END AS tag_a, CASE WHEN o_orderkey % 7 = 0 THEN '◯ x' END AS tag_b
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "students": """SELECT c_custkey AS _seq, CASE WHEN c_custkey % 3 > 0 THEN concat('s', c_custkey) END AS id, concat('s', c_custkey) AS user_id, c_name AS name,
        CASE WHEN c_custkey % 4 > 0 THEN concat('m', c_custkey, '@example.org') END AS email, c_nationkey AS nation,
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE ' ' END AS motivation FROM {customer}""",
    "categories": """SELECT o_custkey AS id, o_orderkey AS _seq, o_orderpriority AS name, o_orderstatus = 'F' AS is_completed, o_orderdate AS due FROM {orders}""",
    "mentions": """SELECT event_id AS id, event_id AS _seq, CAST(user_id AS {string}) AS sender_id, concat('u ', user_id, '(x)') AS user_name,
        CASE WHEN event_id % 10 > 0 THEN event_type ELSE '' END AS channel, ts AS created_at,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0 AS is_read FROM {events}""",
    "videos": """SELECT p_partkey AS id, p_brand AS channel_id, p_name AS title, p_size AS view_count, p_partkey AS published,
        CASE WHEN p_size % 4 = 0 THEN 'private' ELSE 'public' END AS privacy_status FROM {part}""",
    "comments": """SELECT conv_id AS video_id, turn AS pos, CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END AS text_display, concat('o', text) AS text_original FROM {conversations}""",
    "dates": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN concat(CAST(CAST(o_orderdate AS DATE) AS {string}), 'T10:00:00+09')
        WHEN 7 THEN concat(replace(CAST(CAST(o_orderdate AS DATE) AS {string}), '-', ''), 'T101112Z') WHEN 4 THEN concat(CAST(CAST(o_orderdate AS DATE) AS {string}), 'T00:30:00Z')
        WHEN 5 THEN concat(CAST(CAST(o_orderdate AS DATE) AS {string}), ' 23:30:00.5-05:00') WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日 8時05分')
        WHEN 1 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate)) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS {string}) ELSE 'x' END AS raw, o_orderdate FROM {orders}""",
}


def _tables(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text)) - {"string"}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("{string}", "STRING")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(text)})


def duckdb_view(name: str) -> str:
    text = VIEWS[name].replace("{string}", "VARCHAR")
    for table in _tables(text):
        text = text.replace("{" + table + "}", table)
    return f"({text})"
