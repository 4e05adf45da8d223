"""The service's tables as views over the test tables, in SQL that Spark and DuckDB both run.

A name in braces is a table of the input or another view. On a real deployment the same operators take the real tables.
Timestamps are kept without zone; every time-dependent operator takes its time as a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "users": "SELECT c_custkey AS user_id, c_name AS nickname, c_acctbal > 0 AS is_notification_enabled, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 3 + c_nationkey % 5 END AS max_sites_limit, CASE WHEN c_custkey % 100 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, c_mktsegment AS provider, c_custkey % 97 AS referrer_id FROM {customer}",
    "sites": "SELECT s_suppkey AS site_id, concat('https://', lower(replace(s_name, '#', '-')), '.example/notices') AS site_url, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'active' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' ELSE 'blocked' END AS crawl_status, CASE WHEN s_suppkey % 5 = 3 AND s_suppkey % 2 = 0 THEN 'SITE_ACCESS_BLOCKED' WHEN s_suppkey % 11 = 0 THEN 'NO_NOTICE_SOURCE' END AS validation_error_code, s_nationkey AS nation_id FROM {supplier}",
    "n_sites": "SELECT count(*) AS n FROM {supplier}",
    "notices": "SELECT o_orderkey AS notice_id, o_custkey % greatest(n, 1) AS site_id, concat('Notice ', o_orderkey % 500, ' ', o_orderpriority) AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('https://n.example/', o_orderkey) END AS detail_url, concat('https://n.example/list/', o_custkey) AS url, CASE WHEN o_orderkey % 4 = 0 THEN concat('X', o_orderkey) END AS external_id, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE substr(o_orderpriority, 3) END AS author, o_orderdate AS created_at, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate - INTERVAL 1 DAY END AS published_at, o_orderdate AS scraped_at, o_orderstatus <> 'P' AS is_active FROM {orders} CROSS JOIN {n_sites} AS s",
    "subscriptions": "SELECT o_custkey AS user_id, l_suppkey AS site_id, o_custkey * 100000 + l_suppkey AS subscription_id, concat('site ', l_suppkey % 50) AS alias, min(o_orderdate) AS last_viewed_at, CASE WHEN (o_custkey + l_suppkey) % 9 = 0 THEN NULL ELSE min(o_orderdate) END AS registration_completed_at, (o_custkey + l_suppkey) % 4 <> 0 AS notification_enabled FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey HAVING count(*) >= 2",
    "hidden": "SELECT DISTINCT o_custkey AS user_id, l_orderkey AS notice_id FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'",
    "runs": "SELECT event_id AS crawl_run_id, user_id AS site_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'success' WHEN 'click' THEN 'valid_empty' ELSE 'running' END AS status, CASE WHEN event_id % 6 = 0 THEN 'correct' WHEN event_id % 6 = 1 THEN 'incorrect' END AS review_label, CASE event_id % 7 WHEN 0 THEN 'approved' WHEN 1 THEN 'reused' WHEN 2 THEN 'rejected' WHEN 3 THEN 'failed' END AS rule_activation_status, CASE event_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS evaluator_decision, CAST(round(value * 100) AS BIGINT) AS llm_input_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 200 END AS llm_output_tokens, CAST(value AS DECIMAL(12, 6)) AS llm_cost, props AS agent_stage_telemetry, CASE WHEN event_type = 'error' THEN concat('E', event_id % 4) END AS error_code, date_trunc('second', ts) AS started_at FROM {events}",
    "states": "SELECT event_id AS api_id, user_id AS site_id, concat('https://a.example/', event_id) AS api_url, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('h', event_id % 3) END AS last_processed_hash, concat('h', event_id % 5) AS observed_hash, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'success' WHEN 'click' THEN 'valid_empty' WHEN 'signup' THEN 'pending' END AS processing_status, event_id % 5 AS retry_count, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + INTERVAL 1 HOUR END AS next_retry_at, date_trunc('second', ts) AS scraped_at, props AS extractor_config FROM {events}",
    "outbox": "SELECT event_id, user_id * 100000 + event_id % 100 AS subscription_id, event_id % 50 AS crawl_run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'sent' ELSE 'cancelled' END AS status, date_trunc('second', ts) AS created_at, date_trunc('second', ts) + INTERVAL 5 MINUTE AS updated_at FROM {events}",
    "deliveries": "SELECT event_id AS delivery_id, event_id % 700 AS event_id, user_id AS token_id, event_id % 4 AS attempt_count, CASE event_type WHEN 'view' THEN 'sent' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'cancelled' END AS status, date_trunc('second', ts) AS next_attempt_at FROM {events}",
    "tokens": "SELECT c_custkey AS token_id, c_custkey % 900 AS user_id, CASE WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(' tok-', c_custkey % 400, ' ') END AS fcm_token, CASE WHEN c_custkey % 3 = 0 THEN 'IOS' WHEN c_custkey % 3 = 1 THEN 'android' END AS platform FROM {customer}",
    "folders": "SELECT r_regionkey AS folder_id, r_regionkey % 3 AS user_id, CAST(NULL AS INTEGER) AS parent_folder_id, r_name AS folder_name, r_regionkey AS sort_order FROM {region} UNION ALL SELECT 100 + n_nationkey, n_regionkey % 3, CASE WHEN n_nationkey = 24 THEN 99 ELSE n_regionkey END, n_name, n_nationkey % 4 FROM {nation}",
    "folder_notices": "SELECT DISTINCT 100 + s_nationkey AS folder_id, s_suppkey AS notice_id FROM {supplier} WHERE s_suppkey % 3 = 0",
    "keywords": "SELECT DISTINCT 100 + s_nationkey AS folder_id, CASE s_suppkey % 4 WHEN 0 THEN 'RING' WHEN 1 THEN 'bolt' WHEN 2 THEN 'Gear' ELSE 'low' END AS keyword FROM {supplier}",
    "observations": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS site_id, CASE WHEN l_partkey % 3 = 0 THEN concat('L', l_orderkey, '-', l_linenumber) END AS external_id, CASE WHEN l_partkey % 2 = 0 THEN concat('https://n.example/', l_orderkey, '/', l_linenumber) END AS detail_url, concat('Line ', l_orderkey, ' ', l_linenumber) AS title, l_returnflag AS author, l_shipdate AS published_at, l_extendedprice AS price FROM {lineitem}",
    "candidates": "SELECT l_partkey AS target_id, l_orderkey * 10 + l_linenumber AS api_index, CAST(l_quantity AS INTEGER) - 20 AS score, CAST(l_extendedprice AS BIGINT) AS length, l_returnflag = 'R' AS has_repeated_records, l_linenumber = 1 AS is_exact_target, l_linestatus = 'O' AS is_same_host, l_linenumber = 7 AS looks_like_non_content, l_discount > 0.08 AS looks_like_telemetry, l_tax > 0.06 AS has_title_key, l_linenumber % 2 = 0 AS is_json_like, l_linenumber % 3 = 0 AS has_list_key, min(l_shipdate) AS seen FROM {lineitem} GROUP BY ALL",
}

#: DuckDB rounds a double to a whole number, halves to even; Spark cuts it off. So Spark's view rounds first.
SPARK_VIEWS = {"candidates": VIEWS["candidates"].replace("CAST(l_quantity AS", "CAST(rint(l_quantity) AS").replace("CAST(l_extendedprice AS", "CAST(rint(l_extendedprice) AS")}

#: Bytes of lineitem's files for one task, where a view joins orders with lineitem and groups the rows. Spark puts its partitions together until each
#: core has its share, so a task's hash tables would grow with the input. For fewer than LEAST_PARTS such tasks Spark is left to deal the rows.
PART_BYTES, LEAST_PARTS = 4 << 20, 8
DEALT_BY = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
ORDER_LINES = "FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"
#: Those views, over dealt tables and with a place for the number of PARTS. An order's rows are grouped where they are joined.
DEALT_VIEWS = {
    "subscriptions": VIEWS["subscriptions"].replace(ORDER_LINES, f"FROM (SELECT /*+ REPARTITION(PARTS, o_custkey, l_suppkey) */ o_custkey, l_suppkey, o_orderdate {ORDER_LINES})"),
    "hidden": VIEWS["hidden"],
}


def names_in(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def duckdb_with(*views: str) -> str:
    """A WITH clause of the views and those below them, each once and after what it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for other in names_in(VIEWS[name]):
                visit(other)
            order.append(name)

    for v in views:
        visit(v)
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v].format(**{n: n for n in names_in(VIEWS[v])})})" for v in order)


class Source:
    """Tables and views of one directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DEALT_VIEWS and (parts := self.parts()) >= LEAST_PARTS:
            return self.spark.sql(DEALT_VIEWS[name].replace("PARTS", str(parts)), **{n: getattr(self, n).repartition(parts, by) for n, by in DEALT_BY.items()})
        if name in VIEWS:
            sql = SPARK_VIEWS.get(name, VIEWS[name])
            return self.spark.sql(sql, **{n: getattr(self, n) for n in names_in(sql)})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def parts(self) -> int:
        """Tasks over lineitem, by the size of its files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/lineitem.parquet")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return -(-size // PART_BYTES)
