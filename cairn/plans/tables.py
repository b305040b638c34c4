"""The driver's tables seen as the engine's records.

The records of a backup catalogue don't exist among the driver's tables, so that each view below is a deterministic
projection of one of them. The projections are written once, in SQL that both engines read after the few words that
they spell differently are put in: MS(x) is milliseconds since 1970, DIV(a, b) whole division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "jobs": """
SELECT o_orderkey AS job_id, CAST(o_orderkey % 4 + 1 AS INT) AS operation, CAST(CASE o_orderstatus WHEN 'O' THEN 1 + o_orderkey % 3 WHEN 'F' THEN 4 + o_orderkey % 2 ELSE 6 + o_orderkey % 2 END AS INT) AS state,
  CAST(o_orderkey % 2 + 1 AS INT) AS content_kind, MS(o_orderdate) AS created_ms,
  CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 3 > 0 THEN MS(o_orderdate) + 1000 * (o_orderkey % 60) END AS started_ms,
  CASE WHEN o_orderstatus <> 'O' THEN MS(o_orderdate) + 60000 + 1000 * (o_orderkey % 600) END AS completed_ms,
  o_custkey AS schedule_id, CAST(o_custkey % 5 AS INT) AS connection_id, CAST(floor(o_totalprice) AS BIGINT) AS logical_bytes, CAST(floor(o_totalprice * 0.5) AS BIGINT) AS processed_bytes,
  concat('key-', CAST(DIV(o_orderkey, 2) AS VARCHAR)) AS idempotency_key, concat('print-', CAST(o_orderkey % 3 AS VARCHAR)) AS fingerprint
FROM orders""",
    "audit": """
SELECT event_id, MS(ts) AS created_ms, CAST(length(event_type) % 4 + 1 AS INT) AS severity, event_type AS message_code, user_id AS correlation_id, props AS arguments FROM events""",
    "catalog": """
SELECT file_id, backup_set, content_kind, created_ms, CASE WHEN file_id % 7 = 0 THEN NULL ELSE before END AS parent_id,
  CAST(CASE WHEN before IS NULL OR file_id % 7 = 0 THEN 1 WHEN file_id % 5 = 0 THEN 3 ELSE 2 END AS INT) AS backup_type, stored_bytes, logical_bytes, parts, has_sidecar
FROM (SELECT o_orderkey AS file_id, o_custkey AS backup_set, CAST(o_custkey % 2 + 1 AS INT) AS content_kind, MS(o_orderdate) AS created_ms,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, CAST(floor(o_totalprice * 0.7) AS BIGINT) AS stored_bytes, CAST(floor(o_totalprice) AS BIGINT) AS logical_bytes,
  CAST(o_orderkey % 3 + 1 AS INT) AS parts, o_orderkey % 2 = 0 AS has_sidecar FROM orders) c""",
    "tombstones": """
SELECT o_orderkey * 10 AS operation_id, o_orderkey AS file_id FROM orders WHERE o_orderkey % 97 = 0""",
    "entries": """
SELECT CAST(1 + r_regionkey AS BIGINT) AS entry_id, CAST(NULL AS BIGINT) AS parent_id, 1 AS kind, r_name AS name, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS write_time FROM region
UNION ALL SELECT CAST(101 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), 1, n_name, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM nation
UNION ALL SELECT 1001 + c_custkey, CAST(101 + c_nationkey AS BIGINT), 1, c_name, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM customer
UNION ALL SELECT 100000001 + o_orderkey, 1001 + o_custkey, 2, concat('order-', CAST(o_orderkey AS VARCHAR)), CAST(floor(o_totalprice) AS BIGINT), MS(o_orderdate) FROM orders""",
    "old_files": """
SELECT o_orderkey AS entry_id, o_custkey AS folder, concat('order-', CAST(o_orderkey AS VARCHAR)) AS name, 2 AS kind, MS(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS write_time,
  CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS size, o_orderkey % 29 <> 0 AS has_stream FROM orders WHERE o_orderkey % 17 <> 0""",
    "new_files": """
SELECT o_orderkey AS entry_id, o_custkey AS folder, concat('order-', CAST(o_orderkey AS VARCHAR)) AS name, 2 AS kind, MS(o_orderdate) AS write_time, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 19 <> 0""",
    "blocks": """
SELECT doc_id AS block_index, DIV(doc_id, 64) AS chunk, text AS payload, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id % 17 = 0 AS is_free, doc_id % 11 = 0 AS is_zero FROM documents""",
    "ranges": """
SELECT l_partkey AS owner, CAST((l_orderkey * 37 + l_linenumber * 101) % 4000 AS BIGINT) AS low, CAST((l_orderkey * 37 + l_linenumber * 101) % 4000 + l_quantity AS BIGINT) AS high FROM lineitem""",
    "schedules": """
SELECT c_custkey AS schedule_id, c_custkey % 5 <> 0 AS enabled, CAST(c_custkey % 3 + 1 AS INT) AS trigger_kind, CAST(c_custkey % 720 AS INT) AS minute_a, CAST(c_custkey % 720 + 30 + c_custkey % 600 AS INT) AS minute_b,
  CAST(c_custkey % 128 AS INT) AS weekday_mask, CAST((c_custkey * 7919) % 2147483647 AS BIGINT) AS month_mask, 1704067200000 + (c_custkey * 7654321) % 2678400000 AS now_ms,
  CASE WHEN c_custkey % 4 > 0 THEN 1704067200000 + (c_custkey * 1234567) % 2678400000 END AS next_run_ms FROM customer""",
    "inventory": """
SELECT s_suppkey AS source_id, CAST(s_nationkey AS BIGINT) AS disk, s_name AS label, CAST(s_suppkey % 7 > 0 AS BOOLEAN) AS available, CAST(1000 + s_suppkey % 900 AS BIGINT) AS capacity, CAST(s_suppkey % 1300 AS BIGINT) AS free FROM supplier""",
}


def _words(sql: str, spark: bool) -> str:
    ms = r"(datediff(\1, DATE'1970-01-01') * 86400000L + hour(\1) * 3600000L + minute(\1) * 60000L + CAST(floor(date_part('SECOND', \1) * 1000) AS BIGINT))"
    sql = re.sub(r"MS\((\w+)\)", ms if spark else r"(epoch_us(\1) // 1000)", sql)
    sql = re.sub(r"DIV\((\w+), (\w+)\)", r"(\1 div \2)" if spark else r"(\1 // \2)", sql)
    if spark:
        sql = sql.replace("AS VARCHAR)", "AS STRING)").replace("encode(text)", "text")
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a table of the driver itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _words(VIEWS[name], True)
    used = [t for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """The SQL with the projections that it names put before it."""
    sql = _words(sql, False)
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = ", ".join(f"{v} AS ({_words(VIEWS[v], False)})" for v in used)
    body = sql.strip()
    if not used:
        return body
    recursive = re.match(r"WITH RECURSIVE ", body)
    if body.startswith("WITH "):
        body = ", " + re.sub(r"^WITH (RECURSIVE )?", "", body)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}"
