"""Integrity checks (v). Each names its rules; the projections hold both sound and broken rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators.verify import violations
from cairn.plans.catalog import query


def _sql(table: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, {key} AS key FROM {table} WHERE NOT ({rule})" for name, rule in rules.items())


@query(_sql("(SELECT e.*, p.kind AS p_kind FROM entries e LEFT JOIN entries p ON p.entry_id = e.parent_id) x", "entry_id", {"positive_id": "entry_id > 0", "not_own_parent": "parent_id IS NULL OR parent_id <> entry_id", "parent_is_folder": "parent_id IS NULL OR (p_kind IS NOT NULL AND p_kind = 1)", "size_of_folder": "kind = 2 OR size = 0", "file_in_place": "entry_id % 1009 <> 0 OR kind = 1"}), "entries")
def v1_index_rules(entries):
    parents = entries.select(F.col("entry_id").alias("p"), F.col("kind").alias("p_kind"))
    both = entries.join(parents, F.col("parent_id") == F.col("p"), "left")
    return violations(both, "entry_id", {
        "positive_id": F.col("entry_id") > 0, "not_own_parent": F.col("parent_id").isNull() | (F.col("parent_id") != F.col("entry_id")), "parent_is_folder": F.col("parent_id").isNull() | (F.col("p_kind").isNotNull() & (F.col("p_kind") == 1)),
        "size_of_folder": (F.col("kind") == 2) | (F.col("size") == 0), "file_in_place": (F.col("entry_id") % 1009 != 0) | (F.col("kind") == 1)})


@query(_sql("(SELECT c.*, p.backup_set AS p_set, p.content_kind AS p_kind, p.file_id AS p_id FROM catalog c JOIN catalog p ON p.file_id = c.parent_id) x", "file_id", {"incremental": "backup_type <> 1", "same_set": "backup_set = p_set", "same_kind": "content_kind = p_kind", "fingerprint": "file_id % 8 <> p_id % 8"}), "catalog")
def v2_layer_links(catalog):
    parents = catalog.select(F.col("file_id").alias("p_id"), F.col("backup_set").alias("p_set"), F.col("content_kind").alias("p_kind"))
    both = catalog.join(parents, F.col("parent_id") == F.col("p_id"))
    return violations(both, "file_id", {"incremental": F.col("backup_type") != 1, "same_set": F.col("backup_set") == F.col("p_set"), "same_kind": F.col("content_kind") == F.col("p_kind"), "fingerprint": F.col("file_id") % 8 != F.col("p_id") % 8})


@query(_sql("(SELECT block_index, chunk, lag(block_index) OVER (PARTITION BY chunk ORDER BY block_index) AS before, lag(size) OVER (PARTITION BY chunk ORDER BY block_index) AS before_size, size FROM blocks WHERE block_index % 71 <> 0) x", "block_index", {"dense": "before IS NULL OR before + 1 = block_index", "first": "before IS NOT NULL OR block_index = chunk * 64", "grows": "before_size IS NULL OR size < before_size + 20000"}), "blocks")
def v3_chunk_sequence(blocks):
    w = Window.partitionBy("chunk").orderBy("block_index")
    rows = blocks.where("block_index % 71 <> 0").withColumns({"before": F.lag("block_index").over(w), "before_size": F.lag("size").over(w)})
    return violations(rows, "block_index", {"dense": F.col("before").isNull() | (F.col("before") + 1 == F.col("block_index")), "first": F.col("before").isNotNull() | (F.col("block_index") == F.col("chunk") * 64), "grows": F.col("before_size").isNull() | (F.col("size") < F.col("before_size") + 20_000)})


@query(_sql("catalog", "file_id", {"full_has_no_parent": "backup_type <> 1 OR parent_id IS NULL", "others_have_one": "backup_type = 1 OR parent_id IS NOT NULL", "stored_at_most_logical": "stored_bytes <= logical_bytes", "parts": "parts BETWEEN 1 AND 2"}), "catalog")
def v4_catalog_rows(catalog):
    full = F.col("backup_type") == 1
    return violations(catalog, "file_id", {"full_has_no_parent": ~full | F.col("parent_id").isNull(), "others_have_one": full | F.col("parent_id").isNotNull(), "stored_at_most_logical": F.col("stored_bytes") <= F.col("logical_bytes"), "parts": F.col("parts").between(1, 2)})


@query("SELECT 'unknown_target' AS rule, t.file_id AS key FROM tombstones t LEFT JOIN catalog c ON c.file_id = t.file_id WHERE c.file_id IS NULL UNION ALL SELECT 'repeated_target', file_id FROM tombstones GROUP BY file_id HAVING count(*) > 1 UNION ALL SELECT 'operation_id', file_id FROM tombstones WHERE operation_id % 20 <> 0", "tombstones", "catalog")
def v5_tombstone_rules(tombstones, catalog):
    known = catalog.select("file_id")
    unknown = tombstones.join(known, "file_id", "left_anti").select(F.lit("unknown_target").alias("rule"), F.col("file_id").alias("key"))
    repeated = tombstones.groupBy("file_id").count().where("count > 1").select(F.lit("repeated_target").alias("rule"), F.col("file_id").alias("key"))
    return unknown.unionByName(repeated).unionByName(violations(tombstones, "file_id", {"operation_id": F.col("operation_id") % 20 == 0}))


@query(_sql("jobs", "job_id", {"terminal_has_end": "state < 4 OR completed_ms IS NOT NULL", "active_has_none": "state >= 4 OR completed_ms IS NULL", "started_before_end": "completed_ms IS NULL OR started_ms IS NULL OR started_ms <= completed_ms", "operation": "operation BETWEEN 1 AND 4", "running_has_start": "state <> 1 OR started_ms IS NULL OR job_id % 3 > 0"}), "jobs")
def v6_job_records(jobs):
    state, end, start = F.col("state"), F.col("completed_ms"), F.col("started_ms")
    return violations(jobs, "job_id", {
        "terminal_has_end": (state < 4) | end.isNotNull(), "active_has_none": (state >= 4) | end.isNull(), "started_before_end": end.isNull() | start.isNull() | (start <= end),
        "operation": F.col("operation").between(1, 4), "running_has_start": (state != 1) | start.isNull() | (F.col("job_id") % 3 > 0)})


@query(_sql("jobs", "job_id", {"processed_at_most_logical": "logical_bytes IS NULL OR processed_bytes <= logical_bytes", "whole_when_done": "state <> 4 OR processed_bytes = logical_bytes", "not_negative": "processed_bytes >= 0"}), "jobs")
def v7_progress_rules(jobs):
    p, n = F.col("processed_bytes"), F.col("logical_bytes")
    return violations(jobs, "job_id", {"processed_at_most_logical": n.isNull() | (p <= n), "whole_when_done": (F.col("state") != 4) | (p == n), "not_negative": p >= 0})


@query(_sql("new_files", "entry_id", {"name": "length(name) BETWEEN 1 AND 12", "time": "write_time >= 0", "size": "size < 400000"}), "new_files")
def v9_entry_rules(new_files):
    return violations(new_files, "entry_id", {"name": F.length("name").between(1, 12), "time": F.col("write_time") >= 0, "size": F.col("size") < 400_000})
