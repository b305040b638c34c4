"""Aggregates (a), set operations (u) and the remaining joins (j)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.plans.catalog import query
from cairn.plans.control import display_status



class _State:
    """The state column, made when it is used: at import there is no session."""

    def __le__(self, v):
        return F.col("state") <= v

    def __ge__(self, v):
        return F.col("state") >= v

    def __eq__(self, v):
        return F.col("state") == v


STATE = _State()


@query("SELECT CAST(sum(CASE WHEN state <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(CASE WHEN state = 4 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN state >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM jobs", "jobs")
def a1_job_counts(jobs):
    return jobs.agg(F.count_if(STATE <= 3).alias("active"), F.count_if(STATE == 2).alias("running"), F.count_if(STATE == 4).alias("succeeded"), F.count_if(STATE >= 5).alias("failed"))


@query("SELECT CASE WHEN operation = 1 THEN 'backup' WHEN operation = 2 THEN 'restore' ELSE 'other' END AS kind, count(*) AS n FROM jobs GROUP BY 1", "jobs")
def a1_operation_totals(jobs):
    kind = F.when(F.col("operation") == 1, "backup").when(F.col("operation") == 2, "restore").otherwise("other")
    return jobs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


PERCENT = "CASE WHEN state = 4 THEN 100 WHEN logical_bytes IS NULL OR logical_bytes <= 0 THEN 0 ELSE processed_bytes * 100 // logical_bytes END"


def percent():
    """Floor of the share; a success is whole, and an unknown size is none."""
    logical = F.col("logical_bytes")
    return F.when(STATE == 4, F.lit(100).cast("long")).when(logical.isNull() | (logical <= 0), F.lit(0).cast("long")).otherwise(F.expr("processed_bytes * 100 div logical_bytes"))


@query(f"SELECT schedule_id, count(*) AS sessions, CAST(sum(CASE WHEN state <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN state >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum({PERCENT}) AS BIGINT) // count(*) AS percent, CASE WHEN bool_or(state <= 3) THEN 'running' WHEN bool_or(state >= 5) THEN 'failed' ELSE 'success' END AS status FROM jobs GROUP BY schedule_id", "jobs")
def a2_session_rollup(jobs):
    status = F.when(F.bool_or(STATE <= 3), "running").when(F.bool_or(STATE >= 5), "failed").otherwise("success")
    found = jobs.withColumn("pct", percent()).groupBy("schedule_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(STATE <= 3).alias("active"), F.count_if(STATE >= 5).alias("failed"), F.sum("pct").alias("total"), status.alias("status"))
    return found.select("schedule_id", "sessions", "active", "failed", F.expr("total div sessions").alias("percent"), "status")


@query("SELECT schedule_id, coalesce(min(CASE WHEN state <= 3 AND operation = 2 THEN created_ms END), 0) AS oldest_active FROM jobs GROUP BY schedule_id", "jobs")
def a3_oldest_active(jobs):
    return jobs.groupBy("schedule_id").agg(F.coalesce(F.min(F.when((STATE <= 3) & (F.col("operation") == 2), F.col("created_ms"))), F.lit(0)).alias("oldest_active"))


@query("SELECT backup_type, count(*) AS points, CAST(sum(stored_bytes) AS BIGINT) AS stored FROM catalog GROUP BY backup_type", "catalog")
def a4_point_totals(catalog):
    return catalog.groupBy("backup_type").agg(F.count(F.lit(1)).alias("points"), F.sum("stored_bytes").alias("stored"))


@query("SELECT DISTINCT strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day FROM catalog", "catalog")
def a5_backup_days(catalog):
    return catalog.select(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(created_ms div 86400000 as int)")).cast("string").alias("day")).distinct().orderBy("day")


@query("""SELECT disk, count(*) AS volumes, greatest(CAST(sum(capacity) AS BIGINT), 3000) AS capacity, least(CAST(sum(greatest(capacity - free, 0)) AS BIGINT), greatest(CAST(sum(capacity) AS BIGINT), 3000)) AS used, bool_or(available) AS selectable FROM inventory GROUP BY disk""", "inventory")
def a6_disk_rollup(inventory):
    capacity = F.greatest(F.sum("capacity"), F.lit(3000))
    used = F.least(F.sum(F.greatest(F.col("capacity") - F.col("free"), F.lit(0))), capacity)
    return inventory.groupBy("disk").agg(F.count(F.lit(1)).alias("volumes"), capacity.alias("capacity"), used.alias("used"), F.bool_or("available").alias("selectable"))


@query("""WITH d AS (SELECT n.*, o.entry_id IS NOT NULL AND o.write_time = n.write_time AND o.size = n.size AND o.has_stream AS reused FROM new_files n LEFT JOIN old_files o ON o.folder = n.folder AND o.name = n.name AND o.kind = n.kind)
SELECT count(*) AS streams, CAST(sum(size) AS BIGINT) AS logical_bytes, CAST(sum(CASE WHEN reused THEN 0 ELSE size END) AS BIGINT) AS local_bytes FROM d""", "new_files", "old_files")
def a8_plan_totals(new_files, old_files):
    d = j3_snapshot_diff(new_files, old_files).join(new_files.select("entry_id", "size"), "entry_id")
    return d.agg(F.count(F.lit(1)).alias("streams"), F.sum("size").alias("logical_bytes"), F.sum(F.when(F.col("outcome") == "reuse", 0).otherwise(F.col("size"))).alias("local_bytes"))


@query("SELECT CAST(sum(CASE WHEN kind = 2 THEN size ELSE 0 END) AS BIGINT) AS file_bytes, count(*) AS entries_seen FROM entries", "entries")
def a10_file_bytes(entries):
    return entries.agg(F.sum(F.when(F.col("kind") == 2, F.col("size")).otherwise(0)).alias("file_bytes"), F.count(F.lit(1)).alias("entries_seen"))


@query("SELECT code, first_seen FROM (SELECT message_code AS code, min(event_id) AS first_seen FROM audit GROUP BY message_code) x ORDER BY first_seen LIMIT 64", "audit")
def a14_error_codes(audit):
    return audit.groupBy(F.col("message_code").alias("code")).agg(F.min("event_id").alias("first_seen")).orderBy("first_seen").limit(64)


@query("SELECT job_id, logical_bytes * 1000 // (completed_ms - started_ms) AS bytes_a_second FROM jobs WHERE completed_ms > started_ms", "jobs")
def a16_throughput(jobs):
    return jobs.where("completed_ms > started_ms").select("job_id", F.expr("logical_bytes * 1000 div (completed_ms - started_ms)").alias("bytes_a_second"))


@query("SELECT owner, CAST(sum(high - low) AS BIGINT) AS clusters, (CAST(sum(high - low) AS BIGINT) * 4096 + 65535) // 65536 * 65536 + 16777216 AS scratch_bytes FROM ranges GROUP BY owner", "ranges")
def a17_scratch_bound(ranges):
    found = ranges.groupBy("owner").agg(F.sum(F.col("high") - F.col("low")).alias("clusters"))
    return found.select("owner", "clusters", F.expr("(clusters * 4096 + 65535) div 65536 * 65536 + 16777216").alias("scratch_bytes"))


@query("SELECT o_custkey AS archive, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS parts, max_by(o_orderkey % 100, o_orderkey) AS duplicates FROM orders GROUP BY o_custkey", "orders")
def a19_archive_parts(orders):
    """Sizes of all parts; the counts of duplicates stand in the last one."""
    return orders.groupBy(F.col("o_custkey").alias("archive")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("parts"), F.max_by(F.col("o_orderkey") % 100, "o_orderkey").alias("duplicates"))


@query("WITH n AS (SELECT job_id, 2 AS state FROM jobs WHERE job_id % 10 = 0) SELECT job_id, state FROM jobs WHERE state > 3 AND job_id % 10 <> 0 UNION ALL SELECT job_id, state FROM n", "jobs")
def u2_replace_active(jobs):
    """The active rows go, the new active ones come; a row that is active now isn't kept as ended."""
    new = jobs.where("job_id % 10 = 0").select("job_id", F.lit(2).alias("state"))
    return jobs.where("state > 3").select("job_id", "state").join(new, "job_id", "left_anti").unionByName(new)


@query("WITH n AS (SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 2 ELSE 4 END AS state FROM jobs WHERE job_id % 10 = 0), t AS (SELECT * FROM n WHERE state > 3) SELECT job_id, state FROM jobs WHERE job_id NOT IN (SELECT job_id FROM t) UNION ALL SELECT job_id, state FROM t", "jobs")
def u3_terminal_merge(jobs):
    new = jobs.where("job_id % 10 = 0").select("job_id", F.when(F.col("job_id") % 4 == 0, 2).otherwise(4).alias("state")).where("state > 3")
    return jobs.select("job_id", "state").join(new, "job_id", "left_anti").unionByName(new)


@query("SELECT 'idempotency_key' AS rule, count(*) AS repeated FROM (SELECT idempotency_key FROM jobs GROUP BY 1 HAVING count(*) > 1) a UNION ALL SELECT 'job_id', count(*) FROM (SELECT job_id FROM jobs GROUP BY 1 HAVING count(*) > 1) b", "jobs")
def u5_uniqueness(jobs):
    rule = lambda c: jobs.groupBy(c).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(c).alias("rule"), "repeated")
    return rule("idempotency_key").unionByName(rule("job_id"))


@query("SELECT disk, letter FROM (SELECT DISTINCT disk FROM inventory) d, (SELECT chr(CAST(k AS INT)) AS letter FROM range(67, 91) r(k)) l WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.disk = d.disk AND chr(CAST(67 + i.source_id % 24 AS INT)) = letter)", "inventory")
def u6_free_letters(inventory):
    every = F.array(*(F.lit(chr(k)) for k in range(67, 91)))
    used = F.collect_set(F.char(67 + F.col("source_id") % 24))
    return inventory.groupBy("disk").agg(used.alias("used")).select("disk", F.explode(F.array_except(every, "used")).alias("letter"))


@query("""SELECT n.entry_id, CASE WHEN o.entry_id IS NULL THEN 'new' WHEN o.write_time = n.write_time AND o.size = n.size AND o.has_stream THEN 'reuse' ELSE 'changed' END AS outcome FROM new_files n LEFT JOIN old_files o ON o.folder = n.folder AND o.name = n.name AND o.kind = n.kind""", "new_files", "old_files")
def j3_snapshot_diff(new_files, old_files):
    """Entries against those of the parent by selection, path and kind. Deleted ones don't show."""
    keys = ["folder", "name", "kind"]
    old = old_files.select(*keys, F.col("write_time").alias("o_time"), F.col("size").alias("o_size"), "has_stream")
    same = (F.col("o_time") == F.col("write_time")) & (F.col("o_size") == F.col("size")) & F.col("has_stream")
    return new_files.join(old, keys, "left").select("entry_id", F.when(F.col("o_time").isNull(), "new").when(same, "reuse").otherwise("changed").alias("outcome"))


@query("SELECT s.schedule_id, count(o.o_orderkey) AS selections, coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderdate, o.o_orderkey), '') AS in_order FROM schedules s LEFT JOIN orders o ON o.o_custkey = s.schedule_id GROUP BY s.schedule_id", "schedules", "orders")
def j4_schedule_selections(schedules, orders):
    """A schedule with its selections in their order, in one join instead of one lookup a row."""
    lists = orders.groupBy(F.col("o_custkey").alias("schedule_id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",")
    return schedules.select("schedule_id").join(lists, "schedule_id", "left").select("schedule_id", F.coalesce("n", F.lit(0)).alias("selections"), F.coalesce(names, F.lit("")).alias("in_order"))


@query("SELECT j.job_id, j.state, p.processed FROM jobs j LEFT JOIN (SELECT event_id AS job_id, CAST(floor(value * 100) AS BIGINT) AS processed FROM events WHERE event_type = 'view') p ON p.job_id = j.job_id WHERE j.state <= 3", "jobs", "events")
def j5_live_progress(jobs, events):
    progress = events.where("event_type = 'view'").select(F.col("event_id").alias("job_id"), F.floor(F.col("value") * 100).cast("long").alias("processed"))
    return jobs.where("state <= 3").select("job_id", "state").join(progress, "job_id", "left")


@query("""WITH p AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 50 <> 0),
c AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
SELECT coalesce(p.plan, c.plan) AS plan, CAST(sum(CASE WHEN p.size IS DISTINCT FROM c.size THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM p FULL JOIN c ON p.plan = c.plan AND p.k = c.k GROUP BY 1""", "orders")
def j13_positional_compare(orders):
    """A plan against the present state, place by place; any mismatch is a conflict."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    of = lambda df, size: df.select(F.col("o_custkey").alias("plan"), F.row_number().over(w).alias("k"), F.floor("o_totalprice").cast("long").alias(size))
    both = of(orders.where("o_orderkey % 50 <> 0"), "a").join(of(orders, "b"), ["plan", "k"], "full")
    return both.groupBy("plan").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


@query("SELECT c.file_id, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey % 41 = 0 THEN 'conflict' ELSE 'ok' END AS member FROM catalog c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 37 <> 0) o ON o.o_orderkey = c.file_id", "catalog", "orders")
def j14_plan_members(catalog, orders):
    """Members that are gone are fine; one of another generation is a conflict."""
    objects = orders.where("o_orderkey % 37 <> 0").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 41 == 0).alias("other"))
    return catalog.join(objects, "file_id", "left").select("file_id", F.when(F.col("other").isNull(), "missing").when(F.col("other"), "conflict").otherwise("ok").alias("member"))


@query("SELECT j.job_id, c.c_name AS schedule_name, n.n_name AS connection_name, p.file_id AS parent_point FROM jobs j JOIN customer c ON c.c_custkey = j.schedule_id JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN catalog p ON p.file_id = j.job_id AND p.parent_id IS NOT NULL WHERE j.operation = 1", "jobs", "customer", "nation", "catalog")
def j15_start_enrichment(jobs, customer, nation, catalog):
    parents = catalog.where("parent_id IS NOT NULL").select(F.col("file_id").alias("job_id"), F.col("file_id").alias("parent_point"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("schedule_id"), F.col("c_name").alias("schedule_name"), F.col("n_name").alias("connection_name"))
    return jobs.where("operation = 1").select("job_id", "schedule_id").join(named, "schedule_id").join(parents, "job_id", "left").select("job_id", "schedule_name", "connection_name", "parent_point")


@query("SELECT DISTINCT owner FROM ranges WHERE owner % 3 = 0 AND owner NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)", "ranges", "orders")
def j16_mutation_audit(ranges, orders):
    """Changed owners outside the declared set; empty if the audit passes."""
    declared = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("owner"))
    return ranges.where("owner % 3 = 0").select("owner").distinct().join(declared, "owner", "left_anti")


@query("SELECT p.p_partkey AS partition_id, i.source_id IS NOT NULL AS backed_up, i.label FROM part p LEFT JOIN inventory i ON i.source_id = p.p_partkey", "part", "inventory")
def j17_backed_up(part, inventory):
    known = inventory.select(F.col("source_id").alias("partition_id"), "label")
    return part.select(F.col("p_partkey").alias("partition_id")).join(known, "partition_id", "left").select("partition_id", F.col("label").isNotNull().alias("backed_up"), "label")


@query("""SELECT s.source_id, count(*) AS targets, max(t.capacity) AS largest FROM inventory s JOIN inventory t ON t.disk = s.disk AND t.source_id <> s.source_id AND t.available AND (s.capacity <= 0 OR t.capacity + 1 >= s.capacity) GROUP BY s.source_id""", "inventory")
def j18_restore_targets(inventory):
    """Targets of the same machine that are large enough and free to take."""
    t = inventory.where("available").select("disk", F.col("source_id").alias("t_id"), F.col("capacity").alias("t_capacity"))
    fits = (F.col("t_id") != F.col("source_id")) & ((F.col("capacity") <= 0) | (F.col("t_capacity") + 1 >= F.col("capacity")))
    return inventory.join(t, "disk").where(fits).groupBy("source_id").agg(F.count(F.lit(1)).alias("targets"), F.max("t_capacity").alias("largest"))


@query("SELECT file_id, backup_set FROM catalog c WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = c.file_id AND j.schedule_id = c.backup_set AND j.state = 4)", "catalog", "jobs")
def j19_already_mounted(catalog, jobs):
    mounted = jobs.where("state = 4").select(F.col("job_id").alias("file_id"), F.col("schedule_id").alias("backup_set"))
    return catalog.join(mounted, ["file_id", "backup_set"], "left_semi").select("file_id", "backup_set")


@query("SELECT job_id, CASE WHEN state IN (1, 2, 3) THEN 'running' WHEN state = 4 THEN 'success' ELSE 'failed' END AS status, " + PERCENT + " AS percent FROM jobs", "jobs")
def m1_percent(jobs):
    return jobs.select("job_id", display_status().alias("status"), percent().alias("percent"))


@query("""WITH t AS (SELECT disk, source_id, capacity, sum(capacity) OVER (PARTITION BY disk) AS total, row_number() OVER (PARTITION BY disk ORDER BY source_id) AS k, count(*) OVER (PARTITION BY disk) AS n FROM inventory),
w AS (SELECT *, CAST(greatest(40, 1000 * capacity // total) AS BIGINT) AS width FROM t)
SELECT disk, source_id, CASE WHEN k < n THEN width ELSE greatest(40, 1000 - CAST(coalesce(sum(width) OVER (PARTITION BY disk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) END AS width FROM w""", "inventory")
def m6_proportional_split(inventory):
    """A thousand units dealt by capacity with a minimum each; the last one gets what is left."""
    whole, order = Window.partitionBy("disk"), Window.partitionBy("disk").orderBy("source_id")
    t = inventory.withColumns({"total": F.sum("capacity").over(whole), "k": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    t = t.withColumn("w", F.greatest(F.lit(40).cast("long"), F.expr("1000 * capacity div total")))
    rest = F.lit(1000) - F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("disk", "source_id", F.when(F.col("k") < F.col("n"), F.col("w")).otherwise(F.greatest(F.lit(40).cast("long"), rest)).alias("width"))
