"""Reads of the control plane: sources (s), filters (f), projections (p), order and pages (o), rankings (n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.errors import Conflict
from cairn.operators import filters, graph, paging
from cairn.operators.lineage import settle
from cairn.plans.catalog import query

JOB = ["job_id", "operation", "state", "created_ms"]
NOW = 1_000_000_000_000


def jobs_page(jobs: DataFrame, scope=None, operation=None, state=None, start=None, end=None, place=None, size=None) -> DataFrame:
    """The list request over jobs."""
    found = jobs.where(filters.in_scope(scope, state) & filters.equals(operation=operation) & filters.in_time("created_ms", start, end))
    return paging.newest_first(found, "created_ms", "job_id", size, place).select(*JOB, "has_more")


@query("SELECT job_id, operation, state, created_ms, (SELECT count(*) FROM jobs) > 50 AS has_more FROM jobs ORDER BY created_ms DESC, job_id LIMIT 50", "jobs")
def o1_jobs_first_page(jobs):
    return jobs_page(jobs)


@query(
    """WITH p AS (SELECT created_ms AS c, job_id AS i FROM jobs WHERE state IN (4, 5, 6, 7) AND operation = 2 ORDER BY created_ms DESC, job_id LIMIT 1 OFFSET 19)
SELECT job_id, operation, state, created_ms, true AS has_more FROM jobs, p WHERE state IN (4, 5, 6, 7) AND operation = 2 AND (created_ms < c OR (created_ms = c AND job_id > i)) ORDER BY created_ms DESC, job_id LIMIT 20""",
    "jobs",
)
def o2_jobs_second_page(jobs):
    """The page behind the twentieth row, found by its keyset place instead of an offset."""
    chosen = jobs.where(filters.in_scope("terminal") & filters.equals(operation=2))
    last = chosen.orderBy(F.desc("created_ms"), "job_id").limit(20).orderBy("created_ms", F.desc("job_id")).first()
    place = (last["created_ms"], last["job_id"]) if last else None
    return jobs_page(jobs, "terminal", 2, place=place, size=20)


@query("SELECT job_id, operation, state, created_ms, (SELECT count(*) FROM jobs) > 100 AS has_more FROM jobs ORDER BY created_ms DESC, job_id LIMIT 100", "jobs")
def o3_largest_page(jobs):
    return jobs_page(jobs, size=100)


@query("SELECT file_id, backup_set, created_ms, true AS has_more FROM catalog WHERE file_id > 500 AND file_id NOT IN (SELECT file_id FROM tombstones) ORDER BY file_id LIMIT 50", "catalog", "tombstones")
def o4_catalog_page(catalog, tombstones):
    visible = catalog.join(tombstones, "file_id", "left_anti")
    return paging.by_key(visible, "file_id", 50, 500).select("file_id", "backup_set", "created_ms", "has_more")


@query("SELECT source_id, label, capacity, (SELECT count(*) FROM inventory WHERE available) > 20 AS has_more FROM inventory WHERE available ORDER BY source_id LIMIT 20", "inventory")
def o5_inventory_page(inventory):
    return paging.by_key(inventory.where("available"), "source_id", 20).select("source_id", "label", "capacity", "has_more")


def unique(df: DataFrame, key: str) -> DataFrame:
    """The rows, or Conflict if a key occurs twice."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise Conflict(f"{key} occurs twice")
    return df


@query("SELECT parent_id, entry_id, name, nth FROM (SELECT parent_id, entry_id, name, row_number() OVER (PARTITION BY parent_id ORDER BY name, entry_id) AS nth FROM entries WHERE parent_id IS NOT NULL) x WHERE nth > 2 AND nth <= 7", "entries")
def o6_children_page(entries):
    """Five children behind the first two of every folder, by offset."""
    return paging.by_offset(entries.where("parent_id IS NOT NULL"), ["parent_id"], [F.col("name").cast("binary"), F.col("entry_id")], 2, 5).select("parent_id", "entry_id", "name", F.col("nth").cast("long").alias("nth"))


@query("SELECT schedule_id, sha256(concat(CAST(max(created_ms) AS VARCHAR), '|', CAST(max_by(job_id, created_ms * 100000 + job_id % 100000) AS VARCHAR))) AS binding, count(*) AS generation FROM jobs GROUP BY schedule_id", "jobs")
def o7_token_binding(jobs):
    """What a children token is bound to: it changes when the chain gets a new tip."""
    tip = F.max_by("job_id", F.col("created_ms") * 100000 + F.col("job_id") % 100000)
    binding = F.sha2(F.concat(F.max("created_ms").cast("string"), F.lit("|"), tip.cast("string")), 256)
    return jobs.groupBy("schedule_id").agg(binding.alias("binding"), F.count(F.lit(1)).alias("generation"))


@query("SELECT entry_id, row_number() OVER (ORDER BY coalesce(parent_id, 0), encode(name), entry_id) AS nth FROM entries WHERE kind = 1", "entries")
def o8_namespace_order(entries):
    """The order of folders: parent, then name by bytes with the shorter first, then id. Places are found by a range sort."""
    folders = entries.where("kind = 1").withColumns({"p": F.coalesce("parent_id", F.lit(0)), "b": F.col("name").cast("binary")})
    return ranked_globally(folders, ["p", "b", "entry_id"], "nth").select("entry_id", "nth")


def ranked_globally(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Numbers all rows in an order without bringing them to one task: they are dealt by range, numbered within their
    range, and moved on by the number of rows in the ranges before."""
    dealt = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*order)
    # settled, because ranges come from a sample: both uses below have to see the same ones
    inside = settle(dealt.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    before = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("part", "before")), "part").withColumn(to, F.col("before") + F.col("inside")).drop("part", "inside", "before")


@query("SELECT schedule_id, job_id, encoded_upto FROM (SELECT schedule_id, job_id, CAST(sum(length(idempotency_key) + 200) OVER (PARTITION BY schedule_id ORDER BY created_ms DESC, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS encoded_upto FROM jobs) x WHERE encoded_upto <= 1024", "jobs")
def o9_fit_to_frame(jobs):
    return paging.within_bytes(jobs, ["schedule_id"], [F.desc("created_ms"), F.asc("job_id")], F.length("idempotency_key") + 200, 1024).select("schedule_id", "job_id", "encoded_upto")


@query("SELECT count(*) AS rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages, min(source_id) AS first_id, max(source_id) AS last_id FROM inventory", "inventory")
def o10_drain_pages(inventory):
    """What a client that asks for all pages of 100 sees. Pages are fetched one after the other, each behind the token of
    the one before; keys have to rise, tokens to advance, and 10,000 pages are the most."""
    spark, seen = inventory.sparkSession, {"rows": 0, "pages": 0, "first": None, "last": None}

    def fetch(token):
        page = paging.by_key(inventory.select("source_id"), "source_id", 100, token).collect()
        keys = sorted(r["source_id"] for r in page)
        seen["pages"] += bool(keys)
        return keys, keys[-1] if page and page[0]["has_more"] else None

    for key in paging.drain(fetch):
        seen["rows"] += 1
        seen["first"] = key if seen["first"] is None else seen["first"]
        seen["last"] = key
    return spark.createDataFrame([tuple(seen.values())], "rows long, pages long, first_id long, last_id long")


@query("""WITH RECURSIVE d AS (SELECT entry_id, 0 AS depth FROM entries WHERE kind = 1 AND parent_id IS NULL UNION ALL SELECT e.entry_id, d.depth + 1 FROM entries e JOIN d ON e.parent_id = d.entry_id WHERE e.kind = 1)
SELECT e.entry_id, e.kind, d.depth, row_number() OVER (ORDER BY e.kind, d.depth, e.entry_id) AS nth FROM entries e LEFT JOIN d ON d.entry_id = e.entry_id""", "entries")
def o11_restore_order(entries):
    """Each entry's place: folders by their depth in the tree and id, then files by id. Files have no depth here."""
    depths = graph.tops(entries.where("kind = 1"), "entry_id", "parent_id", 64).select(F.col("id").alias("entry_id"), "depth")
    return ranked_globally(entries.select("entry_id", "kind").join(depths, "entry_id", "left"), ["kind", "depth", "entry_id"], "nth").select("entry_id", "kind", "depth", "nth")


@query("SELECT entry_id FROM entries WHERE kind = 2 ORDER BY entry_id LIMIT 10000", "entries")
def o13_capped_selection(entries):
    return entries.where("kind = 2").select("entry_id").orderBy("entry_id").limit(10_000)


@query("""SELECT record, name, is_dir, nth FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, name, record) AS nth FROM (
SELECT p_partkey % 500 AS record, p_partkey % 20 AS folder, p_name AS name, p_partkey % 500 % 3 = 0 AS is_dir, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY length(p_name) DESC, p_name, p_partkey) AS k FROM part) a WHERE k = 1) b WHERE nth <= 10""", "part")
def o14_directory_listing(part):
    """One row for each record number, with its longest name; folders first; ten rows a folder."""
    named = part.select((F.col("p_partkey") % 500).alias("record"), (F.col("p_partkey") % 20).alias("folder"), F.col("p_name").alias("name"), (F.col("p_partkey") % 500 % 3 == 0).alias("is_dir"), "p_partkey")
    longest = named.withColumn("k", F.row_number().over(Window.partitionBy("record").orderBy(F.length("name").desc(), "name", "p_partkey"))).where("k = 1")
    return paging.by_offset(longest, ["folder"], [F.desc("is_dir"), F.asc("name"), F.asc("record")], 0, 10).select("record", "name", "is_dir", F.col("nth").cast("long").alias("nth"))


@query("SELECT job_id, operation, state, created_ms, completed_ms FROM jobs WHERE job_id = 4242", "jobs")
def s1_point_read(jobs):
    return jobs.where(F.col("job_id") == 4242).limit(1).select(*JOB, "completed_ms")


@query("SELECT event_id, created_ms, severity, message_code, correlation_id, (SELECT count(*) FROM audit WHERE severity >= 2) > 50 AS has_more FROM audit WHERE severity >= 2 ORDER BY created_ms DESC, event_id LIMIT 50", "audit")
def s2_audit_list(audit):
    return paging.newest_first(audit.where(filters.at_least("severity", 2)), "created_ms", "event_id").select("event_id", "created_ms", "severity", "message_code", "correlation_id", "has_more")


@query("SELECT object_key, size FROM (SELECT concat('catalog/', CAST(backup_set % 10 AS VARCHAR), '/', CAST(file_id AS VARCHAR)) AS object_key, stored_bytes AS size FROM catalog) o WHERE starts_with(object_key, 'catalog/3/') AND object_key > 'catalog/3/2' ORDER BY object_key LIMIT 100", "catalog")
def s3_prefix_scan(catalog):
    """Objects under a prefix, in order, behind a token."""
    keys = catalog.select(F.concat(F.lit("catalog/"), (F.col("backup_set") % 10).cast("string"), F.lit("/"), F.col("file_id").cast("string")).alias("object_key"), F.col("stored_bytes").alias("size"))
    return keys.where(F.col("object_key").startswith("catalog/3/") & (F.col("object_key") > "catalog/3/2")).orderBy("object_key").limit(100)


@query("SELECT CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, sum(octet_length(encode(props))) <= 67108864 AS within_budget, count(*) AS objects FROM events", "events")
def s4_read_budget(events):
    total = F.sum(F.octet_length("props").cast("long"))
    return events.agg(total.alias("bytes"), (total <= 64 * 1024 * 1024).alias("within_budget"), F.count(F.lit(1)).alias("objects"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) = 1 AS exact_keys FROM events", "events")
def s5_json_documents(events):
    """Documents by an explicit schema; a document with other keys doesn't have the exact ones."""
    parsed = F.from_json("props", "struct<k: bigint>", {"mode": "FAILFAST"})
    return events.select("event_id", parsed["k"].alias("k"), (F.size(F.json_object_keys("props")) == 1).alias("exact_keys"))


@query("SELECT parent_id, entry_id, name FROM entries WHERE parent_id BETWEEN 101 AND 125", "entries")
def s6_namespace_scan(entries):
    return entries.where(F.col("parent_id").between(101, 125)).select("parent_id", "entry_id", "name")


@query("SELECT chunk, block_index, CASE WHEN is_free THEN 1 ELSE 3 END AS extent_state, size FROM blocks", "blocks")
def s8_block_source(blocks):
    return blocks.select("chunk", "block_index", F.when(F.col("is_free"), 1).otherwise(3).alias("extent_state"), "size")


@query("SELECT job_id, created_ms AS started, CASE WHEN state = 3 AND job_id % 2 = 0 THEN 'failed' WHEN state = 3 THEN 'mounted' ELSE 'closed' END AS status FROM jobs WHERE state IN (3, 4) ORDER BY created_ms DESC, job_id LIMIT 100", "jobs")
def s13_mount_sessions(jobs):
    """Newest sessions up to a limit, without a token; a finished one that still counts as mounted has failed."""
    mounted, finished = F.col("state") == 3, F.col("job_id") % 2 == 0
    status = F.when(mounted & finished, "failed").when(mounted, "mounted").otherwise("closed")
    return jobs.where(F.col("state").isin(3, 4)).select("job_id", F.col("created_ms").alias("started"), status.alias("status")).orderBy(F.desc("started"), "job_id").limit(100)


@query("SELECT job_id, operation, state, created_ms FROM jobs WHERE operation = 3 AND state = 4", "jobs")
def f1_optional_equality(jobs):
    return jobs.where(filters.equals(operation=3, state=4, schedule_id=None)).select(*JOB)


@query("SELECT job_id, operation, state, created_ms FROM jobs WHERE state IN (1, 2, 3)", "jobs")
def f2_scope(jobs):
    return jobs.where(filters.in_scope("active")).select(*JOB)


@query("SELECT job_id, operation, state, created_ms FROM jobs WHERE created_ms >= 880000000000 AND created_ms <= 890000000000", "jobs")
def f3_time_range(jobs):
    return jobs.where(filters.in_time("created_ms", 880_000_000_000, 890_000_000_000)).select(*JOB)


@query("SELECT event_id, severity FROM audit WHERE severity >= 3", "audit")
def f4_severity(audit):
    return audit.where(filters.at_least("severity", 3)).select("event_id", "severity")


@query("SELECT job_id, operation, state, created_ms FROM jobs WHERE created_ms < 880070400000 OR (created_ms = 880070400000 AND job_id > 5000)", "jobs")
def f5_keyset(jobs):
    return jobs.where(paging.after("created_ms", "job_id", (880_070_400_000, 5000))).select(*JOB)


@query("SELECT source_id, label, capacity FROM inventory WHERE available AND label <> '' AND free <= capacity", "inventory")
def f6_valid_sources(inventory):
    """Rows that fail validation are dropped one by one."""
    return inventory.where(F.col("available") & (F.col("label") != "") & (F.col("free") <= F.col("capacity"))).select("source_id", "label", "capacity")


@query("SELECT schedule_id, next_run_ms FROM schedules WHERE enabled AND next_run_ms IS NOT NULL AND next_run_ms <= now_ms", "schedules")
def f7_due(schedules):
    return schedules.where(filters.due(F.col("now_ms"))).select("schedule_id", "next_run_ms")


@query("SELECT job_id, 24 AS hours FROM jobs WHERE created_ms BETWEEN 900000000000 - 86400000 AND 900000000000 AND operation = 1 UNION ALL SELECT job_id, 168 FROM jobs WHERE created_ms BETWEEN 900000000000 - 604800000 AND 900000000000 AND operation = 1 UNION ALL SELECT job_id, 720 FROM jobs WHERE created_ms BETWEEN 900000000000 - 2592000000 AND 900000000000 AND operation = 1", "jobs")
def f8_look_back(jobs):
    """The presets of a day, a week and thirty days, from one scan."""
    hours = F.explode(F.array(F.lit(24), F.lit(168), F.lit(720)))
    wanted = jobs.where(filters.look_back("created_ms", 900_000_000_000, 720) & filters.equals(operation=1))
    return wanted.select("job_id", "created_ms", hours.alias("hours")).where(F.col("created_ms") >= 900_000_000_000 - F.col("hours").cast("long") * 3_600_000).select("job_id", "hours")


@query("SELECT p_partkey AS partition_id, p_size * 16 >= 256 AND p_type IN ('ECONOMY', 'STANDARD') AND NOT contains(lower(p_name), 'ring') AS mountable FROM part", "part")
def f9_mountable(part):
    large, known = F.col("p_size") * 16 >= 256, F.col("p_type").isin("ECONOMY", "STANDARD")
    return part.select(F.col("p_partkey").alias("partition_id"), (large & known & ~F.lower("p_name").contains("ring")).alias("mountable"))


@query("SELECT p_partkey AS partition_id, p_name AS label FROM part WHERE NOT contains(lower(p_name), 'widget')", "part")
def f10_label_filter(part):
    return part.where(~F.lower("p_name").contains("widget")).select(F.col("p_partkey").alias("partition_id"), F.col("p_name").alias("label"))


@query("SELECT entry_id, name FROM entries WHERE kind = 1 AND name NOT IN ('ASIA', 'EUROPE')", "entries")
def f11_excluded_names(entries):
    return entries.where((F.col("kind") == 1) & ~F.col("name").isin("ASIA", "EUROPE")).select("entry_id", "name")


@query("SELECT file_id FROM catalog WHERE content_kind = 1 AND has_sidecar AND backup_type IN (1, 2) AND backup_set % 3 = 0", "catalog")
def f12_eligible_parents(catalog):
    """Points that a volume backup may build on. The order of the sources counts, so that arrays are compared whole."""
    sources, wanted = F.array(F.col("backup_set") % 3, F.lit(1)), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return catalog.where((F.col("content_kind") == 1) & F.col("has_sidecar") & F.col("backup_type").isin(1, 2) & (sources.cast("array<bigint>") == wanted)).select("file_id")


@query("SELECT file_id, 'file' AS mode FROM catalog WHERE content_kind = 2 UNION ALL SELECT file_id, 'volume' FROM catalog WHERE content_kind = 1", "catalog")
def f13_restore_mode(catalog):
    return catalog.select("file_id", F.when(F.col("content_kind") == 2, "file").otherwise("volume").alias("mode"))


@query("SELECT source_id, CASE WHEN label = '' THEN 'Unknown' ELSE label END AS label, capacity, least(free, capacity) AS free, CASE WHEN source_id % 9 = 0 THEN 'GPT' ELSE 'MBR' END AS style FROM inventory", "inventory")
def p1_source_summary(inventory):
    return inventory.select("source_id", F.when(F.col("label") == "", "Unknown").otherwise(F.col("label")).alias("label"), "capacity", F.least("free", "capacity").alias("free"), F.when(F.col("source_id") % 9 == 0, "GPT").otherwise("MBR").alias("style"))


@query("""WITH RECURSIVE v AS (SELECT * FROM catalog WHERE file_id % 97 <> 0),
sound AS (SELECT file_id, 0 AS depth FROM v WHERE backup_type = 1 AND parent_id IS NULL
UNION ALL SELECT v.file_id, sound.depth + 1 FROM v JOIN sound ON v.parent_id = sound.file_id WHERE sound.depth < 128)
SELECT v.file_id, v.backup_set, v.backup_type, CASE WHEN sound.file_id IS NOT NULL THEN 'complete' ELSE 'incomplete' END AS chain_state FROM v LEFT JOIN sound ON sound.file_id = v.file_id""", "catalog")
def p2_catalog_summary(catalog):
    """Visible points, and whether their chain comes down to a full one: a parent that is missing anywhere below makes the
    chain incomplete."""
    visible = catalog.where("file_id % 97 <> 0")
    found = graph.tops(visible, "file_id", "parent_id")
    full = visible.where("backup_type = 1").select(F.col("file_id").alias("top"), F.lit(True).alias("full"))
    sound = F.coalesce(F.col("full"), F.lit(False)) & ~F.col("missing") & ~F.col("deep")
    state = found.join(full, "top", "left").select(F.col("id").alias("file_id"), F.when(sound, "complete").otherwise("incomplete").alias("chain_state"))
    return visible.join(state, "file_id").select("file_id", "backup_set", "backup_type", "chain_state")


@query("SELECT job_id, CASE WHEN state IN (1, 2, 3) THEN 'running' WHEN state = 4 THEN 'success' WHEN state IN (5, 6, 7) THEN 'failed' ELSE 'none' END AS status FROM jobs", "jobs")
def p3_display_status(jobs):
    return jobs.select("job_id", display_status().alias("status"))


def display_status(column: str = "state"):
    state = F.col(column)
    return F.when(state.isin(*filters.ACTIVE), "running").when(state == 4, "success").when(state.isin(5, 6, 7), "failed").otherwise("none")


@query("SELECT disk, source_id AS volume, CASE WHEN source_id % 2 = 0 THEN substr(concat(chr(CAST(67 + source_id % 20 AS INT)), ':/data'), 1, 2) END AS letter, least(free, capacity) AS free, capacity FROM inventory", "inventory")
def p4_layout(inventory):
    """Volumes of disks; the letter is taken from the first mount point that has a colon in second place."""
    mounts = F.when(F.col("source_id") % 2 == 0, F.array(F.lit("/mnt"), F.concat(F.char(67 + F.col("source_id") % 20), F.lit(":/data")))).otherwise(F.array(F.lit("/mnt")))
    letter = F.get(F.filter(mounts, lambda m: F.substring(m, 2, 1) == ":"), F.lit(0))
    return inventory.select("disk", F.col("source_id").alias("volume"), F.substring(letter, 1, 2).alias("letter"), F.least("free", "capacity").alias("free"), "capacity")


@query("SELECT backup_set, content_kind, file_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY backup_set, content_kind ORDER BY created_ms DESC, file_id DESC) AS nth FROM catalog WHERE file_id % 97 <> 0) x WHERE nth <= 3", "catalog")
def n1_newest_of_set(catalog):
    nth = F.row_number().over(Window.partitionBy("backup_set", "content_kind").orderBy(F.desc("created_ms"), F.desc("file_id")))
    return catalog.where("file_id % 97 <> 0").withColumn("nth", nth.cast("long")).where("nth <= 3").select("backup_set", "content_kind", "file_id", "nth")


@query("SELECT schedule_id, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY schedule_id ORDER BY CASE WHEN state <= 3 THEN 1 ELSE 0 END DESC, created_ms DESC, job_id DESC) AS k FROM jobs) x WHERE k = 1", "jobs")
def n2_latest_of_schedule(jobs):
    """An active job goes before a newer one that has ended. One row a group: a maximum instead of a sort."""
    rank = F.struct(F.when(F.col("state") <= 3, 1).otherwise(0).alias("a"), F.col("created_ms").alias("c"), F.col("job_id").alias("j"), F.col("state").alias("s"))
    return jobs.groupBy("schedule_id").agg(F.max(rank).alias("m")).select("schedule_id", F.col("m.j").alias("job_id"), F.col("m.s").alias("state"))


@query("SELECT chunk, block_index, CAST(row_number() OVER (PARTITION BY chunk ORDER BY block_index) - 1 AS BIGINT) AS ordinal FROM blocks", "blocks")
def n5_ordinals(blocks):
    return blocks.select("chunk", "block_index", (F.row_number().over(Window.partitionBy("chunk").orderBy("block_index")) - 1).cast("long").alias("ordinal"))


@query("SELECT backup_set, file_id, created_ms FROM catalog WHERE created_ms >= 883612800000 AND created_ms < 883699200000", "catalog")
def n7_points_of_day(catalog):
    day = F.col("created_ms").between(883_612_800_000, 883_612_800_000 + 86_399_999)
    return catalog.where(day).select("backup_set", "file_id", "created_ms").orderBy(F.desc("created_ms"), "file_id")


@query("SELECT disk, source_id FROM (SELECT disk, source_id, row_number() OVER (PARTITION BY disk ORDER BY source_id % 3 = 0 DESC, source_id) AS k FROM inventory WHERE available) x WHERE k = 1", "inventory")
def n8_default_connection(inventory):
    """The first available default, else the first available."""
    rank = F.struct((F.col("source_id") % 3 != 0).alias("other"), F.col("source_id").alias("id"))
    return inventory.where("available").groupBy("disk").agg(F.min(rank).alias("m")).select("disk", F.col("m.id").alias("source_id"))


@query("SELECT r.owner, r.low, min(p.p_partkey) AS partition_id FROM (SELECT DISTINCT owner, low FROM ranges) r JOIN part p ON p.p_partkey % 20 = r.owner % 20 AND p.p_size = r.low % 50 + 1 GROUP BY r.owner, r.low", "ranges", "part")
def n6_first_match(ranges, part):
    """The first matching partition for the ranges of every owner."""
    asked = ranges.select("owner", "low", (F.col("owner") % 20).alias("disk"), (F.col("low") % 50 + 1).cast("int").alias("p_size")).distinct()
    declared = part.groupBy((F.col("p_partkey") % 20).alias("disk"), "p_size").agg(F.min("p_partkey").alias("partition_id"))
    return asked.join(declared, ["disk", "p_size"]).select("owner", "low", "partition_id")


@query("SELECT folder, entry_id, nth FROM (SELECT folder, entry_id, row_number() OVER (PARTITION BY folder ORDER BY name, entry_id) AS nth FROM new_files WHERE name NOT IN ('order-0', 'order-1')) x WHERE nth > 3 AND nth <= 8", "new_files")
def s12_browse_live_source(new_files):
    """Children of a folder without hidden rows, five behind an offset of three."""
    shown = new_files.where(~F.col("name").isin("order-0", "order-1"))
    return paging.by_offset(shown, ["folder"], [F.col("name").cast("binary"), F.col("entry_id")], 3, 5).select("folder", "entry_id", F.col("nth").cast("long").alias("nth"))
