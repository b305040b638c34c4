"""Writes (w) and state machines (z)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import dml
from cairn.plans.catalog import query

AT = 2_000_000_000_000


def fresh(jobs):
    """Rows that a writer brings: every ninth of them has a key that is taken."""
    return jobs.where("job_id % 9 < 2").select(F.when(F.col("job_id") % 9 == 0, F.col("job_id")).otherwise(F.col("job_id") + 100_000_000).alias("job_id"), F.lit(1).alias("state"), (F.col("created_ms") + 5).alias("created_ms"))


FRESH = "n AS (SELECT CASE WHEN job_id % 9 = 0 THEN job_id ELSE job_id + 100000000 END AS job_id, 1 AS state, created_ms + 5 AS created_ms FROM jobs WHERE job_id % 9 < 2)"


@query(f"WITH {FRESH} SELECT job_id, state, 'kept' AS what FROM jobs UNION ALL SELECT job_id, state, 'inserted' FROM n WHERE job_id NOT IN (SELECT job_id FROM jobs) UNION ALL SELECT job_id, state, 'conflict' FROM n WHERE job_id IN (SELECT job_id FROM jobs)", "jobs")
def w1_insert(jobs):
    rows = fresh(jobs).select("job_id", "state", F.lit("inserted").alias("what"))
    after, conflicts = dml.inserted(jobs.select("job_id", "state", F.lit("kept").alias("what")), rows, "job_id")
    return after.unionByName(conflicts.withColumn("what", F.lit("conflict")))


@query(f"WITH {FRESH} SELECT job_id, state, created_ms FROM jobs WHERE job_id NOT IN (SELECT job_id FROM n) UNION ALL SELECT n.job_id, n.state, coalesce(j.created_ms, n.created_ms) FROM n LEFT JOIN jobs j ON j.job_id = n.job_id", "jobs")
def w2_upsert(jobs):
    return dml.upserted(jobs.select("job_id", "state", "created_ms"), fresh(jobs), "job_id", ["created_ms"])


@query("SELECT source_id, disk, source_id = m AS is_default FROM (SELECT source_id, disk, min(CASE WHEN available THEN source_id END) OVER (PARTITION BY disk) AS m FROM inventory) x WHERE m IS NOT NULL", "inventory")
def w3_single_default(inventory):
    chosen = inventory.where("available").groupBy("disk").agg(F.min("source_id").alias("m"))
    return inventory.join(chosen, "disk").select("source_id", "disk", (F.col("source_id") == F.col("m")).alias("is_default"))


REQUESTS = f"r AS (SELECT job_id, CAST(CASE WHEN job_id % 5 = 0 THEN 2 ELSE state END AS INT) AS expected, CAST(job_id % 7 + 1 AS INT) AS target, {AT} + job_id AS at_ms FROM jobs WHERE job_id % 3 = 0)"
LEGAL = "((expected = 1 AND target IN (2, 3, 4, 5, 6, 7)) OR (expected = 2 AND target IN (3, 4, 5, 6, 7)) OR (expected = 3 AND target IN (5, 6, 7)))"


def requests(jobs):
    return jobs.where("job_id % 3 = 0").select("job_id", F.when(F.col("job_id") % 5 == 0, 2).otherwise(F.col("state")).alias("expected"), (F.col("job_id") % 7 + 1).cast("int").alias("target"), (F.lit(AT) + F.col("job_id")).alias("at_ms"))


@query(f"""WITH {REQUESTS}, o AS (SELECT j.*, expected, target, at_ms, CASE WHEN target IS NULL THEN NULL WHEN state <> expected THEN 'conflict' WHEN NOT {LEGAL} THEN 'illegal' ELSE 'applied' END AS outcome FROM jobs j LEFT JOIN r ON r.job_id = j.job_id)
SELECT job_id, CASE WHEN outcome = 'applied' THEN target ELSE state END AS state, outcome FROM o""", "jobs")
def w4_compare_and_set(jobs):
    return dml.transitioned(jobs, requests(jobs)).select("job_id", "state", "outcome")


@query(f"""WITH {REQUESTS}, o AS (SELECT j.*, expected, target, at_ms, coalesce(state = expected AND {LEGAL}, false) AS done FROM jobs j LEFT JOIN r ON r.job_id = j.job_id)
SELECT job_id, CASE WHEN done AND target >= 2 THEN coalesce(started_ms, at_ms) ELSE started_ms END AS started_ms, CASE WHEN done AND target >= 4 THEN at_ms ELSE completed_ms END AS completed_ms FROM o""", "jobs")
def z2_derived_times(jobs):
    return dml.transitioned(jobs, requests(jobs)).select("job_id", "started_ms", "completed_ms")


@query("SELECT expected, target, expected <= 3 AND target <= 7 AND ((expected = 1 AND target >= 2) OR (expected = 2 AND target >= 3) OR (expected = 3 AND target >= 5)) AS legal FROM (SELECT CAST(a AS INT) AS expected, CAST(b AS INT) AS target FROM range(1, 8) x(a), range(1, 8) y(b)) p", "region")
def z1_transition_table(region):
    """All pairs of the seven states. (The region table only brings the session.)"""
    states = F.sequence(F.lit(1), F.lit(7))
    pairs = region.limit(1).select(F.explode(states).alias("expected")).select("expected", F.explode(states).alias("target"))
    return pairs.select("expected", "target", dml.transition_allowed(F.col("expected"), F.col("target")).alias("legal"))


@query(f"SELECT job_id, CASE WHEN state <= 3 THEN 7 ELSE state END AS state, CASE WHEN state <= 3 THEN coalesce(started_ms, {AT}) ELSE started_ms END AS started_ms, CASE WHEN state <= 3 THEN {AT} ELSE completed_ms END AS completed_ms FROM jobs", "jobs")
def w5_interrupt_active(jobs):
    return dml.interrupted(jobs, AT).select("job_id", "state", "started_ms", "completed_ms")


@query("SELECT job_id, completed_ms FROM jobs WHERE NOT (state >= 4 AND completed_ms IS NOT NULL AND completed_ms < 900000000000 - 7776000000)", "jobs")
def w6_retention_purge(jobs):
    return dml.purged(jobs, dml.cutoff(900_000_000_000, 3)).select("job_id", "completed_ms")


@query("SELECT j.job_id, CASE WHEN s.schedule_id IS NULL THEN NULL ELSE j.schedule_id END AS schedule_id FROM jobs j LEFT JOIN schedules s ON s.schedule_id = j.schedule_id AND s.schedule_id % 10 <> 0", "jobs", "schedules")
def w7_delete_set_null(jobs, schedules):
    """Schedules of a tenth are deleted; their jobs stay and lose the reference."""
    left = schedules.where("schedule_id % 10 <> 0").select(F.col("schedule_id").alias("s"))
    return jobs.join(left, F.col("schedule_id") == F.col("s"), "left").select("job_id", F.col("s").alias("schedule_id"))


@query("SELECT o_orderkey AS selection_id FROM orders WHERE o_custkey NOT IN (SELECT schedule_id FROM schedules WHERE schedule_id % 10 = 0)", "orders", "schedules")
def w7_delete_cascade(orders, schedules):
    gone = schedules.where("schedule_id % 10 = 0").select(F.col("schedule_id").alias("o_custkey"))
    return orders.join(gone, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("selection_id"))


@query("SELECT schedule_id, ordinal, item FROM (SELECT o_custkey AS schedule_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal, o_orderkey AS item FROM orders WHERE o_custkey % 4 <> 0) x UNION ALL SELECT schedule_id, CAST(k AS INT), schedule_id * 10 + k FROM schedules, range(0, 3) r(k) WHERE schedule_id % 4 = 0", "orders", "schedules")
def w8_replace_children(orders, schedules):
    """Every fourth schedule gets three new selections in place of all it had."""
    lists = orders.where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("schedule_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))
    new = schedules.where("schedule_id % 4 = 0").select("schedule_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("schedule_id") * 10 + k).alias("items"))
    return lists.unionByName(new).select("schedule_id", F.posexplode("items").alias("ordinal", "item"))


@query("WITH c AS (SELECT job_id, idempotency_key, fingerprint FROM jobs WHERE job_id % 2 = 1), k AS (SELECT idempotency_key, fingerprint AS old FROM jobs WHERE job_id % 2 = 0 AND job_id % 5 > 0) SELECT job_id, CASE WHEN old IS NULL THEN 'execute' WHEN old = fingerprint THEN 'replay' ELSE 'conflict' END AS verdict FROM c LEFT JOIN k ON k.idempotency_key = c.idempotency_key", "jobs")
def w9_idempotent_commands(jobs):
    known = jobs.where("job_id % 2 = 0 AND job_id % 5 > 0").select("idempotency_key", F.concat(F.lit("print-"), (F.col("job_id") % 3).cast("string")).alias("fingerprint"))
    return dml.replayed(jobs.where("job_id % 2 = 1").select("job_id", "idempotency_key", "fingerprint"), known, "idempotency_key", "fingerprint").select("job_id", "verdict")


#: The store holds what succeeded jobs published under their keys; the generation is the job. All other jobs publish: one
#: half create only, the other half replace the generation before their own number. Queued ones haven't staged all bytes.
#: The answer to a job of a schedule that is switched off is lost.
@query("""WITH store AS (SELECT idempotency_key AS k, max(job_id) AS generation FROM jobs WHERE state = 4 GROUP BY idempotency_key),
r AS (SELECT j.job_id, j.idempotency_key AS k, j.state > 1 AS staged, j.operation <= 2 AS create_only, j.job_id - 1 AS expected, NOT coalesce(s.enabled, true) AS lost FROM jobs j LEFT JOIN schedules s ON s.schedule_id = j.schedule_id WHERE j.state <> 4),
f AS (SELECT r.*, NOT staged AS unstaged, (create_only AND store.k IS NOT NULL) OR (NOT create_only AND coalesce(store.generation <> r.expected, true)) AS refused FROM r LEFT JOIN store ON store.k = r.k)
SELECT a.job_id, CASE WHEN a.unstaged THEN 'not_staged' WHEN a.refused OR EXISTS (SELECT 1 FROM f b WHERE b.k = a.k AND b.job_id < a.job_id AND NOT b.unstaged AND NOT b.refused) THEN 'conflict' WHEN a.lost THEN 'unknown' ELSE 'published' END AS outcome FROM f a""", "jobs", "schedules")
def w10_conditional_publish(jobs, schedules):
    """Publication of staged objects on a condition: create-only fails on a key that exists, replacement on any other
    generation than the expected one. Of several requests that could publish under a key the first does, which changes
    the generation for those behind it. A lost answer leaves the outcome unknown."""
    store = jobs.where("state = 4").groupBy("idempotency_key").agg(F.max("job_id").alias("generation"))
    off = schedules.where("not enabled").select("schedule_id", F.lit(True).alias("lost"))
    wanted = jobs.where("state <> 4").join(store, "idempotency_key", "left").join(off, "schedule_id", "left")
    create_only = F.col("operation") <= 2
    met = F.when(create_only, F.col("generation").isNull()).otherwise(F.coalesce(F.col("generation") == F.col("job_id") - 1, F.lit(False)))
    wanted = wanted.select("job_id", "idempotency_key", (F.col("state") > 1).alias("staged"), met.alias("met"), "lost")
    first = wanted.where("staged and met").groupBy("idempotency_key").agg(F.min("job_id").alias("first"))
    outcome = F.when(~F.col("staged"), "not_staged").when(~F.col("met") | (F.col("first") < F.col("job_id")), "conflict").when(F.col("lost"), "unknown").otherwise("published")
    return wanted.join(first, "idempotency_key", "left").select("job_id", outcome.alias("outcome"))


@query("SELECT file_id, CASE WHEN file_id % 97 = 0 THEN 'replayed' WHEN file_id % 5 = 0 THEN 'absent' ELSE 'deleted' END AS outcome FROM catalog WHERE backup_set % 2 = 0", "catalog", "tombstones")
def w11_idempotent_delete(catalog, tombstones):
    """A delete that was logged is a replay; one of a missing key succeeds."""
    log = tombstones.select("file_id", F.lit(True).alias("done"))
    wanted = catalog.where("backup_set % 2 = 0").join(log, "file_id", "left")
    return wanted.select("file_id", F.when(F.col("done"), "replayed").when(F.col("file_id") % 5 == 0, "absent").otherwise("deleted").alias("outcome"))


@query("SELECT event_id, message_code FROM audit UNION ALL SELECT event_id + 100000000, message_code FROM audit WHERE event_id % 8 = 0", "audit")
def w12_append_audit(audit):
    new = audit.where("event_id % 8 = 0").select((F.col("event_id") + 100_000_000).alias("event_id"), "message_code")
    after, _ = dml.inserted(audit.select("event_id", "message_code"), new, "event_id")
    return after


@query("SELECT c.file_id, CASE WHEN c.file_id % 3 > 0 THEN 'created' WHEN c.file_id % 2 = 0 THEN 'same' ELSE 'conflict' END AS outcome FROM catalog c", "catalog")
def w15_idempotent_publish(catalog):
    """An existing object that equals ours is a success."""
    ours = catalog.select("file_id", F.struct("backup_set", "stored_bytes").alias("body"))
    there = catalog.where("file_id % 3 = 0").select("file_id", F.struct("backup_set", (F.col("stored_bytes") + F.col("file_id") % 2).alias("stored_bytes")).alias("old"))
    return ours.join(there, "file_id", "left").select("file_id", F.when(F.col("old").isNull(), "created").when(F.col("old") == F.col("body"), "same").otherwise("conflict").alias("outcome"))


@query("""WITH due AS (SELECT schedule_id, next_run_ms FROM schedules WHERE enabled AND next_run_ms <= now_ms),
f AS (SELECT due.schedule_id, CASE WHEN NOT EXISTS (SELECT 1 FROM jobs j WHERE j.schedule_id = due.schedule_id) THEN 'accepted'
WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.schedule_id = due.schedule_id AND j.state IN (1, 2, 3)) THEN 'deferred'
WHEN (SELECT count(*) FROM jobs j WHERE j.schedule_id = due.schedule_id AND j.state IN (6, 7)) = (SELECT count(*) FROM jobs j WHERE j.schedule_id = due.schedule_id) THEN 'not_found'
WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.schedule_id = due.schedule_id AND j.state = 5) THEN 'skipped' ELSE 'replayed' END AS outcome FROM due)
SELECT schedule_id, outcome, outcome IN ('accepted', 'replayed', 'not_found') AS advances FROM f""", "schedules", "jobs")
def z3_fire_outcomes(schedules, jobs):
    """What a due schedule's fire comes to, told from its jobs, and whether its next run moves on: without jobs it is
    accepted; with an active one deferred; with cancelled ones alone its target isn't found; after a failed one it is
    skipped; otherwise the command was seen before and is replayed."""
    due = schedules.where("enabled AND next_run_ms <= now_ms").select("schedule_id")
    state = F.col("state")
    per = jobs.groupBy("schedule_id").agg(F.count_if(state <= 3).alias("active"), F.count_if(state == 5).alias("failed"), F.count_if(state < 6).alias("others"))
    outcome = F.when(F.col("others").isNull(), "accepted").when(F.col("active") > 0, "deferred").when(F.col("others") == 0, "not_found").when(F.col("failed") > 0, "skipped").otherwise("replayed")
    found = due.join(per, "schedule_id", "left").select("schedule_id", outcome.alias("outcome"))
    return found.withColumn("advances", F.col("outcome").isin("accepted", "replayed", "not_found"))


@query("SELECT schedule_id, CASE WHEN enabled AND next_run_ms IS NOT NULL AND schedule_id % 6 > 0 THEN now_ms + 86400000 ELSE next_run_ms END AS next_run_ms FROM schedules", "schedules")
def z4_advance_next_run(schedules):
    """Moves on only if the schedule is still enabled and still due when it was."""
    seen = schedules.select("schedule_id", F.when(F.col("schedule_id") % 6 == 0, F.col("next_run_ms") - 1).otherwise(F.col("next_run_ms")).alias("due_seen"))
    ok = F.coalesce(F.col("enabled") & (F.col("next_run_ms") == F.col("due_seen")), F.lit(False))
    return schedules.join(seen, "schedule_id").select("schedule_id", F.when(ok, F.col("now_ms") + 86_400_000).otherwise(F.col("next_run_ms")).alias("next_run_ms"))


@query("SELECT schedule_id, CASE WHEN schedule_id % 8 = 0 THEN 'content_kind' WHEN schedule_id % 12 = 3 THEN 'connection' ELSE 'ok' END AS refused FROM schedules", "schedules")
def z5_immutable_fields(schedules):
    """The first field that an update may not change, but did."""
    old = schedules.select("schedule_id", (F.col("schedule_id") % 2).alias("kind"), (F.col("schedule_id") % 3).alias("connection"))
    new = schedules.select("schedule_id", F.when(F.col("schedule_id") % 8 == 0, F.lit(9)).otherwise(F.col("schedule_id") % 2).alias("new_kind"), F.when(F.col("schedule_id") % 12 == 3, F.lit(9)).otherwise(F.col("schedule_id") % 3).alias("new_connection"))
    return old.join(new, "schedule_id").select("schedule_id", F.when(F.col("kind") != F.col("new_kind"), "content_kind").when(F.col("connection") != F.col("new_connection"), "connection").otherwise("ok").alias("refused"))


@query("SELECT source_id, available AND capacity >= 1400 AS feasible FROM inventory", "inventory")
def z6_preflight(inventory):
    return inventory.select("source_id", (F.col("available") & (F.col("capacity") >= 1400)).alias("feasible"))


@query("SELECT c.file_id, CASE WHEN t.file_id IS NOT NULL AND c.file_id % 2 = 0 THEN 'done' WHEN t.file_id IS NOT NULL THEN 'resume' ELSE 'plan' END AS next_step FROM catalog c LEFT JOIN tombstones t ON t.file_id = c.file_id", "catalog", "tombstones")
def z7_delete_resume(catalog, tombstones):
    """A published tombstone is the authority: its members go on being deleted until all are absent."""
    t = tombstones.select("file_id", F.lit(True).alias("published"))
    absent = F.col("file_id") % 2 == 0
    return catalog.join(t, "file_id", "left").select("file_id", F.when(F.col("published") & absent, "done").when(F.col("published"), "resume").otherwise("plan").alias("next_step"))


@query("SELECT parent_id AS folder, CAST(sum(CASE WHEN entry_id % 23 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN entry_id % 23 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS restored, CASE WHEN bool_or(entry_id % 23 = 0) THEN 'partial' ELSE 'complete' END AS outcome FROM entries WHERE kind = 2 GROUP BY parent_id", "entries")
def z8_partial_failures(entries):
    bad = F.col("entry_id") % 23 == 0
    return entries.where("kind = 2").groupBy(F.col("parent_id").alias("folder")).agg(F.count_if(bad).alias("failed"), F.count_if(~bad).alias("restored"), F.when(F.bool_or(bad), "partial").otherwise("complete").alias("outcome"))
