"""Changes of tables, as frames before and after. Writers decide when to swap them; each change is one pass of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From each active state, the states a job may go to.
TRANSITIONS = {1: (2, 3, 4, 5, 6, 7), 2: (3, 4, 5, 6, 7), 3: (5, 6, 7)}


def inserted(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows, and the new rows whose key exists already (conflicts)."""
    known = table.select(key)
    return table.unionByName(new.join(known, key, "left_anti")), new.join(known, key, "left_semi")


def upserted(table: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """New rows replace those of their key; the columns in keep stay as they were."""
    kept = keep or []
    old = table.select(F.col(key), *(F.col(c).alias(f"__old_{c}") for c in kept), F.lit(True).alias("__known")) if kept else None
    rows = new
    if kept:
        rows = new.join(old, key, "left").select(*(F.when(F.col("__known"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns))
    return table.join(new.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def transition_allowed(state: Column, to: Column) -> Column:
    allowed = F.lit(False)
    for old, new in TRANSITIONS.items():
        allowed = allowed | ((state == old) & to.isin(*new))
    return allowed


def transitioned(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: job_id, expected, target, at_ms. Adds outcome: applied, conflict (the state is another one), illegal, or
    null without a request. Starting sets the start time once; ending sets the end time."""
    both = jobs.join(requests, "job_id", "left")
    legal = transition_allowed(F.col("expected"), F.col("target"))
    outcome = F.when(F.col("target").isNull(), None).when(F.col("state") != F.col("expected"), "conflict").when(~legal, "illegal").otherwise("applied")
    both = both.withColumn("outcome", outcome).withColumn("__do", F.coalesce(F.col("outcome") == "applied", F.lit(False)))
    started = F.when(F.col("__do") & (F.col("target") >= 2), F.coalesce("started_ms", "at_ms")).otherwise(F.col("started_ms"))
    completed = F.when(F.col("__do") & (F.col("target") >= 4), F.col("at_ms")).otherwise(F.col("completed_ms"))
    state = F.when(F.col("__do"), F.col("target")).otherwise(F.col("state"))
    return both.select("job_id", state.alias("state"), started.alias("started_ms"), completed.alias("completed_ms"), "outcome")


def interrupted(jobs: DataFrame, at_ms: int) -> DataFrame:
    """Every active job ends as interrupted, and has started then if it had not."""
    active = F.col("state").isin(1, 2, 3)
    return jobs.withColumns({"started_ms": F.when(active, F.coalesce("started_ms", F.lit(at_ms))).otherwise(F.col("started_ms")), "completed_ms": F.when(active, F.lit(at_ms)).otherwise(F.col("completed_ms")), "state": F.when(active, 7).otherwise(F.col("state"))})


def cutoff(now_ms: int, months: int) -> int:
    """A month of retention has thirty days."""
    return max(0, now_ms - months * 30 * 86_400_000)


def purged(jobs: DataFrame, cutoff_ms: int) -> DataFrame:
    """Without those that ended before the cutoff; one that ended exactly then stays."""
    old = F.col("state").isin(4, 5, 6, 7) & F.col("completed_ms").isNotNull() & (F.col("completed_ms") < cutoff_ms)
    return jobs.where(~old)


def replayed(commands: DataFrame, known: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Adds verdict: execute (a new key), replay (the same fingerprint) or conflict (another one)."""
    old = known.select(F.col(key), F.col(fingerprint).alias("__print"))
    verdict = F.when(F.col("__print").isNull(), "execute").when(F.col("__print") == F.col(fingerprint), "replay").otherwise("conflict")
    return commands.join(old, key, "left").withColumn("verdict", verdict).drop("__print")
