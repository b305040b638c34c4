"""The read side of the request surface: functions over frames of records (see cairn.model), each a page or a plan.

Requests that are known but have no answer here raise Unsupported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import tokens
from cairn.functions.errors import InvalidArgument, NotFound, Unsupported
from cairn.operators import filters, graph, paging


@dataclass
class Page:
    """Rows in order, and the token of the next page if there is one."""

    rows: list
    token: str | None


def _page(found: DataFrame, scope: str, described: str, created: str, row_id: str, size: int | None, token: str | None) -> Page:
    place = tokens.decode_token(token, scope, described) if token else None
    kind = dict(found.dtypes)[row_id]
    if place and kind != "string":
        place = (place[0], int(place[1]))
    rows = paging.newest_first(found, created, row_id, size, place).orderBy(F.desc(created), row_id).collect()  # one page
    more = bool(rows) and rows[-1]["has_more"]
    return Page([r.asDict() for r in rows], tokens.encode_token(scope, described, rows[-1][created], str(rows[-1][row_id])) if more else None)


def _described(**values) -> str:
    return "&".join(f"{k}={v}" for k, v in sorted(values.items()) if v is not None)


def list_jobs(jobs: DataFrame, operation=None, state=None, scope=None, start=None, end=None, size=None, token=None) -> Page:
    wanted = filters.in_scope(scope, state) & filters.equals(operation=operation) & filters.in_time("created_utc_ms", start, end)
    return _page(jobs.where(wanted), "jobs", _described(operation=operation, state=state, scope=scope, start=start, end=end), "created_utc_ms", "job_id", size, token)


def list_schedules(schedules: DataFrame, enabled=None, size=None, token=None) -> Page:
    return _page(schedules.where(filters.equals(enabled=enabled)), "schedules", _described(enabled=enabled), "created_utc_ms", "schedule_id", size, token)


def list_connections(connections: DataFrame, state=None, size=None, token=None) -> Page:
    return _page(connections.where(filters.equals(state=state)), "connections", _described(state=state), "created_utc_ms", "connection_id", size, token)


def list_audit_events(events: DataFrame, severity=None, correlation_id=None, start=None, end=None, size=None, token=None) -> Page:
    wanted = filters.at_least("severity", severity) & filters.equals(correlation_id=correlation_id) & filters.in_time("created_utc_ms", start, end)
    return _page(events.where(wanted), "audit", _described(severity=severity, correlation_id=correlation_id, start=start, end=end), "created_utc_ms", "event_id", size, token)


def _chains_of(catalog: DataFrame, tips: DataFrame) -> DataFrame:
    """The rows of the tips and of all points that they build on, as far as they are there."""
    ids = graph.above(catalog, tips, "file_uuid", "parent_uuid").withColumnRenamed("id", "file_uuid")
    return catalog.join(ids, "file_uuid", "left_semi")


def list_recovery_points(catalog: DataFrame, size=None, after=None) -> Page:
    """Points in order of their id with the state of their chain. Only the chains of the page are followed."""
    found = paging.by_key(catalog, "file_uuid", size, after).orderBy("file_uuid").collect()
    ids = [r["file_uuid"] for r in found]  # one page
    if not ids:
        return Page([], None)
    own = _chains_of(catalog, catalog.where(F.col("file_uuid").isin(ids)))
    states = graph.tops(own, "file_uuid", "parent_uuid").where(F.col("id").isin(ids))
    kinds = own.select(F.col("file_uuid").alias("top"), F.col("backup_type").alias("top_type"))
    known = {r["id"]: r["top_type"] == 1 and not r["missing"] and not r["deep"] for r in states.join(kinds, "top").collect()}
    rows = [r.asDict() | {"chain_state": "complete" if known[r["file_uuid"]] else "incomplete"} for r in found]
    return Page(rows, ids[-1] if rows[-1]["has_more"] else None)


def list_source_inventory(sources: DataFrame, available_only=True, size=None, after=None) -> Page:
    found = sources.where("available") if available_only else sources
    rows = [r.asDict() for r in paging.by_key(found, "source_id", size, after).orderBy("source_id").collect()]
    return Page(rows, rows[-1]["source_id"] if rows and rows[-1]["has_more"] else None)


def resolve_chain(catalog: DataFrame, tip: str) -> list[dict]:
    """The chain of a tip with the base first. Neither restoring nor mounting is said to be possible here."""
    own = _chains_of(catalog, catalog.where(F.col("file_uuid") == tip))
    pairs = graph.ancestors(own, "file_uuid", "parent_uuid").where(F.col("id") == tip)
    points = pairs.join(catalog.withColumnRenamed("file_uuid", "ancestor"), "ancestor").orderBy(F.desc("distance")).collect()  # at most 129
    if not points:
        raise NotFound(tip)
    return [{"file_uuid": r["ancestor"], "backup_type": r["backup_type"], "restore_eligible": False, "mount_eligible": False} for r in points]


def get_recovery_point_layout(manifests: DataFrame, file_uuid: str) -> list[dict]:
    """The disks of a point as its manifest has them: partitions in order of their offset, each with the letter of the
    first volume that has an extent which begins in it or covers it. manifests: file_uuid and the columns of MANIFEST."""
    found = manifests.where(F.col("file_uuid") == file_uuid).select("disks", "volumes")
    if found.isEmpty():
        raise NotFound(file_uuid)
    disks = found.select(F.explode("disks").alias("d")).select("d.disk_number", "d.disk_size", "d.partition_style", F.explode_outer("d.partitions").alias("p"))
    parts = disks.select("disk_number", "disk_size", "partition_style", F.col("p.number").alias("partition_number"), F.col("p.offset").alias("offset"), F.col("p.size").alias("size"))
    volumes = found.select(F.explode("volumes").alias("v")).select("v.volume_index", F.left(F.get("v.mount_points", F.lit(0)), F.lit(2)).alias("letter"), F.explode("v.extents").alias("e"))
    extents = volumes.select("volume_index", "letter", F.col("e.disk_number").alias("disk_number"), F.col("e.physical_offset").alias("low"), (F.col("e.physical_offset") + F.col("e.length")).alias("high"))
    end = F.col("offset") + F.col("size")
    lies = ((F.col("low") >= F.col("offset")) & (F.col("low") < end)) | ((F.col("low") <= F.col("offset")) & (F.col("high") >= end))
    first = parts.join(extents, "disk_number").where(lies).groupBy("disk_number", "partition_number").agg(F.min(F.struct("volume_index", "letter")).alias("first"))
    rows = parts.join(first, ["disk_number", "partition_number"], "left").select(*parts.columns, F.col("first.letter").alias("letter"))
    return [r.asDict() for r in rows.orderBy("disk_number", "offset").collect()]  # one manifest


def plan_delete(catalog: DataFrame, target: str) -> DataFrame:
    """The points that go with a target, with their depth below it; the deepest go first."""
    found = graph.descendants(catalog, catalog.where(F.col("file_uuid") == target), "file_uuid", "parent_uuid")
    return found.select(F.col("id").alias("file_uuid"), "depth").orderBy(F.desc("depth"), "file_uuid")


def list_entries(entries: DataFrame, parent: int, size=None, offset: int = 0) -> DataFrame:
    """Children of a folder by name bytes, behind an offset."""
    if offset < 0:
        raise InvalidArgument("the offset is negative")
    own = entries.where(F.col("parent_entry_id") == parent)
    return paging.by_offset(own, ["parent_entry_id"], [F.col("name"), F.col("entry_id")], offset, paging.page_size(size))


def prepare_restore(capacity: int, logical_size: int, is_volume: bool) -> bool:
    return is_volume and capacity >= logical_size


def service_settings(months: int = 3) -> dict:
    if months not in (1, 3, 6):
        raise InvalidArgument("jobs are kept one, three or six months")
    return {"job_retention_months": months}


def list_events(*_, **__):
    raise Unsupported("event lists are not answered; the audit list holds the same rows")


subscribe_task_events = acknowledge_events = list_events
