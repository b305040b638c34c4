"""Requests, sources and streams over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import api
from cairn.functions.errors import Conflict, InvalidArgument, NotFound, Unsupported
from cairn.model.records import CATALOG_ENTRY, JOB, MANIFEST, TOMBSTONE, columns
from cairn.sources import catalog_json
from cairn.streaming import progress


def jobs(spark, n=25):
    rows = [dict.fromkeys(columns(JOB)) | {"job_id": f"j|{i:02d}", "operation": 1 + i % 2, "state": 1 + i % 7, "content_kind": 1, "created_utc_ms": 1000 - i // 3} for i in range(n)]
    return spark.createDataFrame(rows, JOB)


def test_paging_through_jobs(spark):
    df, seen, token = jobs(spark), [], None
    while True:
        page = api.list_jobs(df, size=7, token=token)
        seen += [r["job_id"] for r in page.rows]
        token = page.token
        if token is None:
            break
    assert seen == [f"j|{i:02d}" for i in range(25)]


def test_a_token_is_bound_to_its_filter(spark):
    df = jobs(spark)
    token = api.list_jobs(df, operation=1, size=2).token
    assert api.list_jobs(df, operation=1, size=2, token=token).rows[0]["job_id"] == "j|04"
    with pytest.raises(InvalidArgument):
        api.list_jobs(df, operation=2, size=2, token=token)


def entry(file, parent, kind, repository="r"):
    return dict.fromkeys(columns(CATALOG_ENTRY)) | {"repository_uuid": repository, "file_uuid": file, "parent_uuid": parent, "backup_type": kind}


def points(spark):
    rows = [entry("a", None, 1), entry("b", "a", 2), entry("c", "b", 2), entry("d", "gone", 2)]
    return spark.createDataFrame(rows, CATALOG_ENTRY)


def test_recovery_points(spark):
    df = points(spark)
    page = api.list_recovery_points(df, size=3)
    assert [(r["file_uuid"], r["chain_state"]) for r in page.rows] == [("a", "complete"), ("b", "complete"), ("c", "complete")] and page.token == "c"
    assert [r["chain_state"] for r in api.list_recovery_points(df, after="c").rows] == ["incomplete"]
    assert [r["file_uuid"] for r in api.resolve_chain(df, "c")] == ["a", "b", "c"]
    assert [r["file_uuid"] for r in api.plan_delete(df, "a").collect()] == ["c", "b", "a"]
    with pytest.raises(NotFound):
        api.resolve_chain(df, "x")
    with pytest.raises(Unsupported):
        api.subscribe_task_events()
    with pytest.raises(InvalidArgument):
        api.service_settings(2)


def test_layout_of_a_point(spark):
    disks = [(0, 1000, "GPT", [(2, 500, 400), (1, 100, 300)]), (1, 500, "MBR", [])]
    volumes = [(7, ["D:\\", "mnt"], 300, 0, False, [(0, 2, 450, 0, 600)]), (3, ["C:\\"], 300, 10, True, [(0, 1, 100, 0, 300)]), (4, [], 10, 0, False, [(0, 1, 110, 0, 5)])]
    df = spark.createDataFrame([("a", disks, volumes)], f"file_uuid string, {MANIFEST}")
    found = [(r["disk_number"], r["partition_number"], r["offset"], r["letter"]) for r in api.get_recovery_point_layout(df, "a")]
    assert found == [(0, 1, 100, "C:"), (0, 2, 500, "D:"), (1, None, None, None)]
    with pytest.raises(NotFound):
        api.get_recovery_point_layout(df, "b")


def test_catalogue_objects(spark, tmp_path):
    for e in (entry("a", None, 1), entry("b", "a", 2)):
        (tmp_path / f"{e['file_uuid']}.json").write_text(json.dumps(e))
    found = catalog_json.objects(spark, str(tmp_path))
    assert [r["key"][-6:] for r in catalog_json.listed(found, f"file:{tmp_path}/").collect()] == ["a.json", "b.json"]
    entries = catalog_json.parsed(found)
    stones = spark.createDataFrame([("o", "r", 1, [("a", 1, "f", "k", [])])], TOMBSTONE)
    assert [r["file_uuid"] for r in catalog_json.visible(entries, stones, "r").collect()] == ["b"]
    with pytest.raises(Conflict):
        catalog_json.visible(entries, stones, "other")
    with pytest.raises(InvalidArgument):
        catalog_json.parsed(found, budget=10)
    (tmp_path / "c.json").write_text(json.dumps(entry("c", None, 1) | {"more": 1}))
    with pytest.raises(Exception, match="unknown keys"):
        catalog_json.parsed(catalog_json.objects(spark, str(tmp_path))).collect()


def test_stream_of_progress(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = progress.per_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in progress.per_window(events).collect()}
    newest = progress.latest(events, "user_id", "ts")
    assert newest.count() == events.select("user_id").distinct().count()
