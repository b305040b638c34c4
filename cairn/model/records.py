"""Schemas of the records, as Spark DDL. Whole numbers are signed 64-bit; times are milliseconds since 1970; names of
files are bytes, which sort unsigned with the shorter first. Lists of name and value keep their order and repetitions, so
that they are arrays and not maps."""

from __future__ import annotations

JOB = (
    "job_id string not null, trace_id string, operation int not null, state int not null, content_kind int not null, created_utc_ms bigint not null, started_utc_ms bigint, completed_utc_ms bigint, source_ids array<string>, "
    "schedule_id string, message_code string, repository_connection_id string, backup_type int, parent_recovery_point_id string, idempotency_key string, request_fingerprint string"
)
SCHEDULE = (
    "schedule_id string not null, enabled boolean not null, trigger_kind int not null, local_minutes_of_day array<smallint>, weekday_mask int, day_of_month_mask int, timezone_id string, next_run_utc_ms bigint, "
    "backup_set_uuid string, last_recovery_point_id string, repository_connection_id string, created_utc_ms bigint, updated_utc_ms bigint"
)
AUDIT_EVENT = "event_id string not null, created_utc_ms bigint not null, severity int not null, message_code string, message_arguments array<struct<name:string,value:string>>, correlation_id string"
CONNECTION = "connection_id string not null, locator string, state int not null, is_default boolean not null, capabilities array<string>, created_utc_ms bigint, updated_utc_ms bigint"
COMMAND = "idempotency_key string not null, command_id string not null, request_fingerprint string not null, resource_id string"
PREFLIGHT = "preflight_token string not null, logical_size_bytes bigint, capacity_bytes bigint, expires_utc_ms bigint, feasible boolean, entry_ids array<bigint>"
CATALOG_ENTRY = (
    "repository_uuid string, file_uuid string, backup_set_uuid string, parent_uuid string, backup_type int, content_kind string, archive_main_key string, split_part_count int, has_sidecar boolean, created_utc_ms bigint, "
    "logical_size_bytes bigint, stored_size_bytes bigint, deduplicated_block_count bigint, deduplicated_logical_bytes bigint, source_count int, source_volume_ids array<string>, file_entry_count bigint, file_stream_count bigint, "
    "structural_state string, catalog_generation bigint, file_selection_fingerprint string, file_baseline_available boolean"
)
TOMBSTONE = "operation_uuid string, repository_uuid string, created_utc_ms bigint, targets array<struct<file_uuid:string,catalog_generation:bigint,content_kind:string,archive_main_key:string,members:array<struct<key:string,generation:string>>>>"
FILE_ENTRY = (
    "layer int, entry_id bigint, parent_entry_id bigint, kind int, name binary, selection_id string, volume_identity string, file_id binary, write_time bigint, logical_size bigint, "
    "streams array<struct<stream_index:int,logical_size:bigint,content_storage:int,parent_stream_index:int,extents:array<struct<chunk_index:bigint,block_entry_index:int,file_offset:bigint,logical_size:bigint>>>>"
)
BLOCK = "layer int, source_index int, chunk_index bigint, block_index bigint, size int, state int, payload binary, digest string"
RANGE = "owner string, start bigint, end bigint, state int"
OBJECT = "key string, size bigint, generation string"
MANIFEST = (
    "disks array<struct<disk_number:int,disk_size:bigint,partition_style:string,partitions:array<struct<number:int,offset:bigint,size:bigint>>>>, "
    "volumes array<struct<volume_index:int,mount_points:array<string>,total_size:bigint,free_size:bigint,free_size_known:boolean,extents:array<struct<disk_number:int,partition_number:int,physical_offset:bigint,volume_offset:bigint,length:bigint>>>>"
)
PROGRESS = "job_id string, phase int, logical_bytes bigint, processed_bytes bigint, stored_bytes bigint, discovered_entries bigint, processed_entries bigint"


def columns(ddl: str) -> list[str]:
    """Names of the columns of a schema."""
    depth, names, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += c
    return names
