"""Catalogue objects: one JSON document an object, with exact keys, under a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.errors import Conflict, InvalidArgument
from cairn.model.records import CATALOG_ENTRY, TOMBSTONE, columns

READ_BUDGET = 64 << 20


def objects(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """key, size and body of every object of a folder, whatever store it lies in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("content").cast("string").alias("body"))


def listed(found: DataFrame, prefix: str, after: str | None = None, limit: int = 100) -> DataFrame:
    """Objects under a prefix in order of their keys, behind a key."""
    wanted = found.where(F.col("key").startswith(prefix))
    return (wanted if after is None else wanted.where(F.col("key") > after)).orderBy("key").limit(limit)


def parsed(found: DataFrame, schema: str = CATALOG_ENTRY, budget: int | None = READ_BUDGET) -> DataFrame:
    """Documents with their fields. One that doesn't parse, or has other keys than the schema, fails the read, as does
    more than the budget of bytes."""
    if budget is not None and (found.agg(F.sum("size")).first()[0] or 0) > budget:
        raise InvalidArgument("the catalogue is larger than the budget for reading it")
    names = F.array(*(F.lit(name) for name in columns(schema)))
    exact = F.size(F.array_except(F.coalesce(F.json_object_keys("body"), F.array()), names)) == 0
    body = F.when(exact, F.from_json("body", schema, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.concat(F.lit("unknown keys in "), F.col("key"))))
    return found.select("key", body.alias("d")).select("key", "d.*")


def visible(entries: DataFrame, tombstones: DataFrame, repository: str) -> DataFrame:
    """Entries of one repository that no tombstone hides. Entries of another one fail the scan."""
    if not entries.where(F.col("repository_uuid") != repository).isEmpty():
        raise Conflict("the catalogue holds entries of another repository")
    hidden = tombstones.select(F.explode("targets").alias("t")).select(F.col("t.file_uuid").alias("file_uuid"))
    return entries.join(hidden, "file_uuid", "left_anti")


def tombstones(found: DataFrame) -> DataFrame:
    return parsed(found, TOMBSTONE)
