"""Fixed-size blocks: classes, baselines, duplicates within windows, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.intervals import islands

FREE, ZERO, DATA = 1, 2, 3


def chunked(df: DataFrame, size: Column, block: int) -> DataFrame:
    """A row for each block of a run of bytes: block_no, offset and length (the last may be short)."""
    cut = df.withColumn("__size", size).where("__size > 0").withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__size - 1) div {block}"))))
    return cut.withColumns({"offset": F.col("block_no") * block, "length": F.least(F.lit(block).cast("long"), F.col("__size") - F.col("block_no") * block)}).drop("__size")


def classify(is_free: Column, is_zero: Column) -> Column:
    """Free goes before zero, and zero before data."""
    return F.when(is_free, FREE).when(is_zero, ZERO).otherwise(DATA)


def digest(state: Column, payload: Column) -> Column:
    return F.when(state == DATA, F.sha2(payload, 256))


def unchanged(state: Column, digest_: Column, base_state: Column, base_digest: Column) -> Column:
    """Equal state; data also needs equal digests."""
    return F.coalesce((state == base_state) & ((state != DATA) | (digest_ == base_digest)), F.lit(False))


def deduplicated(blocks: DataFrame) -> DataFrame:
    """blocks: chunk, block_index, state, digest, size, same (unchanged against the baseline). Within a chunk, windows end
    at unchanged blocks; in a window the first block of a digest and size is canonical, and later ones refer to it.
    Adds window and canonical (its block_index, null for blocks that aren't changed data)."""
    w = Window.partitionBy("chunk").orderBy("block_index")
    windowed = islands(blocks, ["chunk"], ["block_index"], F.col("same")).withColumnRenamed("island", "window")
    changed = (F.col("state") == DATA) & ~F.col("same")
    first = F.min(F.when(changed, F.col("block_index"))).over(Window.partitionBy("chunk", "window", "digest", "size"))
    return windowed.withColumn("canonical", F.when(changed, first))


def run_lengths(blocks: DataFrame) -> DataFrame:
    """Entries of a chunk: neighbouring zero or free blocks of one state make one entry, each data block its own.
    Adds entry (its number in the chunk)."""
    w = Window.partitionBy("chunk").orderBy("block_index")
    before, index = F.lag("state").over(w), F.lag("block_index").over(w)
    marked = blocks.withColumns({"__s": before, "__i": index})
    new = F.col("__s").isNull() | (F.col("state") == DATA) | (F.col("__s") != F.col("state")) | (F.col("__i") + 1 != F.col("block_index"))
    return islands(marked, ["chunk"], ["block_index"], new).withColumn("entry", F.col("island") - 1).drop("island", "__s", "__i")


def overlay(layers: DataFrame, key: str, layer: str, values: list[str]) -> DataFrame:
    """The value of the last layer that has a block."""
    newest = F.max_by(F.struct(*values), F.col(layer))
    return layers.groupBy(key).agg(newest.alias("v"), F.max(layer).alias(layer)).select(key, layer, "v.*")
