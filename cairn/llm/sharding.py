"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The rows are written once with the partition that holds them, so that a lost executor can't change the draw.
2. How many rows go from each partition to each shard is drawn from the multivariate hypergeometric law: the matrix
   has one row per partition and one column per shard, and its column sums are the shard sizes, at most one apart.
3. Each partition permutes its rows and deals them out by its row of the matrix.
4. Each shard permutes what it got. Its rows are ordered by a random key; the key's upper part splits a shard over
   many tasks, whose counts summed up give the first place of each.

Defined results: a null text has size 0 plus the overhead and the checksum of nothing; repeated rows are dealt like
others; an empty table gives an empty result. Rows follow neither their id nor their text, so hot groups spread evenly.
Columns of the input beside key and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, need

MATRIX_BROADCAST_PARTITIONS = 50_000


def communication_matrix(held: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; row sums are ``held``, column sums differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(held.sum())
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(held), shards), dtype=np.int64)
    for k, n in enumerate(held):
        left_rows, left_room = int(n), int(room.sum())
        for s in range(shards):  # one hypergeometric draw for each shard, given those before
            left_room -= int(room[s])
            if left_rows == 0:
                break
            drawn = left_rows if left_room == 0 else int(_hypergeometric(rng, int(room[s]), left_room, left_rows))
            matrix[k, s] = drawn
            left_rows -= drawn
        room -= matrix[k]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good and bad ones are good. numpy's draw needs populations under 10**9; above that
    the law's own probabilities are summed up, from the most likely number outwards."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    total = good + bad
    spread = int(np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 1
    k = np.arange(max(low, mode - 40 * spread), min(high, mode + 40 * spread) + 1)  # what lies beyond is under 1e-300
    to = k[:-1].astype(float)  # from each number to the next
    steps = np.log(good - to) + np.log(n - to) - np.log(to + 1) - np.log(bad - n + to + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(upto, rng.random() * upto[-1], "right")])


def shard(rows: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, overhead: int = 8, seed: int = 20240611, rows_per_task: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    need(rows, key, text)
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "shard")
    body = F.coalesce(rows[text], F.lit("")).cast("binary")
    held = scratch.table(
        rows.select(rows[key].alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "held",
    )
    parts = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())  # one row per partition
    matrix = communication_matrix(np.array([n for _, n in parts], dtype=np.int64), shards, seed)
    ends = spark.createDataFrame([(p, row.tolist()) for (p, _), row in zip(parts, matrix.cumsum(axis=1))], "part int, ends array<long>")
    if len(parts) <= MATRIX_BROADCAST_PARTITIONS:
        ends = F.broadcast(ends)
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "place"), "place")
    dealt = (
        held.withColumn("nth", F.row_number().over(local) - 1)
        .join(ends, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "place"))
    )
    total = int(sum(n for _, n in parts))
    splits = max(1, -(-total // (shards * rows_per_task)))
    # the key's upper 31 bits, scaled to the number of splits, so that splits follow the key's order
    dealt = scratch.table(
        dealt.select("doc_id", "size", "text_crc32", "shard", "order", "place", (F.shiftright(F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(2**63))), 33) * splits, 31)).cast("int").alias("split")),
        "dealt",
    )
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "split").count().select("shard", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "split").orderBy("order", "place")
    return (
        dealt.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "split"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("start") + F.col("nth")).cast("long").alias("slot"))
    )
