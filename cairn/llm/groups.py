"""Streams of groups, and connected components, for operators that work within groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, lean, new_names


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, few: int = 4096, then: tuple[str, ...] = ()) -> DataFrame:
    """Calls work with all rows of as many whole groups as come together, in the order of their keys (64-bit numbers).
    One call has many small groups, so that small groups don't pay for a call each. Partitions are streamed.
    then: columns that order the rows of a group."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy() for k in keys])
            changed = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held:
                end = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
                if tuple(end) != tuple(key[0].tolist()):
                    changed = np.concatenate([[0], changed])
            if rows + batch.num_rows >= few and len(changed):
                cut = int(changed[-1])
                held.append(batch.slice(0, cut))
                yield from work(pa.Table.from_batches([b for b in held if b.num_rows] or held[:1]))
                held, rows = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(lean(run), schema)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a table begins, and its end."""
    key = np.column_stack([table.column(k).to_numpy() for k in keys])
    return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])


SIEVE_BITS = 26


def sieve(keys: DataFrame, columns: list[str], scratch: Scratch, name: str) -> Callable[..., DataFrame]:
    """A function that adds to a frame whether keys may have the values of some columns: false for certain, or true. It
    saves a join from dealing rows out that have no partner. Behind it is a bitmap of fixed size, broadcast as a table of
    at most 2**20 words of 64 bits, whatever the input; where it is full everything passes, so that only speed depends
    on it. No Python is run on the rows."""
    place = lambda columns_: F.shiftrightunsigned(F.xxhash64(*columns_), 64 - SIEVE_BITS)
    places = keys.select(place(columns).alias("place"))
    words = places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    words = scratch.table(words, name)

    def mark(df: DataFrame, flag: str, *own: str) -> DataFrame:
        at, word, bits = new_names(df, "place", "word", "bits")
        met = df.withColumn(at, place(own)).join(F.broadcast(words.toDF(word, bits)), F.shiftrightunsigned(at, 6) == F.col(word), "left")
        held = F.expr(f"shiftrightunsigned({bits}, cast({at} & 63 as int)) & 1") == 1
        return met.withColumn(flag, F.coalesce(held, F.lit(False))).drop(at, word, bits)

    return mark


def least_reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..count-1 with edges a-b: the smallest node that each reaches. Roots hang on the least root beside them,
    so that a long chain takes few rounds."""
    label = np.arange(count)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if not (apart := low < high).any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while ((up := label[label]) != label).any():
            label = up


def block_pairs(members: DataFrame, group: list[str], item: str, block: int, scratch: Scratch, name: str) -> DataFrame:
    """Splits groups of more than ``block`` members: members get a block by hash, and each pair of blocks of a group is a
    task of its own, to which the members of both go. Adds block_i, block_j and side (0: of block_i, 1: of block_j)."""
    sizes = scratch.table(members.groupBy(*group).agg(F.count(F.lit(1)).alias("members")), f"{name}_sizes")
    large = sizes.where(F.col("members") > block).select(*group, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    large = scratch.table(large, f"{name}_large")
    placed = members.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"block_i": F.least("own", "other").cast("long"), "block_j": F.greatest("own", "other").cast("long"), "side": F.when(F.col("own") > F.col("other"), 1).otherwise(0)}).drop("blocks", "own", "other")


#: Edges that one task takes at once (16 MB).
AT_ONCE = 1 << 20


def _least(batches):
    """id and component of all edges that come, for each node but a component's least."""
    if not (held := [b for b in batches if b.num_rows]):
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    least = nodes[least_reachable(len(nodes), at[: len(u)], at[len(u) :])]
    moved = least != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], ["id", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of each node of edges(a, b) but the smallest itself. Up to AT_ONCE
    edges are one task; more are contracted by alternating large and small stars, each step a written table. Nothing but
    a count and a checksum comes to the driver."""
    stars = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    check = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last, step = check(stars), 0
    if last[0] <= AT_ONCE:
        return scratch.table(stars.coalesce(1).mapInArrow(lean(_least), "id bigint, component bigint"), name)
    while last[0]:
        step += 1
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).union(stars.select("v", "u"))
        # written, so that Spark can split the rows of a large star's centre in the join
        least = scratch.table(both.groupBy("x").agg(F.min("y").alias("m")), f"{name}_{step}_least")
        large = scratch.table(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct(), f"{name}_{step}_large")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_{step}_lower")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        stars = scratch.table(small, f"{name}_{step}")
        now = check(stars)
        if now == last:
            break
        last = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
