"""Embedding near-duplicates by a pivot-permutation index.

Pivots are vectors of the table, taken from a bounded sample by hash, less the sample's mean, and thinned so that no two
of them are close. Their number grows with the largest label, up to MAX_PIVOTS, and is halved until trials at the
threshold find each other. Every vector is described by its
``depth`` nearest pivots in order. Pairs that share at least ``min_shared`` of them are candidates, and their cosine
decides in double precision. In whatever order of pivots, two vectors that share so many have one in common among the
first ``depth - min_shared + 1`` of each: the inverted lists, one for each label and pivot, hold a vector under its
rarest pivots alone, and a pair is counted in the list of the rarest pivot that it shares. Lists of more than BLOCK
vectors are split into pairs of blocks. Equal vectors of a label are one class and are counted by number.

Lengths with fewer pivots ask for as many shared ones as they have; vectors of a length that the sample lacks are all in
one list of their label and length, and are all compared, in blocks.

Defined results: a vector that is null, zero, or holds null or non-finite components, or whose label is null, links
with nothing: no links, its own id as component, kept. Vectors of different length never link. Equal rows (also of
equal id) are links of each other; an empty table gives an empty result. Columns beside key, vector and label are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, need, tune
from cairn.llm.groups import block_pairs, bounds, by_group, components, least_reachable

BLOCK = 512
APART = 0.9  # pivots of a cosine beyond this are too close
MIN_PIVOTS, MAX_PIVOTS = 256, 4096
PER_PIVOT = 8  # vectors of the largest label for each pivot, between those bounds
SAMPLE = 2  # vectors in the sample for each pivot wanted
DEPTH = 8
MIN_SHARED = 2
WANTED = 0.98  # of the trials have to be found
TRIALS = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def thin(sample: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean, and up to ``most`` directions from it, each of which is apart from those before."""
    x = unit(sample)
    mean = x.mean(0)
    away = x - mean
    size = np.sqrt((away * away).sum(axis=1))
    away = away[size > 1e-9] / size[size > 1e-9, None]
    chosen = np.zeros((min(most, len(away)), x.shape[1]))
    n = 0
    for v in away:
        if n == most:
            break
        if not n or (chosen[:n] @ v).max() < APART:
            chosen[n] = v
            n += 1
    return mean, chosen[:n]


def nearest(vectors: np.ndarray, mean: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, the nearest first."""
    out = np.zeros((len(vectors), min(depth, len(pivots))), np.int32)
    for lo in range(0, len(vectors), 512):
        out[lo : lo + 512] = np.argsort(-((unit(vectors[lo : lo + 512]) - mean) @ pivots.T), axis=1, kind="stable")[:, :depth]
    return out


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of a shares with the same row of b."""
    return (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))


def tried(sample: np.ndarray, mean: np.ndarray, pivots: np.ndarray, depth: int, min_shared: int, threshold: float) -> np.ndarray:
    """As many of the pivots as let vectors at the threshold find each other: those of the sample that link, and made ones
    at just that cosine from one of the sample. The fewer there are, the more of them are shared. Where vectors lie so
    close together that nearly all link, some ten pivots are left, and the lists hold nearly all."""
    rng = np.random.default_rng(7)
    x = unit(sample[:TRIALS])
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    made = threshold * x + np.sqrt(1 - threshold**2) * noise / np.maximum(size, 1e-12)
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    some = rng.permutation(len(i))[: 4 * TRIALS]
    while len(pivots) > depth:
        own = nearest(x, mean, pivots, depth)
        found = [(shared_pivots(own, nearest(made, mean, pivots, depth)) >= min_shared).mean()] if x.shape[1] > 1 else []
        if len(some):
            found.append((shared_pivots(own[i[some]], own[j[some]]) >= min_shared).mean())
        if min(found, default=1) >= WANTED:
            break
        pivots = pivots[: len(pivots) // 2]
    return pivots


def matrices(column: pa.Array):
    """Rows of each length, and their vectors."""
    flat, at = column.flatten().to_numpy().astype(np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(at)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        yield int(length), rows, flat[at[rows][:, None] + np.arange(length)]


_TASK = ["space", "pivot", "block_i", "block_j"]


def _lists(table: pa.Table, kind: type, threshold: float, least_shared: dict[int, int]):
    at = bounds(table, _TASK)
    ids, times, side, pivot = (table.column(c).to_numpy() for c in ("id", "times", "side", "pivot"))
    apart = table.column("block_i").to_numpy() != table.column("block_j").to_numpy()
    raw, orders = table.column("vector").to_pylist(), table.column("pivots").to_pylist()
    out: list[tuple] = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo < 2:
            continue
        near = np.array(orders[lo:hi])
        x = unit(np.stack([np.frombuffer(b, kind) for b in raw[lo:hi]]).astype(np.float64))
        names, local = np.unique(near, return_inverse=True)
        has = np.zeros((hi - lo, len(names)), np.float32)
        has[np.arange(hi - lo)[:, None], local.reshape(near.shape)] = 1
        smaller = has[:, names < pivot[lo]]
        pairs = np.triu((has @ has.T >= least_shared.get(x.shape[1], 1)) & (smaller @ smaller.T == 0), 1)
        if apart[lo]:
            pairs &= side[lo:hi][:, None] != side[lo:hi][None, :]
        i, j = np.nonzero(pairs)
        for a in range(0, len(i), 1 << 14):  # a bounded number of candidates at a time
            b = slice(a, a + (1 << 14))
            pairs[i[b], j[b]] = np.einsum("ij,ij->i", x[i[b]], x[j[b]]) >= threshold
        i, j = np.nonzero(pairs)
        if not len(i):
            continue
        own = times[lo:hi]
        links = np.bincount(i, own[j], hi - lo) + np.bincount(j, own[i], hi - lo)
        label = least_reachable(hi - lo, i, j)
        least = np.full(hi - lo, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids[lo:hi])
        some = np.flatnonzero(links)
        out.append((ids[lo:hi][some], least[label[some]], links[some].astype(np.int64)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "root", "links"])


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, depth: int = DEPTH, min_shared: int = MIN_SHARED) -> DataFrame:
    """id, n_links and component of every row."""
    need(vectors, key, vector, label)
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "vectors")
    kind = np.float32 if dict(vectors.select(vectors[vector].alias("x")).dtypes)["x"] == "array<float>" else np.float64
    v = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("vector"), vectors[label].cast("string").alias("label"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda c: c != 0)
    v = v.select("id", F.when(usable, F.col("vector")).alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("label", F.size("vector")).alias("space"), F.xxhash64("label", "vector").alias("hash_a"), F.xxhash64("vector", F.lit(3), "label").alias("hash_b"))
    good = v.where("usable")
    classes = good.groupBy("space", "hash_a", "hash_b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"), F.any_value("vector").alias("vector"))
    classes = scratch.table(classes.select("space", "hash_a", "hash_b", "least", "times", F.col("vector").cast("array<float>" if kind is np.float32 else "array<double>").alias("vector")), "classes")
    largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << (largest // PER_PIVOT).bit_length()))
    sample = classes.orderBy(F.xxhash64("hash_a", F.lit(11)), "hash_b").limit(SAMPLE * pivots).select("vector").toArrow()  # bounded
    found = matrices(sample.column("vector").combine_chunks()) if sample.num_rows else ()
    spaces = {}
    for length, _, x in found:
        mean, own = thin(x, pivots)
        spaces[length] = mean, tried(x, mean, own, depth, min_shared, threshold)
    shared = spark.sparkContext.broadcast(spaces)

    def describe(batches):
        for batch in batches:
            column = batch.column(3)
            orders, raw, lengths = [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            for length, rows, x in matrices(column):
                mean, own = shared.value.get(length, (None, ()))
                near = nearest(x, mean, own, depth) if len(own) else np.zeros((len(rows), 1), np.int32)
                lengths[rows] = length
                for i, order, body in zip(rows.tolist(), near, x.astype(kind)):
                    orders[i], raw[i] = order, body.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths), pa.array(orders, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["space", "id", "times", "length", "pivots", "vector"])

    told = classes.select("space", F.col("least").alias("id"), "times", "vector").mapInArrow(describe, "space bigint, id bigint, times bigint, length int, pivots array<int>, vector binary")
    told = scratch.table(told, "described")
    # pivots in order of rarity: a row for each pivot of the sample's lengths, and one for each other length
    rarity = told.select("length", F.explode("pivots").alias("pivot")).groupBy("length", "pivot").count()
    rarity = rarity.where(F.col("length").isin(list(spaces))).collect()
    ranks = {length: np.zeros(max(1, len(own)), np.int64) for length, (_, own) in spaces.items()}
    for place, r in enumerate(sorted(rarity, key=lambda r: (r["count"], r["pivot"]))):
        ranks[r["length"]][r["pivot"]] = place
    least_shared = {length: min(min_shared, max(1, len(own))) for length, (_, own) in spaces.items()}
    order_of = spark.sparkContext.broadcast(ranks)

    def ranked(batches):
        """Pivots as their places in order of rarity, the rarest first, and under how many of them a vector is held."""
        for batch in batches:
            pivots_, lengths = batch.column(4), batch.column(3).to_numpy()
            at = np.asarray(pivots_.offsets) - pivots_.offsets[0].as_py()
            flat, owner = pivots_.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), np.diff(at))
            for length in np.unique(lengths):
                if length in order_of.value:
                    which = lengths[owner] == length
                    flat[which] = order_of.value[length][flat[which]]
            flat = flat[np.lexsort((flat, owner))]
            asked = np.array([least_shared.get(int(n), 1) for n in lengths], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1, 2)] + [lists, pa.array((np.diff(at) - asked + 1).astype(np.int32)), batch.column(5)], ["space", "id", "times", "pivots", "held", "vector"])

    held = scratch.table(told.mapInArrow(ranked, "space bigint, id bigint, times bigint, pivots array<bigint>, held int, vector binary"), "ranked")
    scratch.drop("described")
    postings = held.select("space", "id", "times", "pivots", "vector", F.explode(F.slice("pivots", F.lit(1), F.col("held"))).alias("pivot"))
    tasks = block_pairs(postings, ["space", "pivot"], "id", BLOCK, scratch, "lists")
    found = scratch.table(by_group(tasks, _TASK, lambda t: _lists(t, kind, threshold, least_shared), "id bigint, root bigint, links bigint", few=2048), "found")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch).select(F.col("id").alias("least"), "component")
    counted = found.groupBy(F.col("id").alias("least")).agg(F.sum("links").alias("links"))
    out = (
        v.join(classes.select("space", "hash_a", "hash_b", "least", "times"), (v["usable"]) & (v["space"] == classes["space"]) & (v["hash_a"] == classes["hash_a"]) & (v["hash_b"] == classes["hash_b"]), "left")
        .select("id", "least", "times")
        .join(counted, "least", "left")
        .join(joined, "least", "left")
    )
    component = F.coalesce("component", "least", "id")
    return out.select(F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
