"""Forests given by a parent column: chains, closures, descendants.

Chains are followed by pointer doubling: after k rounds every row has gone up 2**k parents, so that the deepest chain
allowed (128) takes eight joins of the table with itself, whatever the number of chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.lineage import settle

MAX_DEPTH = 128


def tops(nodes: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For each node: top (the last known ancestor, or itself), depth (known parents up to it), missing (the top names a
    parent that isn't there) and deep (the chain goes on beyond max_depth, as one with a cycle does)."""
    known = nodes.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    there = known.select(F.col("id").alias("up"))
    at = settle(known.join(there, F.col("parent") == F.col("up"), "left").select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), (F.col("parent").isNotNull() & F.col("up").isNull()).alias("missing")))
    reach = 1
    while reach <= max_depth:
        above = at.select(F.col("id").alias("a"), F.col("top").alias("a_top"), F.col("depth").alias("a_depth"), F.col("missing").alias("a_missing"))
        at = settle(at.join(above, F.col("top") == F.col("a")).select("id", F.col("a_top").alias("top"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_missing").alias("missing")))
        reach *= 2
        if at.where(F.col("depth") >= reach).isEmpty():  # all have come to their top in fewer steps
            break
    return at.withColumn("deep", F.col("depth") > max_depth)


def jumps(nodes: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH):
    """(reach, ups) for reach 1, 2, 4 ...: ups has id and up, the ancestor that lies reach parents above, for all nodes
    that have one. One row a node and round, whatever the depth."""
    known = nodes.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    ups = settle(known.join(known.select(F.col("id").alias("up")), F.col("parent") == F.col("up")).select("id", "up"))
    reach = 1
    while reach <= max_depth and not ups.isEmpty():
        yield reach, ups
        above = ups.select(F.col("id").alias("up"), F.col("up").alias("far"))
        ups, reach = settle(ups.join(above, "up").select("id", F.col("far").alias("up"))), 2 * reach


def above(nodes: DataFrame, starts: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id of the starts (a column named like the key) and of all their ancestors, each once. The climb begins at the
    starts, and doubles its reach: no pairs are made."""
    found = settle(starts.select(F.col(key).alias("id")).distinct())
    for _, ups in jumps(nodes, key, parent, max_depth):
        found = settle(found.union(found.join(ups, "id").select(F.col("up").alias("id"))).distinct())
    return found


def folded(nodes: DataFrame, key: str, parent: str, values: dict, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For each node, values folded over the node and all its ancestors. values: name -> (column of the node, function of
    two columns, which may meet a value twice at no harm or never does so, as the ranges that are folded don't overlap)."""
    at = settle(nodes.select(F.col(key).alias("id"), *(v.alias(n) for n, (v, _) in values.items())))
    for _, ups in jumps(nodes, key, parent, max_depth):
        upper = at.select(F.col("id").alias("up"), *(F.col(n).alias(f"up_{n}") for n in values))
        met = at.join(ups, "id", "left").join(upper, "up", "left")
        at = settle(met.select("id", *(F.when(F.col("up").isNull(), F.col(n)).otherwise(f(F.col(n), F.col(f"up_{n}"))).alias(n) for n, (_, f) in values.items())))
    return at


def heights(nodes: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id and height of each node above the deepest one below it. A height within reach r and the heights of the nodes
    that lie r below make the height within 2 r."""
    at = settle(nodes.select(F.col(key).alias("id"), F.lit(0).alias("height")))
    for reach, ups in jumps(nodes, key, parent, max_depth):
        below = at.join(ups, "id").groupBy(F.col("up").alias("id")).agg((F.max("height") + reach).alias("far"))
        at = settle(at.join(below, "id", "left").select("id", F.greatest("height", "far").alias("height")))
    return at


def ancestors(nodes: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All pairs (id, ancestor, distance), distance 0 for the node itself. Missing parents end a chain."""
    known = nodes.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    there = known.select(F.col("id").alias("ancestor"))
    edges = known.join(there, F.col("parent") == F.col("ancestor")).select("id", "ancestor", F.lit(1).alias("distance"))
    pairs = settle(known.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).union(edges))
    reach = 1
    while reach < max_depth:
        far = pairs.where(F.col("distance") == reach).select("id", F.col("ancestor").alias("mid"))
        if far.isEmpty():
            break
        on = pairs.where("distance > 0").select(F.col("id").alias("mid"), "ancestor", (F.col("distance") + reach).alias("distance"))
        pairs = settle(pairs.union(far.join(on, "mid").select("id", "ancestor", "distance")))
        reach *= 2
    return pairs


def gathered(nodes: DataFrame, key: str, parent: str, sums: dict, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For each node, sums over the node and all below it. sums: name -> column of the node. Each round adds what the nodes
    that lie reach below have gathered."""
    at = settle(nodes.select(F.col(key).alias("id"), *(v.alias(n) for n, v in sums.items())))
    for _, ups in jumps(nodes, key, parent, max_depth):
        below = at.join(ups, "id").groupBy(F.col("up").alias("id")).agg(*(F.sum(n).alias(f"below_{n}") for n in sums))
        at = settle(at.join(below, "id", "left").select("id", *((F.col(n) + F.coalesce(f"below_{n}", F.lit(0))).alias(n) for n in sums)))
    return at


def descendants(nodes: DataFrame, starts: DataFrame, key: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Everything below the starts (a column named like the key), with its depth below the nearest start: level by level,
    so that a small subtree doesn't cost the closure of the whole forest."""
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("up"), F.col(key).alias("down"))
    front = settle(starts.select(F.col(key).alias("id"), F.lit(0).alias("depth")).distinct())
    found = front
    for depth in range(1, max_depth + 1):
        front = settle(front.join(edges, F.col("id") == F.col("up")).select(F.col("down").alias("id"), F.lit(depth).alias("depth")).distinct().join(found.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def paths(nodes: DataFrame, key: str, parent: str, name: str, max_depth: int = 64) -> DataFrame:
    """Names from the root to each node."""
    pairs = ancestors(nodes, key, parent, max_depth)
    named = nodes.select(F.col(key).alias("ancestor"), F.col(name).alias("name"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("distance"), F.col("name"))), asc=False)
    return pairs.join(named, "ancestor").groupBy("id").agg(F.transform(parts, lambda p: p["name"]).alias("path"), F.max("distance").alias("depth"))
