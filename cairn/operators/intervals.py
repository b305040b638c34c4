"""Half-open ranges [low, high) of owners."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list, starts_new) -> DataFrame:
    """Numbers runs of neighbouring rows: a run begins where starts_new holds. Adds island."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", F.when(starts_new, 1).otherwise(0)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merged(ranges: DataFrame, by: list[str], low: str = "low", high: str = "high", touching_only: bool = False) -> DataFrame:
    """Joined ranges. touching_only: just those that begin where the one before ends, for ranges that don't overlap."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.lag(high).over(w) if touching_only else F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__reach", reach)
    new = F.col("__reach").isNull() | ((F.col("__reach") != F.col(low)) if touching_only else (F.col("__reach") < F.col(low)))
    return islands(marked, by, [low, high], new).groupBy(*by, "island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("island")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], width: int, a_low="low", a_high="high", b_low="b_low", b_high="b_high") -> DataFrame:
    """Pairs of ranges of one owner that overlap. Ranges are cut at multiples of ``width`` and meet by equality of the
    piece, so that the join is hashed; a pair counts in the piece where the later one begins, and so once."""
    cut = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    left = a.where(F.col(a_low) < F.col(a_high)).withColumn("__cut", cut(a_low, a_high))
    right = b.where(F.col(b_low) < F.col(b_high)).withColumn("__cut", cut(b_low, b_high))
    both = left.join(right, [*by, "__cut"]).where((F.col(a_low) < F.col(b_high)) & (F.col(b_low) < F.col(a_high)))
    return both.where(F.col("__cut") == F.floor(F.greatest(F.col(a_low), F.col(b_low)) / width)).drop("__cut")


def subtracted(ranges: DataFrame, holes: DataFrame, by: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """What is left of an owner's joined ranges without its holes: a sweep over the ends of both."""
    ends = lambda df, kind: df.select(*by, F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(s if kind == "range" else 0).alias("r"), F.lit(s if kind == "hole" else 0).alias("h")) for c, s in ((low, 1), (high, -1))))).alias("e")).select(*by, "e.*")
    steps = ends(ranges, "range").unionByName(ends(holes, "hole")).groupBy(*by, "at").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    w = Window.partitionBy(*by).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = steps.select(*by, F.col("at").alias(low), F.lead("at").over(w).alias(high), ((F.sum("r").over(upto) > 0) & (F.sum("h").over(upto) == 0)).alias("in"))
    return merged(spans.where(F.col("in") & F.col(high).isNotNull()).select(*by, low, high), by, low, high, touching_only=True)


def clipped(ranges: DataFrame, first, end, low: str = "low", high: str = "high") -> DataFrame:
    cut = ranges.withColumns({low: F.greatest(F.col(low), F.lit(first)), high: F.least(F.col(high), F.lit(end))})
    return cut.where(F.col(low) < F.col(high))


def gaps(ranges: DataFrame, by: list[str], end, least: int, low: str = "low", high: str = "high") -> DataFrame:
    """Gaps larger than ``least`` between an owner's ranges and behind the last."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.coalesce(F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = ranges.select(*by, reach.alias("g_low"), F.col(low).alias("g_high"))
    last = ranges.groupBy(*by).agg(F.max(high).alias("g_low")).select(*by, "g_low", F.lit(end).cast("long").alias("g_high"))
    return inner.unionByName(last).where(F.col("g_high") - F.col("g_low") > least).select(*by, F.col("g_low").alias(low), F.col("g_high").alias(high))


def rooms(spans: list[list[int]]) -> tuple[int, list[int]]:
    """The lengths of ranges as leaves of a tree of maxima: its number of leaves and the tree, with the root at 1."""
    leaves = 1 << max(0, len(spans) - 1).bit_length()
    tree = [-1] * leaves + [high - low for low, high in spans] + [-1] * (leaves - len(spans))
    for i in range(leaves - 1, 0, -1):
        tree[i] = max(tree[2 * i], tree[2 * i + 1])
    return leaves, tree


def first_fit(requests: DataFrame, free: DataFrame, by: str, total: int | None = None) -> DataFrame:
    """Gives each request of an owner the beginning of the first free range that is long enough, or -1. The free room
    after one request decides the next, so that an owner's requests are taken one after the other. Owners run side by
    side: each partition is a stream of owners, with an owner's free ranges before its requests. A tree of maxima over
    the free ranges finds the first one, so that a large owner's requests don't each pass all of its ranges.

    total: the clusters of an owner's volume. The first and the last one are then never given away, and max(64, 1 %) of
    the clusters stay free: a request that would leave less gets -1, and smaller ones behind it are still placed."""
    rows = free.select(by, F.lit(0).alias("kind"), F.col("low").alias("a"), F.col("high").alias("b")).unionByName(requests.select(by, F.lit(1).alias("kind"), F.col("request").alias("a"), F.col("clusters").alias("b")))
    reserve = 0 if total is None else max(64, total // 100)

    def place(batches):
        owner, spans, tree = None, [], None
        for batch in batches:
            out = []
            for o, kind, a, b in zip(batch[by], batch["kind"], batch["a"], batch["b"]):
                if o != owner:
                    owner, spans, tree = o, [], None
                if kind == 0:
                    low, high = (a, b) if total is None else (max(a, 1), min(b, total - 1))
                    if low < high:
                        spans.append([low, high])
                    continue
                if tree is None:
                    leaves, tree = rooms(spans)
                    left = sum(high - low for low, high in spans) - reserve
                if b > left or b > tree[1]:
                    out.append((o, a, -1))
                    continue
                i = 1
                while i < leaves:
                    i = 2 * i + (tree[2 * i] < b)
                at = spans[i - leaves]
                out.append((o, a, at[0]))
                at[0], left, tree[i] = at[0] + b, left - b, tree[i] - b
                while i > 1:
                    i //= 2
                    tree[i] = max(tree[2 * i], tree[2 * i + 1])
            yield pd.DataFrame(out, columns=[by, "request", "placed"])

    kind = dict(requests.dtypes)[by]
    return rows.repartition(by).sortWithinPartitions(by, "kind", "a").mapInPandas(place, f"{by} {kind}, request bigint, placed bigint")
