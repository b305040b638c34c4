"""Ranges (i) and the joins by range (j)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import intervals as ops
from cairn.plans.catalog import query

#: Disjoint ranges: joined ones, cut at multiples of 50.
JOINED = """WITH m AS (SELECT owner, low, high, max(high) OVER (PARTITION BY owner ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < low THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
j AS (SELECT owner, min(low) AS low, max(high) AS high FROM g GROUP BY owner, island) """


@query(JOINED + "SELECT owner, low, high FROM j", "ranges")
def i1_merged(ranges):
    return ops.merged(ranges, ["owner"])


@query(JOINED + """, h AS (SELECT owner, low + 5 AS low, low + 15 AS high FROM ranges WHERE low % 3 = 0),
p AS (SELECT owner, low AS x FROM j UNION SELECT owner, high FROM j UNION SELECT owner, low FROM h UNION SELECT owner, high FROM h),
s AS (SELECT owner, x AS low, lead(x) OVER (PARTITION BY owner ORDER BY x) AS high FROM p),
k AS (SELECT s.* FROM s WHERE high IS NOT NULL AND EXISTS (SELECT 1 FROM j WHERE j.owner = s.owner AND j.low <= s.low AND j.high >= s.high) AND NOT EXISTS (SELECT 1 FROM h WHERE h.owner = s.owner AND h.low <= s.low AND h.high >= s.high)),
l AS (SELECT *, CASE WHEN lag(high) OVER (PARTITION BY owner ORDER BY low) = low THEN 0 ELSE 1 END AS fresh FROM k),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)
SELECT owner, min(low) AS low, max(high) AS high FROM r GROUP BY owner, run""", "ranges")
def i2_subtracted(ranges):
    holes = ranges.where("low % 3 = 0").select("owner", (F.col("low") + 5).alias("low"), (F.col("low") + 15).alias("high"))
    return ops.subtracted(ranges, holes, ["owner"])


@query("SELECT owner, greatest(low, 500) AS low, least(high, 3500) AS high FROM ranges WHERE greatest(low, 500) < least(high, 3500)", "ranges")
def i3_clipped(ranges):
    return ops.clipped(ranges, F.lit(500).cast("long"), F.lit(3500).cast("long"))


@query("""WITH b AS (SELECT c_custkey AS owner, k FROM customer, unnest(range(0, 32)) r(k) WHERE (((c_custkey * 2654435761) % 4294967296) >> CAST(k AS INT)) & 1 = 0),
g AS (SELECT owner, k, k - row_number() OVER (PARTITION BY owner ORDER BY k) AS run FROM b)
SELECT owner, min(k) AS low, max(k) + 1 AS high FROM g GROUP BY owner, run""", "customer")
def i4_bitmap_to_free(customer):
    """Clear bits of a bitmap as ranges."""
    word = (F.col("c_custkey") * 2_654_435_761) % 4_294_967_296
    bits = customer.select(F.col("c_custkey").alias("owner"), word.alias("word"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    clear = bits.where(F.expr("(word >> k) & 1") == 0).select("owner", F.col("k").cast("long").alias("low"), (F.col("k") + 1).cast("long").alias("high"))
    return ops.merged(clear, ["owner"], touching_only=True)


@query(JOINED + "SELECT q.owner, q.at, j.high - q.at AS used_run FROM (SELECT DISTINCT owner, (owner * 31) % 4000 AS at FROM ranges) q LEFT JOIN j ON j.owner = q.owner AND j.low <= q.at AND q.at < j.high", "ranges")
def i5_run_at(ranges):
    """How far the used range at an offset goes on, null where it is free."""
    asked = ranges.select("owner", ((F.col("owner") * 31) % 4000).alias("at")).distinct()
    used = ops.merged(ranges, ["owner"])
    points = asked.select("owner", "at", F.col("at").alias("b_low"), (F.col("at") + 1).alias("b_high"))
    found = ops.overlapping(used, points, ["owner"], 512).select("owner", "at", (F.col("high") - F.col("at")).alias("used_run"))
    return asked.join(found, ["owner", "at"], "left")


@query("SELECT owner, count(*) AS overlaps FROM (SELECT owner, low, lag(high) OVER (PARTITION BY owner ORDER BY low, high) AS before FROM ranges) x WHERE before > low GROUP BY owner", "ranges")
def i6_overlap_check(ranges):
    before = F.lag("high").over(Window.partitionBy("owner").orderBy("low", "high"))
    return ranges.withColumn("before", before).where("before > low").groupBy("owner").agg(F.count(F.lit(1)).alias("overlaps"))


@query(JOINED + "SELECT owner, count(*) = 1 AND min(low) = 0 AND max(high) >= 4000 AS covered, min(low) AS first, max(high) AS last FROM j GROUP BY owner", "ranges")
def i7_coverage(ranges):
    found = ops.merged(ranges, ["owner"]).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("first"), F.max("high").alias("last"))
    return found.select("owner", ((F.col("n") == 1) & (F.col("first") == 0) & (F.col("last") >= 4000)).alias("covered"), "first", "last")


@query("SELECT owner, CAST(sum(high - low) AS BIGINT) AS total, bool_and(before IS NULL OR before <= low) AS disjoint FROM (SELECT *, lag(high) OVER (PARTITION BY owner ORDER BY low, high) AS before FROM ranges) x GROUP BY owner", "ranges")
def i8_extent_rules(ranges):
    before = F.lag("high").over(Window.partitionBy("owner").orderBy("low", "high"))
    return ranges.withColumn("before", before).groupBy("owner").agg(F.sum(F.col("high") - F.col("low")).alias("total"), F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("low"))).alias("disjoint"))


PAIRS = "SELECT owner, l_orderkey AS k, l_linenumber AS n, low, high FROM (SELECT l_partkey AS owner, l_orderkey, l_linenumber, CAST((l_orderkey * 37 + l_linenumber * 101) % 4000 AS BIGINT) AS low, CAST((l_orderkey * 37 + l_linenumber * 101) % 4000 + l_quantity AS BIGINT) AS high FROM lineitem) x"


@query(f"WITH p AS ({PAIRS}) SELECT a.owner, count(*) AS pairs FROM p a JOIN p b ON a.owner = b.owner AND (a.low < b.low OR (a.low = b.low AND a.k * 10 + a.n < b.k * 10 + b.n)) AND a.low < b.high AND b.low < a.high GROUP BY a.owner", "lineitem")
def i9_overlapping_pairs(lineitem):
    """How many pairs of an owner's ranges overlap."""
    low = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 4000
    p = lineitem.select(F.col("l_partkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), low.cast("long").alias("low"), (low + F.col("l_quantity")).cast("long").alias("high"))
    q = p.select("owner", F.col("key").alias("b_key"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    found = ops.overlapping(p, q, ["owner"], 64).where((F.col("low") < F.col("b_low")) | ((F.col("low") == F.col("b_low")) & (F.col("key") < F.col("b_key"))))
    return found.groupBy("owner").agg(F.count(F.lit(1)).alias("pairs"))


@query(None, "ranges")
def i10_first_fit(ranges):
    """All requests of an owner placed into the gaps of its 4096 clusters, with a reserve. Each placement depends on those
    before, which SQL can't tell."""
    free = ops.gaps(ops.merged(ranges, ["owner"]), ["owner"], 4096, 0)
    nth = F.row_number().over(Window.partitionBy("owner").orderBy("low", "high"))
    wanted = ranges.withColumn("request", nth.cast("long")).select("owner", "request", ((F.col("high") - F.col("low")) * 3).alias("clusters"))
    return ops.first_fit(wanted, free, "owner", 4096)


@query("SELECT owner, low, least(high, (low // 64 + 1) * 64) AS high, 0 AS half FROM ranges UNION ALL SELECT owner, (low // 64 + 1) * 64, high, 1 FROM ranges WHERE high > (low // 64 + 1) * 64", "ranges")
def i11_split_at_boundary(ranges):
    """Ranges of at most 64 clusters cut at the next boundary. (Ranges here are shorter than two boundaries apart.)"""
    edge = F.expr("(low div 64 + 1) * 64")
    cut = F.when(F.col("high") > edge, F.array(F.struct(F.col("low").alias("low"), edge.alias("high"), F.lit(0).alias("half")), F.struct(edge.alias("low"), F.col("high").alias("high"), F.lit(1).alias("half")))).otherwise(F.array(F.struct(F.col("low").alias("low"), F.col("high").alias("high"), F.lit(0).alias("half"))))
    return ranges.select("owner", F.inline(cut))


@query("SELECT l_partkey AS owner, l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position FROM lineitem", "lineitem")
def i11_delta_to_absolute(lineitem):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return lineitem.select(F.col("l_partkey").alias("owner"), "l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("long")).over(w).alias("position"))


@query("""WITH n AS (SELECT owner, low, high, row_number() OVER (PARTITION BY owner ORDER BY low, high) AS k FROM ranges)
SELECT 'length' AS rule, count(*) AS violations FROM ranges WHERE high <= low UNION ALL SELECT 'bounds', count(*) FROM ranges WHERE low < 0 OR high > 4030
UNION ALL SELECT 'overlap', count(*) FROM n a JOIN n b ON b.owner = a.owner AND b.k = a.k + 1 AND b.low < a.high
UNION ALL SELECT 'coverage', count(*) FROM (SELECT owner FROM ranges GROUP BY owner HAVING sum(high - low) < 100) x""", "ranges")
def i12_plan_audit(ranges):
    """How often each rule of a plan is broken. Overlap: a range begins before the one that comes before it ends."""
    before = F.lag("high").over(Window.partitionBy("owner").orderBy("low", "high"))
    checks = {"length": F.col("high") <= F.col("low"), "bounds": (F.col("low") < 0) | (F.col("high") > 4030), "overlap": F.coalesce(F.col("before") > F.col("low"), F.lit(False))}
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), bad.alias("bad")) for name, bad in checks.items())))
    each = ranges.withColumn("before", before).select(rules.alias("r")).groupBy("r.rule").agg(F.count_if("r.bad").alias("violations"))
    short = ranges.groupBy("owner").agg(F.sum(F.col("high") - F.col("low")).alias("n")).agg(F.count_if(F.col("n") < 100).alias("violations")).select(F.lit("coverage").alias("rule"), "violations")
    return each.unionByName(short)


@query("""WITH r AS (SELECT owner, low, high, coalesce(max(high) OVER (PARTITION BY owner ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM ranges)
SELECT owner, reach AS low, low AS high FROM r WHERE low - reach > 128 UNION ALL SELECT owner, max(high), 5000 FROM ranges GROUP BY owner HAVING 5000 - max(high) > 128""", "ranges")
def i13_gaps(ranges):
    return ops.gaps(ranges, ["owner"], 5000, 128)


@query("""WITH n AS (SELECT owner, low, high, row_number() OVER (PARTITION BY owner ORDER BY low, high) AS k FROM ranges),
o AS (SELECT b.owner, count(*) AS collisions FROM n a JOIN n b ON b.owner = a.owner AND b.k = a.k + 1 WHERE b.low < a.high GROUP BY b.owner),
t AS (SELECT owner, bool_and(low < high) AS non_empty, min(low) >= 0 AND max(high) <= 4030 AS inside, count(*) - count(DISTINCT low) AS repeated_starts FROM ranges GROUP BY owner)
SELECT t.owner, non_empty, inside, repeated_starts, coalesce(collisions, 0) AS collisions, non_empty AND inside AND repeated_starts = 0 AND collisions IS NULL AS valid FROM t LEFT JOIN o ON o.owner = t.owner""", "ranges")
def i14_final_layout(ranges):
    """A layout is valid if no range is empty, all lie in the usable room, no start repeats and none begins before the one
    that comes before it ends."""
    before = F.lag("high").over(Window.partitionBy("owner").orderBy("low", "high"))
    found = ranges.withColumn("over", F.coalesce(before > F.col("low"), F.lit(False))).groupBy("owner").agg(
        F.bool_and(F.col("low") < F.col("high")).alias("non_empty"), ((F.min("low") >= 0) & (F.max("high") <= 4030)).alias("inside"), (F.count(F.lit(1)) - F.countDistinct("low")).alias("repeated_starts"), F.count_if("over").alias("collisions"))
    return found.withColumn("valid", F.col("non_empty") & F.col("inside") & (F.col("repeated_starts") == 0) & (F.col("collisions") == 0))


@query("SELECT owner, low, high, coalesce(lead(low) OVER (PARTITION BY owner ORDER BY low), 5000) // 8 * 8 AS limit_at FROM (SELECT owner, low, max(high) AS high FROM ranges GROUP BY owner, low) x", "ranges")
def i15_clip_to_next(ranges):
    """Up to where a segment may grow: the next reserved start, aligned down to a sector of eight."""
    starts = ranges.groupBy("owner", "low").agg(F.max("high").alias("high"))
    following = F.coalesce(F.lead("low").over(Window.partitionBy("owner").orderBy("low")), F.lit(5000).cast("long"))
    return starts.withColumn("f", following).select("owner", "low", "high", F.expr("f div 8 * 8").alias("limit_at"))


@query("SELECT owner, low, CAST(coalesce(sum(high - low) OVER (PARTITION BY owner ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS placed FROM (SELECT owner, low, max(high) AS high FROM ranges GROUP BY owner, low) x", "ranges")
def i16_sequential_placement(ranges):
    """Edits in order of their source start, each placed behind the one before."""
    starts = ranges.groupBy("owner", "low").agg(F.max("high").alias("high"))
    w = Window.partitionBy("owner").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return starts.select("owner", "low", F.coalesce(F.sum(F.col("high") - F.col("low")).over(w), F.lit(0).cast("long")).alias("placed"))


@query(JOINED + "SELECT owner, CAST(sum(high - low) AS BIGINT) AS used, CAST(5000 - sum(high - low) AS BIGINT) AS free FROM j GROUP BY owner", "ranges")
def a13_free_bytes(ranges):
    used = F.sum(F.col("high") - F.col("low"))
    return ops.merged(ranges, ["owner"]).groupBy("owner").agg(used.alias("used"), (F.lit(5000) - used).alias("free"))


@query("""WITH p AS (SELECT p_partkey AS partition_id, p_size * 40 AS low, p_size * 40 + 60 AS high, p_partkey % 20 AS disk FROM part),
e AS (SELECT DISTINCT l_suppkey AS extent, l_suppkey % 20 AS disk, CAST((l_suppkey * 17) % 2000 AS BIGINT) AS low, CAST((l_suppkey * 17) % 2000 + 30 AS BIGINT) AS high FROM lineitem)
SELECT extent, disk, min(partition_id) AS partition_id FROM (SELECT e.extent, e.disk, p.partition_id FROM e JOIN p ON p.disk = e.disk AND ((e.low >= p.low AND e.low < p.high) OR (e.low <= p.low AND e.high >= p.high))) x GROUP BY extent, disk""", "part", "lineitem")
def j7_extent_to_partition(part, lineitem):
    """The first partition in which an extent starts, or that it covers."""
    p = part.select(F.col("p_partkey").alias("partition_id"), (F.col("p_partkey") % 20).alias("disk"), (F.col("p_size") * 40).cast("long").alias("b_low"), (F.col("p_size") * 40 + 60).cast("long").alias("b_high"))
    low = (F.col("l_suppkey") * 17) % 2000
    e = lineitem.select(F.col("l_suppkey").alias("extent"), (F.col("l_suppkey") % 20).alias("disk"), low.alias("low"), (low + 30).alias("high")).distinct()
    starts = (F.col("low") >= F.col("b_low")) & (F.col("low") < F.col("b_high"))
    covers = (F.col("low") <= F.col("b_low")) & (F.col("high") >= F.col("b_high"))
    return ops.overlapping(e, p, ["disk"], 128).where(starts | covers).groupBy("extent", "disk").agg(F.min("partition_id").alias("partition_id"))


@query("""SELECT p_partkey AS partition_id FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT owner % 20 AS disk, low, high FROM ranges) r WHERE r.disk = p_partkey % 20 AND r.low < p_size * 40 + 60 AND p_size * 40 < r.high)""", "part", "ranges")
def j12_uncovered_partitions(part, ranges):
    """Partitions that no volume of any owner lies on. Of the volumes that begin at one place the longest tells."""
    p = part.select(F.col("p_partkey").alias("partition_id"), (F.col("p_partkey") % 20).alias("disk"), (F.col("p_size") * 40).cast("long").alias("b_low"), (F.col("p_size") * 40 + 60).cast("long").alias("b_high"))
    volumes = ranges.groupBy((F.col("owner") % 20).alias("disk"), "low").agg(F.max("high").alias("high"))
    return p.select("partition_id").join(ops.overlapping(volumes, p, ["disk"], 128).select("partition_id"), "partition_id", "left_anti")
