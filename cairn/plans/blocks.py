"""Blocks (b) and what is counted and joined over them (j, a, n)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import blocks as ops
from cairn.plans.catalog import query

STATES = """WITH s AS (SELECT block_index, chunk, size, CASE WHEN is_free THEN 1 WHEN is_zero THEN 2 ELSE 3 END AS state, CASE WHEN NOT is_free AND NOT is_zero THEN sha256(payload) END AS digest FROM blocks),
d AS (SELECT s.*, coalesce(CASE WHEN block_index % 9 = 0 THEN 3 - CASE WHEN state = 3 THEN 1 ELSE 0 END ELSE state END = state AND (state <> 3 OR block_index % 5 = 0), false) AS same FROM s),
w AS (SELECT d.*, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS win FROM d),
u AS (SELECT w.*, CASE WHEN state = 3 AND NOT same THEN min(CASE WHEN state = 3 AND NOT same THEN block_index END) OVER (PARTITION BY chunk, win, digest, size) END AS canonical FROM w) """


def classified(blocks):
    state = ops.classify(F.col("is_free"), F.col("is_zero"))
    return blocks.withColumn("state", state).withColumn("digest", ops.digest(F.col("state"), F.col("payload"))).select("block_index", "chunk", "size", "state", "digest")


def baseline(blocks):
    """The layer before: every ninth block had another state, and data has equal digests in every fifth block alone."""
    old = classified(blocks)
    state = F.when(F.col("block_index") % 9 == 0, 3 - F.when(F.col("state") == 3, 1).otherwise(0)).otherwise(F.col("state"))
    return old.select("block_index", state.alias("base_state"), F.when(F.col("block_index") % 5 == 0, F.col("digest")).otherwise(F.lit("other")).alias("base_digest"))


def compared(blocks):
    same = ops.unchanged(F.col("state"), F.col("digest"), F.col("base_state"), F.col("base_digest"))
    return classified(blocks).join(baseline(blocks), "block_index", "left").withColumn("same", same).drop("base_state", "base_digest")


@query("SELECT o_orderkey AS file_id, k AS block_no, k * 65536 AS offset_bytes, least(65536, CAST(floor(o_totalprice) AS BIGINT) - k * 65536) AS length FROM orders, unnest(range(0, (CAST(floor(o_totalprice) AS BIGINT) + 65535) // 65536)) r(k)", "orders")
def b1_fixed_chunks(orders):
    found = ops.chunked(orders, F.floor("o_totalprice").cast("long"), 65_536)
    return found.select(F.col("o_orderkey").alias("file_id"), "block_no", F.col("offset").alias("offset_bytes"), "length")


@query(STATES + "SELECT block_index, state FROM s", "blocks")
def b2_block_states(blocks):
    return classified(blocks).select("block_index", "state")


@query(STATES + "SELECT block_index, digest FROM s WHERE state = 3", "blocks")
def b3_digests(blocks):
    return classified(blocks).where(F.col("state") == ops.DATA).select("block_index", "digest")


@query(STATES + "SELECT chunk, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS changed, count(*) AS total FROM d GROUP BY chunk", "blocks")
def b4_changed_of_chunk(blocks):
    return compared(blocks).groupBy("chunk").agg(F.count_if(~F.col("same")).alias("changed"), F.count(F.lit(1)).alias("total"))


@query(STATES + "SELECT block_index, same FROM d", "blocks")
def j6_baseline_join(blocks):
    return compared(blocks).select("block_index", "same")


@query(STATES + "SELECT block_index, chunk, canonical, canonical < block_index AS duplicate FROM u WHERE canonical IS NOT NULL", "blocks")
def b5_windowed_dedup(blocks):
    found = ops.deduplicated(compared(blocks)).where("canonical IS NOT NULL")
    return found.select("block_index", "chunk", "canonical", (F.col("canonical") < F.col("block_index")).alias("duplicate"))


@query("SELECT doc_id AS block_index, min(doc_id) OVER (PARTITION BY sha256(text), octet_length(encode(text))) AS canonical FROM documents WHERE text IS NOT NULL", "documents")
def b5_wide_window_dedup(documents):
    """The same with one window over all blocks. The first block of each digest is found by partial minima, and joined
    back by its digest: no digest's blocks have to meet in one task."""
    d = documents.where("text IS NOT NULL").select(F.col("doc_id").alias("block_index"), F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
    first = d.groupBy("digest", "size").agg(F.min("block_index").alias("canonical"))
    return d.join(first, ["digest", "size"]).select("block_index", "canonical")


RUNS = STATES + """, r AS (SELECT s.*, CASE WHEN lag(state) OVER o IS NULL OR state = 3 OR lag(state) OVER o <> state OR lag(block_index) OVER o + 1 <> block_index THEN 1 ELSE 0 END AS fresh FROM s WINDOW o AS (PARTITION BY chunk ORDER BY block_index)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS entry FROM r) """


@query(RUNS + "SELECT chunk, CAST(entry AS BIGINT) AS entry, min(block_index) AS first_block, count(*) AS blocks, CAST(min(state) AS INT) AS state FROM e GROUP BY chunk, entry", "blocks")
def b6_run_lengths(blocks):
    found = ops.run_lengths(classified(blocks))
    return found.groupBy("chunk", "entry").agg(F.min("block_index").alias("first_block"), F.count(F.lit(1)).alias("blocks"), F.min("state").alias("state"))


@query(RUNS + "SELECT chunk, count(DISTINCT entry) AS entries, CAST(sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) AS BIGINT) AS absorbed FROM e GROUP BY chunk", "blocks")
def n3_coalesced_runs(blocks):
    found = ops.run_lengths(classified(blocks)).groupBy("chunk").agg(F.max("entry").alias("m"), F.count(F.lit(1)).alias("n"))
    return found.select("chunk", (F.col("m") + 1).alias("entries"), (F.col("n") - F.col("m") - 1).alias("absorbed"))


@query(STATES + "SELECT chunk, digest, min(block_index) AS first_block FROM s WHERE state = 3 GROUP BY chunk, digest", "blocks")
def n4_first_of_digest(blocks):
    return classified(blocks).where("state = 3").groupBy("chunk", "digest").agg(F.min("block_index").alias("first_block"))


@query("SELECT block_index, CASE WHEN size * (block_index % 7 + 4) // 10 < size THEN size * (block_index % 7 + 4) // 10 ELSE size END AS stored, size * (block_index % 7 + 4) // 10 < size AS compressed FROM blocks", "blocks")
def b7_compression_choice(blocks):
    """A compressed form is kept only if it is smaller."""
    packed = F.expr("size * (block_index % 7 + 4) div 10")
    return blocks.select("block_index", F.when(packed < F.col("size"), packed).otherwise(F.col("size")).alias("stored"), (packed < F.col("size")).alias("compressed"))


@query(STATES + """, k AS (SELECT *, sum(CASE WHEN same OR lag_same THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT d.*, coalesce(lag(same) OVER (PARTITION BY chunk ORDER BY block_index), false) AS lag_same FROM d) x)
SELECT chunk, CAST(row_number() OVER (PARTITION BY chunk ORDER BY min(block_index)) - 1 AS BIGINT) AS emitted, min(block_index) AS first_block, count(*) AS blocks FROM k WHERE NOT same GROUP BY chunk, run""", "blocks")
def b8_chunk_emission(blocks):
    """Runs of changed blocks; an unchanged one closes the run, and runs are numbered."""
    w = Window.partitionBy("chunk").orderBy("block_index")
    marked = compared(blocks).withColumn("lag_same", F.coalesce(F.lag("same").over(w), F.lit(False)))
    run = F.sum(F.when(F.col("same") | F.col("lag_same"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("run", run).where("not same").groupBy("chunk", "run").agg(F.min("block_index").alias("first_block"), F.count(F.lit(1)).alias("blocks"))
    return runs.select("chunk", (F.row_number().over(Window.partitionBy("chunk").orderBy("first_block")) - 1).cast("long").alias("emitted"), "first_block", "blocks")


@query(STATES + "SELECT u.block_index, c.digest, c.size FROM u JOIN s c ON c.block_index = u.canonical AND c.size = u.size", "blocks")
def b9_dedup_expansion(blocks):
    """What a reader gets for each block: the data of the one it refers to."""
    found = ops.deduplicated(compared(blocks)).where("canonical IS NOT NULL")
    target = classified(blocks).select(F.col("block_index").alias("canonical"), "digest", F.col("size").alias("c_size"))
    return found.drop("digest").join(target, "canonical").where("canonical <= block_index AND size = c_size").select("block_index", "digest", "size")


LAYERS = """WITH l AS (SELECT 0 AS layer, block_index, size FROM blocks UNION ALL SELECT 1, block_index, size + 1 FROM blocks WHERE block_index % 3 = 0 UNION ALL SELECT 2, block_index, size + 2 FROM blocks WHERE block_index % 4 = 0) """


def layered(blocks):
    base = blocks.select(F.lit(0).alias("layer"), "block_index", "size")
    one = blocks.where("block_index % 3 = 0").select(F.lit(1).alias("layer"), "block_index", (F.col("size") + 1).alias("size"))
    two = blocks.where("block_index % 4 = 0").select(F.lit(2).alias("layer"), "block_index", (F.col("size") + 2).alias("size"))
    return base.unionByName(one).unionByName(two)


@query(LAYERS + "SELECT block_index, max(layer) AS layer, max_by(size, layer) AS size FROM l GROUP BY block_index", "blocks")
def b10_layered_overlay(blocks):
    return ops.overlay(layered(blocks), "block_index", "layer", ["size"])


@query("""WITH l AS (SELECT block_index, chunk, CASE WHEN block_index % 4 = 0 THEN block_index % 8 = 0 ELSE is_free END AS free_now FROM blocks),
g AS (SELECT chunk, block_index, block_index - row_number() OVER (PARTITION BY chunk ORDER BY block_index) AS run FROM l WHERE free_now)
SELECT chunk, min(block_index) AS low, max(block_index) + 1 AS high FROM g GROUP BY chunk, run""", "blocks")
def b11_free_after_overlay(blocks):
    """Free ranges after a layer that rewrote every fourth block."""
    now = F.when(F.col("block_index") % 4 == 0, F.col("block_index") % 8 == 0).otherwise(F.col("is_free"))
    free = blocks.where(now).withColumn("run", F.col("block_index") - F.row_number().over(Window.partitionBy("chunk").orderBy("block_index")))
    return free.groupBy("chunk", "run").agg(F.min("block_index").alias("low"), (F.max("block_index") + 1).alias("high")).drop("run")


@query("SELECT chunk, CAST(sum(CASE WHEN length(trim(payload, ' ')) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_blocks, bool_and(is_free OR length(trim(payload, ' ')) = 0) AS all_empty FROM blocks GROUP BY chunk", "blocks")
def b12_empty_chunks(blocks):
    """Chunks that hold no byte but the filling one, which is a space in these payloads. The bytes tell, not a flag."""
    empty = F.length(F.trim("payload")) == 0
    return blocks.groupBy("chunk").agg(F.count_if(empty).alias("empty_blocks"), F.bool_and(F.col("is_free") | empty).alias("all_empty"))


@query("SELECT b.block_index, coalesce(o.size, b.size) AS size, o.size IS NOT NULL AS written FROM blocks b LEFT JOIN (SELECT block_index, size + 1 AS size FROM blocks WHERE block_index % 3 = 0) o ON o.block_index = b.block_index", "blocks")
def b13_copy_on_write(blocks):
    own = blocks.where("block_index % 3 = 0").select("block_index", (F.col("size") + 1).alias("o"))
    return blocks.join(own, "block_index", "left").select("block_index", F.coalesce("o", "size").alias("size"), F.col("o").isNotNull().alias("written"))


@query("SELECT block_index, chunk * 4096 AS low, least(chunk * 4096 + size, chunk * 4096 + 3000) AS high FROM blocks WHERE NOT is_free AND least(chunk * 4096 + size, chunk * 4096 + 3000) > chunk * 4096", "blocks")
def b14_clipped_writes(blocks):
    low = F.col("chunk") * 4096
    return blocks.where(~F.col("is_free")).select("block_index", low.alias("low"), F.least(low + F.col("size"), low + 3000).alias("high")).where("high > low")


@query("SELECT block_index, CASE WHEN block_index % 3 = 0 THEN 'scratch' WHEN block_index < 700 AND block_index % 5 <> 0 THEN 'target' ELSE 'source' END AS origin FROM blocks", "blocks")
def b15_read_priority(blocks):
    """A page is read from the scratch layer, else from the target if it lies there unprotected, else from the source."""
    i = F.col("block_index")
    return blocks.select("block_index", F.coalesce(F.when(i % 3 == 0, "scratch"), F.when((i < 700) & (i % 5 != 0), "target"), F.lit("source")).alias("origin"))


@query(STATES + "SELECT chunk, CAST(sum(CASE WHEN canonical < block_index THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN canonical < block_index THEN size ELSE 0 END) AS BIGINT) AS duplicate_bytes FROM u GROUP BY chunk", "blocks")
def a11_dedup_metrics(blocks):
    again = F.coalesce(F.col("canonical") < F.col("block_index"), F.lit(False))
    return ops.deduplicated(compared(blocks)).groupBy("chunk").agg(F.count_if(again).alias("duplicates"), F.sum(F.when(again, F.col("size")).otherwise(0)).alias("duplicate_bytes"))


@query(STATES + "SELECT CAST(sum(size) AS BIGINT) AS logical_bytes, CAST(sum(CASE WHEN state = 3 THEN size ELSE 0 END) AS BIGINT) AS stored_bytes, count(DISTINCT chunk) AS chunks FROM s", "blocks")
def a7_backup_summary(blocks):
    s = classified(blocks)
    return s.agg(F.sum("size").alias("logical_bytes"), F.sum(F.when(F.col("state") == 3, F.col("size")).otherwise(0)).alias("stored_bytes"), F.countDistinct("chunk").alias("chunks"))


@query("""WITH footer AS (SELECT doc_id // 64 AS chunk, count(*) AS entries, CAST(sum((n_chars + 511) // 512) AS BIGINT) AS total_blocks, CAST(sum(n_chars) AS BIGINT) AS total_payload FROM documents GROUP BY doc_id // 64),
scan AS (SELECT chunk, count(*) AS entries, CAST(sum(ceil(size / 512.0)) AS BIGINT) AS expected_blocks, CAST(sum(size) AS BIGINT) AS payload FROM blocks GROUP BY chunk)
SELECT scan.chunk, expected_blocks, payload, total_blocks, total_payload, scan.entries = footer.entries AND expected_blocks = total_blocks AND payload = total_payload AS reconciled FROM scan JOIN footer ON footer.chunk = scan.chunk""", "blocks", "documents")
def a12_footer_check(blocks, documents):
    """What a scan counts against what the footer says. The footer is what was noted when the text was written, in
    characters: it agrees where all of them take one byte."""
    chars = F.col("n_chars")
    footer = documents.groupBy(F.expr("doc_id div 64").alias("chunk")).agg(F.count(F.lit(1)).alias("noted"), F.sum(F.expr("(n_chars + 511) div 512")).alias("total_blocks"), F.sum(chars).alias("total_payload"))
    scan = blocks.groupBy("chunk").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.expr("(size + 511) div 512")).alias("expected_blocks"), F.sum("size").alias("payload"))
    same = (F.col("entries") == F.col("noted")) & (F.col("expected_blocks") == F.col("total_blocks")) & (F.col("payload") == F.col("total_payload"))
    return scan.join(footer, "chunk").select("chunk", "expected_blocks", "payload", "total_blocks", "total_payload", same.alias("reconciled"))


@query("SELECT CAST(sum(CASE WHEN is_free THEN 0 ELSE size END) AS BIGINT) AS restored, CAST(sum(CASE WHEN is_free THEN 0 ELSE least(size, 3000) END) AS BIGINT) AS written, CAST(sum(CASE WHEN is_free THEN size ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN is_free THEN 1 ELSE 0 END) AS BIGINT) AS free_blocks FROM blocks", "blocks")
def a9_restore_totals(blocks):
    free, size = F.col("is_free"), F.col("size")
    return blocks.agg(F.sum(F.when(free, 0).otherwise(size)).alias("restored"), F.sum(F.when(free, 0).otherwise(F.least(size, F.lit(3000)))).alias("written"), F.sum(F.when(free, size).otherwise(0)).alias("skipped"), F.count_if(free).alias("free_blocks"))


@query("""SELECT a.block_index AS base_block, b.block_index AS over_block, greatest(a.block_index * 10, b.block_index * 10 + 3) AS low, least(a.block_index * 10 + 10, b.block_index * 10 + 13) AS high
FROM blocks a JOIN blocks b ON a.chunk = b.chunk AND b.block_index % 4 = 0 AND a.block_index * 10 < b.block_index * 10 + 13 AND b.block_index * 10 + 3 < a.block_index * 10 + 10""", "blocks")
def j8_layer_overlap(blocks):
    """Where the extents of an upper layer lie over those of the base."""
    from cairn.operators.intervals import overlapping

    base = blocks.select("chunk", F.col("block_index").alias("base_block"), (F.col("block_index") * 10).alias("low"), (F.col("block_index") * 10 + 10).alias("high"))
    over = blocks.where("block_index % 4 = 0").select("chunk", F.col("block_index").alias("over_block"), (F.col("block_index") * 10 + 3).alias("b_low"), (F.col("block_index") * 10 + 13).alias("b_high"))
    found = overlapping(base, over, ["chunk"], 40)
    return found.select("base_block", "over_block", F.greatest("low", "b_low").alias("low"), F.least("high", "b_high").alias("high"))


@query("SELECT chunk, block_index, greatest(block_index * 10, chunk * 640 + 100) AS low, least(block_index * 10 + 10, chunk * 640 + 333) AS high FROM blocks WHERE block_index * 10 < chunk * 640 + 333 AND block_index * 10 + 10 > chunk * 640 + 100", "blocks")
def j9_extents_of_request(blocks):
    """Extents that a requested range touches, clipped to it."""
    low, high = F.col("block_index") * 10, F.col("block_index") * 10 + 10
    first, end = F.col("chunk") * 640 + 100, F.col("chunk") * 640 + 333
    return blocks.where((low < end) & (high > first)).select("chunk", "block_index", F.greatest(low, first).alias("low"), F.least(high, end).alias("high"))


@query("SELECT event_id, (SELECT max(block_index) FROM blocks b WHERE NOT b.is_free AND b.block_index <= event_id % 1000) AS block_index FROM events", "events", "blocks")
def j10_as_of(events, blocks):
    """The last block with data at or before a cursor: cursors and blocks in one order, and the last block carried on.
    The order is cut into pieces and runs of pieces. A piece learns the last block before it from the pieces of its run,
    and a run from the runs before: a run is 4096 pieces of 256 places, so that runs are few."""
    piece, run = 256, 4096
    at = events.select(F.col("event_id"), (F.col("event_id") % 1000).alias("at"), F.lit(None).cast("long").alias("own"))
    own = blocks.where(~F.col("is_free")).select(F.lit(None).cast("long").alias("event_id"), F.col("block_index").alias("at"), F.col("block_index").alias("own"))
    both = at.unionByName(own).withColumn("piece", F.floor(F.col("at") / piece)).withColumn("run", F.floor(F.col("piece") / run))
    pieces = both.groupBy("run", "piece").agg(F.max("own").alias("last"))
    runs = pieces.groupBy("run").agg(F.max("last").alias("last"))
    before = lambda w: F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("run", before(Window.orderBy("run")).alias("of_runs"))
    pieces = pieces.withColumn("of_pieces", before(Window.partitionBy("run").orderBy("piece"))).join(runs, "run")
    carried = pieces.select("piece", F.coalesce("of_pieces", "of_runs").alias("carried"))
    w = Window.partitionBy("piece").orderBy("at", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("seen", F.max("own").over(w)).where("event_id IS NOT NULL")
    return found.join(carried, "piece").select("event_id", F.coalesce("seen", "carried").alias("block_index"))


@query("SELECT e.entry_id, b.block_index, b.chunk FROM entries e JOIN blocks b ON b.block_index = e.entry_id - 100000001 WHERE e.kind = 2", "entries", "blocks")
def j11_index_lookups(entries, blocks):
    found = entries.where("kind = 2").select("entry_id", (F.col("entry_id") - 100_000_001).alias("block_index"))
    return found.join(blocks.select("block_index", "chunk"), "block_index").select("entry_id", "block_index", "chunk")
