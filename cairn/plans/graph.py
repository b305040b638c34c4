"""Recovery points as a forest (g), the file tree (g, u, j): joins without SQL counterparts in the record's home."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import graph
from cairn.plans.catalog import query

#: Visible points: those without a tombstone. Every 97th is hidden, so that some chains are incomplete.
UP = """WITH RECURSIVE v AS (SELECT * FROM catalog WHERE file_id % 97 <> 0),
up AS (SELECT file_id AS id, file_id AS ancestor, parent_id AS next, backup_type, 0 AS distance FROM v
UNION ALL SELECT up.id, v.file_id, v.parent_id, v.backup_type, up.distance + 1 FROM up JOIN v ON v.file_id = up.next WHERE up.distance < 200),
top AS (SELECT id, max(distance) AS depth, max_by(ancestor, distance) AS top, max_by(backup_type, distance) AS top_type FROM up GROUP BY id) """


def visible(catalog):
    return catalog.where("file_id % 97 <> 0")


def chains(catalog):
    points = visible(catalog)
    found = graph.tops(points, "file_id", "parent_id")
    kinds = points.select(F.col("file_id").alias("top"), F.col("backup_type").alias("top_type"))
    return found.join(kinds, "top").select("id", "top", F.col("depth").cast("int").alias("depth"), "missing", "deep", "top_type", ((F.col("top_type") == 1) & ~F.col("missing") & ~F.col("deep")).alias("complete"))


@query("SELECT c.file_id, c.backup_set, c.created_ms FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.file_id = c.file_id)", "catalog", "tombstones")
def j1_minus_tombstones(catalog, tombstones):
    targets = tombstones.groupBy("operation_id").agg(F.collect_list("file_id").alias("targets")).select(F.explode("targets").alias("file_id"))
    return catalog.join(targets, "file_id", "left_anti").select("file_id", "backup_set", "created_ms")


@query("SELECT c.file_id, c.parent_id, CASE WHEN c.parent_id IS NULL THEN 'root' WHEN p.file_id IS NULL THEN 'missing' WHEN p.backup_set <> c.backup_set THEN 'other_set' WHEN p.content_kind <> c.content_kind THEN 'other_kind' WHEN c.backup_type = 3 AND p.backup_type <> 1 THEN 'differential_on_other' ELSE 'ok' END AS edge FROM catalog c LEFT JOIN catalog p ON p.file_id = c.parent_id AND p.file_id % 97 <> 0 WHERE c.file_id % 97 <> 0", "catalog")
def j2_parent_edges(catalog):
    """A missing parent is legal; an edge that is there has rules."""
    points = visible(catalog)
    parents = points.select(F.col("file_id").alias("p"), F.col("backup_set").alias("p_set"), F.col("content_kind").alias("p_kind"), F.col("backup_type").alias("p_type"))
    edge = (
        F.when(F.col("parent_id").isNull(), "root").when(F.col("p").isNull(), "missing").when(F.col("p_set") != F.col("backup_set"), "other_set")
        .when(F.col("p_kind") != F.col("content_kind"), "other_kind").when((F.col("backup_type") == 3) & (F.col("p_type") != 1), "differential_on_other").otherwise("ok")
    )
    return points.join(parents, F.col("parent_id") == F.col("p"), "left").select("file_id", "parent_id", edge.alias("edge"))


@query(UP + "SELECT (SELECT count(*) FROM v) AS points, count(DISTINCT top) AS chains, CAST(max(depth) AS INT) AS deepest, max(depth) <= 128 AS legal FROM top", "catalog")
def g1_graph_summary(catalog):
    found = chains(catalog)
    return found.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("top").alias("chains"), F.max("depth").alias("deepest"), (~F.bool_or("deep")).alias("legal"))


@query(UP + "SELECT up.id AS tip, up.ancestor AS point, CAST(top.depth - up.distance AS INT) AS nth FROM up JOIN top ON top.id = up.id", "catalog")
def g2_chain_base_first(catalog):
    """The chain of each visible point with the base first."""
    pairs = graph.ancestors(visible(catalog), "file_id", "parent_id")
    depth = F.max("distance").over(Window.partitionBy("id"))
    return pairs.select(F.col("id").alias("tip"), F.col("ancestor").alias("point"), (depth - F.col("distance")).alias("nth"))


@query(UP + "SELECT top.id AS file_id, CASE WHEN top_type = 1 THEN 'complete' ELSE 'incomplete' END AS chain_state, CAST(depth AS INT) AS depth FROM top", "catalog")
def g3_chain_state(catalog):
    return chains(catalog).select(F.col("id").alias("file_id"), F.when(F.col("complete"), "complete").otherwise("incomplete").alias("chain_state"), "depth")


TIPS = """, ranked AS (SELECT v.*, row_number() OVER (PARTITION BY backup_set, content_kind ORDER BY created_ms DESC, file_id DESC) AS k FROM v JOIN top ON top.id = v.file_id WHERE top.top_type = 1) """


def retained_tips(catalog):
    complete = chains(catalog).where("complete").select(F.col("id").alias("file_id"))
    nth = F.row_number().over(Window.partitionBy("backup_set", "content_kind").orderBy(F.desc("created_ms"), F.desc("file_id")))
    return visible(catalog).join(complete, "file_id").withColumn("k", nth).where("k <= 2")


@query(UP + TIPS + "SELECT DISTINCT up.ancestor AS file_id FROM up JOIN ranked ON ranked.file_id = up.id AND k <= 2", "catalog")
def g4_retention_closure(catalog):
    """All points that the two newest complete points of each set need."""
    return graph.above(visible(catalog), retained_tips(catalog), "file_id", "parent_id").select(F.col("id").alias("file_id"))


@query(UP + TIPS + "SELECT max(depth) AS deepest, max(depth) >= 20 AS over_threshold, count(*) AS tips FROM top JOIN ranked ON ranked.file_id = top.id AND k <= 2", "catalog")
def a15_retained_depth(catalog):
    deep = retained_tips(catalog).select("file_id").join(chains(catalog).select(F.col("id").alias("file_id"), "depth"), "file_id")
    return deep.agg(F.max("depth").alias("deepest"), F.bool_or(F.col("depth") >= 20).alias("over_threshold"), F.count(F.lit(1)).alias("tips"))


@query(UP + TIPS + ", kept AS (SELECT DISTINCT up.ancestor AS file_id FROM up JOIN ranked ON ranked.file_id = up.id AND k <= 2) SELECT v.file_id, kept.file_id IS NOT NULL AS kept FROM v LEFT JOIN kept ON kept.file_id = v.file_id", "catalog")
def u1_retention_union(catalog):
    """Which points the union of the closures keeps."""
    kept = g4_retention_closure(catalog).withColumn("k", F.lit(True))
    return visible(catalog).select("file_id").join(kept, "file_id", "left").select("file_id", F.coalesce("k", F.lit(False)).alias("kept"))


@query(UP + "SELECT up.ancestor AS target, up.id AS point, CAST(up.distance AS INT) AS depth FROM up", "catalog")
def g5_descendants(catalog):
    """Everything that builds on each visible point; children come before parents when ordered by depth, deepest first."""
    pairs = graph.ancestors(visible(catalog), "file_id", "parent_id")
    return pairs.select(F.col("ancestor").alias("target"), F.col("id").alias("point"), F.col("distance").alias("depth"))


@query(UP + """, m AS (SELECT up.ancestor AS target, up.id AS point, CAST(up.distance AS INT) AS depth, v.parts, v.has_sidecar FROM up JOIN v ON v.file_id = up.id)
SELECT target, point, depth, CASE WHEN k = 0 THEN '.bhx' WHEN k < 1000 THEN concat('.', lpad(CAST(1000 - k AS VARCHAR), 3, '0')) ELSE 'main' END AS member, k AS ordinal
FROM (SELECT target, point, depth, unnest(list_concat(CASE WHEN has_sidecar THEN CAST([0] AS BIGINT[]) ELSE CAST([] AS BIGINT[]) END, range(1001 - parts, 1001))) AS k FROM m) x""", "catalog")
def g6_delete_plan(catalog):
    """What has to go with each visible point, member by member: the sidecar, the parts from the last, the main file at
    the end."""
    plan = g5_descendants(catalog).join(visible(catalog).select(F.col("file_id").alias("point"), "parts", "has_sidecar"), "point")
    sidecar = F.when(F.col("has_sidecar"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    parts = F.when(F.col("parts") > 1, F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda p: 1000 - p)).otherwise(F.array().cast("array<int>"))
    k = F.explode(F.concat(sidecar, parts, F.array(F.lit(1000))))
    member = F.when(F.col("k") == 0, ".bhx").when(F.col("k") < 1000, F.concat(F.lit("."), F.lpad((1000 - F.col("k")).cast("string"), 3, "0"))).otherwise("main")
    return plan.withColumn("k", k).select("target", "point", "depth", member.alias("member"), F.col("k").cast("long").alias("ordinal"))


@query("SELECT DISTINCT p.file_id FROM catalog p JOIN catalog c ON c.parent_id = p.file_id WHERE p.file_id % 97 <> 0 AND c.file_id % 97 <> 0", "catalog")
def g7_has_descendants(catalog):
    points = visible(catalog)
    return points.join(points.select(F.col("parent_id").alias("file_id")), "file_id", "left_semi").select("file_id")


@query(UP + """, tip AS (SELECT backup_set, max_by(file_id, created_ms * 100000 + file_id % 100000) AS tip FROM catalog GROUP BY backup_set)
SELECT tip.backup_set, tip.tip, CAST(CASE WHEN tip.tip % 31 = 0 THEN 9 WHEN top.id IS NULL THEN 1 WHEN top.top_type <> 1 THEN 3 WHEN tip.backup_set % 13 = 0 THEN 2 ELSE 0 END AS INT) AS reason FROM tip LEFT JOIN top ON top.id = tip.tip""", "catalog")
def g8_incremental_parent(catalog):
    """Whether a schedule's tip can be built on, with the first reason against it: 9 baseline invalid, 1 no parent,
    3 chain incomplete, 2 selection changed. Older points are never looked for."""
    tip = catalog.groupBy("backup_set").agg(F.max_by("file_id", F.col("created_ms") * 100000 + F.col("file_id") % 100000).alias("tip"))
    found = tip.join(chains(catalog).select(F.col("id").alias("tip"), "complete"), "tip", "left")
    reason = F.when(F.col("tip") % 31 == 0, 9).when(F.col("complete").isNull(), 1).when(~F.col("complete"), 3).when(F.col("backup_set") % 13 == 0, 2).otherwise(0)
    return found.select("backup_set", "tip", reason.alias("reason"))


@query(UP + ", s AS (SELECT up.id, count(DISTINCT v.backup_set) AS sets, count(*) AS n FROM up JOIN v ON v.file_id = up.ancestor GROUP BY up.id) SELECT top.id AS file_id, top_type = 1 AND sets = 1 AND n <= 129 AS usable FROM top JOIN s ON s.id = top.id", "catalog")
def g9_volume_parent(catalog):
    """A tip is usable if all points of its chain are of one set, none repeats, and the last one is full."""
    points = visible(catalog)
    per = graph.folded(points, "file_id", "parent_id", {"low": (F.col("backup_set"), F.least), "high": (F.col("backup_set"), F.greatest)})
    found = per.join(chains(catalog).select("id", "complete", "depth"), "id")
    return found.select(F.col("id").alias("file_id"), (F.col("complete") & (F.col("low") == F.col("high")) & (F.col("depth") <= 128)).alias("usable"))


@query("SELECT e.entry_id, e.parent_id, e.kind, EXISTS (SELECT 1 FROM entries c WHERE c.parent_id = e.entry_id) AS has_children FROM entries e WHERE e.parent_id < 1000", "entries")
def g10_children(entries):
    parents = entries.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("p")).distinct()
    own = entries.where("parent_id < 1000")
    return own.join(parents, F.col("entry_id") == F.col("p"), "left").select("entry_id", "parent_id", "kind", F.col("p").isNotNull().alias("has_children"))


SELECTED = "entry_id IN (103, 1005, 1010) OR entry_id = 100000101"


@query(f"""WITH RECURSIVE s AS (SELECT entry_id, parent_id FROM entries WHERE {SELECTED}),
down AS (SELECT entry_id FROM s UNION SELECT e.entry_id FROM entries e JOIN down ON e.parent_id = down.entry_id),
up AS (SELECT entry_id, parent_id FROM s UNION SELECT e.entry_id, e.parent_id FROM entries e JOIN up ON e.entry_id = up.parent_id)
SELECT entry_id FROM down UNION SELECT entry_id FROM up""", "entries")
def g11_selection_closure(entries):
    """A selection, all below it, and all folders above it."""
    chosen = entries.where(SELECTED)
    below = graph.descendants(entries, chosen, "entry_id", "parent_id", 64).select(F.col("id").alias("entry_id"))
    above = graph.above(entries, chosen, "entry_id", "parent_id", 64).select(F.col("id").alias("entry_id"))
    return below.union(above).distinct()


@query("""WITH RECURSIVE p AS (SELECT entry_id, name AS path, 0 AS depth FROM entries WHERE parent_id IS NULL
UNION ALL SELECT e.entry_id, concat(p.path, '/', e.name), p.depth + 1 FROM entries e JOIN p ON e.parent_id = p.entry_id WHERE e.kind = 1)
SELECT entry_id, path, depth FROM p""", "entries")
def g12_paths(entries):
    found = graph.paths(entries.where("kind = 1"), "entry_id", "parent_id", "name")
    return found.select(F.col("id").alias("entry_id"), F.array_join("path", "/").alias("path"), "depth")


@query("""WITH RECURSIVE n AS (SELECT entry_id, parent_id, CASE WHEN row_number() OVER (PARTITION BY parent_id, lower(name) ORDER BY entry_id) = 1 THEN name ELSE concat(name, '~', CAST(entry_id AS VARCHAR)) END AS shown FROM entries),
p AS (SELECT entry_id, shown AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.entry_id, concat(p.path, '/', n.shown) FROM n JOIN p ON n.parent_id = p.entry_id),
a AS (SELECT concat(lower(r_name), '/', n_name, '/', upper(c_name)) AS asked FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT concat(r_name, '/nowhere') FROM region)
SELECT a.asked, p.entry_id FROM a LEFT JOIN p ON lower(p.path) = lower(a.asked)""", "entries", "customer", "nation", "region")
def g13_path_resolve(entries, customer, nation, region):
    """The entry at each asked path, whatever the case of its letters. Names that collide are shown with their id behind."""
    first = F.row_number().over(Window.partitionBy("parent_id", F.lower("name")).orderBy("entry_id")) == 1
    folders = entries.where("kind = 1")
    shown = folders.withColumn("shown", F.when(first, F.col("name")).otherwise(F.concat("name", F.lit("~"), F.col("entry_id").cast("string"))))
    paths = graph.paths(shown, "entry_id", "parent_id", "shown").select(F.col("id").alias("entry_id"), F.lower(F.array_join("path", "/")).alias("path"))
    places = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    asked = places.select(F.concat(F.lower("r_name"), F.lit("/"), "n_name", F.lit("/"), F.upper("c_name")).alias("asked")).unionByName(region.select(F.concat("r_name", F.lit("/nowhere")).alias("asked")))
    return asked.join(paths, F.lower("asked") == F.col("path"), "left").select("asked", "entry_id")


@query("""SELECT p_partkey AS id, CASE WHEN row_number() OVER (PARTITION BY p_partkey % 50, lower(p_name) ORDER BY p_partkey) = 1 THEN p_name ELSE concat(p_name, '~', CAST(p_partkey AS VARCHAR)) END AS shown FROM part""", "part")
def g13_case_collisions(part):
    """Names that differ in case alone: all but the first get their id behind them."""
    first = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 50, F.lower("p_name")).orderBy("p_partkey")) == 1
    return part.select(F.col("p_partkey").alias("id"), F.when(first, F.col("p_name")).otherwise(F.concat("p_name", F.lit("~"), F.col("p_partkey").cast("string"))).alias("shown"))


#: A point has as many streams as parts. A full point holds all of them; another one holds every second, and its others
#: are those of the same number one layer down.
STREAMS = """WITH RECURSIVE v AS (SELECT * FROM catalog WHERE file_id % 97 <> 0),
st AS (SELECT file_id, parent_id, content_kind, CAST(k AS BIGINT) AS stream, backup_type = 1 OR (file_id + k) % 2 = 0 AS local FROM v, unnest(range(0, parts)) r(k)),
walk AS (SELECT file_id AS tip, stream AS tip_stream, file_id, parent_id, content_kind, stream, local, 0 AS hops FROM st
UNION ALL SELECT w.tip, w.tip_stream, s.file_id, s.parent_id, s.content_kind, s.stream, s.local, w.hops + 1 FROM walk w JOIN st s ON NOT w.local AND s.file_id = w.parent_id AND s.stream = w.stream AND s.content_kind = w.content_kind AND w.hops < 128) """


def resolved_streams(catalog):
    """file_id, stream, resolved (the layer that holds its bytes, or null) and hops."""
    points = visible(catalog).withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    local = (F.col("backup_type") == 1) | ((F.col("file_id") + F.col("stream")) % 2 == 0)
    node = lambda point: F.struct(point.alias("file_id"), F.col("stream"), F.col("content_kind"))
    streams = points.select(node(F.col("file_id")).alias("node"), F.when(~local, node(F.col("parent_id"))).alias("below"), local.alias("local"))
    found = graph.tops(streams, "node", "below")
    held = streams.where("local").select(F.col("node").alias("top"), F.lit(True).alias("held"))
    both = found.join(held, "top", "left").withColumn("sound", F.coalesce(F.col("held") & ~F.col("deep"), F.lit(False)))
    return both.select("id.file_id", "id.stream", F.when(F.col("sound"), F.col("top.file_id")).alias("resolved"), F.when(F.col("sound"), F.col("depth").cast("int")).alias("hops"))


@query(STREAMS + "SELECT st.file_id, st.stream, w.file_id AS resolved, CAST(w.hops AS INT) AS hops FROM st LEFT JOIN walk w ON w.tip = st.file_id AND w.tip_stream = st.stream AND w.local", "catalog")
def g14_stream_layers(catalog):
    """Where the bytes of each stream are: it is followed down its parents' streams of the same kind until a layer holds it,
    128 layers at most. A layer that is missing, or lacks the stream, leaves it unresolved."""
    return resolved_streams(catalog)


@query(STREAMS + """, up AS (SELECT file_id AS tip, file_id, parent_id, stored_bytes, backup_type, 0 AS distance FROM v UNION ALL SELECT up.tip, v.file_id, v.parent_id, v.stored_bytes, v.backup_type, up.distance + 1 FROM up JOIN v ON v.file_id = up.parent_id WHERE up.distance < 200),
layers AS (SELECT tip, count(*) AS layer_count, CAST(sum(stored_bytes) AS BIGINT) AS local_bytes, max_by(backup_type, distance) = 1 AND max(distance) <= 128 AS whole FROM up GROUP BY tip),
tips AS (SELECT st.file_id, count(*) AS streams, count(w.tip) AS resolved FROM st LEFT JOIN walk w ON w.tip = st.file_id AND w.tip_stream = st.stream AND w.local GROUP BY st.file_id)
SELECT tips.file_id, layer_count, local_bytes, streams, resolved, whole AND streams = resolved AS recoverable FROM tips JOIN layers ON layers.tip = tips.file_id""", "catalog")
def v8_recoverability(catalog):
    """Whether each visible point can be recovered: all layers of its chain are there, and all of its streams resolve."""
    points = visible(catalog)
    layers = graph.folded(points, "file_id", "parent_id", {"layer_count": (F.lit(1).cast("long"), lambda a, b: a + b), "local_bytes": (F.col("stored_bytes"), lambda a, b: a + b)})
    tips = resolved_streams(catalog).groupBy("file_id").agg(F.count(F.lit(1)).alias("streams"), F.count("resolved").alias("resolved"))
    whole = chains(catalog).select("id", "complete")
    both = layers.join(whole, "id").join(tips, layers["id"] == tips["file_id"])
    return both.select("file_id", "layer_count", "local_bytes", "streams", "resolved", (F.col("complete") & (F.col("streams") == F.col("resolved"))).alias("recoverable"))


@query("""WITH RECURSIVE leaf AS (SELECT entry_id, parent_id, CASE WHEN kind = 2 AND size % 2 = 0 THEN 1 ELSE 0 END AS ticked FROM entries e WHERE kind = 2 OR NOT EXISTS (SELECT 1 FROM entries c WHERE c.parent_id = e.entry_id)),
p AS (SELECT entry_id, entry_id AS leaf, parent_id, ticked FROM leaf UNION ALL SELECT e.entry_id, p.leaf, e.parent_id, p.ticked FROM entries e JOIN p ON e.entry_id = p.parent_id)
SELECT p.entry_id, CAST(CASE WHEN sum(ticked) = 0 THEN 0 WHEN sum(ticked) = count(*) THEN 2 ELSE 1 END AS INT) AS state FROM p JOIN entries e ON e.entry_id = p.entry_id WHERE e.kind = 1 GROUP BY p.entry_id""", "entries")
def g15_tri_state(entries):
    """0 none, 1 some, 2 all, for folders of any depth. All children of a folder are checked whole just if every leaf below
    it is checked, and some are checked just if some leaf is; a folder without children is an unchecked leaf."""
    parents = entries.select(F.col("parent_id").alias("entry_id"), F.lit(False).alias("bare")).where("entry_id IS NOT NULL").distinct()
    rows = entries.join(parents, "entry_id", "left").select("entry_id", "parent_id", "kind", ((F.col("kind") == 2) & (F.col("size") % 2 == 0)).cast("long").alias("ticked"), ((F.col("kind") == 2) | F.coalesce("bare", F.lit(True))).cast("long").alias("leaf"))
    below = graph.gathered(rows, "entry_id", "parent_id", {"ticked": F.col("ticked"), "leaves": F.col("leaf")}, 64)
    state = F.when(F.col("ticked") == 0, 0).when(F.col("ticked") == F.col("leaves"), 2).otherwise(1)
    return rows.where("kind = 1").select(F.col("entry_id").alias("id")).join(below, "id").select(F.col("id").alias("entry_id"), state.alias("state"))


PRUNE = "SELECT p_partkey AS id, p_partkey % 4 AS volume, CASE p_partkey % 3 WHEN 0 THEN concat('/', p_type) WHEN 1 THEN concat('/', p_type, '/', p_brand) ELSE concat('/', p_type, '/', p_brand, '/', p_name) END AS path, p_partkey % 5 > 0 AS recursive FROM part"


@query(f"WITH s AS ({PRUNE}) SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.volume = s.volume AND b.recursive AND length(b.path) < length(s.path) AND starts_with(s.path, concat(b.path, '/')))", "part")
def g16_pruned_selection(part):
    """Selections that a shorter recursive folder of the same volume doesn't cover. Each path meets its own prefixes by
    equality; no path is compared with all others."""
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, F.concat(F.lit("/"), "p_type")).when(k == 1, F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand")).otherwise(F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name"))
    s = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("volume"), path.alias("path"), (F.col("p_partkey") % 5 > 0).alias("recursive"))
    parts = F.split("path", "/")
    above = s.where(F.size(parts) > 2).select("id", "volume", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    covering = s.where("recursive").select("volume", F.col("path").alias("prefix")).distinct()
    return s.select("id").join(above.join(covering, ["volume", "prefix"], "left_semi").select("id"), "id", "left_anti")


@query(UP + "SELECT top.id AS file_id, CAST(depth + CASE WHEN v.parent_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS shown_depth FROM top JOIN v ON v.file_id = top.top", "catalog")
def g17_display_depth(catalog):
    """The depth that is shown counts a missing parent once."""
    return chains(catalog).select(F.col("id").alias("file_id"), (F.col("depth") + F.when(F.col("missing"), 1).otherwise(0)).alias("shown_depth"))


@query("""SELECT l_partkey AS volume, count(*) AS extents, CAST(sum(l_quantity) AS BIGINT) AS total, bool_and(low = before) AS contiguous FROM (
SELECT l_partkey, l_quantity, low, coalesce(lag(low + CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY low, l_orderkey, l_linenumber), low) AS before FROM (SELECT *, CAST((l_orderkey * 37 + l_linenumber * 101) % 4000 AS BIGINT) AS low FROM lineitem) a) b GROUP BY l_partkey""", "lineitem")
def g18_group_layout(lineitem):
    """Volumes as lists of extents, and whether each extent begins where the one before ends."""
    low = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 4000).cast("long")
    e = lineitem.select(F.col("l_partkey").alias("volume"), low.alias("low"), F.col("l_quantity").cast("long").alias("n"), "l_orderkey", "l_linenumber")
    before = F.coalesce(F.lag(F.col("low") + F.col("n")).over(Window.partitionBy("volume").orderBy("low", "l_orderkey", "l_linenumber")), F.col("low"))
    return e.withColumn("before", before).groupBy("volume").agg(F.count(F.lit(1)).alias("extents"), F.sum("n").alias("total"), F.bool_and(F.col("low") == F.col("before")).alias("contiguous"))


@query("""WITH RECURSIVE p AS (SELECT entry_id, entry_id AS start, parent_id FROM entries WHERE entry_id % 5 = 0 AND entry_id < 3000
UNION ALL SELECT e.entry_id, p.start, e.parent_id FROM entries e JOIN p ON e.entry_id = p.parent_id)
SELECT entry_id FROM entries WHERE entry_id % 5 = 0 AND entry_id < 3000 AND entry_id NOT IN (SELECT start FROM p WHERE entry_id <> start AND entry_id % 5 = 0)""", "entries")
def u4_topmost_selection(entries):
    """Checked rows without a checked row above them."""
    folders = entries.where("kind = 1").select("entry_id", "parent_id", (F.col("entry_id").between(0, 2999) & (F.col("entry_id") % 5 == 0)).alias("checked"))
    checked = F.col("checked").cast("int")
    covered = graph.folded(folders, "entry_id", "parent_id", {"n": (checked, lambda a, b: a + b)}, 64).where("n > 1")
    return folders.where("checked").select("entry_id").join(covered.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


@query("""WITH RECURSIVE p AS (SELECT entry_id, parent_id, 0 AS height FROM entries
UNION ALL SELECT e.entry_id, e.parent_id, p.height + 1 FROM entries e JOIN p ON e.entry_id = p.parent_id)
SELECT entry_id, CAST(max(height) AS INT) AS height FROM p GROUP BY entry_id""", "entries")
def o12_post_order(entries):
    """The height of every entry above the deepest row below it: in this order every row comes before its folder."""
    return graph.heights(entries, "entry_id", "parent_id", 64).select(F.col("id").alias("entry_id"), "height")


@query("""WITH RECURSIVE down AS (SELECT entry_id, kind, size FROM entries WHERE entry_id IN (103, 1004) UNION SELECT e.entry_id, e.kind, e.size FROM entries e JOIN down ON e.parent_id = down.entry_id)
SELECT count(*) AS entries_found, CAST(sum(CASE WHEN kind = 2 THEN size ELSE 0 END) AS BIGINT) AS logical_size, max(CASE WHEN kind = 2 THEN size END) AS largest FROM down""", "entries")
def a18_restore_totals(entries):
    below = graph.descendants(entries, entries.where("entry_id IN (103, 1004)"), "entry_id", "parent_id", 64)
    own = entries.join(below.select(F.col("id").alias("entry_id")), "entry_id")
    file = F.col("kind") == 2
    return own.agg(F.count(F.lit(1)).alias("entries_found"), F.sum(F.when(file, F.col("size")).otherwise(0)).alias("logical_size"), F.max(F.when(file, F.col("size"))).alias("largest"))
