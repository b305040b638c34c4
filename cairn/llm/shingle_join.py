"""Exact n-gram Jaccard join with signature trees.

1. Texts become sets of word shingles (64-bit hashes). Equal sets are one class, which its first row stands for.
2. All sets are counted into a table of fixed size (``COUNTERS`` counters), which orders shingles by rarity. In any such
   order, two sets as similar as asked share a shingle among the first ``n - ceil(t * n) + 1`` of each.
3. Classes that share such a shingle meet in the group of the smallest of them. There, a signature tree is built on
   their bitmaps: each node holds the OR of its members' token bitmaps, their range of sizes and their largest slack
   (tokens beyond the bits set). A bitmap has two to four bits for each token, so that it tells large sets apart as well as
   small ones; there is a tree for each width, and a bitmap is folded to meet one of half its width (sets whose sizes
   differ by more can't be similar). Two trees are walked at once, and a pair of nodes is left out if its greatest possible
   overlap is too small for its smallest sizes. What remains joins its members into clusters of candidates.
4. The sets themselves go to these clusters alone, where overlaps are counted exactly.
5. Links within a cluster leave as a forest; the components of all forests are found by star contraction.

A group or cluster of more than BLOCK members is compared within blocks first, twice, by two hashes. That connects near
copies, whatever their number. Then only members of different components are compared, as pairs of blocks of fitting
sizes; no pair that could join two components is left out.

Defined results: a null or empty text has an empty set, and is linked with nothing, not even its like; a text of fewer
words than a shingle has one shingle. Rows of equal id are one document: each has its own set and size, a link of one is
a link of all, and they are in one component. Rows with a null id link with nothing. An empty table gives an empty
result. Columns of docs beside key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, lean, need, tune
from cairn.llm.groups import bounds, by_group, components, least_reachable, sieve

COUNTERS = 1 << 22
CHUNK = 1 << 16  # counters in one row of the table on its way
LEAST_BITS = 256  # in a bitmap
BLOCK = 256
FAN = 4
TEXT_BLOCK = 1 << 19


def _sets(batch: pa.RecordBatch, column: int, k: int):
    """Row number and sorted set of each row's shingles."""
    data, offsets = bytetext.buffers(batch.column(column))
    for lo, hi in bytetext.chunks(offsets, TEXT_BLOCK):
        own = offsets[lo : hi + 1]
        hashes, first = bytetext.word_hashes(data[own[0] : own[-1]], own - own[0], bytetext.NOT_SPACE)
        shingles, begins = bytetext.shingle_hashes(hashes, first, k)
        for r in range(hi - lo):
            yield lo + r, np.unique(shingles[begins[r] : begins[r + 1]])


def _count(batches, k: int):
    """A row for each document (its set's size and two hashes), then the task's counters."""
    counters = np.zeros(COUNTERS, np.uint8)
    for batch in batches:
        n, a, b = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
        for r, s in _sets(batch, 2, k):
            n[r], a[r], b[r] = len(s), bytetext.mix(s).sum(), bytetext.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
            at = (s >> np.uint64(42)).astype(np.int64)
            at, times = np.unique(at, return_counts=True)
            counters[at] = np.minimum(counters[at].astype(np.int64) + times, 255)
        none = pa.nulls(batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, pa.nulls(batch.num_rows, pa.binary())], _COUNT_NAMES)
    parts, task = COUNTERS // CHUNK, TaskContext.get().partitionId()
    none = pa.nulls(parts, pa.int64())
    blobs = pa.array([counters[i * CHUNK : (i + 1) * CHUNK].astype(np.uint16).tobytes() for i in range(parts)], pa.binary())
    yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), blobs], _COUNT_NAMES)


_COUNT_NAMES = ["id", "text_hash", "n", "set_a", "set_b", "part", "task", "counts"]


def _add(table: pa.Table):
    at = bounds(table, ["part", "task"])
    sums = []
    for lo, hi in zip(at[:-1], at[1:]):
        total = np.zeros(CHUNK, np.int64)
        for blob in table.column("counts").slice(lo, hi - lo).to_pylist():
            total += np.frombuffer(blob, np.uint16)
        sums.append(np.minimum(total, 65535).astype(np.uint16).tobytes())
    first = pa.array(at[:-1])
    yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(first) for c in ("part", "task")] + [pa.array(sums, pa.binary())], ["part", "task", "counts"])


def _total(blobs: DataFrame, scratch: Scratch, at_once: int = 64) -> np.ndarray:
    """Sums the tasks' counters in rounds of at most ``at_once`` each; the result has a fixed size."""
    tasks, step = blobs.agg(F.max("task")).first()[0], 0
    if tasks is None:
        return np.zeros(COUNTERS, np.uint16)
    while tasks or not step:
        blobs = scratch.table(by_group(blobs.select("part", F.floor(F.col("task") / at_once).cast("int").alias("task"), "counts"), ["part", "task"], _add, "part int, task int, counts binary", few=256), f"counters{step}")
        tasks, step = tasks // at_once, step + 1
    return np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in blobs.orderBy("part").collect()])


def width_of(n: int) -> int:
    """Bits in the bitmap of a set of n tokens."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(batches, k: int, num: int, den: int, counts):
    for batch in batches:
        prefix, bitmap = [], []
        for _, s in _sets(batch, 2, k):
            bits = np.zeros(width_of(len(s)), bool)
            bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            bitmap.append(np.packbits(bits, bitorder="little").tobytes())
            order = np.lexsort((s, counts.value[(s >> np.uint64(42)).astype(np.int64)]))
            prefix.append(s[order[: prefix_size(len(s), num, den)]].view(np.int64) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.binary())], ["id", "text_hash", "prefix", "bitmap"])


class Tree:
    """A balanced tree over members in order of size; level 0 has the members themselves."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        bits, low = bitmaps[self.order], sizes[self.order]
        slack = low - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, low, low, slack)]
        while len(low) > 1:
            at = np.arange(0, len(low), FAN)
            bits, slack = np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(slack, at)
            high = np.maximum.reduceat(self.levels[-1][2], at)
            low = np.minimum.reduceat(low, at)
            self.levels.append((bits, low, high, slack))


def candidates(a: Tree, b: Tree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that may be similar, by walking both trees from their roots."""
    same, level_a, level_b = a is b, len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        bits_a, low_a, high_a, slack_a = (x[i] for x in a.levels[level_a])
        bits_b, low_b, high_b, slack_b = (x[j] for x in b.levels[level_b])
        overlap = np.minimum(np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64) + np.minimum(slack_a, slack_b), np.minimum(high_a, high_b))
        keep = (den * overlap >= num * (low_a + low_b - overlap)) & (den * high_b >= num * low_a) & (den * high_a >= num * low_b)
        if same:
            keep &= (i <= j) if level_a else (i < j)
        i, j = i[keep], j[keep]
        if not len(i) or not (level_a or level_b):
            return a.order[i], b.order[j]
        if level_a and (same or level_a >= level_b):
            level_a, n = level_a - 1, len(a.levels[level_a - 1][1])
            j = np.repeat(j, FAN)
            i = (i[:, None] * FAN + np.arange(FAN)).ravel()
            ok = i < n
            i, j = i[ok], j[ok]
        if level_b and (same or level_b > level_a):
            level_b, n = level_b - 1, len(b.levels[level_b - 1][1])
            i = np.repeat(i, FAN)
            j = (j[:, None] * FAN + np.arange(FAN)).ravel()
            ok = j < n
            i, j = i[ok], j[ok]


_TASK = ["leader", "block_i", "block_j"]


def similar(bitmaps: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right members (of all two, if both are the same) that may be similar, by a tree for each width."""
    widths, whole = np.array([len(b) for b in bitmaps]), left is right
    stack = lambda rows: np.stack([bitmaps[r] for r in rows])
    out: list[tuple] = []

    def met(a: np.ndarray, b: np.ndarray, tree_a: Tree, tree_b: Tree):
        i, j = candidates(tree_a, tree_b, num, den)
        if len(i):
            out.append((a[i], b[j]))

    for w in np.unique(widths):
        a, b = left[widths[left] == w], right[widths[right] == w]
        tree_a = Tree(stack(a), sizes[a]) if len(a) else None
        tree_b = tree_a if whole else Tree(stack(b), sizes[b]) if len(b) else None
        if tree_a and tree_b and not (whole and len(a) < 2):
            met(a, b, tree_a, tree_b)
        for own, tree, others in ((a, tree_a, right), (b, tree_b, left))[: 1 if whole else 2]:
            wider = others[widths[others] == 2 * w]
            if tree and len(wider):
                folded = stack(wider)
                met(own, wider, tree, Tree(folded[:, :w] | folded[:, w:], sizes[wider]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none
    i, j = (np.concatenate(c) for c in zip(*out))
    return i, j


def _clusters(table: pa.Table, num: int, den: int):
    """For each member with a possible partner: the least member that it is joined with."""
    at = bounds(table, _TASK)
    ids, sizes, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
    bitmaps = [np.frombuffer(b, np.uint64) for b in table.column("bitmap").to_pylist()]
    apart = table.column("block_i").to_numpy() != table.column("block_j").to_numpy()
    out: list[tuple] = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo < 2:
            continue
        rows = np.arange(hi - lo)
        left, right = (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1]) if apart[lo] else (rows, rows)
        i, j = similar(bitmaps[lo:hi], sizes[lo:hi], left, right, num, den)
        if not len(i):
            continue
        label = least_reachable(hi - lo, i, j)
        some = np.unique(np.concatenate([i, j]))
        least = np.full(hi - lo, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids[lo:hi])
        out.append((least[label[some]], ids[lo:hi][some]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["leader", "id"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two different sets share (the diagonal isn't filled)."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    token = np.unique(token, return_inverse=True)[1] if len(token) else token
    total = np.zeros((n, n))
    width = max(1, (1 << 20) // n)
    for lo in range(0, int(token.max()) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], token[a:b] - lo] = 1
        total += x @ x.T
    return np.rint(total).astype(np.int64)


def _links(table: pa.Table, num: int, den: int):
    """A forest of the exact links among each task's members."""
    at = bounds(table, _TASK)
    ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
    apart = table.column("block_i").to_numpy() != table.column("block_j").to_numpy()
    blobs = table.column("members").to_pylist()
    out: list[tuple] = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo < 2:
            continue
        sets = [np.frombuffer(b, np.uint64) for b in blobs[lo:hi]]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = den * both >= num * (size[:, None] + size[None, :] - both)
        if apart[lo]:
            linked &= side[lo:hi][:, None] != side[lo:hi][None, :]
        i, j = np.nonzero(np.triu(linked, 1))
        if len(i):
            label = least_reachable(hi - lo, i, j)
            least = np.full(hi - lo, np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids[lo:hi])
            out.append((ids[lo:hi], least[label]))
    if out:
        a, b = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles and component of every row: rows link if den * overlap >= num * union."""
    need(docs, key, text)
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "shingles")
    rows = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    counted = scratch.table(rows.mapInArrow(lean(lambda b: _count(b, shingle)), "id bigint, text_hash bigint, n bigint, set_a bigint, set_b bigint, part int, task int, counts binary"), "counted")
    counts = spark.sparkContext.broadcast(_total(counted.where("part is not null").select("part", "task", "counts"), scratch))
    each = counted.where("part is null").select("id", "text_hash", "n", "set_a", "set_b")
    same = ["n", "set_a", "set_b"]
    classes = each.where("n > 0 and id is not null").groupBy(*same).agg(F.min(F.struct("id", "text_hash")).alias("first"))
    classes = scratch.table(classes.select(*same, "first.*", F.monotonically_increasing_id().alias("node")), "classes")

    prefixes = rows.mapInArrow(lean(lambda b: _prefixes(b, shingle, num, den, counts)), "id bigint, text_hash bigint, prefix array<bigint>, bitmap binary")
    prefixes = prefixes.groupBy("id", "text_hash").agg(F.any_value("prefix").alias("prefix"), F.any_value("bitmap").alias("bitmap"))  # equal rows
    own = scratch.table(prefixes.join(classes.select("id", "text_hash", "node", "n"), ["id", "text_hash"]).select(F.col("node").alias("id"), "n", "prefix", "bitmap"), "prefixes")
    postings = own.select("id", F.explode("prefix").alias("token"))
    leaders = scratch.table(postings.groupBy("token").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("times")).where("times > 1").select("token", "leader"), "leaders")
    members = postings.join(leaders, "token").select("leader", "id").distinct()
    members = scratch.table(members.join(own.select("id", "n"), "id"), "members")
    scratch.drop("leaders")

    def clustered(tasks: DataFrame, name: str) -> DataFrame:
        """Members of the groups that have a possible partner, with the least one that they are joined with."""
        signed = tasks.join(own.select("id", "bitmap"), "id")
        found = scratch.table(by_group(signed, _TASK, lambda t: _clusters(t, num, den), "leader bigint, id bigint").distinct(), f"{name}_found")
        # clusters of several groups with the same least member are one, so that a pair is seldom compared twice
        return scratch.table(found.join(own.select("id", "n"), "id"), name)

    large = large_groups(members, scratch, "large_leaders")
    clusters = clustered(dealt_once(members, large), "clusters")
    large_clusters = large_groups(clusters, scratch, "large_clusters")
    tasks = dealt_once(clusters, large_clusters).groupBy("id").agg(F.collect_list(F.struct(*_TASK, "side")).alias("tasks"))
    later = members.join(large, "leader").select("id").unionByName(clusters.join(large_clusters, "leader").select("id")).distinct().withColumn("later", F.lit(True))
    near = tasks.join(later, "id", "full").select(F.col("id").alias("node"), "tasks", F.coalesce("later", F.lit(False)).alias("later"))
    near = scratch.table(near.join(classes.select("node", "id", "text_hash"), "node"), "placed")

    def sets(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))  # equal rows are sent once
            blobs = [s.tobytes() for _, s in _sets(batch, 3, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), batch.column(1), batch.column(2)], ["id", "members", "tasks", "later"])

    maybe = sieve(near, ["id", "text_hash"], scratch, "sieve")
    texts = maybe(rows, "maybe", "id", "text_hash").where("maybe").join(near, ["id", "text_hash"]).select("node", "tasks", "later", "text")
    task = "array<struct<leader:bigint,block_i:bigint,block_j:bigint,side:int>>"
    held = scratch.table(texts.mapInArrow(lean(sets), f"id bigint, members binary, tasks {task}, later boolean"), "held")

    def exact(dealt: DataFrame, name: str) -> DataFrame:
        return scratch.table(by_group(dealt, _TASK, lambda t: _links(t, num, den), "a bigint, b bigint", few=512).distinct(), name)

    stock = held.where("later").select("id", "members")
    edges = exact(held.select("id", "members", F.inline("tasks")), "edges")
    if not (large.isEmpty() and large_clusters.isEmpty()):
        found = components(edges, scratch, "components_of_blocks")
        dealt = dealt_across(clusters, large_clusters, found, num, den, scratch, "of_clusters")
        again = clustered(scratch.table(dealt_across(members, large, found, num, den, scratch, "of_leaders"), "leader_tasks"), "clusters_across")
        large_again = large_groups(again, scratch, "large_clusters_across")
        dealt = dealt.unionByName(dealt_once(again, large_again))
        edges = edges.unionByName(exact(dealt.join(stock, "id"), "edges_across"))
        if not large_again.isEmpty():
            found = components(edges, scratch, "components_across")
            dealt = dealt_across(again, large_again, found, num, den, scratch, "of_clusters_across")
            edges = edges.unionByName(exact(dealt.join(stock, "id"), "edges_last"))
    # all sets of one id are one document
    nodes = scratch.table(each.join(classes.select(*same, "node", F.col("id").alias("least")), same).groupBy("id", "node", "least").agg(F.count(F.lit(1)).alias("rows")).drop("rows"), "nodes")
    several = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    edges = edges.unionByName(nodes.join(several, "id").select("a", F.col("node").alias("b")))
    found = components(edges, scratch).select(F.col("id").alias("node"), "component")
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())  # each with its least node
    # a component is named by its smallest id
    known = scratch.table(classes.select("node", "id").join(found, "node").select("node", "component", "id"), "known")
    names = known.groupBy("component").agg(F.min("id").alias("name"))
    named = known.join(names, "component").select("node", "name")
    told = classes.select(*same, F.col("id").alias("least"), "node").join(named, "node", "left").select(*same, F.coalesce("name", "least").alias("component"))
    out = each.join(told, same, "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def large_groups(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """leader and number of blocks of each group of more than BLOCK members."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    return scratch.table(sizes.where(F.col("size") > BLOCK).select("leader", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")), name)


def dealt_once(members: DataFrame, large: DataFrame) -> DataFrame:
    """A task for each small group. Members of large ones go to two blocks, by two hashes, and each block is a task: in a
    group of near copies that connects all of them."""
    placed = members.join(large, "leader", "left").withColumn("turn", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.col("turn") * F.col("blocks") + F.pmod(F.xxhash64("id", "turn"), F.col("blocks"))).cast("long")
    return placed.withColumns({"block_i": block, "block_j": block, "side": F.lit(0)}).drop("blocks", "turn")


def dealt_across(members: DataFrame, large: DataFrame, found: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs of large groups that may add to the components found so far, as pairs of blocks. A component of more
    than BLOCK members has blocks of its own, which are not paired with each other; members of other components share
    blocks. Blocks hold sizes whose ratio is at most that of the threshold, and are paired with those of their own range
    and of the next."""
    step = float(np.log(den / num)) * (1 + 1e-9) if den > num else 1.0  # a little more, for rounding
    range_of = F.floor(F.log("n") / F.lit(step)).cast("long")
    own = members.join(large, "leader").join(found, "id", "left").select("leader", "id", "n", F.coalesce("component", "id").alias("component"), range_of.alias("range"))
    own = scratch.table(own, f"{name}_own")
    per = own.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("size"))
    several = per.groupBy("leader").agg(F.count(F.lit(1)).alias("components")).where("components > 1").select("leader")
    ranges = own.groupBy("leader", "range").agg(F.count(F.lit(1)).alias("there"))
    sized = own.join(several, "leader").join(per, ["leader", "component"]).join(ranges, ["leader", "range"])
    alone = F.col("size") > BLOCK
    part = F.when(alone, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("there") / BLOCK)))
    placed = sized.select("leader", "id", "n", "range", F.when(alone, F.col("component")).alias("alone"), part.alias("part"))
    placed = scratch.table(placed.withColumn("block", F.xxhash64("range", F.coalesce("alone", F.lit(-1)), "part")), f"{name}_placed")
    blocks = placed.groupBy("leader", "block", "range", "alone").agg(F.count(F.lit(1)).alias("members")).drop("members")
    other = blocks.toDF("leader", "other", "other_range", "other_alone")
    near = (F.abs(F.col("range") - F.col("other_range")) <= 1) & (F.col("block") <= F.col("other")) & ~F.coalesce(F.col("alone") == F.col("other_alone"), F.lit(False))
    pairs = scratch.table(blocks.join(other, "leader").where(near).select("leader", "block", "other"), f"{name}_pairs")
    first = placed.join(pairs, ["leader", "block"]).select("leader", "id", "n", F.col("block").alias("block_i"), F.col("other").alias("block_j"), F.lit(0).alias("side"))
    second = placed.join(pairs.where("block <> other").select("leader", F.col("block").alias("one"), F.col("other").alias("block")), ["leader", "block"])
    return first.unionByName(second.select("leader", "id", "n", F.col("one").alias("block_i"), F.col("block").alias("block_j"), F.lit(1).alias("side")))
