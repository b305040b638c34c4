"""Removal of long byte strings that occur more than once, by longest-previous-factor arrays over anchored contexts.

Every window of ``length`` bytes chooses an anchor: its k-byte string of least hash, the first of equals. Windows that
are equal choose the same anchor at the same place, so that an anchor's windows need be compared with those of anchors
of the same k bytes alone. An anchor's context is all bytes of its windows.

1. Anchors are counted by their hash. Those that occur once have no repeated windows; the places of the others are
   listed for each text. Of texts that are equal as a whole, one goes on and counts as two.
2. Texts meet their lists once. The contexts of a batch of texts are put together first: a row for each different
   context of the batch, with its places. A context of very many places is so many rows as there are batches.
3. Equal contexts are one class, with the number and the first of its places. If an anchor has several classes, their
   bytes go to its task: it builds a suffix array over them and, from the previous and next smaller places in suffix
   order, the longest-previous-factor array. A window repeats if its factor is as long as the window.
4. An anchor with more than ``max_contexts`` classes would be too much for one task: they are cut into ever narrower
   pieces, whose hashes are counted by partial sums (see narrowed()).
5. Classes of several places are told to the batches that have them. Per text, the windows that repeat are merged into
   runs, which are cut out.

Defined results: a null text is empty; texts shorter than ``length`` stay as they are. Rows of one id but different
texts are told apart. Rows equal in id and text are separate rows: their windows all repeat, and ``keep_first`` leaves
one of them as the first. First is the smallest id, then the smallest hash of the text, then the earliest place. An
empty table gives an empty result. Columns of docs stay whatever their names are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, lean, need, new_names, tune
from cairn.llm.groups import bounds, by_group, sieve

LENGTH = 200
ANCHOR = 64
MAX_CONTEXTS = 256
UNITS = 2000  # rows in a batch of contexts
TEXT_BLOCK = 1 << 19
SUFFIX_BLOCK = 1 << 20  # bytes of contexts in one suffix array


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each anchor: its text's number, its place, its first and last window, and the hash of its k bytes."""
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    hashes = bytetext.span_hash(bytetext.prefix_sums(data), np.arange(n - k + 1), np.arange(k, n + 1))
    rank = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(n - k + 1, dtype=np.uint64)
    m = len(rank)
    blocks = -(-m // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[:m] = rank
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = m - w + 1
    chosen = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = bytetext.ranges(offsets[:-1], sizes)  # windows that lie within one text
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return owner[at], place[at], starts[at], starts[last], hashes[place[at]]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _spot(place, first, last) -> np.ndarray:
    """An anchor's place, how far before it its first window starts, and how many more windows there are, as one number."""
    return (place << 32) | ((place - first) << 16) | (last - first)


def _of_spot(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = spot >> 32
    first = place - ((spot >> 16) & 0xFFFF)
    return place, first, first + (spot & 0xFFFF)


def _anchors(batches, length: int, k: int):
    """A row for each anchor of each text. Places are counted from the text's beginning."""
    for batch in batches:
        data, offsets = bytetext.buffers(batch.column(1))
        for lo, hi in bytetext.chunks(offsets, TEXT_BLOCK):
            own = offsets[lo : hi + 1]
            text, place, first, last, key = anchors(data[own[0] : own[-1]], own - own[0], length, k)
            if len(text):
                base = (own - own[0])[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + lo)), pa.array(_signed(key)), pa.array(_spot(place - base, first - base, last - base))], ["doc", "anchor", "spot"])


def _units(batches, length: int, k: int):
    """A row for each different context of a batch of texts: its places, the first of them, and its bytes. Places whose
    bytes are not the anchor's belong to another text of the same doc number and are left out."""
    digest, task, count = xxhash.xxh3_64_intdigest, TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = (batch.column(c).to_numpy() for c in (0, 1))
        data, offsets = bytetext.buffers(batch.column(2))
        times = np.ones(len(ids), np.int64)
        for r, told in enumerate(batch.column(4).to_pylist()):
            for t in told or ():
                if t["id"] == ids[r] and t["text_hash"] == texts[r]:
                    times[r] = 2 if t["first"] else 0
        lists = batch.column(3)
        flat, at = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        anchor, spot = (flat.field(c).to_numpy() for c in ("anchor", "spot"))
        owner = np.repeat(np.arange(len(ids)), np.diff(at))
        place, first, last = _of_spot(spot)
        size = np.diff(offsets)[owner]
        sound = (last + length <= size) & (times[owner] > 0)
        for lo, hi in bytetext.chunks(offsets, TEXT_BLOCK):
            rows = np.arange(at[lo], at[hi])[sound[at[lo] : at[hi]]]
            start = offsets[owner[rows]] + place[rows] - offsets[lo]
            sums = bytetext.prefix_sums(data[offsets[lo] : offsets[hi]])
            sound[rows] = _signed(bytetext.span_hash(sums, start, start + k)) == anchor[rows]
        rows = np.flatnonzero(sound)
        if not len(rows):
            continue
        view = memoryview(np.ascontiguousarray(data))
        start, end = (offsets[owner[rows]] + first[rows]).tolist(), (offsets[owner[rows]] + last[rows] + length).tolist()
        context = _signed(np.fromiter((digest(view[a:b], c) for a, b, c in zip(start, end, (place[rows] - first[rows]).tolist())), np.uint64, len(rows)))
        order = np.lexsort((spot[rows], texts[owner[rows]], ids[owner[rows]], context, anchor[rows]))
        rows, context = rows[order], context[order]
        new = np.ones(len(rows), bool)
        new[1:] = (context[1:] != context[:-1]) | (anchor[rows[1:]] != anchor[rows[:-1]])
        heads = np.append(np.flatnonzero(new), len(rows))
        total = np.add.reduceat(times[owner[rows]], heads[:-1])
        whose = owner[rows]
        for lo in range(0, len(heads) - 1, UNITS):
            part = heads[lo : lo + UNITS + 1]
            one, many = part[:-1], slice(part[0], part[-1])
            cut = pa.array((part - part[0]).astype(np.int32))
            blobs = pa.array([bytes(view[start[order[i]] : end[order[i]]]) for i in one.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(one), (task << 32) + count)), pa.array(anchor[rows[one]]), pa.array(context[one]), pa.array(total[lo : lo + len(one)]), pa.array(ids[whose[one]]), pa.array(texts[whose[one]]), pa.array(spot[rows[one]])]
                + [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids[whose[many]], texts[whose[many]], spot[rows[many]])]
                + [blobs],
                _UNIT_NAMES,
            )
        count += 1


_UNIT_NAMES = ["batch", "anchor", "context", "times", "id", "text_hash", "spot", "ids", "texts", "spots", "bytes"]
_UNITS = "batch bigint, anchor bigint, context bigint, times bigint, id bigint, text_hash bigint, spot bigint, ids array<bigint>, texts array<bigint>, spots array<bigint>, bytes binary"
_WINDOWS = "array<struct<low:int,high:int>>"
_FOUND = f"id bigint, text_hash bigint, windows {_WINDOWS}"


def _window_lists(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> pa.ListArray:
    pairs = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["low", "high"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs)


def _tell(table: pa.Table, keep_first: bool):
    """For each text of a batch, the windows of its contexts that have several places (all but the first place)."""
    at = bounds(table, ["batch"])
    for lo, hi in zip(at[:-1], at[1:]):
        rows = table.slice(lo, hi - lo).combine_chunks()
        lists = [rows.column(c).combine_chunks() for c in ("ids", "texts", "spots")]
        unit = np.repeat(np.arange(hi - lo), np.diff(np.asarray(lists[0].offsets)))
        ids, texts, spots = (x.flatten().to_numpy() for x in lists)
        if keep_first:
            one = [rows.column(c).to_numpy()[unit] for c in ("one_id", "one_text", "one_spot")]
            own = np.flatnonzero((ids != one[0]) | (texts != one[1]) | (spots != one[2]))
            ids, texts, spots = ids[own], texts[own], spots[own]
        if not len(ids):
            continue
        order = np.lexsort((spots, texts, ids))
        ids, texts = ids[order], texts[order]
        _, first, last = _of_spot(spots[order])
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
        heads = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(texts[heads]), _window_lists(first, last, np.append(heads, len(ids)))], ["id", "text_hash", "windows"])


def suffix_order(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order and the rank of each place by its first ``length`` bytes (place order between equals).
    Prefix doubling from 8 bytes; the last step overlaps. Places whose context ends sooner (``ends``: its end) rank alone."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for b in range(8):
        key = (key << np.uint64(8)) | padded[b : b + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    known = 8
    whole = np.flatnonzero(ends - np.arange(n) >= length)
    while known < length:
        step = min(known, length - known)
        follow = np.zeros(n, np.uint64)
        follow[: max(0, n - step)] = rank[step:]
        known += step
        rank = np.unique((rank << np.uint64(32)) | follow, return_inverse=True)[1].astype(np.uint64)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, the nearest position before it that has a smaller one, or -1. Pointers jump over pointers: all
    between a pointer's end and its start is larger than the start."""
    at = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[values[at[todo]] > values[todo]]):
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the previous and of the next smaller value, or -1."""
    after = smaller_before(values[::-1])[::-1]
    return smaller_before(values), np.where(after >= 0, len(values) - 1 - after, -1)


def previous_factors(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in suffix order, an earlier place whose match is as long as the rank tells, or -1: the
    longest-previous-factor array, cut off at that length. The longest match with any earlier place stands at the
    previous or at the next smaller place in suffix order."""
    earlier = np.full(len(order), -1)
    for at in smaller_neighbours(order):
        own = np.flatnonzero(at >= 0)
        own = own[rank[order[at[own]]] == rank[order[own]]]
        earlier[own] = order[at[own]]
    return earlier


def _repeats(table: pa.Table, length: int, keep_first: bool):
    """Runs of windows of each context that occur at an earlier place too, or (unless the first stays) at any other."""
    at = bounds(table, ["anchor"])
    blob, begins = bytetext.buffers(table.column("bytes").combine_chunks())
    ids, texts, starts = (table.column(c).to_numpy() for c in ("id", "text_hash", "first"))
    wanted = np.ones(len(ids), bool) if keep_first else table.column("times").to_numpy() == 1
    lo = 0
    while lo < len(at) - 1:  # as many anchors as fill a suffix array
        hi = max(lo + 1, int(np.searchsorted(begins[at], begins[at[lo]] + SUFFIX_BLOCK, "right")) - 1)
        rows, base = np.arange(at[lo], at[hi]), begins[at[lo]]
        data = blob[base : begins[at[hi]]]
        first, ends = begins[rows] - base, begins[rows + 1] - base
        owner = np.repeat(np.arange(len(rows)), ends - first)
        order, rank = suffix_order(data, ends[owner], length)
        earlier = previous_factors(order, rank)
        repeats = np.zeros(len(data), bool)
        repeats[order[earlier >= 0]] = True
        if not keep_first:
            repeats[earlier[earlier >= 0]] = True
        repeats &= wanted[rows][owner]
        runs_at = np.flatnonzero(repeats)
        if len(runs_at):
            new = np.ones(len(runs_at), bool)
            new[1:] = (runs_at[1:] != runs_at[:-1] + 1) | (owner[runs_at[1:]] != owner[runs_at[:-1]])
            heads = np.flatnonzero(new)
            low, high = runs_at[heads], runs_at[np.append(heads[1:], len(runs_at)) - 1]
            which = owner[low]
            shift = starts[rows[which]] - first[which]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[which]]), pa.array(texts[rows[which]]), pa.array((low + shift).astype(np.int32)), pa.array((high + shift).astype(np.int32))], ["id", "text_hash", "low", "high"])
        lo = hi


def _split(batches, length: int, width: int):
    """Cuts contexts into pieces of at most ``width`` neighbouring windows, by the windows' distance from the anchor. A
    piece's core is what all windows of its range share; any text that has a window of the range has it."""
    digest = xxhash.xxh3_64_intdigest
    names = ["anchor", "id", "text_hash", "times", "first", "last", "place", "bytes"]
    for batch in batches:
        out: list[tuple] = []
        for anchor, id_, text, times, first, last, place, body in zip(*(batch.column(c).to_pylist() for c in names)):
            view = memoryview(body)
            for part in range((place - last) // width, (place - first) // width + 1):
                near, far = part * width, part * width + width - 1  # distances of the range
                low, high = max(first, place - far), min(last, place - near)
                core = digest(view[place - near - first : place - far - first + length])
                own = view[low - first : high - first + length]
                out.append((anchor, part, core, digest(own, place - low), id_, text, times, low, high, place, bytes(own) if width > 1 else b""))
        if out:
            columns = [*zip(*out)]
            kinds = [pa.int64(), pa.int32(), pa.uint64(), pa.uint64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2], arrays[3] = (pa.array(np.asarray(x).view(np.int64)) for x in arrays[2:4])
            yield pa.RecordBatch.from_arrays(arrays, _PIECE_NAMES)


_PIECE_NAMES = ["anchor", "part", "core", "whole", "id", "text_hash", "times", "first", "last", "place", "bytes"]
_PIECES = "anchor bigint, part int, core bigint, whole bigint, id bigint, text_hash bigint, times bigint, first int, last int, place int, bytes binary"


def narrowed(contexts: DataFrame, scratch: Scratch, length: int, keep_first: bool, widths: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """Runs of repeated windows among contexts of anchors that have too many. Contexts are cut into ever narrower pieces.
    Pieces that agree in all bytes repeat; those whose core no other has hold no repeated window; only what agrees in
    its core but not in all bytes is cut again. At one window both are the same. Counts are partial sums."""
    rows, found = contexts, None
    for level, width in enumerate(widths):
        pieces = scratch.table(rows.mapInArrow(lambda b, w=width: _split(b, length, w), _PIECES), f"pieces{level}")
        keys = ["anchor", "part", "core", "whole"]
        kinds = scratch.table(pieces.groupBy(*keys).agg(F.sum("times").alias("total"), F.min(F.struct(*_PLACE)).alias("one")), f"piece_kinds{level}")
        cores = kinds.groupBy(*keys[:3]).agg(F.count(F.lit(1)).alias("wholes"), F.min("total").alias("rarest"))
        cores = scratch.table(cores.where("wholes > 1" if keep_first else "wholes > 1 and rarest = 1").select(*keys[:3], F.lit(True).alias("again")), f"cores{level}")
        decided = scratch.table(kinds.join(cores, keys[:3], "left").where("total > 1 or again"), f"decided{level}")
        first = F.struct(*_PLACE) == F.col("one")
        told = scratch.table(pieces.join(decided, keys), f"told{level}")
        repeats = told.where(F.col("total") > 1).where(~first if keep_first else F.col("times") == 1).select("id", "text_hash", F.col("first").alias("low"), F.col("last").alias("high"))
        repeats = scratch.table(repeats, f"repeats{level}")
        found = repeats if found is None else found.unionByName(repeats)
        rows = scratch.table(told.where("again").where(first).select("anchor", "id", "text_hash", F.col("total").alias("times"), "first", "last", "place", "bytes"), f"rows{level}")
        scratch.drop(*(f"{n}{level}" for n in ("pieces", "piece_kinds", "cores", "decided", "told")), *([f"rows{level - 1}"] if level else []))
    return found


_PLACE = ("id", "text_hash", "first")


def _copies(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """id, text_hash, size and rows of all texts of at least ``length`` bytes that occur in several rows; first: of the
    smallest id."""
    size = F.octet_length("text").alias("size")
    texts = docs.select("id", "text_hash", F.xxhash64(F.lit(7), "text").alias("text_hash_b"), size).where(F.col("size") >= length)
    places = scratch.table(texts.groupBy("id", "text_hash", "text_hash_b", "size").agg(F.count(F.lit(1)).alias("rows")), "places")
    same = ["text_hash", "text_hash_b", "size"]
    several = scratch.table(places.groupBy(*same).agg(F.min("id").alias("least"), F.sum("rows").alias("all")).where(F.col("all") > 1).drop("all"), "several")
    found = places.join(several, same).select("id", "text_hash", "size", "rows", (F.col("id") == F.col("least")).alias("first"))
    found = scratch.table(found, "copies")
    scratch.drop("places", "several")
    return found


def repeated_windows(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR, max_contexts: int = MAX_CONTEXTS, keep_first: bool = False) -> DataFrame:
    """id, text_hash, and runs of window starts (low to high) that occur more than once. twin: of rows equal in id and
    text one is to stay. docs: id, text_hash, text."""
    doc = F.xxhash64("id", "text_hash").alias("doc")
    copies = _copies(docs, scratch, length)
    spots = scratch.table(docs.select(doc, "text").mapInArrow(lean(lambda b: _anchors(b, length, k)), "doc bigint, anchor bigint, spot bigint"), "spots")
    often = scratch.table(spots.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    lists = scratch.table(spots.join(often, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "spot")).alias("held")), "lists")
    scratch.drop("spots", "often")
    told = copies.groupBy(doc).agg(F.collect_set(F.struct("id", "text_hash", "first")).alias("copies"))
    lists = scratch.table(lists.join(told, "doc", "left"), "lists_told")
    maybe = sieve(lists, ["doc"], scratch, "listed")
    texts = maybe(docs.withColumn("doc", doc), "maybe", "doc").where("maybe").join(lists, "doc").select("id", "text_hash", "text", "held", "copies")
    units = scratch.table(texts.mapInArrow(lean(lambda b: _units(b, length, k)), _UNITS), "units")
    scratch.drop("lists", "lists_told")

    kinds = scratch.table(units.groupBy("anchor", "context").agg(F.sum("times").alias("total"), F.min(F.struct("id", "text_hash", "spot")).alias("one")), "kinds")
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("total").alias("rarest"))
    mixed = scratch.table(per.where("contexts > 1" if keep_first else "contexts > 1 and rarest = 1").select("anchor", (F.col("contexts") > max_contexts).alias("hot")), "mixed")
    wanted = kinds.join(mixed, "anchor").select("anchor", "context", F.col("total").alias("times"), "hot", "one.*")
    at = ["anchor", "context", "id", "text_hash", "spot"]
    place, ahead = F.shiftright("spot", 32), F.shiftright("spot", 16).bitwiseAND(0xFFFF)
    first = (place - ahead).cast("int")
    # rows equal in id and text may have sent the same place twice
    parts = units.select(*at, "bytes").join(scratch.table(wanted, "wanted"), at).groupBy(*at, "times", "hot").agg(F.any_value("bytes").alias("bytes"))
    parts = parts.select("anchor", "id", "text_hash", "times", "hot", first.alias("first"), (first + F.col("spot").bitwiseAND(0xFFFF)).cast("int").alias("last"), place.cast("int").alias("place"), "bytes")
    parts = scratch.table(parts, "contexts")
    near = by_group(parts.where("not hot"), ["anchor"], lambda t: _repeats(t, length, keep_first), "id bigint, text_hash bigint, low int, high int", few=4096, then=_PLACE)
    near = scratch.table(near, "near")
    hot = narrowed(parts.where("hot").drop("hot"), scratch, length, keep_first)
    scratch.drop("mixed", "wanted", "contexts")

    several = kinds.where("total > 1").select("anchor", "context", *(F.col(f"one.{a}").alias(b) for a, b in (("id", "one_id"), ("text_hash", "one_text"), ("spot", "one_spot"))))
    held = units.select("batch", "anchor", "context", "ids", "texts", "spots").join(scratch.table(several, "several_places"), ["anchor", "context"])
    classes = scratch.table(by_group(held, ["batch"], lambda t: _tell(t, keep_first), _FOUND), "classes")
    scratch.drop("units", "kinds", "several_places")

    window = lambda low, high: F.array(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))).alias("windows")
    not_twin = F.lit(False).alias("twin")
    found = classes.select("*", not_twin).unionByName(near.unionByName(hot).select("id", "text_hash", window(F.col("low"), F.col("high")), not_twin))
    gone = copies.where(~F.col("first")) if keep_first else copies
    found = found.unionByName(gone.select("id", "text_hash", window(F.lit(0), F.col("size") - length), not_twin))
    if keep_first:
        twins = copies.where(F.col("first") & (F.col("rows") > 1))
        found = found.unionByName(twins.select("id", "text_hash", F.expr(f"cast(array() as {_WINDOWS})").alias("windows"), F.lit(True).alias("twin")))
    # a set, as rows equal in id and text tell the same
    return found.groupBy("id", "text_hash").agg(F.flatten(F.collect_set("windows")).alias("windows"), F.max("twin").alias("twin"))


def _merge(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes that windows low..high cover."""
    order = np.argsort(low, kind="stable")
    start, end = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64) + length)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist()))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False) -> tuple[DataFrame, str]:
    """All rows of docs with one column more, the runs of bytes to remove (an array of start and end), and its name."""
    need(docs, key, text)
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    own_key, own_text = F.coalesce(docs[key].cast("long"), F.lit(-(2**63))), F.xxhash64(docs[text])  # a null id is a place like others
    found = repeated_windows(docs.select(own_key.alias("id"), own_text.alias("text_hash"), docs[text].alias("text")), scratch, length, keep_first=keep_first)

    def merged(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
            out = [[{"start": a, "end": b} for a, b in _merge(low[s:e], high[s:e], length)] if e > s else None for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), batch.column(3)], ["id", "text_hash", "runs", "twin"])

    k, h, id_, hash_, cuts, twin, row, least, maybe = new_names(docs, "k", "h", "id", "hash", "runs", "twin", "row", "least", "maybe")
    spans = scratch.table(found.mapInArrow(merged, "id bigint, text_hash bigint, runs array<struct<start:int,end:int>>, twin boolean"), "runs").toDF(id_, hash_, cuts, twin)
    scratch.drop("copies", "classes", "near", *(f"repeats{i}" for i in range(3)))
    both = docs.withColumns({k: own_key, h: own_text})
    both = sieve(spans, [id_, hash_], scratch, "cut")(both, maybe, k, h)
    asked = both.where(F.col(maybe)).drop(maybe)
    joined = asked.join(spans, (asked[k] == spans[id_]) & (asked[h] == spans[hash_]), "left").drop(id_, hash_)
    rest = both.where(~F.col(maybe)).drop(maybe).withColumns({cuts: F.lit(None).cast(spans.schema[cuts].dataType), twin: F.lit(None).cast("boolean")})
    joined = joined.unionByName(rest)
    if not keep_first or spans.where(F.col(twin)).isEmpty():
        return joined.drop(k, h, twin), cuts
    # of rows equal in id and text, the one of the smallest number stays
    is_twin = F.coalesce(F.col(twin), F.lit(False))
    twins = scratch.table(joined.where(is_twin).withColumn(row, F.monotonically_increasing_id()), "twins")
    ones = scratch.table(twins.groupBy(k, h).agg(F.min(row).alias(row)), "first_twins")
    ones = ones.toDF(id_, hash_, least)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(F.col(text)).alias("end")))
    stay = twins.join(ones, (twins[k] == ones[id_]) & (twins[h] == ones[hash_]))
    stay = stay.withColumn(cuts, F.when(F.col(row) == F.col(least), F.col(cuts)).otherwise(whole)).drop(id_, hash_, least, row)
    return joined.where(~is_twin).unionByName(stay).drop(k, h, twin), cuts


def kept_bytes(body: bytes, cuts) -> bytes:
    out, upto = [], 0
    for c in cuts or ():
        out.append(body[upto : c["start"]])
        upto = c["end"]
    return b"".join([*out, body[upto:]])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found, cuts = runs(docs.select(key, text), key, text, length)

    def told(batches):
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sizes, removed, count, digest = [], [], [], []
            for t, s in zip(texts, spans):
                body = (t or "").encode()
                kept = kept_bytes(body, s)
                sizes.append(len(body))
                removed.append(len(body) - len(kept))
                count.append(len(s or ()))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = found.select(F.col(key).cast("long").alias("k"), text, cuts)
    return rows.mapInArrow(told, "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("k", key)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """The rows of docs with later copies of long strings cut out of their texts. Cuts shrink to whole characters."""
    found, spans = runs(docs, key, text, length, keep_first)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            body = t.encode()
            whole = lambda i: i == len(body) or body[i] & 0xC0 != 0x80
            cuts = []
            for c in s:
                a, b = c["start"], c["end"]
                while not whole(a):
                    a += 1
                while not whole(b):
                    b -= 1
                cuts.append({"start": a, "end": b})
            out.append(kept_bytes(body, cuts).decode())
        return pd.Series(out, dtype=object)

    return found.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(spans)))).select(*docs.columns)
