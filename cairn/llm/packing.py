"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Documents become tokens and an end mark each; only those longer than a sequence are cut, into pieces as long as a
sequence, of which the first may be shorter. Then, in rounds: each partition packs its items best-fit, the largest
first, and emits nearly full bins; the underfull bins become items of the next, smaller round. A bin's row carries its
pieces, at most as many as a sequence has tokens. The rounds end at one partition, or when a round leaves so many
underfull bins that fewer partitions can't hold them: those then have no partners.

Tokens are found once for each distinct run of white space and word in a block of text. This is exact because the
tokenizer's own pre-tokens never depend on what stands before such a run or after it; texts with white space beyond
ASCII go to the tokenizer whole.

Defined results: a null or empty text is its end mark alone; repeated rows are packed like others; an empty table
gives an empty result. Columns of docs beside key and text are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, need, tune

SEQUENCE = 2048
ITEMS_PER_TASK = 50_000
CLOSE_AT = 4  # a bin with this many free tokens or fewer is full
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_encoders: dict = {}


class UnitEncoder:
    """Ids of texts; remembers the ids of units, up to a bound."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None, most: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.encode_special_tokens = True
        self.unit = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.unit = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [self.unit(t) for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        at = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, flat])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin."""
        space = ~bytetext.NOT_SPACE[data]
        starts = np.zeros(len(data), bool)
        starts[1:] = space[1:] & ~space[:-1]
        starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        hashes = bytetext.span_hash(bytetext.prefix_sums(data), starts, ends)
        distinct, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self.forget()
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        if not known.all():
            raw, new = data.tobytes(), some[~known]
            self._learn(distinct[~known], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in new])
            slot = np.searchsorted(self.keys, distinct)
        at, size = self.at[slot][which], self.size[slot][which]
        ids = self.ids[bytetext.ranges(at, size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, upto[np.searchsorted(starts, offsets)]


def _pieces(batches, json_path, ranks_path, pattern, limit):
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(json_path, ranks_path, pattern)
    encoder = _encoders[key]
    for batch in batches:
        doc, all_data, all_offsets = batch.column(0), *bytetext.buffers(batch.column(1))
        rows, piece, start, length, crc = [], [], [], [], []
        for lo, hi in bytetext.chunks(all_offsets, 1 << 20):
            offsets = all_offsets[lo : hi + 1]
            data, offsets = all_data[offsets[0] : offsets[-1]], offsets - offsets[0]
            ids, begins = encoder.encode(data, offsets)
            odd = {}
            if found := [m.start() for m in _OTHER_SPACE.finditer(data)]:
                for k in np.unique(np.searchsorted(offsets, found, "right") - 1):
                    odd[int(k)] = np.array(encoder.whole.encode(bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            for k in range(hi - lo):
                own = np.append(odd[k] if k in odd else ids[begins[k] : begins[k + 1]], np.uint32(0)).astype("<u4", copy=False)
                cut = 0
                for p in range(-(-len(own) // limit)):
                    end = cut + (len(own) - 1) % limit + 1 if p == 0 else cut + limit
                    rows.append(lo + k)
                    piece.append(p)
                    start.append(cut)
                    length.append(end - cut)
                    crc.append(zlib.crc32(own[cut:end].tobytes()))
                    cut = end
        yield pa.RecordBatch.from_arrays(
            [doc.take(pa.array(rows, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, limit: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece. ranks_path: the same vocabulary for the faster library."""
    need(docs, key, text)
    tune(docs.sparkSession)
    chosen = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return chosen.mapInArrow(lambda b: _pieces(b, json_path, ranks_path, pattern, limit), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins as lists of item numbers: the largest item first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by free room
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = limit, len(bins)
            bins.append([i])
        stacks[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def _round(batches, number: int, limit: int, last: bool):
    """Packs a partition's bins; a bin leaves when nearly full or in the last round."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    sizes = table.column("size").combine_chunks().to_numpy()
    members = table.column("members").combine_chunks()
    bins = best_fit(sizes, limit)
    order = pa.array([i for b in bins for i in b], pa.int64())
    taken = members.take(order)
    flat = taken.flatten()
    counts = np.diff(np.asarray(taken.offsets))
    per_bin = np.add.reduceat(counts, np.cumsum([0] + [len(b) for b in bins[:-1]]))
    ends = np.concatenate([[0], np.cumsum(per_bin)])
    lengths = flat.field("length").to_numpy()
    before = np.cumsum(lengths) - lengths
    offset = before - np.repeat(before[ends[:-1]], per_bin)
    filled = pa.StructArray.from_arrays([flat.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "offset"])
    size = np.add.reduceat(lengths, ends[:-1])
    full = np.ones(len(bins), bool) if last else size >= limit - CLOSE_AT
    names = (np.int64(number) << 56) + (np.int64(TaskContext.get().partitionId()) << 32) + np.arange(len(bins))
    step = 2000
    for lo in range(0, len(bins), step):
        hi = min(lo + step, len(bins))
        lists = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), filled[ends[lo] : ends[hi]])
        yield pa.RecordBatch.from_arrays([pa.array(size[lo:hi]), lists, pa.array(full[lo:hi]), pa.array(names[lo:hi])], ["size", "members", "closed", "sequence_id"])


def pack(items: DataFrame, limit: int = SEQUENCE, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """items: the columns of pieces(), of lengths up to limit. Adds sequence_id and offset."""
    scratch = Scratch(items.sparkSession, "pack")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = scratch.table(items.select(*columns), "pieces")
    done = [items.where(F.col("length") >= limit).select(*columns, (F.monotonically_increasing_id() + F.lit(127 << 56)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    bins = items.where(F.col("length") < limit).select(F.col("length").alias("size"), F.array(F.struct(*columns, F.lit(0).cast("long").alias("offset"))).cast(f"array<{_MEMBER}>").alias("members"))
    left, parts, number = bins.count(), None, 0
    while left:
        wanted = -(-left // items_per_task)
        last = wanted == 1 or (parts is not None and wanted >= parts)
        parts = wanted
        packed = scratch.table(
            bins.repartition(parts).mapInArrow(lambda b, n=number, e=last: _round(b, n, limit, e), f"size bigint, members array<{_MEMBER}>, closed boolean, sequence_id bigint"),
            f"round{number}",
        )
        done.append(packed.where("closed").select("sequence_id", F.inline("members")).select(*columns, "sequence_id", "offset"))
        bins, number = packed.where("not closed").select("size", "members"), number + 1
        left = 0 if last else bins.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, limit: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(pieces(docs, json_path, ranks_path, pattern, limit, key, text), limit)
