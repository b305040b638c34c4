"""Scores texts by an interpolated modified Kneser-Ney bigram model.

Counting: tasks count words, then word pairs, of their learning texts and send sorted, packed arrays to the part that
owns them; parts merge them. How many parts there are follows the data. Words are owned by the upper bits of their
hash, so that the parts' sorted hash arrays make one sorted vocabulary, in which a word's place is its number. Pairs are
owned by the number of the first word; the pairs of very frequent first words, of which there are fewer than parts, are
spread by both words. Parts write their arrays to the shared folder, once and under their final name only when whole, so
that a repeated task changes nothing. Counts are 64-bit numbers; a part whose counts fit is stored with 32 bits.

Scoring: workers map the arrays into memory and look up the pairs of a block of texts in sorted order.

    p(w | v) = max(c(v,w) - D, 0) / c(v) + g(v) * q(w)        q(w) = max(a(w) - D', 0) / A + g' / (V + 1)

a(w): how many different words come before w; A: their sum. D and D' depend on the count (1, 2, 3 or more), and g and
g' are what the discounts set free. A text begins after a start mark and ends with an end mark, which counts as a token.

The order is two; the README gives the figures of order three.

Defined results: a null or empty text has the end mark alone; with nothing to learn from, every token has probability
1 / (V + 1) = 1. Repeated rows count and score like others; an empty table gives an empty result. Columns of docs beside
key and text are not read.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, lean, need, tune
from cairn.llm.groups import bounds, by_group

BYTES_PER_WORD_PART = 64 << 20  # of learning texts
MIN_WORD_BITS, MAX_WORD_BITS = 4, 16
TOKENS_PER_PART = 3_000_000
MAX_PAIR_PARTS = 1 << 16
BLOCK = 1 << 19
HELD = 1_500_000  # pairs that a counting task holds before it sends them
END = np.uint64(0x0123456789ABCDEF)
_codec = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; sorted keys go in as differences."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True) if raw else b""


def unpack(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_codec.decompress(blob[8:], decompressed_size=size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def by_part(keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by part and key, and where in it another pair of both begins. Parts are 16-bit numbers, which numpy
    sorts by their digits."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(parts[order], kind="stable")]
    keys, parts = keys[order], parts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
    return order, np.flatnonzero(new)


class Counter:
    """Counts pairs of a key and a part in memory up to a bound."""

    def __init__(self):
        self.keys, self.parts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
        self.fresh, self.waiting = [], 0

    def add(self, keys: np.ndarray, parts: np.ndarray) -> None:
        self.fresh.append((keys, parts))
        self.waiting += len(keys)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        keys, parts = (np.concatenate(c) for c in zip((self.keys, self.parts), *self.fresh))
        counts = np.concatenate([self.counts, np.ones(self.waiting, np.int64)])
        order, at = by_part(keys, parts)
        self.keys, self.parts = keys[order[at]], parts[order[at]]
        self.counts = np.add.reduceat(counts[order], at) if len(at) else counts
        self.fresh, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.keys) > HELD

    def send(self):
        """Rows with all counts, after which it is empty."""
        self.settle()
        out = self.parts.astype(np.int64), self.keys, self.counts
        self.__init__()
        return _send(*out)


def _tokens(column: pa.Array):
    """Blocks of texts: hashes of all tokens with an end mark after each text, and each text's first token."""
    data, offsets = bytetext.buffers(column)
    for lo, hi in bytetext.chunks(offsets, BLOCK):
        own = offsets[lo : hi + 1]
        hashes, first = bytetext.word_hashes(data[own[0] : own[-1]], own - own[0], bytetext.NOT_SPACE)
        begin = first + np.arange(len(first))
        out = np.full(begin[-1], END, np.uint64)
        out[np.arange(len(hashes)) + np.repeat(np.arange(hi - lo), np.diff(first))] = hashes
        yield out, begin


def _send(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """A row for each part, with its sorted keys and their counts."""
    order = np.argsort(parts, kind="stable")
    parts, keys, counts = parts[order], keys[order], counts[order].astype(np.uint64)
    at = np.append(np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])), len(parts)) if len(parts) else np.zeros(1, int)
    for lo in range(0, len(at) - 1, 32):
        spans = list(zip(at[lo : lo + 32], at[lo + 1 : lo + 33]))
        yield pa.RecordBatch.from_arrays([pa.array([int(parts[a]) for a, _ in spans], pa.int64()), pa.array([pack(_differences(keys[a:b])) for a, b in spans], pa.binary()), pa.array([pack(counts[a:b]) for a, b in spans], pa.binary())], ["part", "keys", "counts"])


_SENT = "part bigint, keys binary, counts binary"


def _received(table: pa.Table):
    """Each part with its merged keys and counts."""
    at = bounds(table, ["part"])
    for lo, hi in zip(at[:-1], at[1:]):
        rows = table.slice(lo, hi - lo)
        keys = [np.cumsum(unpack(b, np.uint64)).astype(np.uint64) for b in rows.column("keys").to_pylist()]
        counts = [unpack(b, np.uint64).astype(np.int64) for b in rows.column("counts").to_pylist()]
        yield int(rows.column("part")[0].as_py()), *merge(np.concatenate(keys), np.concatenate(counts))


def _write(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{os.getpid()}.{np.random.randint(1 << 30)}"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(values).tobytes())
    os.replace(part, f"{folder}/{name}")


def _map(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def _write_counts(folder: str, name: str, values: np.ndarray) -> None:
    """Under a name that tells the width, the least that holds the values."""
    wide = len(values) and int(values.max()) >= 1 << 32
    _write(folder, f"{name}.{8 if wide else 4}", values.astype(np.uint64 if wide else np.uint32))


def _map_counts(folder: str, name: str) -> np.ndarray:
    wide = _map(folder, f"{name}.8", np.uint64)
    return wide if len(wide) else _map(folder, f"{name}.4", np.uint32)


class Words:
    """The vocabulary's sorted hashes, mapped when first needed."""

    def __init__(self, folder: str, starts: np.ndarray):
        self.folder, self.starts, self.parts = folder, starts, {}
        self.shift = np.uint64(65 - len(starts).bit_length())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones. hashes: sorted."""
        out = np.full(len(hashes), -1)
        at = np.searchsorted(hashes >> self.shift, np.arange(len(self.starts), dtype=np.uint64))
        for p in np.flatnonzero(np.diff(at)):
            if p not in self.parts:
                self.parts[p] = _map(self.folder, f"hash-{p}", np.uint64)
            own, asked = self.parts[p], hashes[at[p] : at[p + 1]]
            if len(own):
                slot = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                out[at[p] : at[p + 1]] = np.where(own[slot] == asked, slot + self.starts[p], -1)
        return out

    def number(self, tokens: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(tokens, return_inverse=True)
        return self.find(distinct)[which]


class Layout:
    """Which part has a pair, and the pair's key there. A part numbers the first words that it owns, and after them the
    frequent ones, so that a key has room for any vocabulary: a part owns few words if there are many."""

    def __init__(self, types: int, parts: int, hot: np.ndarray):
        self.parts, self.hot, self.bits = parts, hot, np.uint64(types.bit_length())
        self.own = types // parts + 1

    def place(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and parts."""
        part, local = v % self.parts, v // self.parts
        if len(self.hot):
            slot = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            is_hot = self.hot[slot] == v
            spread = bytetext.mix(bytetext.mix(v.astype(np.uint64)) + w.astype(np.uint64)) % np.uint64(self.parts)
            part, local = np.where(is_hot, spread.astype(np.int64), part), np.where(is_hot, self.own + slot, local)
        return (local.astype(np.uint64) << self.bits) | w.astype(np.uint64), part.astype(np.uint16)

    def words(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second words of a part's keys."""
        local = (keys >> self.bits).astype(np.int64)
        v = local * self.parts + part
        hot = local >= self.own
        v[hot] = self.hot[local[hot] - self.own]
        return v, (keys & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many have a count of 1, 2, 3 and 4; fixed ones where those can't tell."""
    if min(n[:4]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), found))


class Model:
    """What a worker needs to score; everything large is mapped from the shared folder."""

    def __init__(self, folder, starts, layout, tokens, types, texts, pair_types, pair_d, word_d, free):
        self.folder, self.starts, self.layout = folder, starts, layout
        self.tokens, self.types, self.texts, self.pair_types = tokens, types, texts, pair_types
        self.pair_d, self.word_d, self.free = np.array([0.0, *pair_d]), np.array([0.0, *word_d]), free
        self.words = self.maps = self.pairs = None

    def __getstate__(self):
        return self.__dict__ | {"words": None, "maps": None, "pairs": None}

    def open(self) -> None:
        if self.words is None:
            self.words, self.maps, self.pairs = Words(self.folder, self.starts), {}, {}

    def column(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = _map_counts(self.folder, name)
        return self.maps[name]

    def of_words(self, ids: np.ndarray, name: str) -> np.ndarray:
        """Values of distinct sorted word numbers (the start mark has the number after the last word)."""
        out = np.zeros(len(ids))
        at = np.searchsorted(ids, self.starts)
        at[-1] = len(ids)
        at[0] = np.searchsorted(ids, 0)
        for p in np.flatnonzero(np.diff(at)):
            out[at[p] : at[p + 1]] = self.column(f"{name}-{p}")[ids[at[p] : at[p + 1]] - self.starts[p]]
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs of known words."""
        keys, parts = self.layout.place(v, w)
        order, at = by_part(keys, parts)
        keys, parts = keys[order[at]], parts[order[at]]
        found, ends = np.zeros(len(at)), np.searchsorted(parts, np.arange(self.layout.parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            own, asked = slice(ends[p], ends[p + 1]), keys[ends[p] : ends[p + 1]]
            if p not in self.pairs:
                self.pairs[p] = _map(self.folder, f"pair-{p}", np.uint64)
            have = self.pairs[p]
            if len(have):
                slot = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                found[own] = np.where(have[slot] == asked, self.column(f"times-{p}")[slot], 0)
        out = np.zeros(len(order))
        out[order] = np.repeat(found, np.diff(np.append(at, len(order))))
        return out

    def score(self, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        self.open()
        ids = self.words.number(tokens)
        distinct, which = np.unique(ids, return_inverse=True)
        count = self.of_words(distinct, "count")
        before_kinds = self.of_words(distinct, "before")
        n = np.diff(begin)
        v = np.empty(len(ids), np.int64)
        v[1:] = ids[:-1]
        v[begin[:-1]] = self.types
        q = np.maximum(before_kinds - self.word_d[np.minimum(before_kinds, 3).astype(int)], 0) / max(1, self.pair_types) + self.free / (self.types + 1)
        contexts, context = np.unique(v, return_inverse=True)
        follow = self.of_words(contexts, "count")
        follow[contexts == self.types] = self.texts
        freed = sum(self.pair_d[k] * self.of_words(contexts, f"after{k}") for k in (1, 2, 3))
        seen = follow > 0
        gamma = np.where(seen, freed / np.maximum(follow, 1), 1.0)
        p = gamma[context] * q[which]
        known = (ids >= 0) & seen[context]
        c = self.pair_counts(v[known], ids[known])
        c = np.maximum(c - self.pair_d[np.minimum(c, 3).astype(int)], 0)
        p[known] += c / follow[context[known]]
        sums = lambda x: np.add.reduceat(x, begin[:-1]) if len(n) else x  # noqa: E731  every text has a token
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        return n, sums((count > 0)[which].astype(np.int64)), sums(base[which]), sums(np.log10(p))


def local_folder(path: str) -> str:
    """The path that workers open. Mapping needs a folder that all nodes have mounted."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model is mapped into memory; its folder has to be mounted on all nodes")
    return parsed.path


def train(docs: DataFrame, text: str = "text") -> Model:
    """Learns from all rows of docs."""
    need(docs, text)
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "kneser-ney")
    folder = local_folder(f"{scratch.path}/model")
    texts = docs.select(docs[text].alias("text"))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = min(MAX_WORD_BITS, max(MIN_WORD_BITS, (size // BYTES_PER_WORD_PART).bit_length()))
    word_parts, shift = 1 << word_bits, np.uint64(64 - word_bits)

    def count_words(batches):
        counter = Counter()
        for batch in batches:
            for tokens, _ in _tokens(batch.column(0)):
                counter.add(tokens, (tokens >> shift).astype(np.uint16))
                if counter.full():
                    yield from counter.send()
        yield from counter.send()

    def keep_words(table):
        for part, keys, counts in _received(table):
            _write(folder, f"hash-{part}", keys)
            _write_counts(folder, f"count-{part}", counts)
            ends = int(counts[keys == END].sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(keys), int(counts.sum()), ends)], ["part", "types", "tokens", "texts"])

    found = scratch.table(by_group(texts.mapInArrow(lean(count_words), _SENT), ["part"], keep_words, "part bigint, types bigint, tokens bigint, texts bigint", few=256), "words").collect()  # one row a part
    sizes = np.zeros(word_parts, np.int64)
    for r in found:
        sizes[r["part"]] = r["types"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    types, tokens, text_count = int(starts[-1]), sum(r["tokens"] for r in found), sum(r["texts"] for r in found)
    parts = int(min(MAX_PAIR_PARTS, max(1, -(-tokens // TOKENS_PER_PART))))

    def frequent(batches):
        """Words of more tokens than a part should have; fewer than there are parts."""
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at = np.flatnonzero(_map_counts(folder, f"count-{part}") > tokens / parts)
                yield pa.RecordBatch.from_arrays([pa.array(at + starts[part])], ["id"])

    marks = [types] if text_count > tokens / parts else []
    every = spark.createDataFrame([(r["part"],) for r in found], "part bigint") if found else None
    hot = np.array(sorted([r["id"] for r in every.mapInArrow(frequent, "id bigint").collect()] + marks) if found else [], np.int64)

    layout = Layout(types, parts, hot)

    def owner(ids: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(starts, ids, "right") - 1, word_parts - 1)

    def count_pairs(batches):
        counter, words = Counter(), Words(folder, starts)
        for batch in batches:
            for tokens_, begin in _tokens(batch.column(0)):
                ids = words.number(tokens_)
                v = np.empty(len(ids), np.int64)
                v[1:] = ids[:-1]
                v[begin[:-1]] = types
                counter.add(*layout.place(v, ids))
                if counter.full():
                    yield from counter.send()
        yield from counter.send()

    def keep_pairs(table):
        """Writes the part's pairs; sends on how many kinds come after each word, by count, and before each word."""
        for part, keys, counts in _received(table):
            _write(folder, f"pair-{part}", keys)
            _write_counts(folder, f"times-{part}", counts)
            v, w = layout.words(part, keys)
            for kind in (1, 2, 3):
                ids, n = np.unique(v[counts == kind if kind < 3 else counts >= 3], return_counts=True)
                for b in _send(owner(ids) * 4 + kind, ids.astype(np.uint64), n):
                    yield b.append_column("note", pa.nulls(b.num_rows, pa.list_(pa.int64())))
            ids, n = np.unique(w, return_counts=True)
            for b in _send(owner(ids) * 4, ids.astype(np.uint64), n):
                yield b.append_column("note", pa.nulls(b.num_rows, pa.list_(pa.int64())))
            note = [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([note], pa.list_(pa.int64()))], ["part", "keys", "counts", "note"])

    def keep_kinds(table):
        for part, ids, counts in _received(table):
            word_part, kind = divmod(part, 4)
            dense = np.zeros(int(sizes[word_part]) + (word_part == word_parts - 1), np.int64)
            dense[ids.astype(np.int64) - starts[word_part]] = counts
            _write_counts(folder, f"{'before' if not kind else f'after{kind}'}-{word_part}", dense)
            n = [int((counts == k).sum()) if not kind else 0 for k in (1, 2, 3, 4)]
            n.append(int((counts > 0).sum()) if not kind else 0)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.list_(pa.int64()))], ["part", "note"])

    def blank(batches):
        """Arrays of zeros for parts of which no word has such neighbours; those that exist stay."""
        for batch in batches:
            for p in batch.column(0).to_pylist():
                n = int(sizes[p]) + (p == word_parts - 1)
                for name in ("count", "before", "after1", "after2", "after3"):
                    have = np.array(_map_counts(folder, f"{name}-{p}")).astype(np.int64)
                    if len(have) < n:
                        _write_counts(folder, f"{name}-{p}", np.concatenate([have, np.zeros(n - len(have), np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["part"])

    pairs = scratch.table(by_group(texts.mapInArrow(lean(count_pairs), _SENT), ["part"], keep_pairs, f"{_SENT}, note array<bigint>", few=64), "kinds")
    notes = [r["note"] for r in pairs.where("part = -1").select("note").collect()]  # one row a part
    kinds = scratch.table(by_group(pairs.where("part >= 0").drop("note"), ["part"], keep_kinds, "part bigint, note array<bigint>", few=256), "neighbours").collect()  # four rows a part
    spark.range(word_parts).select(F.col("id").alias("part")).mapInArrow(blank, "part bigint").collect()
    scratch.drop("kinds", "neighbours", "words")
    pair_types = sum(n[0] for n in notes)
    pair_d = discounts([sum(n[k] for n in notes) for k in (1, 2, 3, 4)])
    word_n = [sum(r["note"][k] for r in kinds) for k in range(5)]
    word_d = discounts(word_n[:4])
    free = (word_d[0] * word_n[0] + word_d[1] * word_n[1] + word_d[2] * (word_n[4] - word_n[0] - word_n[1])) / pair_types if pair_types else 1.0
    return Model(folder, starts, layout, tokens, types, text_count, pair_types, pair_d, word_d, free)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score and score of every row."""
    need(docs, key, text)
    tune(docs.sparkSession)

    def scored(batches):
        for batch in batches:
            found = [model.score(tokens, begin) for tokens, begin in _tokens(batch.column(1))]
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c) for c in columns], ["k", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(docs[key].alias("k"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(lean(scored), f"k {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("k", key)


