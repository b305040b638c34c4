"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver on a bounded sample of labelled rows (``max_train_rows``, chosen by a hash of the
id, and of the statistics where ids have many texts) and flattened into arrays; scoring walks all texts of a block through each tree at once. Statistics are found for
whole texts, for all texts of a block at once.

Defined results: a null text has the statistics of an empty one; a null label is no label; several labels of one id are
averaged; without labelled rows, or with one class alone, the score is the share of label 1 (0.5 without rows).
Repeated rows get equal scores, and labelled rows of equal id and statistics are learned from once; an empty table gives
an empty result. Columns of docs beside key and text are not read, and stay whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import Scratch, crc_bucket, need, tune

MAX_TRAIN_ROWS = 40_000
_CLASSES = {
    "upper": [range(65, 91)],
    "lower": [range(97, 123)],
    "digit": [range(48, 58)],
    "other_letter": [range(128, 256)],
    "line": [[10]],
    "space": [[9, 11, 12, 13, 32]],
    "stop": [[44, 46, 58, 59, 63, 39, 34]],
    "mark": [[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]],
    "bar": [[124, 45, 47]],
    "control": [range(0, 9), range(14, 32), [127]],
}
_LUTS = {name: np.isin(np.arange(256), np.concatenate([np.array(list(p)) for p in parts])) for name, parts in _CLASSES.items()}
FEATURES = [f"share_{c}" for c in _CLASSES] + [
    "log_bytes", "log_words", "word_length", "word_length_sd", "distinct_words", "again_next", "capital_words", "marked_words", "short_words", "log_lines", "words_a_line", "again_lines", "top_bytes_again",
]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the places ``at``."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(first) - 1).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = np.diff(offsets).astype(float)
    safe = np.maximum(n, 1)
    cols = [_sums(lut[data], offsets) / safe for lut in _LUTS.values()]
    starts, ends, first = bytetext.words(data, offsets, bytetext.NOT_SPACE)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    sums = bytetext.prefix_sums(bytetext.LOWER[data])
    hashes = bytetext.span_hash(sums, starts, ends)
    mean = _sums(length, first) / some
    again = np.zeros(len(hashes))
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][np.diff(first) > 0]] = 0
    upto = lambda lut: np.concatenate([[0], np.cumsum(lut[data])])
    upper, lower, mark = upto(_LUTS["upper"]), upto(_LUTS["lower"]), upto(_LUTS["mark"] | _LUTS["bar"])
    capital = ((upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])).astype(float)
    lines, line_ends, first_line = bytetext.words(data, offsets, _NOT_LINE)
    line_count = np.diff(first_line).astype(float)
    again_bytes = np.zeros(len(data))
    again_bytes[1:] = data[1:] == data[:-1]
    again_bytes[offsets[:-1][n > 0]] = 0  # not with the text before
    distinct_lines = _distinct(bytetext.span_hash(sums, lines, line_ends), first_line)
    cols += [
        np.log1p(n), np.log1p(count), mean, np.sqrt(np.maximum(_sums(length**2, first) / some - mean**2, 0)), _distinct(hashes, first) / some, _sums(again, first) / some, _sums(capital, first) / some,
        _sums((mark[ends] > mark[starts]).astype(float), first) / some, _sums((length <= 3).astype(float), first) / some, np.log1p(line_count), count / np.maximum(line_count, 1), 1 - distinct_lines / np.maximum(line_count, 1),
        _sums(again_bytes, offsets) / safe,
    ]
    return np.column_stack(cols).astype(np.float64)


_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


@dataclass
class Trees:
    """All nodes of all trees in flat arrays. A leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts logistic loss; splits are sought over histograms of at most ``bins`` quantile bins."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        one = np.zeros(1, np.int64)
        return Trees(one, np.zeros(1), one, one, np.zeros(1), np.zeros(0, np.int64), 0, base if len(y) == 0 or share != 0.5 else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        where = np.full(len(y), len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        level = [len(nodes) - 1]
        for _ in range(depth):
            slot = np.full(len(nodes), -1)
            slot[level] = np.arange(len(level))
            own = slot[where]
            act = own >= 0
            m = len(level)
            gs, hs = np.bincount(own[act], g[act], m), np.bincount(own[act], h[act], m)
            best = [(1e-6, -1, 0)] * m
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = own[act] * bins + binned[act, j]
                gl = np.bincount(key, g[act], m * bins).reshape(m, bins).cumsum(1)[:, : len(e)]
                hl = np.bincount(key, h[act], m * bins).reshape(m, bins).cumsum(1)[:, : len(e)]
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                for k in range(m):
                    b = int(gain[k].argmax())
                    if gain[k, b] > best[k][0]:
                        best[k] = (float(gain[k, b]), j, b)
            grown = []
            for k, (_, j, b) in enumerate(best):
                if j < 0:
                    continue
                at = level[k]
                left, right = len(nodes), len(nodes) + 1
                for child in (left, right):
                    nodes.append([0, 0.0, child, child, 0.0])
                nodes[at][:4] = [j, float(edges[j][b]), left, right]
                rows = where == at
                where[rows] = np.where(binned[rows, j] <= b, left, right)
                grown += [left, right]
            level = grown
            if not level:
                break
        ends = np.unique(where)
        gs, hs = np.bincount(where, g, len(nodes)), np.bincount(where, h, len(nodes))
        for at in ends:
            nodes[at][4] = float(-rate * gs[at] / (hs[at] + ridge))
        margin += np.array([node[4] for node in nodes])[where]
    feature, threshold, left, right, value = map(np.array, zip(*nodes))
    return Trees(feature.astype(np.int64), threshold, left.astype(np.int64), right.astype(np.int64), value, np.array(roots), depth, base)


def _blocks(batch_column: pa.Array, limit: int = 1 << 20):
    data, offsets = bytetext.buffers(batch_column)
    for lo, hi in bytetext.chunks(offsets, limit):
        own = offsets[lo : hi + 1]
        yield statistics(data[own[0] : own[-1]], own - own[0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS, folds: int = 5, **options) -> Trees:
    """Fits on rows whose fold isn't 0. The sample is bounded, and so are its ids, which are broadcast."""
    need(docs, key, text)
    need(labels, key, label)
    tune(docs.sparkSession)
    known = labels.where(labels[label].isNotNull() & labels[key].isNotNull() & (crc_bucket(labels[key], folds) != 0)).groupBy(labels[key].alias("id")).agg(F.avg(label).alias("y"))
    n = known.count()
    if n > max_train_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < int(max_train_rows / n * (1 << 20)))
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text")).join(F.broadcast(known), "id").select("id", "text", "y")

    def found(batches):
        for batch in batches:
            x = np.concatenate([*_blocks(batch.column(1))]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "y"])

    kind = dict(rows.dtypes)["id"]
    scratch = Scratch(docs.sparkSession, "quality")
    learned = scratch.table(rows.mapInArrow(found, f"id {kind}, x array<double>, y double").groupBy("id", "x").agg(F.max("y").alias("y")), "learned")
    n = learned.count()
    if n > max_train_rows:
        learned = learned.where(F.pmod(F.xxhash64("id", "x", F.lit(23)), F.lit(1 << 20)) < int(max_train_rows / n * (1 << 20)))
    got = learned.select("x", "y").limit(2 * max_train_rows).toArrow()  # the hash leaves max_train_rows or so
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = (np.array(got.column("y")) >= 0.5).astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the same trees whatever the order of arrival
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, trees: Trees, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of each row's whole text."""
    need(docs, text)
    tune(docs.sparkSession)
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        blocks = [trees.score(x) for x in _blocks(pa.Array.from_pandas(texts, type=pa.string()))]
        return pd.Series(np.concatenate(blocks) if blocks else np.zeros(0))

    return docs.withColumn(to, scored(docs[text]))
