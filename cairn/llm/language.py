"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed three-byte sequences, counted over all labelled texts of the learning
folds. A document's language proportions come from expectation-maximisation over its own sequences; then the set of
languages grows from the likeliest one, as long as the likelihood gains more than a penalty of half a logarithm of the
length for each language. The prediction is the selected language with the largest proportion, which is the score.

Defined results: ``und`` and 0 for a null text, one without a letter, or where nothing was learned. A null language is
no label. Ties go to the first language by name. Repeated rows get equal results; an empty table gives an empty one.
Columns of docs beside the named ones are not read; those that bear the name of a result column are replaced.

Memory follows the number of languages: the model has BUCKETS numbers for each, and a block of texts is the shorter the
more languages there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bytetext
from cairn.llm.common import crc_bucket, need, new_names, tune

BUCKETS = 1 << 16
ROUNDS = 8
BLOCK = 1 << 19

#: What a byte counts as: lower case, and one space for all that is neither a letter nor beyond ASCII.
_FOLD = np.where(bytetext.ALNUM, bytetext.LOWER, 32).astype(np.uint8)
_FOLD[48:58] = 32


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each three-byte sequence, with a space before and after each text, and each text's first one."""
    n, docs = len(data), len(offsets) - 1
    padded = np.full(n + 2 * docs, 32, np.uint8)
    at = offsets + 2 * np.arange(docs + 1)
    padded[np.arange(n) + np.repeat(2 * np.arange(docs) + 1, np.diff(offsets))] = _FOLD[data]
    wide = padded.astype(np.uint32)
    code = np.zeros(len(wide), np.uint32)
    code[:-2] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    keep = np.ones(len(code), bool)
    keep[at[1:] - 1] = keep[at[1:] - 2] = False  # those that would reach into the next text
    return code[keep], at - 2 * np.arange(docs + 1)


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = bytetext.buffers(batch.column(0))
        languages = np.array(batch.column(1).to_pylist(), dtype=object)
        for lo, hi in bytetext.chunks(offsets, BLOCK):
            own = offsets[lo : hi + 1]
            codes, first = sequences(data[own[0] : own[-1]], own - own[0])
            owner = np.repeat(languages[lo:hi], np.diff(first))
            for name in set(languages[lo:hi]):
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += np.bincount(codes[owner == name], minlength=BUCKETS)
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the logarithm of each bucket's probability in each. Counts cover all rows of
    the learning folds; the table that comes to the driver has a row for each language and bucket at most."""
    need(docs, key, text, lang)
    tune(docs.sparkSession)
    rows = docs.where(docs[text].isNotNull() & docs[lang].isNotNull() & (crc_bucket(docs[key], folds) != 0)).select(docs[text].alias("text"), docs[lang].alias("lang"))
    got = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, max(1, len(names))))
    counts[got["bucket"].to_numpy(int), got["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(int)] = got["n"].to_numpy(float)
    smooth = 0.5
    return names, np.log((counts + smooth) / (counts.sum(0) + smooth * BUCKETS))


def _mixture(p: np.ndarray, c: np.ndarray, begins: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each text. p: likelihoods of its distinct sequences, c: their counts;
    start: proportions to begin with, whose zeros stay."""
    sizes = np.diff(np.append(begins, len(c)))
    n = np.add.reduceat(c, begins)
    share = start
    for _ in range(rounds):
        part = p * np.repeat(share, sizes, axis=0)
        part *= (c / np.maximum(part.sum(1), 1e-300))[:, None]
        share = np.add.reduceat(part, begins) / n[:, None]
    return share, np.add.reduceat(c * np.log(np.maximum((p * np.repeat(share, sizes, axis=0)).sum(1), 1e-300)), begins)


def infer(data: np.ndarray, offsets: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of the predicted language and its proportion."""
    docs, languages = len(offsets) - 1, log_p.shape[1]
    codes, first = sequences(data, offsets)
    sizes = np.diff(first)
    best, share = np.zeros(docs, np.int64), np.zeros(docs)
    keys = np.sort((np.repeat(np.arange(docs, dtype=np.uint64), sizes) << np.uint64(16)) | codes.astype(np.uint64))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    c = np.diff(np.append(at, len(keys))).astype(float)
    owner, lp = (keys[at] >> np.uint64(16)).astype(np.int64), log_p[(keys[at] & np.uint64(BUCKETS - 1)).astype(np.int64)]
    present, begins = np.unique(owner, return_index=True)
    if not len(present):
        return best, share
    each = np.diff(np.append(begins, len(owner)))
    p = np.exp(lp - lp.max(1, keepdims=True))  # a row's common factor changes neither proportions nor comparisons
    everything, _ = _mixture(p, c, begins, np.full((len(present), languages), 1 / languages), ROUNDS)
    order = np.argsort(-everything, axis=1, kind="stable")
    chosen = np.zeros((len(present), languages))
    chosen[np.arange(len(present)), order[:, 0]] = 1
    value = _mixture(p, c, begins, chosen, 0)[1]
    penalty = 0.5 * np.log(np.add.reduceat(c, begins))
    open_, proportions = np.arange(len(present)), chosen.copy()
    for k in range(2, languages + 1):  # texts whose set still grows
        rows = bytetext.ranges(begins[open_], each[open_])
        own = np.cumsum(each[open_]) - each[open_]
        start = np.zeros((len(open_), languages))
        np.put_along_axis(start, order[open_, :k], np.take_along_axis(everything[open_], order[open_, :k], 1) + 1e-6, 1)
        mixed, ll = _mixture(p[rows], c[rows], own, start / start.sum(1, keepdims=True), ROUNDS // 2)
        gains = ll - penalty[open_] > value[open_]
        open_, mixed, ll = open_[gains], mixed[gains], ll[gains]
        if not len(open_):
            break
        proportions[open_], value[open_] = mixed, ll
    best[present] = proportions.argmax(1)
    share[present] = proportions.max(1)
    return best, share


def predict(docs: DataFrame, names: list[str], log_p: np.ndarray, text: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """Adds the predicted language and its proportion. The model has a fixed number of buckets, and is broadcast."""
    need(docs, text)
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(log_p)
    block = max(1 << 12, 4 * BLOCK // max(4, len(names)))
    has_letter = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False))
    if not names:
        return docs.withColumns({lang_to: F.lit("und"), score_to: F.lit(0.0)})

    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        data, offsets = bytetext.buffers(pa.Array.from_pandas(texts, type=pa.string()))
        best, share = [], []
        for lo, hi in bytetext.chunks(offsets, block):
            own = offsets[lo : hi + 1]
            b, s = infer(data[own[0] : own[-1]], own - own[0], model.value)
            best.append(b)
            share.append(s)
        found = np.concatenate(best) if best else np.zeros(0, int)
        return pd.DataFrame({"lang": np.array(names, object)[found], "score": np.concatenate(share) if share else np.zeros(0)})

    (found,) = new_names(docs, "told")
    out = docs.withColumn(found, told(docs[text]))
    return out.withColumns({lang_to: F.when(has_letter, F.col(f"{found}.lang")).otherwise("und"), score_to: F.when(has_letter, F.least(F.col(f"{found}.score"), F.lit(1.0))).otherwise(0.0)}).drop(found)
