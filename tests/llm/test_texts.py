"""Operators on texts against brute force: awkward rows, and the smallest data folder whole."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, LONG, Groups, fold, frame, letter_words, white_words
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bytetext, decontaminate, kneser_ney, language, packing, quality, queries, sharding, shingle_join, substrings


def documents(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


# ---- word shingles -------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = white_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked(rows, k, num, den):
    """Set size of each row, and the smallest id of its component; all rows of an id are one document."""
    sets, groups, holders = [(i, shingles(t, k)) for i, t in rows], Groups(), defaultdict(list)
    for n, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            holders[g].append(n)
    for n, m in {(n, m) for own in holders.values() for n in own for m in own if n < m}:
        x, y = sets[n][1], sets[m][1]
        both = len(x & y)
        if den * both >= num * (len(x) + len(y) - both):
            groups.join(sets[n][0], sets[m][0])
    return sorted(((i, len(s), None if i is None else groups.find(i)) for i, s in sets), key=str)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join_over_all_documents(spark, data, k, num, den):
    rows = documents(spark, data)
    assert joined(shingle_join.join(frame(spark, rows), shingle=k, num=num, den=den)) == linked(rows, k, num, den)


@pytest.mark.parametrize("block", [3, 6])
def test_jaccard_join_splits_large_groups(spark, monkeypatch, block):
    """A chain of near copies, and texts of many sizes that share a rare beginning but little else."""
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + n, " ".join(base[:n] + [f"new{n}"] + base[n + 1 :])) for n in range(1, 25)] + [(1, " ".join(base)), (500, "something else altogether here")]
    rows += [(200 + n, " ".join(base[: 60 - n])) for n in range(30)]
    rows += [(600 + n, " ".join(base[:6] + [f"own{n // 2}x{j}" for j in range(10 + 2 * n + n % 2)])) for n in range(30)]
    rows += [(700 + n, " ".join([f"x{j}" for j in range(80) if j != n])) for n in range(40)]
    assert joined(shingle_join.join(frame(spark, rows), shingle=4, num=85, den=100)) == linked(rows, 4, 85, 100)


def test_rows_of_one_id_are_one_document(spark):
    """Each has its own set; a smaller text of an id links although another one of the id is much larger."""
    x = [f"x{i}" for i in range(60)]
    other = " ".join(f"y{i}" for i in range(500))
    rows = [(1, " ".join(x)), (1, other), (2, " ".join(x[:-2])), (3, other), (3, other), (4, "y1 y2 y3 y4 y5 y6"), (None, other), (None, None)]
    assert joined(shingle_join.join(frame(spark, rows), shingle=4, num=85, den=100)) == linked(rows, 4, 85, 100)


def test_jaccard_join_awkward_rows(spark):
    for rows in (AWKWARD, AWKWARD * 2, []):
        assert joined(shingle_join.join(frame(spark, rows), shingle=4, num=85, den=100)) == linked(rows, 4, 85, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 90), min_size=1, max_size=85), min_size=1, max_size=12), st.integers(0, 40), st.sampled_from([64, 256]))
def test_tree_walk_loses_no_pair(sets, gone, least_bits):
    """Sets of several widths, and each of them without a few of its elements."""
    sets = sets + [s - {gone, gone + 1, gone + 2} or s for s in sets]
    words = [np.unique(bytetext.mix(np.array(sorted(s), np.uint64))) for s in sets]
    sizes = np.array([len(w) for w in words])
    maps = []
    for w in words:
        bits = np.zeros(max(least_bits, shingle_join.width_of(len(w)) if least_bits > 64 else 1 << (2 * len(w) - 1).bit_length()), bool)
        bits[(w & np.uint64(len(bits) - 1)).astype(int)] = True
        maps.append(np.packbits(bits, bitorder="little").view(np.uint64))
    rows = np.arange(len(sets))
    pairs = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in shingle_join.similar(maps, sizes, rows, rows, 80, 100)))}
    halves = rows[::2], rows[1::2]
    across = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in shingle_join.similar(maps, sizes, *halves, 80, 100)))}
    assert {(a, b) for a, b in pairs if (a + b) % 2} == across
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (b, a) in pairs
    exact = shingle_join.overlaps(words)
    assert all(exact[a, b] == len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(a))


# ---- repeated byte strings -------------------------------------------------------------------------------------------


def repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cut[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(cut)) if cut[k] and not (k and cut[k - 1]))
        out.append((i, len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, y in zip(b, cut) if not y)).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [substrings.MAX_CONTEXTS, 1])
def test_suffix_arrays_over_all_documents(spark, data, monkeypatch, most):
    """Also with every anchor counted as too frequent for a suffix array."""
    monkeypatch.setattr(substrings.repeated_windows, "__defaults__", (substrings.LENGTH, substrings.ANCHOR, most, False))
    rows = documents(spark, data)
    assert told(substrings.report(frame(spark, rows))) == repeats(rows, substrings.LENGTH)


def test_suffix_arrays_awkward_rows(spark):
    assert told(substrings.report(frame(spark))) == repeats(AWKWARD, substrings.LENGTH)
    assert substrings.report(frame(spark, [])).count() == 0


def test_first_copy_stays_and_characters_stay_whole(spark):
    passage = "é".join(f"passage{i}" for i in range(30))
    rows = [(2, "ü before " + passage + " after"), (1, "front " + passage), (3, None), (4, "short")]
    kept = {r["doc_id"]: r["text"] for r in substrings.remove(frame(spark, rows)).collect()}
    assert kept[1] == rows[1][1] and kept[3] is None and kept[4] == "short"
    assert kept[2].startswith("ü before") and kept[2].endswith("after") and "passage1" not in kept[2]


def first_stays(rows, n):
    """(id, text left) of rows in order of id, whose later copies of n bytes are cut by whole characters."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        body = (t or "").encode()
        cut = bytearray(len(body))
        for k in range(len(body) - n + 1):
            if body[k : k + n] in seen:
                cut[k : k + n] = b"\1" * n
            seen.add(body[k : k + n])
        starts = [k for k in range(len(body)) if body[k] & 0xC0 != 0x80] + [len(body)]
        out.append((i, None if t is None else b"".join(body[a:b] for a, b in zip(starts, starts[1:]) if not all(cut[a:b])).decode()))
    return sorted(out, key=str)


def left_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_of_equal_rows_stays(spark):
    """Rows equal in id and text, a copy of another id, a text that shares a passage, and the awkward rows."""
    rng = np.random.default_rng(4)
    line = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    shared = line(45)
    a, b = line(40) + shared + line(40), line(30) + shared
    rows = [(1, a), (1, a), (1, a), (2, b), (3, a), (4, line(50)), (4, line(60))]
    for own in (rows, rows[:2] + rows[3:4], AWKWARD, [(7, b), (7, b), (None, b), (None, b)]):
        df = frame(spark, own).withColumnRenamed("items", "__runs").withColumnRenamed("source", "__k").repartition(3)
        found = substrings.remove(df)
        assert found.columns == df.columns and left_of(found) == first_stays(own, substrings.LENGTH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=4), st.sampled_from([8, 9, 16, 20]))
def test_previous_factors_by_hand(texts, n):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    order, rank = substrings.suffix_order(data, ends, n)
    found = dict(zip(order.tolist(), substrings.previous_factors(order, rank).tolist()))
    body, whole = bytes(data), [p for p in range(len(data)) if p + n <= ends[p]]
    assert set(found) == set(whole)
    for p in whole:
        earlier = [q for q in whole if q < p and body[q : q + n] == body[p : p + n]]
        assert found[p] in earlier if earlier else found[p] == -1
    before, after = substrings.smaller_neighbours(order)
    for i, v in enumerate(order):
        assert before[i] == max((j for j in range(i) if order[j] < v), default=-1)
        assert after[i] == min((j for j in range(i + 1, len(order)) if order[j] < v), default=-1)


# ---- benchmark windows -----------------------------------------------------------------------------------------------


def contamination(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = letter_words(t)
        for p in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[p : p + window])].add(i)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in rows:
        w, hit, found = letter_words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


ITEMS = [(1, "the quick brown fox"), (2, "over the lazy dog"), (10, "école"), (11, None), (12, ""), (13, "!!"), (14, " ".join(f"w{i} the of" for i in range(5))), (14, "runs away"), (15, "THE QUICK BROWN FOX")]


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST, 0])
def test_windows_awkward_rows(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.report(frame(spark), items, max_broadcast=most)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=str) == contamination(AWKWARD, ITEMS)
    clean = decontaminate.remove(frame(spark), items, max_broadcast=most)
    assert clean.columns == frame(spark).columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((d for d, _, hit, _ in contamination(AWKWARD, ITEMS) if not hit), key=str)


def test_many_single_words_and_long_texts_beyond_the_bound(spark):
    """Items of one word alone count for the bound like others, and long texts don't travel with every word."""
    items = [(i, f"w{7 * i}") for i in range(3000)] + [(9000 + i, " ".join(f"w{j} the of" for j in range(i, i + 4))) for i in range(50)]
    rows = [(10, LONG), (11, None), (12, LONG[5000:]), (None, "w7"), (13, "nothing here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    scratch_plan = decontaminate.mark(frame(spark, rows), table, max_broadcast=1000)
    assert "BroadcastHashJoin" not in scratch_plan._jdf.queryExecution().optimizedPlan().toString()
    found = decontaminate.report(frame(spark, rows), table, max_broadcast=1000).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == contamination(rows, items)


def test_windows_with_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(frame(spark, []), items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(frame(spark), items.limit(0)).collect())


# ---- packing -----------------------------------------------------------------------------------------------------------


def test_packing_awkward_rows(spark):
    files = queries.tokenizer_files()
    encoder = packing.UnitEncoder(**files)
    found = packing.pack_documents(frame(spark), **files).collect()
    wanted = Counter()
    for i, t in AWKWARD:
        ids = encoder.whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > first else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            wanted[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
    assert packing.pack_documents(frame(spark, []), **files).count() == 0


def test_packing_in_several_rounds_is_nearly_tight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 2048, 3000))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(items, items_per_task=300).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(3000))
    assert len({r["sequence_id"] for r in found}) <= 1.04 * sum(r[3] for r in rows) / 2048


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=" \n\tab1'é日!.\u00a0\u3000\x1c", max_size=60))
def test_units_give_the_tokenizers_ids(text):
    encoder = _encoder()
    rows = list(packing._pieces([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["d", "t"])], *_encoder_key, limit=2048))[0].to_pylist()
    ids = encoder.whole.encode(text, add_special_tokens=False).ids + [0]
    assert rows[0]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


_encoder_key = tuple(queries.tokenizer_files().values())


def _encoder():
    key = _encoder_key[:2]
    if key not in packing._encoders:
        packing._encoders[key] = packing.UnitEncoder(*_encoder_key)
    return packing._encoders[key]


# ---- sharding ------------------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_slots_gapless(spark):
    rows = AWKWARD * 40
    found = sharding.shard(frame(spark, rows).repartition(5), shards=7, rows_per_task=20).collect()
    sizes = Counter(r["shard"] for r in found)
    assert sum(sizes.values()) == len(rows) and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard(frame(spark, [])).count() == 0


def test_communication_matrix_sums_and_law():
    held = np.array([10, 0, 25, 7])
    total = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(held, 3, seed)
        assert (m.sum(axis=1) == held).all() and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()
        total += m
    assert np.allclose(total / 400, held[:, None] / 3, atol=0.4)


def test_draws_from_large_populations():
    """The law above numpy's limit: where both can draw, both follow the same probabilities; beyond it, mean and spread."""
    rng = np.random.Generator(np.random.PCG64(1))
    real, sharding_limit = sharding._hypergeometric, 10**9
    big = [real(rng, 3 * sharding_limit, 5 * sharding_limit, 4000) for _ in range(3000)]
    mean, spread = 4000 * 3 / 8, math.sqrt(4000 * 3 / 8 * 5 / 8)
    assert abs(np.mean(big) - mean) < 5 * spread / math.sqrt(3000) and 0.9 < np.std(big) / spread < 1.1
    for good, bad, n in ((10, 2 * 10**9, 5), (2 * 10**9, 1, 2 * 10**9), (10**9, 10**9, 2 * 10**9 - 3), (0, 2 * 10**9, 7), (2 * 10**9, 0, 7)):
        for _ in range(20):
            k = real(rng, good, bad, n)
            assert max(0, n - bad) <= k <= min(good, n)
    matrix = sharding.communication_matrix(np.array([2 * 10**9, 10**9 + 7, 5]), 24, 3)
    assert (matrix.sum(axis=1) == [2 * 10**9, 10**9 + 7, 5]).all() and np.ptp(matrix.sum(axis=0)) <= 1


# ---- quality, language -----------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest folder has too few labels to learn from
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_quality_classifier"](spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    held = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels if r["doc_id"] in found and fold(r["doc_id"], 5) == 0]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in found.items())


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    docs = frame(spark)
    scored = quality.score(docs, quality.train(docs, labels), to="__score").collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r["__score"] <= 1 for r in scored)
    assert scored[2]["__score"] == scored[3]["__score"]
    nothing = quality.train(docs, labels.limit(0))
    assert {r["__score"] for r in quality.score(docs, nothing, to="__score").collect()} == {0.5}
    assert quality.score(frame(spark, []), nothing).count() == 0


def statistics_by_hand(text):
    body = (text or "").encode()
    n = len(body)
    kinds = {
        "upper": lambda b: 65 <= b <= 90, "lower": lambda b: 97 <= b <= 122, "digit": lambda b: 48 <= b <= 57, "other_letter": lambda b: b >= 128, "line": lambda b: b == 10, "space": lambda b: b in b"\t\x0b\x0c\r ",
        "stop": lambda b: b in b",.:;?'\"", "mark": lambda b: b in b"!#$%&*+<=>@\\^_`{}~", "bar": lambda b: b in b"|-/", "control": lambda b: b < 9 or 14 <= b < 32 or b == 127,
    }
    out = [sum(map(f, body)) / max(1, n) for f in kinds.values()]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", body) if w]
    low = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines = [x for x in body.split(b"\n") if x]
    m = max(1, len(words))
    size = [len(w) for w in words]
    mean = sum(size) / m
    capital = [sum(map(kinds["upper"], w)) >= 2 and not any(map(kinds["lower"], w)) for w in words]
    marked = [any(kinds["mark"](b) or kinds["bar"](b) for b in w) for w in words]
    low_lines = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in lines]
    out += [math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(0, sum(k * k for k in size) / m - mean**2)), len(set(low)) / m, sum(a == b for a, b in zip(low, low[1:])) / m, sum(capital) / m, sum(marked) / m]
    out += [sum(k <= 3 for k in size) / m, math.log1p(len(lines)), len(words) / max(1, len(lines)), 1 - len(set(low_lines)) / max(1, len(lines)), sum(a == b for a, b in zip(body, body[1:])) / max(1, n)]
    return out


def test_statistics_by_hand(spark, data):
    texts = [t for _, t in AWKWARD] + [t for _, t in documents(spark, data)] + ["A\n\nB b\nB b\n", "!!! ||| a-b", "\x00\x7f\n"]
    found = np.concatenate(list(quality._blocks(pa.array(texts, pa.string()), limit=20_000)))
    assert np.allclose(found, [statistics_by_hand(t) for t in texts], rtol=1e-9, atol=1e-7)


def test_quality_learns_from_a_bounded_sample(spark):
    """Many rows of few ids, and equal rows, come to the driver in bounded number."""
    docs = spark.createDataFrame([(i % 3 + 1, f"text {i} " * (i % 7 + 1)) for i in range(900)] + [(1, "same text")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, y, **o: seen.append(len(y)) or fit(x, y, **o)
    try:
        quality.train(docs, labels, max_train_rows=100)
    finally:
        quality.fit = fit
    assert 0 < seen[0] <= 200


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], trees.score(x[:50]))


def test_language_held_out(spark, data):
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").where("lang is not null").collect()
    held = [r for r in rows if fold(r["doc_id"], 5) == 0]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_language_awkward_rows_and_mixtures(spark):
    english, german = "the house and the garden with the dog ", "das haus und der garten mit dem hund "
    rows = [(k, english * 3) for k in range(10)] + [(k, german * 3) for k in range(20, 30)]
    docs = spark.createDataFrame([(i, t, "en" if i < 15 else "de") for i, t in rows] + [(99, "x", None), (98, None, "fr")], "doc_id long, text string, lang string")
    names, log_p = language.train(docs)
    assert names == ["de", "en"]
    mixed = [(1, english * 9 + german * 3), (2, german), (3, None), (4, ""), (5, "123 !?"), (6, "é")]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(mixed, "doc_id long, text string"), names, log_p).collect()}
    assert found[1]["lang_pred"] == "en" and 0.5 < found[1]["score"] < 1
    assert found[2]["lang_pred"] == "de" and found[2]["score"] > 0.99
    assert all((found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0) for k in (3, 4, 5)) and found[6]["lang_pred"] in names
    nobody, flat = language.train(docs.limit(0))
    assert nobody == [] and {r["lang_pred"] for r in language.predict(docs, nobody, flat).collect()} == {"und"}


def mixture_by_hand(text, names, log_p):
    """Proportions by expectation-maximisation over the text's three-byte sequences, then the set of languages that grows
    while the likelihood gains more than the penalty."""
    body = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    padded = b" " + body + b" "
    codes = [((((padded[i] << 16) | (padded[i + 1] << 8) | padded[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(padded) - 2)]
    counts = Counter(codes)
    if not counts:
        return 0, 0.0
    p = {c: np.exp(log_p[c] - log_p[c].max()) for c in counts}

    def run(start, rounds):
        share = np.array(start, float)
        for _ in range(rounds):
            new = np.zeros(len(share))
            for c, k in counts.items():
                part = p[c] * share
                new += k * part / max(part.sum(), 1e-300)
            share = new / len(codes)
        return share, sum(k * math.log(max(float(p[c] @ share), 1e-300)) for c, k in counts.items())

    languages = len(names)
    everything, _ = run([1 / languages] * languages, language.ROUNDS)
    order = sorted(range(languages), key=lambda i: -everything[i])
    chosen, value = run([float(i == order[0]) for i in range(languages)], 0)
    penalty = 0.5 * math.log(len(codes))
    for k in range(2, languages + 1):
        start = np.array([everything[i] + 1e-6 if i in order[:k] else 0 for i in range(languages)])
        mixed, ll = run(start / start.sum(), language.ROUNDS // 2)
        if ll - penalty <= value:
            break
        chosen, value = mixed, ll
    return int(chosen.argmax()), float(chosen.max())


def test_mixtures_by_hand(spark, data):
    """Every document of the data folder and the awkward ones."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, log_p = language.train(docs)
    counts = Counter()
    texts = [t for _, t in AWKWARD if t is None or len(t) < 3000] + [t for _, t in documents(spark, data) if t is None or len(t) < 3000]
    column = pa.array(texts, pa.string())
    best, share = language.infer(*bytetext.buffers(column), log_p)
    for t, b, s in zip(texts, best, share):
        hand = mixture_by_hand(t, names, log_p)
        assert math.isclose(s, hand[1], rel_tol=1e-6, abs_tol=1e-9) and (b == hand[0] or s < 0.51)
        counts[b] += 1
    assert len(counts) >= 3


def test_counts_of_sequences_by_hand(spark):
    docs = frame(spark, [(i, t) for i, t in AWKWARD if i is not None])
    names, log_p = language.train(docs)
    total = Counter()
    for i, t in AWKWARD:
        if i is not None and t is not None and fold(i, 5):
            body = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode()) + b" "
            total.update(((((body[k] << 16) | (body[k + 1] << 8) | body[k + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for k in range(len(body) - 2))
    wanted = np.full(language.BUCKETS, 0.5)
    for c, n in total.items():
        wanted[c] += n
    assert names == ["en"] and np.allclose(log_p[:, 0], np.log(wanted / wanted.sum()))


def test_many_languages(spark):
    """More languages than fit a byte, each with words of its own."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(x) for x in rng.integers(97, 123, 9))
    rows = [(5 * k + 1, " ".join([word(), word(), word()] * 4), f"l{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, log_p = language.train(docs)
    assert len(names) == len([r for r in rows if fold(r[0], 5)]) > 200
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.select("doc_id", "text"), names, log_p).collect()}
    learned = [r for r in rows if fold(r[0], 5)]
    assert sum(found[i] == lang for i, _, lang in learned) >= 0.95 * len(learned)


# ---- Kneser-Ney ----------------------------------------------------------------------------------------------------------


def kneser_ney_by_hand(train, rows):
    tok = lambda t: [*white_words(t), "</s>"]
    c, b = Counter(), Counter()
    for t in train:
        w = tok(t)
        c.update(w)
        b.update(zip(["<s>", *w], w))
    n, v = sum(c.values()), len(c)
    follow, before = defaultdict(Counter), Counter()
    for (x, w), k in b.items():
        follow[x][w] = k
        before[w] += 1
    d = kneser_ney.discounts([sum(k == j for k in b.values()) for j in (1, 2, 3, 4)])
    e = kneser_ney.discounts([sum(k == j for k in before.values()) for j in (1, 2, 3, 4)])
    cut = lambda k, x: max(k - x[min(k, 3) - 1], 0) if k else 0
    free = sum(e[min(k, 3) - 1] for k in before.values()) / len(b) if b else 1.0
    q = lambda w: cut(before[w], e) / max(1, len(b)) + free / (v + 1)

    def p(x, w):
        if x not in follow:
            return q(w)
        total = sum(follow[x].values())
        return cut(follow[x][w], d) / total + sum(d[min(k, 3) - 1] for k in follow[x].values()) / total * q(w)

    out = []
    for t in rows:
        w = tok(t)
        out.append((len(w), sum(x in c for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(x, y)) for x, y in zip(["<s>", *w], w))))
    return out, p, {*c}


@pytest.mark.parametrize("per_part,word_bytes", [(kneser_ney.TOKENS_PER_PART, kneser_ney.BYTES_PER_WORD_PART), (3000, 2000)])
def test_scores_by_hand(spark, monkeypatch, per_part, word_bytes):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_PART", per_part)
    monkeypatch.setattr(kneser_ney, "BYTES_PER_WORD_PART", word_bytes)
    rows = [r for r in AWKWARD if r[0] is not None]
    docs = frame(spark, rows)
    model = kneser_ney.train(docs.where("doc_id <> 11"))
    found = sorted(kneser_ney.score(docs, model).collect(), key=lambda r: (r["doc_id"], r["score"]))
    wanted, _, _ = kneser_ney_by_hand([t for i, t in rows if i != 11], [t for _, t in rows])
    assert len(found) == len(wanted)
    for r, w in zip(found, [w for _, w in sorted(zip([i for i, _ in rows], wanted))]):
        assert (r["n_tokens"], r["n_known"]) == w[:2]
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9)


def test_counts_beyond_32_bits(tmp_path):
    """Counts travel, meet and are stored whole."""
    keys, counts = np.array([3, 9, 2**63], np.uint64), np.array([2**32 + 5, 1, 2**40], np.int64)
    rows = pa.Table.from_batches([b for _ in range(3) for b in kneser_ney._send(np.zeros(3, np.int64), keys, counts)])
    ((part, found, total),) = kneser_ney._received(rows)
    assert part == 0 and found.tolist() == keys.tolist() and total.tolist() == (3 * counts).tolist()
    kneser_ney._write_counts(str(tmp_path), "many", total)
    kneser_ney._write_counts(str(tmp_path), "few", counts[1:2])
    assert kneser_ney._map_counts(str(tmp_path), "many").tolist() == total.tolist()
    assert kneser_ney._map_counts(str(tmp_path), "few").dtype == np.uint32


@pytest.mark.parametrize("types,parts", [(1000, 1), (1000, 7), (2**34, 65536), (2**38, 65536)])
def test_places_of_pairs_are_their_own(types, parts):
    """Also with more words than 32 bits number."""
    rng = np.random.default_rng(2)
    hot = np.unique(rng.integers(0, types, 5))
    layout = kneser_ney.Layout(types, parts, hot)
    v, w = np.concatenate([rng.integers(0, types + 1, 3000), rng.choice(hot, 500), [types]]), rng.integers(0, types, 3501)
    keys, part = layout.place(v, w)
    for p in np.unique(part):
        back = layout.words(int(p), keys[part == p])
        assert back[0].tolist() == v[part == p].tolist() and back[1].tolist() == w[part == p].tolist()


def test_probabilities_sum_to_one():
    _, p, words = kneser_ney_by_hand(["a b a c", "a b d", "b a a", "e", None], [])
    for context in ("<s>", "a", "never"):
        assert math.isclose(sum(p(context, w) for w in words) + p(context, "unknown"), 1, rel_tol=1e-9)


def test_scores_with_nothing_learned(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    found = kneser_ney.score(docs, kneser_ney.train(docs.limit(0))).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in found] == [(3, 0, 0.0), (1, 0, 0.0)]
