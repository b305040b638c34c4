import numpy as np
import pytest
from helpers import Groups

from cairn.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, times int, pivot long"


def cosine_links(rows):
    links, groups = {i: 0 for i, _, _ in rows}, Groups()
    ok = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if v is not None and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (a, x, c) in enumerate(ok):
        for b, y, d in ok[:k]:
            if c == d and len(x) == len(y) and x @ y >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y):
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i)) for i, _, _ in rows}


def awkward():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + 0.03 * rng.normal(size=16), i % 2) for i in range(300)]
    rows += [(1000 + i, base[0], 0) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return rows + [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None)]


def links(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 7)
    rows = awkward()
    found = vector_dedup.link(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))
    got, wanted = links(found), cosine_links(rows)
    assert set(got) == set(wanted) and all(got[i][0] <= wanted[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in wanted.values())
    assert all(got[i] == (0, i) for i in (*range(2000, 2006), 3000)) and got[2006] == (1, 2006) == (got[2007][0], got[2007][1])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.collect())


def test_empty_table(spark):
    assert vector_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(d, common, labels=6, each=120, seed=3):
    """Vectors around one direction (common > 0) or none, each with one or two others of a cosine just above 0.98."""
    rng = np.random.default_rng(seed)
    directed = lambda n: (x := rng.normal(size=(n, d)) + common * np.ones(d)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = []
    for c in range(labels):
        base = directed(each)
        for copy in range(3):
            noise = rng.normal(size=(each, d))
            noise -= (noise * base).sum(1, keepdims=True) * base
            noise /= np.linalg.norm(noise, axis=1, keepdims=True)
            made = base if copy == 0 else 0.981 * base + np.sqrt(1 - 0.981**2) * noise
            rows += [(len(rows) + k, [float(y) for y in np.float32(x)], c) for k, x in enumerate(made[: each if copy < 2 else each // 4])]
    return rows


@pytest.mark.parametrize("d,common", [(8, 0.0), (64, 0.0), (64, 1.0), (768, 0.0), (768, 1.0), (64, 7.0)])
def test_recall_on_planted_links(spark, d, common):
    """7.0 puts all vectors of a label so close to one direction that most of them link."""
    rows = planted(d, common, each=120 if d < 700 else 40)
    got, wanted = links(vector_dedup.link(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))), cosine_links(rows)
    assert all(got[i][0] <= wanted[i][0] for i in got)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in wanted.values())
    assert there >= len(rows) / 2 and found >= 0.97 * there


def test_vectors_with_few_or_no_pivots(spark, monkeypatch):
    """Most pivots have to be shared by all, and lengths that the sample misses are compared whole."""
    monkeypatch.setattr(vector_dedup, "MIN_PIVOTS", 3)
    monkeypatch.setattr(vector_dedup, "MAX_PIVOTS", 3)
    rows = planted(16, 0.0, labels=2, each=40)
    got, wanted = links(vector_dedup.link(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))), cosine_links(rows)
    assert got == wanted


def test_lengths_without_pivots_still_link(spark, monkeypatch):
    """The sample of pivots is so small that it misses the length of two vectors."""
    monkeypatch.setattr(vector_dedup, "MIN_PIVOTS", 20)
    monkeypatch.setattr(vector_dedup, "MAX_PIVOTS", 20)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(400)]
    rows += [(4000 + i, [1.0, 1.0, 2.0 + i / 1000], 0) for i in range(2)]
    got, wanted = links(vector_dedup.link(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))), cosine_links(rows)
    assert {i: got[i] for i in got if i >= 4000} == {i: wanted[i] for i in wanted if i >= 4000}
    assert all(got[i][0] == 1 for i in got if i >= 4000)
