"""What the operators on groups share, against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import Groups

from cairn.llm import groups as shared
from cairn.llm.common import Scratch, new_names
from cairn.llm.groups import by_group, components, least_reachable, sieve


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(300 - i, 300) for i in range(1, 20)]
    edges += [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)] + [(7, 7), (5, 4), (4, 5)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    got = {r["id"]: r["component"] for r in found}
    assert len(got) == len(found) and all(groups.find(i) == c for i, c in got.items())
    assert {i for e in edges for i in e if groups.find(i) != i} == set(got)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def chain(n, seed):
    ids = random.Random(seed).sample(range(10 * n), n)
    return list(zip(ids[:-1], ids[1:])), min(ids)


def test_few_edges_take_few_tables(spark):
    """Each table is a job or more, which costs the same however few rows it has."""
    edges, least = chain(300, 3)
    scratch = Scratch(spark, "test")
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert found == {(i, least) for e in edges for i in e if i != least}
    assert len(os.listdir(scratch.path.removeprefix("file://"))) <= 2


@pytest.mark.parametrize("bound", [0, 298, 299])
def test_components_are_the_same_beyond_one_task(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "AT_ONCE", bound)
    edges, least = chain(300, 4)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert sorted(tuple(r) for r in found) == sorted({(i, least) for e in edges for i in e if i != least})


def test_least_reachable_of_a_long_chain_and_of_random_edges():
    order = np.random.default_rng(1).permutation(200_000)
    assert not least_reachable(len(order), order[:-1], order[1:]).any()
    rng = random.Random(2)
    for _ in range(50):
        n, groups = rng.randrange(1, 40), Groups()
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(40))]
        for a, b in edges:
            groups.join(a, b)
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        assert least_reachable(n, a, b).tolist() == [groups.find(i) for i in range(n)]


def test_sieve_lets_all_keys_pass(spark):
    keys = spark.createDataFrame([(i, f"k{i}") for i in range(0, 3000, 3)] + [(None, "x"), (5, None)], "a long, b string")
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(3000)] + [(None, "x"), (5, None), (None, None)], "c long, d string")
    marked = sieve(keys, ["a", "b"], Scratch(spark, "test"), "sieve")(rows, "held", "c", "d")
    assert marked.columns == ["c", "d", "held"] and marked.count() == rows.count()
    found = {tuple(r) for r in marked.where("held").drop("held").collect()}
    assert {tuple(r) for r in keys.collect()} <= found and len(found) < 1010
    nothing = sieve(keys.limit(0), ["a", "b"], Scratch(spark, "test"), "sieve")(rows, "held", "c", "d")
    assert nothing.where("held").count() == 0 and nothing.count() == rows.count()


def test_groups_come_whole_and_in_order(spark):
    rows = [(g, n) for g in range(50) for n in range(g % 13 + 1)]

    def told(table):
        keys = table.column("g").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(keys))), pa.array([keys.count(k) for k in sorted(set(keys))])], ["g", "n"])

    found = by_group(spark.createDataFrame(rows, "g long, n long").repartition(7), ["g"], told, "g bigint, n bigint", few=5)
    assert sorted(tuple(r) for r in found.collect()) == [(g, g % 13 + 1) for g in range(50)]


def test_new_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__k int, __K_ int, doc_id int")
    assert new_names(df, "k", "text") == ["__k__", "__text"]
