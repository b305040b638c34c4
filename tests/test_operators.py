"""Edge cases of the operators on small tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import calendar, texts, tokens
from cairn.functions.errors import Conflict, InvalidArgument
from cairn.operators import blocks, dml, filters, graph, intervals, paging
from cairn.plans import catalog
from cairn.plans.control import unique

DAY = 86_400_000


def test_token_round_trip_and_binding():
    token = tokens.encode_token("jobs", "state=4|x", 17, "id %|é")
    assert tokens.decode_token(token, "jobs", "state=4|x") == (17, "id %|é")
    for scope, wanted in (("audit", "state=4|x"), ("jobs", "state=5")):
        with pytest.raises(InvalidArgument):
            tokens.decode_token(token, scope, wanted)
    with pytest.raises(InvalidArgument):
        tokens.decode_token("v1|jobs", "jobs", "")
    with pytest.raises(InvalidArgument):
        tokens.encode_token("jobs", "x" * 2000, 1, "a")


def test_list_encoding():
    items = ["a|b", "", "c d", "ü"]
    assert tokens.decode_list(tokens.encode_list(items)) == items
    assert tokens.decode_list("") == []


def test_request_limits():
    with pytest.raises(InvalidArgument):
        paging.page_size(0)
    with pytest.raises(InvalidArgument):
        paging.page_size(101)
    assert paging.page_size(None) == 50


def test_contradictions_are_refused(spark):
    with pytest.raises(InvalidArgument):
        filters.in_scope("active", 4)
    with pytest.raises(InvalidArgument):
        filters.in_time("t", 5, 4)


def test_pages_cover_all_rows_with_equal_times(spark):
    df = spark.createDataFrame([(i, 100 - i // 7) for i in range(50)], "id long, created long")
    seen, place = [], None
    while True:
        page = paging.newest_first(df, "created", "id", 9, place).orderBy(F.desc("created"), "id").collect()
        seen += [r["id"] for r in page]
        if not page or not page[0]["has_more"]:
            break
        place = (page[-1]["created"], page[-1]["id"])
    assert seen == list(range(50))


def test_drain():
    pages = {None: ([1, 2], "a"), "a": ([3], None)}
    assert paging.drain(pages.get) == [1, 2, 3]
    with pytest.raises(Conflict):
        paging.drain(lambda t: ([1], "a") if t is None else ([2], "a"))


def test_unique(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Conflict):
        unique(df, "k")


def chain(n):
    return [(i, i - 1 if i else None) for i in range(n)]


def test_chains_of_legal_and_illegal_depth(spark):
    for n, deep in ((129, False), (130, True)):
        tops = graph.tops(spark.createDataFrame(chain(n), "id long, parent long"), "id", "parent")
        last = tops.where(F.col("id") == n - 1).first()
        assert (last["deep"], last["depth"] > 128) == (deep, deep)
        if not deep:
            assert last["top"] == 0


def test_missing_parent_and_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 3), (5, 6), (6, 5), (7, 7)], "id long, parent long")
    found = {r["id"]: r for r in graph.tops(df, "id", "parent").collect()}
    assert (found[2]["top"], found[2]["missing"]) == (1, False)
    assert (found[4]["top"], found[4]["missing"], found[4]["depth"]) == (3, True, 1)
    assert found[5]["deep"] and found[6]["deep"] and found[7]["deep"]


def test_ancestors_and_paths(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id long, parent long, name string")
    assert {(r["id"], r["ancestor"], r["distance"]) for r in graph.ancestors(df, "id", "parent").collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (2, 1, 1), (3, 2, 1), (3, 1, 2)}
    assert {r["id"]: list(r["path"]) for r in graph.paths(df, "id", "parent", "name").collect()} == {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"]}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent long")
    found = graph.descendants(df, df.where("id = 1"), "id", "parent")
    assert {(r["id"], r["depth"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 2)}


def ranges(spark, rows):
    return spark.createDataFrame(rows, "owner long, low long, high long")


def spans(df):
    return sorted((r["owner"], r["low"], r["high"]) for r in df.collect())


def test_merging_overlap_nested_and_touching(spark):
    df = ranges(spark, [(1, 0, 10), (1, 2, 4), (1, 10, 12), (1, 20, 30), (2, 5, 6), (2, 5, 6)])
    assert spans(intervals.merged(df, ["owner"])) == [(1, 0, 12), (1, 20, 30), (2, 5, 6)]


def test_subtracting_splits(spark):
    df, holes = ranges(spark, [(1, 0, 10), (2, 0, 5), (3, 1, 2)]), ranges(spark, [(1, 3, 5), (1, 9, 20), (2, 0, 5), (9, 0, 5)])
    assert spans(intervals.subtracted(df, holes, ["owner"])) == [(1, 0, 3), (1, 5, 9), (3, 1, 2)]


def test_overlap_join_counts_each_pair_once(spark):
    a = ranges(spark, [(1, 0, 1000), (1, 5, 5), (2, 0, 9)])
    b = ranges(spark, [(1, 10, 900), (1, 1000, 1001), (2, 8, 20)]).toDF("owner", "b_low", "b_high")
    found = intervals.overlapping(a, b, ["owner"], 16)
    assert sorted((r["owner"], r["low"], r["b_low"]) for r in found.collect()) == [(1, 0, 10), (2, 0, 8)]


def test_gaps_and_clip(spark):
    df = ranges(spark, [(1, 10, 20), (1, 100, 110)])
    assert spans(intervals.gaps(df, ["owner"], 200, 15)) == [(1, 20, 100), (1, 110, 200)]
    assert spans(intervals.clipped(df, F.lit(15), F.lit(100))) == [(1, 15, 20)]


def test_first_fit_takes_the_first_room(spark):
    wanted = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 9)], "owner long, request long, clusters long")
    free = ranges(spark, [(1, 0, 6), (1, 10, 20)])
    found = intervals.first_fit(wanted, free, "owner")
    assert sorted((r["request"], r["placed"]) for r in found.collect()) == [(1, 0), (2, 10), (3, -1)]


def test_chunking_with_a_short_last_block(spark):
    df = spark.createDataFrame([(1, 10), (2, 0), (3, 4)], "id long, size long")
    assert sorted((r["id"], r["offset"], r["length"]) for r in blocks.chunked(df, F.col("size"), 4).collect()) == [(1, 0, 4), (1, 4, 4), (1, 8, 2), (3, 0, 4)]


def test_dedup_windows_end_at_unchanged_blocks(spark):
    rows = [(0, 0, 3, "x", 5, False), (0, 1, 3, "x", 5, False), (0, 2, 3, "y", 5, True), (0, 3, 3, "x", 5, False), (0, 4, 3, "x", 6, False), (1, 5, 3, "x", 5, False), (0, 6, 2, None, 5, False)]
    df = spark.createDataFrame(rows, "chunk long, block_index long, state int, digest string, size long, same boolean")
    assert {r["block_index"]: r["canonical"] for r in blocks.deduplicated(df).collect()} == {0: 0, 1: 0, 2: None, 3: 3, 4: 4, 5: 5, 6: None}


def test_overlay_takes_the_last_layer(spark):
    df = spark.createDataFrame([(0, 1, "a"), (2, 1, "c"), (1, 1, "b"), (0, 2, "z")], "layer int, k long, v string")
    assert {(r["k"], r["v"]) for r in blocks.overlay(df, "k", "layer", ["v"]).collect()} == {(1, "c"), (2, "z")}


def test_purge_keeps_the_cutoff_itself(spark):
    df = spark.createDataFrame([(1, 4, 99), (2, 4, 100), (3, 2, None), (4, 5, None)], "id long, state int, completed_ms long")
    assert sorted(r["id"] for r in dml.purged(df, 100).collect()) == [2, 3, 4]
    assert dml.cutoff(5, 3) == 0


def test_upsert_keeps_the_creation_time(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, created long")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "id long, v string, created long")
    assert sorted(map(tuple, dml.upserted(old, new, "id", ["created"]).collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def next_run(spark, kind, now, minutes, mask=0):
    df = spark.createDataFrame([(now, minutes, mask)], "now long, minutes array<int>, mask long")
    columns = [F.col("now"), F.col("minutes")] + ([F.col("mask")] if kind != "daily" else [])
    return df.select(getattr(calendar, kind)(*columns).alias("n")).first()["n"]


def test_calendar_edges(spark):
    sunday = 3 * DAY  # 4 January 1970
    assert next_run(spark, "daily", 10 * 60_000, [10]) == DAY + 10 * 60_000  # a slot that is now rolls on
    assert next_run(spark, "daily", 5, []) == 5
    assert next_run(spark, "weekly", 0, [0], 1) == sunday
    assert next_run(spark, "weekly", sunday, [0], 1) == sunday + 7 * DAY
    assert next_run(spark, "weekly", 5, [1], 0) == 60_000
    february = 31 * DAY
    assert next_run(spark, "monthly", february, [0], 1 << 30) == february + (28 + 30) * DAY  # the 31st of March
    assert next_run(spark, "monthly", 7, [0], 0) == 7


def test_trigger_rules(spark):
    for minutes, ok in (([0], True), ([0, 30], True), ([0, 29], False), ([0, 1420], False), ([30, 0], False), ([1440], False), ([], False)):
        df = spark.createDataFrame([(minutes,)], "m array<int>")
        assert df.select(calendar.valid_minutes(F.col("m")).alias("v")).first()["v"] is ok, minutes


def test_texts(spark):
    df = spark.createDataFrame([("18446744073709551615", -5), ("007", 1023), ("+1", 1536), ("0", 1 << 41)], "t string, n long")
    found = df.select(texts.strict_u64(F.col("t")).alias("u"), texts.byte_size(F.col("n")).alias("s")).collect()
    assert [r["u"] if r["u"] is None else int(r["u"]) for r in found] == [18446744073709551615, None, None, 0]
    assert [r["s"] for r in found] == ["0 B", "1023 B", "1.5 KB", "2.00 TB"]


def test_hashes(spark, data):
    names = {r["n_nationkey"]: r["n_name"] for r in spark.read.parquet(f"{data}/nation.parquet").collect()}
    for r in catalog.QUERIES["h3_fnv1a"](spark, data).collect():
        h = 0xCBF29CE484222325
        for b in names[r["id"]].encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert r["fnv"] == str(h)
    assert all(r["crc"] == zlib.crc32(names[r["id"]].encode()) for r in catalog.QUERIES["m4_crc32"](spark, data).collect())
