"""Queries that once answered for a part of their rows, against brute-force versions over all of them."""

from cairn.plans import dml
from cairn.plans import control
from cairn.plans import graph as graph_plans
from cairn.operators import intervals
from cairn.plans import intervals as plans


def ranges(spark, rows):
    return spark.createDataFrame(rows, "owner long, low long, high long")


def placed_by_bitmap(used, requests, total):
    """Cluster by cluster: the first run of free clusters, but for the first, the last and the reserve."""
    free = [0 < c < total - 1 and not any(low <= c < high for low, high in used) for c in range(total)]
    found = []
    for n in requests:
        at = -1
        if sum(free) - max(64, total // 100) >= n:
            at = next((c for c in range(total - n + 1) if all(free[c : c + n])), -1)
        if at >= 0:
            free[at : at + n] = [False] * n
        found.append(at)
    return found


def test_first_fit_places_all_requests_of_a_large_owner(spark):
    of = {1: [(7 * i % 1900 * 2 + 10, 7 * i % 1900 * 2 + 11 + i % 2) for i in range(300)], 2: [(0, 30), (4000, 4030)], 3: [(0, 4000)], 4: [(1, 2)] * 12}
    df = ranges(spark, [(o, *r) for o, rows in of.items() for r in rows])
    found = sorted(tuple(r) for r in plans.i10_first_fit(df).collect())
    expected = [(o, i + 1, at) for o, rows in of.items() for i, at in enumerate(placed_by_bitmap(rows, [3 * (high - low) for low, high in sorted(rows)], 4096))]
    assert found == expected
    assert len([x for x in found if x[0] == 1]) == 300


def test_first_fit_keeps_reserve_and_outer_clusters(spark):
    sizes = [40, 70, 30, 200, 1, 60, 25, 1, 5, 300, 2]
    wanted = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "owner long, request long, clusters long")
    found = intervals.first_fit(wanted, ranges(spark, [(1, 0, 60), (1, 100, 310), (1, 395, 400)]), "owner", 400)
    assert [r["placed"] for r in sorted(found.collect())] == placed_by_bitmap([(60, 100), (310, 395)], sizes, 400)


def points(spark, n=420):
    """Chains in which each point names one before it, now and then none, and 97 and 194 are hidden."""
    rows = [(i, i % 4, 1, 1000 + i, None if i % 23 == 1 else max(1, i - 1 - i % 3), 1 if i % 23 == 1 else 2, i % 3 + 1, i % 2 == 0) for i in range(1, n)]
    return spark.createDataFrame(rows, "file_id long, backup_set long, content_kind int, created_ms long, parent_id long, backup_type int, parts int, has_sidecar boolean")


def walked(df):
    """Each visible point with the points up from it, itself first."""
    seen = {r["file_id"]: r for r in df.collect() if r["file_id"] % 97}
    up = {}
    for i in seen:
        up[i], at = [], i
        while at in seen:
            up[i].append(at)
            at = seen[at]["parent_id"]
    return seen, up


def test_every_point_has_its_subtree_and_its_delete_plan(spark):
    df = points(spark)
    seen, up = walked(df)
    below = {(t, i, d) for i, chain in up.items() for d, t in enumerate(chain)}
    found = [tuple(r) for r in graph_plans.g5_descendants(df).collect()]
    assert len(found) == len(below) and set(found) == below
    members = lambda r: [".bhx"] * r["has_sidecar"] + [f".{p:03d}" for p in range(r["parts"] - 1, 0, -1)] + ["main"]
    plans_found = {}
    for r in sorted(graph_plans.g6_delete_plan(df).collect()):
        plans_found.setdefault((r["target"], r["point"], r["depth"]), []).append((r["ordinal"], r["member"]))
    assert {k: [m for _, m in sorted(v)] for k, v in plans_found.items()} == {k: members(seen[k[1]]) for k in below}


def test_every_point_has_its_chain_and_its_verdict(spark):
    df = points(spark)
    seen, up = walked(df)
    found = [tuple(r) for r in graph_plans.g2_chain_base_first(df).collect()]
    assert sorted(found) == sorted((i, p, n) for i, chain in up.items() for n, p in enumerate(reversed(chain)))
    usable = {i: seen[c[-1]]["backup_type"] == 1 and len({seen[p]["backup_set"] for p in c}) == 1 and len(c) <= 129 for i, c in up.items()}
    found = [tuple(r) for r in graph_plans.g9_volume_parent(df).collect()]
    assert len(found) == len(usable) and dict(found) == usable


def test_volumes_of_every_owner_count(spark):
    part = [(i, i * 7 % 50 + 1) for i in range(1, 101)]
    df = [(o, o * 131 % 2000 + 40 * k, o * 131 % 2000 + 40 * k + 1 + o % 9) for o in range(1, 90) for k in range(2)]
    parts, rows = spark.createDataFrame(part, "p_partkey long, p_size int"), ranges(spark, df)
    bare = [p for p, n in part if not any(o % 20 == p % 20 and low < n * 40 + 60 and n * 40 < high for o, low, high in df)]
    assert sorted(r[0] for r in plans.j12_uncovered_partitions(parts, rows).collect()) == bare
    first = {(o, low): min(m) for o, low, _ in df if (m := [p for p, n in part if p % 20 == o % 20 and n == low % 50 + 1])}
    assert bare and first and {(r[0], r[1]): r[2] for r in control.n6_first_match(rows, parts).collect()} == first


def tree(spark):
    """Folders whose ids don't tell their depth, and files among them."""
    rows = [(5, None, 1), (90, 700, 1), (700, 2000, 1), (2000, 5, 1), (3, 90, 1), (8, 5, 1), (1, 3, 2), (4000, 8, 2), (2, 5, 2)]
    rows += [(10_000 + i, 8, 2) for i in range(200)]
    return rows, spark.createDataFrame(rows, "entry_id long, parent_id long, kind int")


def test_restore_order_has_every_entry(spark):
    rows, df = tree(spark)
    up = {i: p for i, p, _ in rows}
    depth = lambda i: 0 if up[i] is None else 1 + depth(up[i])
    order = sorted(rows, key=lambda r: (r[2], depth(r[0]) if r[2] == 1 else 0, r[0]))
    found = sorted(control.o11_restore_order(df).collect(), key=lambda r: r["nth"])
    assert [(r["entry_id"], r["kind"], r["depth"], r["nth"]) for r in found] == [(i, k, depth(i) if k == 1 else None, n) for n, (i, _, k) in enumerate(order, 1)]


def test_every_entry_has_a_height_and_every_point_a_next_step(spark):
    rows, df = tree(spark)
    height = lambda i: max((1 + height(c) for c, p, _ in rows if p == i), default=0)
    assert sorted(tuple(r) for r in graph_plans.o12_post_order(df).collect()) == sorted((i, height(i)) for i, _, _ in rows)
    gone = [10, 11, 97, 300]
    tombstones = spark.createDataFrame([(i * 10, i) for i in gone], "operation_id long, file_id long")
    found = sorted(tuple(r) for r in dml.z7_delete_resume(points(spark), tombstones).collect())
    assert found == [(i, "plan" if i not in gone else "resume" if i % 2 else "done") for i in range(1, 420)]


def equal_ranges(n=60, owners=12):
    """Ranges of which most are there several times, also such that begin a run of joined ranges."""
    return [(o, low := (o * 977 + k * 389) % 4000, low + 1 + (o + k) % 50) for o in range(owners) for k in range(n) for _ in range(1 + (o + k) % 5)]


def runs(cells):
    """Maximal runs of cells as half-open ranges."""
    return [(c, next(e for e in range(c + 1, 10_000) if e not in cells)) for c in sorted(cells) if c - 1 not in cells]


def cells_of(rows):
    used = {}
    for o, low, high in rows:
        used.setdefault(o, set()).update(range(low, high))
    return used


def test_equal_ranges_are_merged_cell_by_cell(spark):
    rows = equal_ranges()
    expected = sorted((o, *r) for o, cells in cells_of(rows).items() for r in runs(cells))
    for df in (ranges(spark, rows), ranges(spark, rows[::-1]).repartition(7)):
        assert sorted(tuple(r) for r in plans.i1_merged(df).collect()) == expected


def test_equal_ranges_count_once_as_used(spark):
    rows = equal_ranges()
    expected = sorted((o, len(cells), 5000 - len(cells)) for o, cells in cells_of(rows).items())
    for df in (ranges(spark, rows), ranges(spark, rows[::-1]).repartition(7)):
        assert sorted(tuple(r) for r in plans.a13_free_bytes(df).collect()) == expected


def test_equal_ranges_without_holes_cell_by_cell(spark):
    rows = equal_ranges()
    holes = cells_of((o, low + 5, low + 15) for o, low, _ in rows if low % 3 == 0)
    expected = sorted((o, *r) for o, cells in cells_of(rows).items() for r in runs(cells - holes.get(o, set())))
    assert holes and expected
    for df in (ranges(spark, rows), ranges(spark, rows[::-1]).repartition(7)):
        assert sorted(tuple(r) for r in plans.i2_subtracted(df).collect()) == expected


def test_joined_ranges_are_sorted_once(spark):
    """Equal ranges of an owner must come to both windows in one order, which holds as long as nothing sorts or deals them in between."""
    plan = plans.i1_merged(ranges(spark, equal_ranges()))._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Window ["), plan.count("Sort ["), plan.count("Exchange hashpartitioning")) == (2, 1, 1)
