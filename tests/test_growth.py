"""What grows with the tables: no side of a join whole in every task, no work or memory beyond a group's rows."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from grainframe.operators import joins, matching, overlap, packing, polygons, suppression
from grainframe.plans import catalogue
from grainframe.sources import workspace


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_each_pair_once(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, rng.randint(-30, 30) / 2, rng.randint(-30, 30) / 2, float(i)) for i in range(160)]
    frame = spark.createDataFrame([*rows, (0, 900, None, 1.0, 1.0), (0, 901, float("inf"), 1.0, 1.0), (0, None, 1.0, 1.0, 1.0)], "k int, i int, x double, y double, w double")
    found = joins.near_pairs(frame, ["k"], "i", "x", "y", 3.0, ["w"])
    wanted = {(p[0], p[1], q[1], p[2], q[2], p[4], q[4]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 3.0}
    got = [(r["k"], r["a"], r["b"], r["x_a"], r["x_b"], r["w_a"], r["w_b"]) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


@pytest.mark.parametrize("kind", ["polygons", "contacts"])
def test_pairs_in_the_plane_broadcast_nothing(spark, kind):
    """a side sent whole to every task passes through the driver, and fails there once it is large."""
    frame = spark.range(300).selectExpr("id % 3 AS k", "id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 23 AS DOUBLE) AS y", "1.0D AS radius", "array(1.0D, 2.0D, 1.5D, 1.0D) AS rays")
    if kind == "polygons":
        found = polygons.overlapping_pairs(frame, ["k"], "id", "x", "y", "rays")
    else:
        found = suppression.contact_pairs(frame, ["k"], "id", "x", "y", "radius", 1.5, 1.0)
    assert found.count() > 0 and "Broadcast" not in plan_of(found)


def test_polygon_pairs_are_made_in_tasks(spark, monkeypatch):
    """F1 of round 4: a join made every pair with both polygons' rays; now rows are dealt by blocks, each pair is made once in one unit."""
    rng = random.Random(11)
    rows = [(rng.choice(["u", "v", None]), i, rng.randint(-40, 40) / 2, rng.randint(-20, 20) / 2, [float(rng.randint(1, 5)) for _ in range(6)]) for i in range(220)]
    rows += [("u", 300 + i, 2.0, 2.0, [2.0] * 6) for i in range(30)] + [("v", 400, 0.0, 0.0, [3.0, 0.0, 3.0, 0.0, 3.0, 3.0])]
    bad = [("u", 500, None, 1.0, [1.0] * 6), ("u", 501, 1.0, 1.0, None), ("u", None, 1.0, 1.0, [1.0] * 6), ("u", 502, float("inf"), 1.0, [1.0] * 6)]
    frame = spark.createDataFrame(rows + bad, "k string, id int, x double, y double, r array<double>").repartition(3)
    wanted = {}
    for key in "uv":
        mine = [p for p in rows if p[0] == key]
        for at, p in enumerate(mine[:-1]):
            for q, iou in zip(mine[at + 1 :], polygons.star_overlap(p[2:5], [q[2:5] for q in mine[at + 1 :]])):
                if iou > 1e-6:
                    wanted[key, p[1], q[1]] = iou
    for block in (7, 5_000):
        monkeypatch.setattr(joins, "BLOCK", block)
        monkeypatch.setattr(joins, "TASK_PAIRS", 40 * block)
        found = polygons.overlapping_pairs(frame, ["k"], "id", "x", "y", "r")
        assert plan_of(found).count("Join") == 1 and "Broadcast" not in plan_of(found)  # of points with their cells' counts
        got = [((r["k"], r["a"], r["b"]), r["iou"]) for r in found.where("iou > 1e-6").collect()]
        assert len(got) == len(wanted) and all(abs(wanted[pair] - iou) < 1e-9 for pair, iou in got)
    assert polygons.overlapping_pairs(frame.limit(0), ["k"], "id", "x", "y", "r").count() == 0


def test_nearest_frames_only_grow(spark):
    """a frame from the current row to the end is gone through anew for every row, so a cell's time grew with its square."""
    left, right = (spark.range(50).selectExpr("id % 2 AS k", "id", "CAST(id * 7 % 31 AS DOUBLE) AS x") for _ in "ab")
    plan = plan_of(joins.nearest(left, right.withColumnRenamed("id", "r"), "k", "x", "r")).lower()
    assert "specifiedwindowframe(rangeframe" in plan and "rangeframe, currentrow$(), unboundedfollowing" not in plan


def test_nearest_point_makes_no_pairs(spark):
    """all pairs of a cell were made and sorted to find the nearest, so a task's memory grew with their square."""
    rng = random.Random(5)
    place = lambda: (rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4)
    left = [(i % 2, i, *place()) for i in range(150)] + [(0, 900, None, 1.0), (None, 901, 1.0, 1.0), (1, 902, float("nan"), 1.0), (1, 903, 500.0, 0.0)]
    right = [(i % 2, i, *place()) for i in range(60)] + [(0, 70, 1.0, 1.0), (0, 69, 1.0, 1.0), (0, 71, None, 0.0), (1, None, 2.0, 2.0)]
    frames = [spark.createDataFrame(rows, f"k int, {n} int, x double, y double") for rows, n in ((left, "l"), (right, "r"))]
    found = suppression.nearest_point(*frames, ["k"], "l", "r", "x", "y", 2.5)
    plan = plan_of(found)
    assert plan.count("Join") == 1  # of the answers with their rows
    got = {r["l"]: (r["near_id"], r["distance"]) for r in found.collect()}
    assert len(got) == len(left)
    for k, i, x, y in left:
        fits = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for m, j, u, v in right if None not in (x, k, j, u) and m == k]
        assert got[i] == min(((j, d) for d, j in fits if d <= 2.5), key=lambda t: (t[1], t[0]), default=(None, None))


def test_ties_and_stars_need_no_components(spark, monkeypatch):
    """every label that competes went through rounds of components, stars and ties at one half too."""
    rows = [(0, 1, 10, 0.5), (0, 1, 11, 0.5), (0, 2, 12, 0.5), (0, 3, 12, 0.5), (0, 4, 13, 0.5), (0, 5, 14, 0.9)]
    pairs = spark.createDataFrame(rows, "k int, truth int, prediction int, iou double")
    calls, plain = [], matching.connected_components
    monkeypatch.setattr(matching, "connected_components", lambda links, *a: (calls.append(1), plain(links, *a))[1])
    for threshold in (0.5, 0.4):
        assert sorted((r["truth"], r["prediction"]) for r in matching.matches(pairs, ["k"], threshold).collect()) == [(1, 10), (2, 12), (4, 13), (5, 14)]
    assert not calls
    chain = spark.createDataFrame([(0, 1, 1, 0.4), (0, 1, 2, 0.45), (0, 2, 2, 0.4), (0, 3, 5, 0.3), (0, 4, 5, 0.35)], pairs.schema)
    assert sorted((r["truth"], r["prediction"]) for r in matching.matches(chain, ["k"], 0.25).collect()) == [(1, 1), (2, 2), (4, 5)] and calls


@pytest.mark.parametrize("spread", [1, 7919])
def test_chains_within_ranges_need_no_rounds(spark, monkeypatch, spread):
    """every chain went through rounds of components; now only what ties ranges together does, and no matching changes."""
    rng = random.Random(spread)
    rows = [(k, i * spread % 50_021, j * spread % 50_021, rng.choice([0.25, 0.3, 0.4, rng.uniform(0.25, 0.5)])) for k in ("a", "b") for i in range(400) for j in (i, i + 1) if rng.random() < 0.8]
    rows += [("a", 90_000 + i, 90_000 + (i + d) % 3, 0.25 + 0.05 * d) for i in range(3) for d in (0, 1)]  # a ring
    pairs = spark.createDataFrame(rows, "k string, truth int, prediction int, iou double").repartition(3)
    links, plain = [], matching.connected_components
    monkeypatch.setattr(matching, "connected_components", lambda found, *a: (links.append(found.count()), plain(found, *a))[1])
    monkeypatch.setattr(matching, "RANGE_ROWS", 150)
    got = [(r["k"], r["truth"], r["prediction"], r["iou"]) for r in matching.matches(pairs, ["k"], 0.25).collect()]
    assert len(got) == len({g[:2] for g in got}) == len({(g[0], g[2]) for g in got}) and set(got) <= set(rows)
    for k in ("a", "b"):
        own = [r[1:] for r in rows if r[0] == k]
        best = [own[i] for i in matching.assign(own)]
        mine = [g[1:] for g in got if g[0] == k]
        assert len(mine) == len(best) and abs(sum(w for *_, w in mine) - sum(w for *_, w in best)) < 1e-9
    assert spread > 1 or links[0] < 20  # of over a thousand pairs


def test_assignment_of_a_tangle_ends():
    """an end found farther than the best one took its place, costs fell below 0, and a path went round for ever."""
    rng = random.Random(3)
    tangle = [(t, p, rng.random()) for t, p in sorted({(rng.randrange(5000), rng.randrange(5000)) for _ in range(20_000)})]
    found = [tangle[k] for k in matching.assign(tangle)]
    assert len({t for t, *_ in found}) == len({p for _, p, _ in found}) == len(found)
    for n in range(1, 9):
        path = [((i + 1) // 2, i // 2, rng.random()) for i in range(n)]
        rng.shuffle(path)
        assert matching.along_path(path) == matching.assign(path)
    assert matching.along_path([(1, 1, 0.4), (1, 2, 0.4)]) is None is matching.along_path([(t, p, 0.4 + t / 9) for t in (0, 1) for p in (0, 1)])


@pytest.mark.parametrize("max_nodes", [60, 20_000])
def test_packing_within_keys_needs_no_components(spark, monkeypatch, max_nodes):
    """every candidate went through rounds of components though keys keep candidates apart; keys beyond the bounds still do."""
    rng = random.Random(max_nodes)
    nodes = [(i, i * 7 % 20 if i < 150 else None if i < 200 else 99, rng.random() < 0.1, rng.choice([0.2, 0.3, 0.5, 0.55, 0.9, 1.1]), rng.randrange(1, 4), rng.randrange(6) if i < 200 else i // 2) for i in range(280)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(nodes[:200], 2) if a[1] == b[1] and rng.random() < 0.15] + [(i, i + 2) for i in range(200, 270, 8)]
    frame = spark.createDataFrame(nodes, "id int, key int, marked boolean, score double, area int, marker int").repartition(3)
    both = spark.createDataFrame([*links, *((b, a) for a, b in links), links[0], (7, 7), (5, 900)], "a int, b int")
    calls, plain = [], packing.connected_components
    monkeypatch.setattr(packing, "connected_components", lambda found, *a: (calls.append(1), plain(found, *a))[1])
    found = packing.pack(frame, "id", both, ["key", "marker"], F.col("marked"), max_nodes, within=["key"])
    assert not calls if max_nodes > 80 else calls
    order = sorted(nodes, key=lambda n: (not n[2], -n[3], -n[4], n[0]))
    place = {n[0]: i for i, n in enumerate(order)}
    around = [[] for _ in order]
    for a, b in links:
        around[place[a]].append(place[b])
        around[place[b]].append(place[a])
    known = packing.settle([(n[2], n[3], (n[1], n[5])) for n in order], around)
    assert sorted(r["id"] for r in found.collect()) == sorted(order[i][0] for i in known)


def test_a_task_keeps_its_rows_as_counts_grow(spark, monkeypatch):
    """F8: counts of any size went into the session's few partitions, so a task's memory grew with them."""
    monkeypatch.setattr(workspace, "TASK_ROWS", 100)
    cells = spark.range(1200).selectExpr("id % 2 AS k", "IF(id % 7 = 0, NULL, id) AS truth", "IF(id % 5 = 0, NULL, id DIV 2) AS prediction")
    counts = overlap.overlap_counts(cells, ["k"])
    assert workspace.dealt(counts, 1200, "truth").rdd.getNumPartitions() == 12 and "Join" not in plan_of(overlap.overlap_iou(counts, ["k"]))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    areas = {r["truth"]: (r["truth_area"], r["prediction_area"]) for r in overlap.overlap_iou(counts, ["k"]).collect()}
    assert len(areas) == sum(i % 7 != 0 and i % 5 != 0 for i in range(1200)) and set(areas.values()) == {(1, 1)}


def test_costly_rows_are_dealt_to_all_cores(spark, small_dir):
    """rows stayed in the one or few splits of their small file, while a row costs far more than its reading."""
    found = catalogue.queries()["c35_plane_and_colour"](spark, small_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
