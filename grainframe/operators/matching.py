"""Matching of truths with predictions: most pairs first, then the greatest sum of overlap.

From an overlap above one half on, a label has one partner at most, and every pair stands; at one half only ties compete.
Below, labels compete: where all partners of a label have no other, the best pair stands; the rest falls into components of the graph of pairs, and each
component is solved exactly.
Overlap bounds how many partners a label can have (1 / threshold), so components stay small against the data. Labels are dealt by
ranges, and a task joins what meets in its range; only what crosses ranges goes through rounds of components.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from grainframe.operators.components import connected_components
from grainframe.sources.workspace import Workspace, dealt

#: Pairs of one component that a task solves; beyond that the matching is refused, never cut.
MAX_PAIRS = 200_000
#: Pairs of a range of truths, which one task joins into components.
RANGE_ROWS = 125_000


def assign(pairs: list[tuple[int, int, float]]) -> list[int]:
    """Places of the chosen ones among ``(truth, prediction, weight)``; weights are 0 to 1.

    Each pair is worth its weight and more than all weights together, so most pairs come first. Truths are added one by one:
    a shortest path over chosen and open pairs leads from the new truth to a free prediction, or to a truth that gives its
    own up. Potentials keep all costs positive, and only those of nodes that a path has reached are touched. Weights are taken
    as whole numbers of their common unit, so no rounding decides. The end only ever comes nearer: a path never goes beyond it.
    """
    around: dict = defaultdict(list)
    ratios = [float(w).as_integer_ratio() for _, _, w in pairs]
    unit = max((d for _, d in ratios), default=1)  # denominators are powers of two
    worth = [n * (unit // d) for n, d in ratios]
    each = sum(worth) + 1
    for k, (t, p, _) in enumerate(pairs):
        around[t].append((p, -(each + worth[k]), k))
    height_t, height_p, held_by, holds = {}, defaultdict(int), {}, {}
    for new in around:
        height_t[new] = min(0, min(cost - height_p[p] for p, cost, _ in around[new]))
        far_t, far_p, came, heap, done = {new: 0}, {}, {}, [(0, 0, new)], set()
        best, end, n = float("inf"), None, 0  # the end is a free prediction, or a truth that stays alone
        while heap and heap[0][0] < best:
            d, _, t = heapq.heappop(heap)
            if t in done:
                continue
            done.add(t)
            base = d - height_t[t]
            if base < best:
                best, end = base, (t, None)
            for p, cost, k in around[t]:
                at = base + cost - height_p[p]
                if at < min(best, far_p.get(p, best)) and holds.get(t) != k:
                    far_p[p], came[p] = at, k
                    holder = held_by.get(p)
                    if holder is None:
                        best, end = at, (None, p)
                    elif at < far_t.get(back := pairs[holder][0], float("inf")):
                        far_t[back], n = at, n + 1
                        heapq.heappush(heap, (at, n, back))
        for t in done:
            height_t[t] += best - far_t[t]
        for p, at in far_p.items():
            if at < best:
                height_p[p] -= best - at
        alone, p = end
        if alone is not None:
            if alone == new:
                continue
            p = pairs[holds.pop(alone)][1]
        while True:
            k = came[p]
            t = pairs[k][0]
            before = holds.get(t)
            held_by[p], holds[t] = k, k
            if t == new:
                break
            p = pairs[before][1]
    return sorted(held_by[p] for p in held_by)


def along_path(pairs: list[tuple[int, int, float]]) -> list[int] | None:
    """As ``assign`` where the pairs form one path; none where they don't, or where the best sum isn't clear.

    Of an odd number of pairs only every other one, the first included, makes the most. Of an even number, every other one from
    the first stands up to some place, and every other one from the second from there on.
    """
    of_t, of_p = {}, {}
    for k, (t, p, _) in enumerate(pairs):
        of_t.setdefault(t, []).append(k)
        of_p.setdefault(p, []).append(k)
    ends = [(at, of) for of in (of_t, of_p) for at in of.values() if len(at) == 1]
    if len(ends) != 2 or any(len(at) > 2 for of in (of_t, of_p) for at in of.values()):
        return None
    (k,), by_truth = ends[0][0], ends[0][1] is of_t
    order = [k]
    while True:
        by_truth = not by_truth
        at = of_t[pairs[k][0]] if by_truth else of_p[pairs[k][1]]
        if len(at) == 1:
            break
        k = at[1] if at[0] == k else at[0]
        order.append(k)
    if len(order) != len(pairs):
        return None
    if len(order) % 2:
        return sorted(order[::2])
    first, second = order[::2], order[1::2]
    sums = [sum(pairs[k][2] for k in second)]
    for a, b in zip(first, second):
        sums.append(sums[-1] + pairs[a][2] - pairs[b][2])
    best = max(range(len(sums)), key=sums.__getitem__)
    if sum(x > sums[best] - 1e-9 for x in sums) > 1:
        return None
    return sorted(first[:best] + second[best:])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range with ``root_``: the least node (of ``t_, p_``) that a pair is linked to within the range."""
    held = list(batches)
    ends = [np.concatenate([batch.column(batch.schema.names.index(c)).to_numpy() for batch in held] or [np.zeros(0, np.int64)]) for c in ("t_", "p_")]
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    (t, p), least = places.reshape(2, -1), np.arange(len(nodes))
    while (least[t] != least[p]).any():
        a, b = least[t], least[p]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))  # the larger of two roots goes below the smaller
        while (least != least[least]).any():
            least = least[least]
    roots, done = nodes[least[t]], 0
    for batch in held:
        mine = pa.array(roots[done : (done := done + batch.num_rows)])
        yield pa.RecordBatch.from_arrays([*batch.columns, mine], names=[*batch.schema.names, "root_"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen pairs of components that come whole and in order."""
    held: list[tuple] = []  # (component, truth, prediction, iou, batch, row) of the component that is open

    def solve() -> list[tuple]:
        if len(held) > MAX_PAIRS:
            raise ValueError(f"a component of {len(held)} pairs is more than one task takes")
        if (found := along_path([r[1:4] for r in held])) is not None:
            return [held[k] for k in found]
        part = sorted(held, key=lambda r: (str(r[1]), str(r[2])))
        return [part[k] for k in assign([r[1:4] for r in part])]

    def rows_of(chosen: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_batch: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        for *_, batch, row in chosen:
            by_batch.setdefault(id(batch), (batch, []))[1].append(row)
        for batch, rows in by_batch.values():
            yield batch.take(pa.array(rows))

    chosen: list[tuple] = []
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in ("component_", "key_", "truth", "prediction", "iou")]
        for row, (number, key, truth, prediction, iou) in enumerate(zip(*columns)):
            component = number, key
            if held and held[0][0] != component:
                chosen += solve()
                held = []
            held.append((component, truth, prediction, iou, batch, row))
        yield from rows_of(chosen)
        chosen = []
    if held:
        yield from rows_of(solve())


def matches(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """The matching among pairs (``keys, truth, prediction, iou`` ...) with an ``iou`` of ``threshold`` or more.

    It has the most pairs, and among those the greatest sum of ``iou``. A label may be in several matchings of equal value;
    which one is taken is fixed by the order of labels.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    open_ = pairs.where(F.col("iou") >= threshold)
    if threshold > 0.5:
        return open_
    work, rivals = Workspace(pairs.sparkSession, "matching"), F.count("*").over(Window.partitionBy(*keys, "prediction"))
    if threshold < 0.5:
        return _competing(work.save(open_.withColumn("np_", rivals), "open"), keys, work)
    open_ = work.save(open_, "open")  # labels of a map are disjoint, so a pair above one half leaves its labels no other of a half
    ties = open_.where(F.col("iou") == 0.5)
    if not (rows := ties.count()):
        return open_
    ties = work.save(dealt(ties, rows, *keys, "prediction").withColumn("np_", rivals), "ties")
    return open_.where(F.col("iou") > 0.5).union(_competing(ties, keys, work))


def _competing(open_: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """The matching among pairs that compete. ``open_`` is a saved table with ``np_``, the pairs of a prediction.

    Where all partners of a label have no other, its best pair stands, by the order of labels if several are; so does a pair that
    is alone. Two labels of one half each leave no room, so ties at one half are all of this kind. Only what is left has chains.
    """
    rows, columns = open_.count(), [c for c in open_.columns if c != "np_"]
    of_t, of_p = Window.partitionBy(*keys, "truth"), Window.partitionBy(*keys, "prediction")
    best = lambda window, other: F.row_number().over(window.orderBy(F.col("iou").desc(), F.col(other).cast("string")))
    held = dealt(open_, rows, *keys, "truth").withColumns({"nt_": F.count("*").over(of_t), "most_np_": F.max("np_").over(of_t), "place_t_": best(of_t, "prediction")})
    held = dealt(held, rows, *keys, "prediction").withColumns({"most_nt_": F.max("nt_").over(of_p), "place_p_": best(of_p, "truth")})
    held = work.save(held, "degrees")
    stars = held.where("(most_np_ = 1 AND place_t_ = 1) OR (most_np_ > 1 AND most_nt_ = 1 AND place_p_ = 1)").select(*columns)
    rest = held.where("most_np_ > 1 AND most_nt_ > 1").select(*columns)
    return stars if rest.isEmpty() else stars.union(_by_components(rest, keys, work))


def _by_components(open_: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """The matching among pairs of components that are no stars.

    Nodes are hashes. Two with one hash put two components into one, which changes no matching as long as keys stay apart. A truth
    lies in one range, so ranges are linked where a prediction has pairs in several.
    """
    columns, rows = open_.columns, open_.count()
    node = lambda side: F.xxhash64(*keys, F.lit(side), F.col(side).cast("string"))
    ranges = open_.repartitionByRange(-(-rows // RANGE_ROWS), *keys, "truth").withColumns({"t_": node("truth"), "p_": node("prediction")})
    rooted = work.save(ranges.mapInArrow(_rooted, StructType([*ranges.schema.fields, StructField("root_", LongType())])), "rooted")
    met = dealt(rooted.select("p_", "root_"), rows, "p_").withColumn("least_", F.min("root_").over(Window.partitionBy("p_")))
    found = connected_components(met.where("root_ <> least_").select(F.col("root_").alias("a"), F.col("least_").alias("b")), work)
    placed = rooted.join(found.select(F.col("node").alias("root_"), "component"), "root_", "left")
    placed = placed.select(*columns, F.coalesce("component", "root_").alias("component_"), (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("key_"))
    return dealt(placed, rows, "component_").sortWithinPartitions("component_", "key_").mapInArrow(_solved, placed.schema).select(*columns)
