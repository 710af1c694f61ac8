"""Best closed paths around rings: one state at each angle, by evidence less what changes of state cost.

A stretch of angles is a matrix of the best score from each state at its beginning to each at its end. Such matrices compose
associatively (the best over what joins them), so a long ring is cut into stretches that tasks take apart, and pairs of
stretches are composed level by level. From the top down, each pair then learns the states at which its halves meet, and each
stretch finds its own path between two known states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.operators.ordered import join_nulls
from grainframe.sources.workspace import Workspace

#: Angles of one stretch.
STRETCH = 256
#: States at which a path may begin: the best of the first angle, and the middle one.
STARTS = 10
#: How much dearer than other changes the one that closes the ring is.
CLOSURE = 1.5


def steps(states: int, smoothness: float, reach: int) -> np.ndarray:
    """Score of going from a state to another: what the change costs, or out of reach."""
    gap = np.abs(np.arange(states)[:, None] - np.arange(states)[None])
    return np.where(gap <= reach, -smoothness * gap, -np.inf)


def join_best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best over the state in between: (a ⊗ b)[i, j] = max over k of a[i, k] + b[k, j]."""
    return (a[:, :, None] + b[None]).max(axis=1)


def stretch_matrix(evidence: np.ndarray, step: np.ndarray) -> np.ndarray:
    found = np.full(step.shape, -np.inf)
    np.fill_diagonal(found, evidence[0])
    for row in evidence[1:]:
        found = join_best(found, step) + row
    return found


def stretch_path(evidence: np.ndarray, step: np.ndarray, first: int, last: int) -> list[int]:
    """States of the best path from ``first`` to ``last``; of equal ways the one from the highest state."""
    score, came = np.full(step.shape[0], -np.inf), []
    score[first] = evidence[0][first]
    for row in evidence[1:]:
        ways = (score[:, None] + step)[::-1]
        came.append(len(score) - 1 - ways.argmax(axis=0))
        score = ways.max(axis=0) + row
    path = [last]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def _ends(whole: np.ndarray, first_row: np.ndarray, smoothness: float, reach: int) -> tuple[float, int, int]:
    """Score and end states of the best closed path; no score where none closes."""
    states = len(first_row)
    order = np.argsort(first_row, kind="stable")[-min(STARTS, states) :]
    best = (-np.inf, states // 2, states // 2)
    for start in np.unique(np.append(order, states // 2)).tolist():
        gap = np.abs(np.arange(states) - start)
        total = whole[start] - np.where(gap <= reach, CLOSURE * smoothness * gap, np.inf)
        end = int(total.argmax())
        if total[end] > best[0]:
            best = (float(total[end]), start, end)
    return best


def cyclic_paths(evidence: DataFrame, ring: str, smoothness: float, reach: int) -> DataFrame:
    """``ring, angle, state, score``: the best closed path of each ring and its score.

    ``evidence``: ring, ``angle`` from 0 without gaps, and ``u``, an array with the evidence of each state, as long for all. A
    change by more than ``reach`` states is no way. A path begins at the angle of the strongest evidence (the first of equals),
    in one of its ``STARTS`` best states or the middle one. Where no path closes, the middle state is taken throughout and the
    score is null.
    """
    work = Workspace(evidence.sparkSession, "rings")
    held = work.save(evidence.select(ring, F.col("angle").cast("long").alias("angle"), F.col("u").cast("array<double>").alias("u")), "evidence")
    states = held.agg(F.max(F.size("u"))).first()[0]
    kind = evidence.schema[ring].dataType.simpleString()
    if states is None:
        return evidence.select(ring, "angle", F.lit(0).cast("long").alias("state"), F.lit(0.0).alias("score")).limit(0)
    turns = held.groupBy(ring).agg(F.max(F.struct(F.array_max("u").alias("m"), (-F.col("angle")).alias("a"))).alias("b"), F.count("*").alias("n")).select(ring, (-F.col("b.a")).alias("turn"), "n")
    rolled = join_nulls(held, turns, [ring]).withColumn("at", F.pmod(F.col("angle") - F.col("turn"), F.col("n")))
    parts = rolled.groupBy(ring, F.floor(F.col("at") / STRETCH).alias("part"), "turn", "n").agg(F.array_sort(F.collect_list(F.struct("at", "u"))).alias("rows"))
    parts = work.save(parts.withColumn("rows", F.transform("rows", lambda r: r["u"])), "parts")
    step = steps(states, smoothness, reach)
    shape = step.shape

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretch_matrix(np.array(rows), step).tobytes() for rows in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=[ring, "part", "m"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one = np.frombuffer(left).reshape(shape)
                found.append(left if right is None else join_best(join_best(one, step), np.frombuffer(right).reshape(shape)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=[ring, "part", "m"])

    levels = [work.save(parts.select(ring, "part", "rows").mapInArrow(matrices, f"`{ring}` {kind}, part bigint, m binary"), "level-0")]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        below = levels[-1]
        left = below.where("part % 2 = 0").select(ring, F.floor(F.col("part") / 2).alias("part"), F.col("m").alias("left"))
        right = below.where("part % 2 = 1").select(ring, F.floor(F.col("part") / 2).alias("part"), F.col("m").alias("right"))
        pairs = join_nulls(left, right, [ring, "part"], "left").select(ring, "part", "left", "right")
        levels.append(work.save(pairs.mapInArrow(composed, f"`{ring}` {kind}, part bigint, m binary"), f"level-{len(levels)}"))

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_ends(np.frombuffer(m).reshape(shape), np.array(rows[0]), smoothness, reach) for m, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            score = pa.array([None if s == -np.inf else s for s, *_ in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score, pa.array(np.zeros(len(found), dtype=np.int64)), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))], names=[ring, "score", "part", "first", "last"])

    first_rows = parts.where("part = 0").select(ring, F.slice("rows", 1, 1).alias("rows"))
    tops = join_nulls(levels[-1].select(ring, "m"), first_rows, [ring]).select(ring, "m", "rows")
    ends = work.save(tops.mapInArrow(closed, f"`{ring}` {kind}, score double, part bigint, first bigint, last bigint"), "ends")
    scores, known = ends.select(ring, "score"), ends.select(ring, "part", "first", "last")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a pair with known ends, the states at which its halves meet."""
        for batch in batches:
            rows = []
            for r, part, first, last, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if right is None:
                    rows.append((r, 2 * part, first, last))
                    continue
                ways = np.frombuffer(left).reshape(shape)[first][:, None] + step + np.frombuffer(right).reshape(shape)[:, last][None]
                a, b = divmod(int(ways[::-1].argmax()), shape[1])
                rows += [(r, 2 * part, first, shape[0] - 1 - a), (r, 2 * part + 1, b, last)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()))], names=[ring, "part", "first", "last"])

    for level in range(len(levels) - 2, -1, -1):
        below = levels[level]
        left = below.where("part % 2 = 0").select(ring, F.floor(F.col("part") / 2).alias("part"), F.col("m").alias("left"))
        right = below.where("part % 2 = 1").select(ring, F.floor(F.col("part") / 2).alias("part"), F.col("m").alias("right"))
        joined = join_nulls(join_nulls(known, left, [ring, "part"]), right, [ring, "part"], "left").select(ring, "part", "first", "last", "left", "right")
        known = work.save(joined.mapInArrow(halves, f"`{ring}` {kind}, part bigint, first bigint, last bigint"), f"known-{level}")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretch_path(np.array(rows), step, first, last) if score is not None else [states // 2] * len(rows) for rows, first, last, score in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3, 7)), pa.array(found, pa.list_(pa.int64()))], names=[ring, "part", "turn", "n", "score", "states"])

    whole = join_nulls(join_nulls(parts, known, [ring, "part"]), scores, [ring]).select(ring, "part", "turn", "n", "rows", "first", "last", "score")
    found = whole.mapInArrow(paths, f"`{ring}` {kind}, part bigint, turn bigint, n bigint, score double, states array<bigint>")
    long = found.select(ring, "part", "turn", "n", "score", F.posexplode("states").alias("place", "state"))
    angle = F.pmod(F.col("part") * STRETCH + F.col("place") + F.col("turn"), F.col("n"))
    return long.select(ring, angle.alias("angle"), "state", "score")
