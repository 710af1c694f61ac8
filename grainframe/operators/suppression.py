"""Suppression of weaker candidates near stronger ones, exactly as a greedy pass by score would, but over all at once.

Points are settled in blocks of the plane (``suppress_near``). Candidates whose conflicts are given as links are settled in
rounds (``greedy_keep``): each open one that is better than all open ones it is linked to is kept, and those linked to it go.
The order of a greedy pass only matters along chains of conflicts, so the outcome is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.operators.joins import finite, near_pairs
from grainframe.operators.ordered import ranked
from grainframe.operators.polygons import star_overlap
from grainframe.sources.workspace import Workspace

#: Width of the first blocks in separations, and open points of a block up to which blocks grow.
BLOCK_REACHES, MAX_BLOCK = 64, 250_000


def greedy_keep(candidates: DataFrame, point_id: str, score: str, conflicts: DataFrame) -> DataFrame:
    """``point_id`` of the candidates that a pass by falling score (then rising id) keeps. ``conflicts``: ``a, b``, both ways.

    Every round keeps at least the best open candidate of each linked group, so rounds end.
    """
    work = Workspace(candidates.sparkSession, "greedy")
    scored = work.save(candidates.select(F.col(point_id).alias("id"), F.struct((-F.col(score)).alias("s"), F.col(point_id).alias("i")).alias("place")), "scored")
    links = conflicts.select("a", "b").join(scored.select(F.col("id").alias("a"), F.col("place").alias("pa")), "a").join(scored.select(F.col("id").alias("b"), F.col("place").alias("pb")), "b")
    links = work.save(links, "links")
    open_, round_ = scored.select("id"), 0
    schema = f"id {candidates.schema[point_id].dataType.simpleString()}"
    while True:
        live = work.save(links.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi"), f"links-{round_}")
        beaten = live.where("pb < pa").select(F.col("a").alias("id")).distinct()
        kept = work.save(open_.join(beaten, "id", "left_anti"), f"kept-{round_}")
        work.append(kept, "kept")
        gone = live.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        open_ = work.save(open_.join(kept, "id", "left_anti").join(gone, "id", "left_anti"), f"open-{round_ + 1}")
        links, round_ = live, round_ + 1
        if open_.isEmpty():
            return work.read("kept", schema).withColumnRenamed("id", point_id)


def _near_enough(separation: float) -> Callable:
    """Whether a point ``(x, y, shape)`` is closer than ``separation`` to any other."""
    return lambda one, others: any(math.hypot(one[0] - x, one[1] - y) < separation for x, y, _ in others)


def _settled(side: float, steps: int, against: Callable, alike: bool):
    """Kept and gone candidates of blocks that come whole and in order: ``block, own, kept, x, y, id, shape``.

    What can be ``against`` a candidate is at most ``steps`` cells of ``side`` away; ``alike``: all of one cell are against each other.
    """
    around = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, waiting = None, {}, {}
        for batch in batches:
            states = []
            for block, own, is_kept, x, y, _, shape in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last:
                    last, kept, waiting = block, {}, {}
                cell = cx, cy = math.floor(x / side), math.floor(y / side)
                one, state = (x, y, shape), None
                near = [(cx + i, cy + j) for i, j in around]
                if is_kept:
                    kept.setdefault(cell, []).append(one)
                elif against(one, [o for c in near if c in kept for o in kept[c]]):
                    state = "gone"
                elif own and not (alike and cell in waiting) and not against(one, [o for c in near if c in waiting for o in waiting[c]]):
                    kept.setdefault(cell, []).append(one)
                    state = "kept"
                else:
                    waiting.setdefault(cell, []).append(one)
                states.append(state)
            found = pa.RecordBatch.from_arrays([batch.column(5), batch.column(1), pa.array(states, pa.string())], names=["id", "own", "state"])
            yield found.filter(pc.and_(found.column("own"), pc.is_valid(found.column("state")))).select(["id", "state"])

    return run


def _kept_by_blocks(held: DataFrame, reach: float, width: float, settle: Callable, work: Workspace) -> DataFrame:
    """``id`` of the kept. ``held``: key, id, x, y, rank (its place in the order) and shape; none is against another beyond ``reach``."""
    open_ = work.save(held, "open-0")
    kept, kind, round_ = open_.limit(0), held.schema["id"].dataType.simpleString(), 0
    while not open_.isEmpty():
        both = open_.withColumn("kept", F.lit(False)).union(kept.withColumn("kept", F.lit(True)))
        reached = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / width) for d in (0.0, -reach, reach))))
        dealt = both.withColumn("bx", F.explode(reached("x"))).withColumn("by", F.explode(reached("y")))
        own = (F.col("bx") == F.floor(F.col("x") / width)) & (F.col("by") == F.floor(F.col("y") / width))
        dealt = dealt.select(F.concat_ws("/", "bx", "by", "key").alias("block"), own.alias("own"), "kept", "x", "y", "id", "shape", "rank")
        ordered = dealt.repartition("block").sortWithinPartitions("block", F.col("kept").desc(), "rank").drop("rank")
        settled = work.save(ordered.mapInArrow(settle, f"id {kind}, state string"), f"settled-{round_}")
        kept = work.save(open_.join(settled.where("state = 'kept'").select("id"), "id", "left_semi").select(*open_.columns), f"kept-{round_}")
        work.append(kept.select("id"), "all-kept")
        round_ += 1
        open_ = work.save(open_.join(settled.select("id"), "id", "left_anti").select(*open_.columns), f"open-{round_}")
        largest = open_.groupBy("key", F.floor(F.col("x") / (4 * width)), F.floor(F.col("y") / (4 * width))).count().agg(F.max("count")).first()[0] or 0
        width = 4 * width if largest <= MAX_BLOCK else width
    return work.read("all-kept", f"id {kind}") if round_ else held.select("id").limit(0)


def _placed(points: DataFrame, keys: list[str], point_id: str, x: str, y: str, score: str) -> tuple[DataFrame, DataFrame]:
    """``key, id, x, y, rank`` of the points with a place, and ``id`` of those without. Null scores come last."""
    places = [F.col(c).cast("double") for c in (x, y)]
    known = F.coalesce((F.abs(places[0]) < float("inf")) & (F.abs(places[1]) < float("inf")), F.lit(False))
    rank = F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("s"), F.col(point_id).alias("i"))
    held = points.where(known).select(F.to_json(F.struct(*keys)).alias("key"), F.col(point_id).alias("id"), places[0].alias("x"), places[1].alias("y"), rank.alias("rank"))
    return held, points.where(~known).select(F.col(point_id).alias("id"))


def suppress_near(points: DataFrame, keys: list[str], point_id: str, x: str, y: str, score: str, separation: float) -> DataFrame:
    """Points that remain when, by falling score (then rising id), each takes all others of its key closer than ``separation`` out.

    The plane is cut into blocks, and a task settles a block in one pass over its points in order, with those of other blocks
    within reach. A point waits for a better one within reach that isn't settled; only what crosses an edge waits for another
    round, with blocks four times as wide, as long as none has over ``MAX_BLOCK`` open points. Points are never paired, so a
    dense place costs no more than its points.

    Points without a place (null, or no finite number) take nothing out and stay. Null scores come last.
    """
    held, without = _placed(points, keys, point_id, x, y, score)
    side = separation / math.sqrt(2) * (1 - 1e-9)  # two points of one cell are nearer than the separation
    settle = _settled(side, 2, _near_enough(separation), True)
    kept = _kept_by_blocks(held.withColumn("shape", F.lit(None).cast("array<double>")), separation, BLOCK_REACHES * separation, settle, Workspace(points.sparkSession, "suppression"))
    return points.join(without.union(kept).withColumnRenamed("id", point_id), point_id, "left_semi")


def suppress_polygons(polygons: DataFrame, keys: list[str], polygon_id: str, x: str, y: str, rays: str, score: str, threshold: float, maximum: int | None = None) -> DataFrame:
    """Star polygons that remain when, by falling score (then rising id), each takes out those it overlaps by over ``threshold``.

    ``rays``: distances (0.5 at least) from a centre at even angles, three or more, as many for all. The overlap is exact: the
    area of the intersection by that of the union. With ``maximum``, only so many of the best of each key are candidates.
    Settled by blocks, as points are; a candidate is only held against kept ones near it.

    Polygons without a place, or with a ray that is null or no finite number, are left out. Null scores come last.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is from 0 to 1")
    work = Workspace(polygons.sparkSession, "polygons")
    sound = F.coalesce(F.forall(rays, lambda r: r.isNotNull() & ~F.isnan(r) & (r < float("inf"))) & (F.size(rays) >= 3), F.lit(False))
    held, _ = _placed(polygons.where(sound), keys, polygon_id, x, y, score)
    if maximum is not None:
        held = ranked(held, [F.col("rank.s"), F.col("rank.i")], "place", ["key"]).where(F.col("place") < maximum)
    shapes = polygons.where(sound).select(F.col(polygon_id).alias("id"), F.transform(rays, lambda r: F.greatest(r.cast("double"), F.lit(0.5))).alias("shape"))
    held = work.save(held.join(shapes, "id").select("key", "id", "x", "y", "rank", "shape"), "polygons")
    largest = held.agg(F.max(F.array_max("shape"))).first()[0]
    if largest is None:
        return polygons.limit(0)
    reach = 2 * largest
    kept = _kept_by_blocks(held, reach, BLOCK_REACHES / 8 * reach, _settled(reach, 1, _overlapping(threshold), False), work)
    return polygons.join(kept.withColumnRenamed("id", polygon_id), polygon_id, "left_semi")


def _overlapping(threshold: float) -> Callable:
    """Whether a polygon ``(x, y, rays)`` overlaps any other by more than ``threshold``."""

    def against(one: tuple, others: list[tuple]) -> bool:
        widest = max(one[2])
        near = [o for o in others if math.hypot(one[0] - o[0], one[1] - o[1]) < widest + max(o[2])]
        return bool(near) and bool((star_overlap(one, near) > threshold).any())

    return against


def overlap_conflicts(pairs: DataFrame, limit: float) -> DataFrame:
    """``a, b`` both ways of candidate pairs whose overlap passes ``limit``: conflicts of masks or polygons for ``greedy_keep``."""
    found = pairs.where(F.col("iou") > limit)
    return found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def contact_pairs(points: DataFrame, keys: list[str], point_id: str, x: str, y: str, radius: str, multiplier: float, largest: float) -> DataFrame:
    """``keys, a, b, confidence`` of points a < b apart by more than 0 and at most the sum of their radii times ``multiplier``.

    ``largest`` bounds the radii, so cells of that reach hold all partners. Confidence is 1 less the distance by its limit.
    """
    limit: Column = (F.col(f"{radius}_a") + F.col(f"{radius}_b")) * multiplier
    met = (F.col("distance") > 0) & (F.col("distance") <= limit)
    pairs = near_pairs(points, keys, point_id, x, y, 2 * largest * multiplier, [radius], met)
    return pairs.select(*keys, "a", "b", (1 - F.col("distance") / limit).alias("confidence"))


def _nearest_held(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, ids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest held point of each within ``reach`` (else -1); ties take the lower id. ``hx`` is in order.

    Each looks from its own ``x`` up and down, one held point at a step, until these are further off in ``x`` than the best found.
    """
    best, place = np.full(len(x), reach), np.full(len(x), -1)
    middle = np.searchsorted(hx, x)
    for step, first in ((1, middle), (-1, middle - 1)):
        open_, at = np.arange(len(x)), first
        while True:
            inside = (at >= 0) & (at < len(hx))
            open_, at = open_[inside], at[inside]
            aside = hx[at] - x[open_]
            near = np.abs(aside) <= best[open_]
            open_, at, aside = open_[near], at[near], aside[near]
            if not len(open_):
                break
            far, before = np.sqrt(aside * aside + (hy[at] - y[open_]) ** 2), place[open_]
            better = (far < best[open_]) | (far == best[open_]) & ((before < 0) | (ids[at] < ids[before]))
            best[open_[better]], place[open_[better]] = far[better], at[better]
            at = at + step
    return best, place


def _nearest_in_blocks(reach: float):
    """``l__, r__, d`` of blocks that come whole, their held points first and along x: ``block, l__, r__, x, y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # parts of the held points of the open block: ids, x, y
        for batch in batches:
            block, asking = batch.column(0), pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            codes = block.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(asking, prepend=False) != 0))
            for start, end in zip(cuts, [*cuts[1:], len(codes)]):
                part = batch.slice(start, end - start)
                if (name := block[int(start)].as_py()) != last:
                    last, held = name, []
                x, y = (part.column(i).to_numpy() for i in (3, 4))
                if not asking[start]:
                    held.append((part.column(2), x, y))
                elif held:
                    if len(held) > 1:
                        held = [(pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))]
                    ids, hx, hy = held[0]
                    order = pc.rank(ids, tiebreaker="first").to_numpy()
                    far, place = _nearest_held(x, y, hx, hy, order, reach)
                    met = np.flatnonzero(place >= 0)
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(met)), ids.take(pa.array(place[met])), pa.array(far[met])], names=["l__", "r__", "d"])

    return run


def nearest_point(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, x: str, y: str, reach: float) -> DataFrame:
    """``left`` with ``near_id, distance`` of its nearest point of ``right`` within ``reach``; ties take the lower id.

    The plane is cut into blocks as wide as the reach; a point of ``right`` is in all blocks it reaches, once for all that are
    in one place. A task goes through the points of a block along x, so pairs are never made.
    """
    sound = lambda rows, i: rows.where(finite(x, y)).dropna(subset=[*keys, i])
    places = [F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"))]
    one = sound(left, left_id).select(F.to_json(F.struct(*keys)).alias("key"), F.col(left_id).alias("l__"), *places)
    other = sound(right, right_id).select(F.to_json(F.struct(*keys)).alias("key"), F.col(right_id).alias("r__"), *places).groupBy("key", "x", "y").agg(F.min("r__").alias("r__"))
    of = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(of(c) - 1, of(c) + 1))
    other = other.withColumn("bx", around("x")).withColumn("by", around("y"))
    both = one.withColumn("bx", of("x")).withColumn("by", of("y")).unionByName(other, allowMissingColumns=True)
    dealt = both.select(F.concat_ws("/", "bx", "by", "key").alias("block"), "l__", "r__", "x", "y")
    kinds = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in ("l__", "r__"))
    ordered = dealt.repartition("block").sortWithinPartitions("block", F.col("l__").isNotNull(), "x")
    pairs = ordered.mapInArrow(_nearest_in_blocks(reach), f"{kinds}, d double")
    best = pairs.groupBy("l__").agg(F.min(F.struct("d", "r__")).alias("b")).select(F.col("l__").alias(left_id), F.col("b.r__").alias("near_id"), F.col("b.d").alias("distance"))
    return left.join(best, left_id, "left")
