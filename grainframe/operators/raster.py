"""Label rasters as tables of cells: statistics, outlines, connectivity, boundaries and their agreement, convex shape.

A cell is ``image, y, x, label``; background has no row or a null label. Neighbours meet by an equi-join on shifted places, so
rasters of any size spread over tasks; what is counted is combined before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.operators.components import connected_components
from grainframe.operators.ordered import join_nulls, linear_quantile
from grainframe.sources.workspace import Workspace

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(dy, dx) for dy, dx in EIGHT if not (dy and dx)]


def component_statistics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, area, y0, x0, height, width, centre_y, centre_x`` of each label."""
    found = cells.groupBy(*keys).agg(F.count("*").alias("area"), *(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))))
    return found.select(*keys, "area", F.col("least_y").alias("y0"), F.col("least_x").alias("x0"), (F.col("most_y") - F.col("least_y") + 1).alias("height"), (F.col("most_x") - F.col("least_x") + 1).alias("width"), F.col("mean_y").alias("centre_y"), F.col("mean_x").alias("centre_x"))


def major_extent(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, extent``: four times the root of the greater eigenvalue of the cells' covariance (population)."""
    var = lambda c: F.var_pop(c)
    found = cells.groupBy(*keys).agg(var("y").alias("a"), var("x").alias("b"), F.covar_pop("y", "x").alias("c"))
    half = (F.col("a") + F.col("b")) / 2
    root = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.pow("c", F.lit(2.0)))
    return found.select(*keys, (4 * F.sqrt(half + root)).alias("extent"))



def median_extent(cells: DataFrame, image: list[str], label: str) -> DataFrame:
    """``image, labels, extent``: the median (mean of middles) over the labels of an image of their major extents."""
    extents = major_extent(cells.where(F.col(label).isNotNull()), [*image, label])
    middle = linear_quantile(extents, image, "extent", 0.5, "extent")
    return join_nulls(extents.groupBy(*image).agg(F.count("*").alias("labels")), middle, image)

def _shifted(cells: DataFrame, offsets: list[tuple[int, int]], image: list[str]) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    moved = cells.select(*image, "y", "x", "label", F.explode(steps).alias("s"))
    return moved.select(*image, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("label").alias("other"))


def boundary(cells: DataFrame, image: list[str], height: int, width: int, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells with a label one of whose neighbours inside the frame has another label or none."""
    offsets = EIGHT if offsets is None else offsets
    held = cells.where(F.col("label").isNotNull()).select(*image, "y", "x", "label")
    same = _shifted(held, offsets, image).join(held, [*image, "y", "x"]).where("other = label").groupBy(*image, "y", "x").agg(F.count("*").alias("same__"))
    inside = F.lit(0)
    for dy, dx in offsets:
        inside = inside + F.when((F.col("y") + dy).between(0, height - 1) & (F.col("x") + dx).between(0, width - 1), 1).otherwise(0)
    return held.join(same, [*image, "y", "x"], "left").where(F.coalesce("same__", F.lit(0)) < inside).drop("same__")


def boundary_agreement(truth: DataFrame, prediction: DataFrame, image: list[str], tolerance: int = 2, images: DataFrame | None = None) -> DataFrame:
    """``image, precision, recall, f1``: shares of boundary cells with one of the other side within ``tolerance`` cells.

    ``images`` lists all images; one without boundaries on both sides has 1 throughout, and is only known from this list. With
    boundaries on one side only all are 0. Reach is a fixed set of offsets, so an equi-join.
    """
    reach = [(dy, dx) for dy in range(-tolerance, tolerance + 1) for dx in range(-tolerance, tolerance + 1) if dy * dy + dx * dx <= tolerance * tolerance]
    near = lambda a, b: a.select(*image, "y", "x").join(_shifted(b.withColumn("label", F.lit(1)), reach, image).select(*image, "y", "x").distinct(), [*image, "y", "x"], "left_semi")
    count = lambda frame, name: frame.groupBy(*image).agg(F.count("*").alias(name))
    parts = [count(prediction, "p"), count(near(prediction, truth), "hit_p"), count(truth, "t"), count(near(truth, prediction), "hit_t")]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, image, "full")
    if images is not None:
        joined = join_nulls(images.select(*image).distinct(), joined, image, "left")
    joined = joined.fillna(0, ["p", "hit_p", "t", "hit_t"])
    nothing = (F.col("p") == 0) & (F.col("t") == 0)
    precision, recall = (F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(f"hit_{c}", c), F.lit(0.0))) for c in ("p", "t"))
    return joined.select(*image, precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall)).alias("f1"))


def label_components(cells: DataFrame, image: list[str], offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """``image, y, x, label, component``: connected pieces of each label, under the least place of the piece.

    Cells of a row that follow each other are one run first, so links join runs, not cells.
    """
    from pyspark.sql import Window

    offsets = EIGHT if offsets is None else offsets
    work = Workspace(cells.sparkSession, "pieces")
    held = cells.where(F.col("label").isNotNull()).select(*image, "y", "x", "label")
    along = Window.partitionBy(*image, "y", "label").orderBy("x")  # one row of a raster
    runs = work.save(held.withColumn("first__", F.col("x") - F.row_number().over(along)), "runs")
    starts = runs.groupBy(*image, "y", "label", "first__").agg(F.min("x").alias("x0"))
    runs = runs.join(starts, [*image, "y", "label", "first__"]).withColumn("node", F.struct(*image, "y", "x0")).select(*image, "y", "x", "label", "node")
    runs = work.save(runs, "nodes")
    down = [(dy, dx) for dy, dx in offsets if dy == 1]
    steps = F.array(*(F.lit(dx) for _, dx in down))
    below = runs.select(*image, (F.col("y") + 1).alias("y"), "label", F.col("node").alias("a"), F.explode(F.transform(steps, lambda dx: F.col("x") + dx)).alias("x"))
    links = below.join(runs, [*image, "y", "x", "label"]).select("a", F.col("node").alias("b")).distinct()
    found = connected_components(links, work)
    joined = runs.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return joined.select(*image, "y", "x", "label", "component")


def continuity(cells: DataFrame, image: list[str]) -> DataFrame:
    """``image, label, pieces``: how many connected pieces each label has."""
    return label_components(cells, image).groupBy(*image, "label").agg(F.count_distinct("component").alias("pieces"))


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull in turn, from the least point; points on edges are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    chains = []
    for way in (points, points[::-1]):
        chain: list[tuple[float, float]] = []
        for p in way:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return chains


def shape_of(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """Area and perimeter of a hull, its greatest distance between corners, and its least width across an edge."""
    hull = convex_hull(points)
    n = len(hull)
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0
    edges = list(zip(hull, hull[1:] + hull[:1]))
    length = [((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in edges]
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in edges)) / 2
    widest = max((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for p in hull for q in hull) ** 0.5
    narrow = min(max(abs(cross(a, b, p)) / s for p in hull) for (a, b), s in zip(edges, length) if s > 1e-9)
    return area, sum(length), widest, narrow


def hull_shapes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, hull_area, hull_perimeter, feret_max, feret_min`` of each label's cells (their centres).

    Only the first and last cell of each row of a label can be corners; so a task gets two points for each row of a label.
    """
    ends = cells.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    points = ends.select(*keys, "y", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema), "hull_area double, hull_perimeter double, feret_max double, feret_min double"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = [shape_of([(float(p["x"]), float(p["y"])) for p in some]) for some in batch["points"]]
            yield pd.concat([batch[keys], pd.DataFrame(shapes, columns=["hull_area", "hull_perimeter", "feret_max", "feret_min"])], axis=1)

    return points.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("points")).mapInPandas(measure, schema)


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon, its edges included (even-odd rule). A polygon is a literal of few corners."""
    crossings, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        edge = edge | ((turn == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            at = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return edge | (crossings % 2 == 1)


def in_region(cells: DataFrame, keys: list[str], polygon: list[tuple[float, float]]) -> DataFrame:
    """Labels whose mean place (in the middle of cells) lies in a polygon."""
    found = component_statistics(cells, keys)
    return found.where(inside_polygon(F.col("centre_x"), F.col("centre_y"), polygon))


def small_removed(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Cells of labels of at least ``least`` cells."""
    large = cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    return cells.join(large, keys, "left_semi")


def mask_union(masks: list[DataFrame], image: list[str]) -> DataFrame:
    """``image, y, x`` of the cells that any of the masks has."""
    out = masks[0].select(*image, "y", "x")
    for mask in masks[1:]:
        out = out.union(mask.select(*image, "y", "x"))
    return out.distinct()


def hysteresis(cells: DataFrame, image: list[str], strong: str, weak: str, rounds: int = 8) -> DataFrame:
    """``image, y, x, step`` of the cells that strong ones reach through weak ones by steps to one of eight neighbours, in ``rounds`` at most.

    ``step`` is 0 for strong cells. A round joins the cells reached last with the weak ones not reached yet; a cell that
    is not weak is never entered, a null flag is false. Repeated cells count once.
    """
    work = Workspace(cells.sparkSession, "hysteresis")
    flag = lambda c: F.coalesce(F.max(F.col(c)), F.lit(False))
    held = work.save(cells.groupBy(*image, "y", "x").agg(flag(strong).alias("strong"), flag(weak).alias("weak")), "cells")
    reached = work.save(held.where("strong").select(*image, "y", "x", F.lit(0).alias("step")), "reached-0")
    open_, out = held.where("weak AND NOT strong").select(*image, "y", "x"), reached
    for step in range(1, rounds + 1):
        around = _shifted(reached.withColumn("label", F.lit(1)), EIGHT, image).select(*image, "y", "x").distinct()
        reached = work.save(open_.join(around, [*image, "y", "x"], "left_semi").withColumn("step", F.lit(step)), f"reached-{step}")
        if reached.isEmpty():
            break
        out = out.union(reached)
        open_ = work.save(open_.join(reached, [*image, "y", "x"], "left_anti"), f"open-{step}")
    return out


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """Least ``(x - c) ** 2 + heights[c]`` for every place x: the lower envelope of a parabola over each place with a finite height."""
    known = np.flatnonzero(np.isfinite(heights)).tolist()
    if not known:
        return np.full(len(heights), np.inf)
    lowest, starts = [known[0]], [-np.inf]
    for c in known[1:]:
        while True:
            last = lowest[-1]
            meet = (heights[c] + c * c - heights[last] - last * last) / (2 * (c - last))
            if meet > starts[-1] or len(lowest) == 1:
                break
            lowest.pop()
            starts.pop()
        if meet <= starts[-1]:
            lowest[-1] = c
        else:
            lowest.append(c)
            starts.append(meet)
    at = np.arange(len(heights))
    own = np.array(lowest)[np.searchsorted(np.array(starts), at, side="left") - 1]
    return (at - own) ** 2 + heights[own]


def distance_transform(features: DataFrame, image: list[str], images: DataFrame) -> DataFrame:
    """``image, y, x, distance`` of every cell of every frame to its nearest feature cell; null in frames without one.

    ``images``: ``image, height, width``. Exact and separable: first the columns, each a row of its own with its feature
    cells, give the distance along them; then the rows take the lower envelope over their columns. No task holds more than a
    column or a row at once. Features outside their frame don't count.
    """
    frames = images.select(*image, "height", "width").distinct()
    inside = join_nulls(features.select(*image, "y", "x"), frames, image).where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))
    columns = inside.groupBy(*image, "x", "height", "width").agg(F.array_sort(F.collect_set(F.col("y").cast("int"))).alias("ys"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*image).schema.fields)
    comma = ", " if image else ""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, height, width, ys = (row.column(len(image) + k)[0].as_py() for k in range(4))
                ys, at = np.array(ys), np.arange(height)
                after = np.searchsorted(ys, at)
                gap = np.minimum(np.abs(at - ys[np.maximum(after - 1, 0)]), np.abs(ys[np.minimum(after, len(ys) - 1)] - at))
                same = pa.array(np.zeros(height, dtype=np.int64))
                fixed = [pa.array(np.full(height, v)) for v in (int(x), int(width))]
                yield pa.RecordBatch.from_arrays([*(c.take(same) for c in row.columns[: len(image)]), pa.array(at), *fixed, pa.array(gap.astype(np.float64) ** 2)], names=[*image, "y", "x", "width", "height2"])

    dropped = columns.mapInArrow(down, f"{kinds}{comma}y bigint, x bigint, width bigint, height2 double")
    rows = dropped.groupBy(*image, "y", "width").agg(F.collect_list(F.struct("x", "height2")).alias("places"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                width = row.column(len(image) + 1)[0].as_py()
                heights = np.full(width, np.inf)
                for place in row.column(len(image) + 2)[0].as_py():
                    heights[place["x"]] = place["height2"]
                same = pa.array(np.zeros(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*(c.take(same) for c in row.columns[: len(image) + 1]), pa.array(np.arange(width)), pa.array(np.sqrt(lower_envelope(heights)))], names=[*image, "y", "x", "distance"])

    found = rows.mapInArrow(across, f"{kinds}{comma}y bigint, x bigint, distance double")
    if not image:
        return found
    empty = frames.join(columns.select(*image).distinct(), image, "left_anti")
    cells = empty.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return found.union(cells.select(*image, F.col("y").cast("bigint"), F.col("x").cast("bigint"), F.lit(None).cast("double").alias("distance")))
