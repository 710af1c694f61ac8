"""Overlap of two labelings, matching and instance metrics.

A cell is a position with a truth label and a predicted label; a null label is background. Everything derives from one
count by label pair, combined before its shuffle, so a label of very many cells is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainframe.operators.matching import matches
from grainframe.sources.workspace import Workspace, dealt


def overlap_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, truth, prediction, n`` of all label pairs, background included. Written once: all metrics read it, not the cells."""
    counts = cells.groupBy(*keys, "truth", "prediction").agg(F.count("*").alias("n"))
    return Workspace(cells.sparkSession, "overlap").save_large(counts, "counts", cells.count())


def label_areas(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
    held = dealt(counts.where(F.col(label).isNotNull()), counts.count(), *keys, label)
    return held.groupBy(*keys, label).agg(F.sum("n").alias(f"{label}_area"))


def overlap_iou(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of labels that meet, with both areas and ``iou``.

    Areas are summed where a label's counts lie, in two shuffles. What has no truth has no area there, and goes by its prediction.
    """
    rows, area = counts.count(), lambda *by: F.sum("n").over(Window.partitionBy(*by))
    lone = F.when(F.col("truth").isNull(), F.col("prediction"))
    held = counts.where("truth IS NOT NULL OR prediction IS NOT NULL")
    held = held.dropna(subset=keys) if keys else held
    held = dealt(held.withColumn("lone__", lone), rows, *keys, "truth", "lone__").withColumn("truth_area", area(*keys, "truth", "lone__"))
    held = dealt(held.where("prediction IS NOT NULL").drop("lone__"), rows, *keys, "prediction").withColumn("prediction_area", area(*keys, "prediction"))
    return held.where("truth IS NOT NULL").withColumn("iou", F.col("n") / (F.col("truth_area") + F.col("prediction_area") - F.col("n")))


def overlap_above(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs that overlap by more than ``least``."""
    return pairs.where(F.col("iou") > least)


def ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    """``a / b``; null, or ``empty``, where ``b`` is 0."""
    found = F.try_divide(a.cast("double"), b.cast("double"))
    return found if empty is None else F.when(b == 0, empty).otherwise(found)


def instance_metrics(counts: DataFrame, keys: list[str], threshold: float = 0.5, share: float = 0.1) -> DataFrame:
    """Instances of both sides, matches, precision, recall, F1, mean IoU, panoptic quality, count errors, splits and merges.

    One row for each of ``keys`` and a pooled one with null keys. A labeling without instances on both sides is perfect;
    without matches the mean IoU is 0.
    """
    names = ["tp", "iou_sum", "truths", "predictions", "splits", "merges"]
    contacts = split_merge(counts, keys, share)

    def part(frame: DataFrame, **found: Column) -> DataFrame:
        return frame.groupBy(*keys).agg(*(found.get(n, F.lit(0)).cast("double" if n == "iou_sum" else "long").alias(n) for n in names))

    parts = [
        part(matches(overlap_iou(counts, keys), keys, threshold), tp=F.count("*"), iou_sum=F.sum("iou")),
        part(label_areas(counts, keys, "truth"), truths=F.count("*")),
        part(label_areas(counts, keys, "prediction"), predictions=F.count("*")),
        part(contacts, splits=F.count_if(F.col("kind") == "split"), merges=F.count_if(F.col("kind") == "merge")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    sums = union.rollup(*keys).agg(*(F.sum(c).alias(c) for c in names), F.grouping_id().alias("level"))
    sums = sums.where(F.col("level").isin(0, 2 ** len(keys) - 1))
    fp, fn = F.col("predictions") - F.col("tp"), F.col("truths") - F.col("tp")
    one = F.lit(1.0)
    both = F.col("predictions") + F.col("truths")
    error = F.col("predictions") - F.col("truths")
    return sums.select(
        *keys,
        "truths",
        "predictions",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        ratio(F.col("tp"), F.col("predictions"), F.when(F.col("truths") == 0, one).otherwise(0.0)).alias("precision"),
        ratio(F.col("tp"), F.col("truths"), F.when(F.col("predictions") == 0, one).otherwise(0.0)).alias("recall"),
        ratio(2 * F.col("tp"), both, one).alias("f1"),
        ratio(F.col("iou_sum"), F.col("tp"), F.lit(0.0)).alias("mean_iou"),
        ratio(2 * F.col("iou_sum"), both, one).alias("pq"),
        error.alias("count_error"),
        (F.abs(error) / F.greatest(F.lit(1), F.col("truths"))).alias("relative_count_error"),
        "splits",
        "merges",
    )


def macro_metrics(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means of ``columns`` over the rows of ``instance_metrics`` that have keys: every image counts the same."""
    own = metrics.where(" OR ".join(f"`{k}` IS NOT NULL" for k in keys))
    return own.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"macro_{c}") for c in columns))


def split_merge(counts: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Labels that ``share`` of their own area or more gives to several partners: split truths and merged predictions."""
    rows, found = counts.count(), []
    held = counts.dropna(subset=keys) if keys else counts
    for label, other, kind in (("truth", "prediction", "split"), ("prediction", "truth", "merge")):
        areas = dealt(held.where(F.col(label).isNotNull()), rows, *keys, label).withColumn("area", F.sum("n").over(Window.partitionBy(*keys, label)))
        part = areas.where(F.col(other).isNotNull() & (F.col("n") >= share * F.col("area"))).groupBy(*keys, label).agg(F.count("*").alias("partners")).where("partners > 1")
        found.append(part.select(*keys, F.lit(kind).alias("kind"), F.col(label).alias("label"), "partners"))
    return found[0].union(found[1])


def relabel(labels: DataFrame, keys: list[str], label: str, name: str = "new_label") -> DataFrame:
    """``keys, label, name``: the distinct labels of each key (cells or counts) numbered from 1 in their order.

    Only distinct labels are ordered. Labels of a whole raster are ranked by ranges, not in one task.
    """
    from grainframe.operators.ordered import ranked

    distinct = labels.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    return ranked(distinct, [F.col(label)], name, keys).withColumn(name, F.col(name) + 1)


def instance_summary(cells: DataFrame, instance: str, measures: list[str], class_name: str, classes: list[str]) -> DataFrame:
    """``instance, area``, means of ``measures``, the share of each class, and the dominant class (first by name on ties).

    Cells are summed by instance and class first, so an instance of very many cells is no hot group.
    """
    counts = cells.groupBy(instance, class_name).agg(F.count("*").alias("n"), *(F.sum(m).alias(f"{m}__") for m in measures))
    total = F.sum("n")
    share = [(F.sum(F.when(F.col(class_name) == c, F.col("n")).otherwise(0)) / total).alias(f"share_{c}") for c in classes]
    found = counts.groupBy(instance).agg(total.alias("area"), *((F.sum(f"{m}__") / total).alias(f"mean_{m}") for m in measures), *share, F.min(F.when(F.col(class_name).isNotNull(), F.struct(-F.col("n"), F.col(class_name)))).alias("best"))
    return found.withColumn("dominant", F.col(f"best.{class_name}")).drop("best")


def unoutlined(existing: DataFrame, predicted: DataFrame) -> DataFrame:
    """``label, new_label, area, free`` of predicted labels more than half of whose cells are free of existing ones.

    Both tables hold ``image, cell, label``. New labels go on from the image's largest existing one, in the order of the
    predicted labels. Counts are combined before each shuffle.
    """
    taken = existing.where("label IS NOT NULL").select("image", "cell").distinct().withColumn("taken", F.lit(1))
    seen = predicted.where("label IS NOT NULL").join(taken, ["image", "cell"], "left")
    areas = seen.groupBy("image", "label").agg(F.count("*").alias("area"), F.count_if(F.col("taken").isNull()).alias("free")).where("free * 2 > area")
    top = existing.groupBy("image").agg(F.max("label").alias("top"))
    numbered = relabel(areas, ["image"], "label", "place")
    joined = areas.join(numbered, ["image", "label"]).join(top, "image", "left")
    return joined.select("image", "label", (F.coalesce("top", F.lit(0)) + F.col("place")).alias("new_label"), "area", "free")


def class_proportions(summary: DataFrame, class_name: str) -> DataFrame:
    """``class_name, n, share``: instances by class; the total comes from the counts by class."""
    counts = summary.groupBy(class_name).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all_")))).select(class_name, "n", (F.col("n") / F.col("all_")).alias("share"))
