"""Smaller operators on cells, sets and studies: thinning, local maxima, profiles, key sets, gates, rank disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainframe.functions.measures import identity, kept_by_pattern
from grainframe.operators.ordered import counted_quantiles, join_nulls, value_counts
from grainframe.operators.statistics import correlation, mean_ranks


def thinned(mask: DataFrame, image: list[str], reviewed: DataFrame, weight: float) -> DataFrame:
    """``mask`` (``image, y, x``) thinned to about ``weight`` cells for each reviewed one (``image, reviewed``); whole without any."""
    totals = mask.groupBy(*image).agg(F.count("*").alias("total__")).join(reviewed, image, "left")
    fraction = F.when(F.coalesce("reviewed", F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), max(0.0, weight) * F.col("reviewed") / F.col("total__")))
    return mask.join(totals.select(*image, fraction.alias("fraction__")), image).where(kept_by_pattern(F.col("y"), F.col("x"), F.col("fraction__"))).drop("fraction__")


def local_maxima(cells: DataFrame, image: list[str], value: str, reach: int, least: float) -> DataFrame:
    """Cells that hold the greatest value within ``reach`` rows and columns, and ``least`` or more.

    The greatest of a square is the greatest of its rows' greatest, so two windows over one row or column each.
    """
    row = Window.partitionBy(*image, "y").orderBy("x").rangeBetween(-reach, reach)
    column = Window.partitionBy(*image, "x").orderBy("y").rangeBetween(-reach, reach)
    # a column must be whole: only places with a cell in the row take part, so rows without one don't hide others
    held = cells.withColumn("row__", F.max(value).over(row))
    return held.withColumn("top__", F.max("row__").over(column)).where((F.col(value) >= F.col("top__") - 1e-6) & (F.col(value) >= least)).drop("row__", "top__")


def radial_profile(cells: DataFrame, keys: list[str], distance: Column, bins: int, most: float, value: str) -> DataFrame:
    """``cells`` with ``bin``, the ``profile`` of its label there (a mean) and the ``residual`` from it."""
    held = cells.withColumn("bin", F.least(F.floor(distance / most * bins), F.lit(bins - 1)).cast("int"))
    means = held.groupBy(*keys, "bin").agg(F.avg(value).alias("profile"))
    return join_nulls(held, means, [*keys, "bin"]).withColumn("residual", F.col(value) - F.col("profile"))


def chip_means(cells: DataFrame, image: list[str], channels: list[str]) -> DataFrame:
    """``image, mask, n`` and the mean of each channel as a share of 255, by the mask value of a chip; 0 is no chip."""
    return cells.where("mask > 0").groupBy(*image, "mask").agg(F.count("*").alias("n"), *((F.avg(c) / 255).alias(c) for c in channels))


def positive_percentile(cells: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """``keys, name``: the linear quantile of the positive values of each key."""
    return counted_quantiles(value_counts(cells.where(F.col(value) > 0), keys, value), keys, value, {name: (share, "linear")})


def timing_sums(events: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """``keys, runs, seconds, longest`` of finished runs; rows without a time don't count."""
    return events.where(F.col(seconds).isNotNull()).groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest"))


def key_differences(expected: DataFrame, supplied: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem``: keys that are missing from what is supplied, and unknown ones; no row where the sets agree."""
    a = expected.select(*keys).distinct().withColumn("a__", F.lit(1))
    b = supplied.select(*keys).distinct().withColumn("b__", F.lit(1))
    joined = a.join(b, keys, "full")
    return joined.where("a__ IS NULL OR b__ IS NULL").select(*keys, F.when(F.col("b__").isNull(), "missing").otherwise("unknown").alias("problem"))


def rank_disagreement(rows: DataFrame, channels: list[tuple[str, str]]) -> DataFrame:
    """One row, ``n, disagreement``: 1 less the mean over channels of Spearman's correlation; a constant channel counts 0."""
    joined, names = rows, []
    for i, (a, b) in enumerate(channels):
        for side, column in (("a", a), ("b", b)):
            joined = joined.join(mean_ranks(rows, column, f"{side}{i}__"), column)
        names.append(F.coalesce(correlation(f"a{i}__", f"b{i}__"), F.lit(0.0)))
    return joined.agg(F.count("*").alias("n"), (1 - sum(names[1:], names[0]) / len(names)).alias("disagreement"))


def first_best(trials: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """``keys, order, score`` of the greatest score; the first that reached it (a later equal one is no better)."""
    best = trials.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("b"))
    return best.select(*keys, F.col("b.o").alias(order), (-F.col("b.s")).alias(score))


def evaluation_gate(samples: DataFrame, protocol: str) -> DataFrame:
    """``sample_id, problem`` of samples that stand against an independent evaluation under ``protocol``; none for development.

    Reads reviewed, annotation_author, annotation_revision, analysis_mode, source_sha256, recipe_sha256, target_audit, references_sha256.
    """
    if protocol not in ("development", "frozen", "reference_assisted"):
        raise ValueError("unknown protocol")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = (
        F.when(~F.coalesce("reviewed", F.lit(False)) | blank("annotation_author") | blank("annotation_revision"), "not reviewed and attributed").when(~F.col("analysis_mode").eqNullSafe(F.lit(protocol)), "other preprocessing")
        .when(blank("source_sha256") | blank("recipe_sha256") | blank("target_audit"), "no provenance").when(F.col("target_audit") != "targets_excluded_from_all_preprocessing", "targets may have had influence")
    )
    if protocol == "reference_assisted":
        problem = problem.when(blank("references_sha256"), "no references")
    found = samples.withColumn("problem", problem).where("problem IS NOT NULL").select("sample_id", "problem")
    return found.limit(0) if protocol == "development" else found


def dataset_identity(samples: DataFrame, sample_id: str, fields: list[str]) -> DataFrame:
    """``rows, identity`` of a dataset: an exclusive-or-free sum of its rows' digests, so order and partitions play no part.

    Each row's identity covers its id and ``fields``. The sum is taken over two halves of 15 hexadecimal digits, as whole numbers.
    """
    own = identity({c: F.col(c) for c in (sample_id, *fields)})
    half = lambda at: F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = samples.agg(F.count("*").alias("rows"), half(1).alias("a"), half(16).alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("identity"))


def mismatched_sources(annotations: DataFrame, labels: DataFrame, image: str, digest: str) -> DataFrame:
    """``image, state``: whether annotations and labels of an image are of one source: same, different, or not recorded."""
    a = annotations.select(image, F.col(digest).alias("a__"))
    joined = a.join(labels.select(image, F.col(digest).alias("b__")), image)
    known = F.col("a__").isNotNull() & F.col("b__").isNotNull()
    return joined.select(image, F.when(~known, "not recorded").when(F.col("a__") == F.col("b__"), "same").otherwise("different").alias("state"))
