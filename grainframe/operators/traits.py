"""Trait evidence of annotated instances: eligibility, labels, counts, diagnostics of a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.functions.evidence import first_reason
from grainframe.operators.ordered import join_nulls


def _said(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def trait_exclusion() -> Column:
    """Why a seed is no trait evidence; null if it is. Reads shape_reviewed, outline_visibility, shape_exclusion_reason, touches_edge."""
    reviewed = F.coalesce(F.col("shape_reviewed"), F.lit(False))
    return first_reason([
        ("outline or pose not set", ~reviewed),
        ("outline not complete", ~F.col("outline_visibility").eqNullSafe(F.lit("complete"))),
        ("excluded from modelling", _said("shape_exclusion_reason")),
        ("touches the image edge", F.coalesce(F.col("touches_edge"), F.lit(False))),
    ])


def shape_exclusion() -> Column:
    """Why a seed is not for the shape model; null if it is. Also reads pose."""
    return (
        F.when(~F.coalesce(F.col("shape_reviewed"), F.lit(False)), "shape reference not reviewed")
        .when(~F.col("outline_visibility").eqNullSafe(F.lit("complete")), F.concat(F.lit("outline visibility is "), F.coalesce("outline_visibility", F.lit("unknown"))))
        .when(~F.coalesce(F.col("pose").isin("flat", "oblique", "side", "uncertain"), F.lit(False)), "pose is not explicitly reviewed")
        .when(_said("shape_exclusion_reason"), F.col("shape_exclusion_reason"))
    )


def eligible_instances(annotations: DataFrame, disconnected: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations of reviewed, completely visible, connected instances that nothing excludes."""
    good = annotations.where(F.col("shape_reviewed") & (F.col("outline_visibility") == "complete") & ~_said("shape_exclusion_reason"))
    return good.join(disconnected.select(*keys), keys, "left_anti")


def connected_instances(instances: DataFrame, annotations: DataFrame, disconnected: DataFrame, keys: list[str]) -> DataFrame:
    """Instances, reviewed or not, that are connected and not excluded: two anti-joins."""
    excluded = annotations.where(_said("shape_exclusion_reason")).select(*keys)
    return instances.join(excluded, keys, "left_anti").join(disconnected.select(*keys), keys, "left_anti")


def condition_label(condition: str, conditions: str = "conditions", reviewed: str = "conditions_reviewed") -> Column:
    """The class a seed is evidence of: the condition, ``not_`` it if its conditions were reviewed, or nothing."""
    has = F.coalesce(F.array_contains(conditions, condition), F.lit(False))
    return F.when(has, condition).when(F.col(reviewed), f"not_{condition}")


def class_counts(seeds: DataFrame, label: Column, keys: list[str]) -> DataFrame:
    """``keys, label, exclusion, n``: usable seeds (``exclusion`` null) and skipped ones by reason. Seeds without a label don't count."""
    labelled = seeds.withColumns({"label": label, "exclusion": trait_exclusion()}).where("label IS NOT NULL")
    return labelled.groupBy(*keys, "label", "exclusion").agg(F.count("*").alias("n"))


def split_counts(counts: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """``split, label, n`` of usable seeds, from ``class_counts`` and each image's split."""
    return counts.where("exclusion IS NULL").join(splits, keys).groupBy("split", "label").agg(F.sum("n").alias("n"))


def evidence_problem(counts: DataFrame) -> DataFrame:
    """One row: ``classes, in_training, in_calibration, problem`` of ``split_counts``; the first thing that stops training, or null."""
    by_label = counts.groupBy("label").agg(F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("split") == "calibration", F.col("n")).otherwise(0)).alias("c")).where("t + c > 0")
    seen = by_label.agg(F.count("*").alias("classes"), F.count_if(F.col("t") > 0).alias("in_training"), F.count_if(F.col("c") > 0).alias("in_calibration"))
    return seen.withColumn("problem", first_reason([("no usable seeds", F.col("classes") == 0), ("only one class", F.col("classes") < 2), ("a class has no training seeds", F.col("in_training") < F.col("classes")), ("no calibration seeds", F.col("in_calibration") == 0)]))


def effective_annotations(ids: DataFrame, annotations: DataFrame, keys: list[str], order: list[str], defaults: dict[str, Column]) -> DataFrame:
    """One row for each of ``ids`` (``keys``): its last annotation by ``order``, with defaults where there is none.

    Annotations of ids that don't exist are left out. The last one is a grouped maximum, combined before the shuffle.
    """
    values = list(defaults)
    last = annotations.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in values if c not in order))).alias("last__"))
    joined = ids.select(*keys).distinct().join(last, keys, "left")
    found = F.col("last__").isNotNull()
    return joined.select(*keys, *(F.when(found, F.col(f"last__.{c}")).otherwise(defaults[c]).alias(c) for c in values), found.alias("annotated"))


def review_states(instances: DataFrame, decisions: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """``instances`` with ``state``: the decision made on the same revision, else ``unreviewed``. Decisions on others don't count."""
    held = decisions.select(*keys, revision, F.col("decision").alias("decision__"))
    return instances.join(held, [*keys, revision], "left").withColumn("state", F.coalesce("decision__", F.lit("unreviewed"))).drop("decision__")


def with_predictions(instances: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``instances`` with their trait predictions; those without one get ``not_predicted``."""
    return instances.join(predictions, keys, "left").withColumn("trait_state", F.when(F.col("abstained").isNull(), "not_predicted").when(F.col("abstained"), "abstained").otherwise("predicted"))


def method_priority(results: DataFrame, keys: list[str], method: str, order: list[str], tie: Column) -> DataFrame:
    """``keys, priority, method, tie``: the first method of ``order`` that a key has (others come last), then the least ``tie``."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(method) == name, i).otherwise(rank)
    best = results.groupBy(*keys).agg(F.min(F.struct(rank.alias("priority"), tie.alias("tie"), F.col(method).alias("method"))).alias("b"))
    return best.select(*keys, "b.priority", "b.method", "b.tie")


def classifier_diagnostics(scored: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """``keys, n, nll, brier, accepted, coverage, accepted_error`` of rows ``probabilities`` (map by class), ``truth``.

    Multiclass Brier over all classes; the error of accepted rows is null where none is accepted.
    """
    p = F.coalesce(F.try_element_at("probabilities", F.col("truth")), F.lit(0.0))
    squares = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, v: s + v * v) - 2 * p + 1
    top = F.array_max(F.transform(F.map_entries("probabilities"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    held = scored.withColumn("top__", top).withColumns({"p__": p, "squares__": squares})
    accepted = F.col("top__.p") >= threshold
    wrong = F.col("top__.k") != F.col("truth")
    found = held.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(F.col("p__"), F.lit(2.2250738585072014e-308)))).alias("nll"), F.avg("squares__").alias("brier"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & wrong).alias("wrong"))
    return found.select(*keys, "n", "nll", "brier", "accepted", (F.col("accepted") / F.col("n")).alias("coverage"), F.try_divide(F.col("wrong").cast("double"), F.col("accepted").cast("double")).alias("accepted_error"))


def confidence_bins(scored: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """``bin, n, mean_confidence, correct``: equal bins of the confidence (the last holds 1), empty ones too."""
    at = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    sums = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("correct"))
    return scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").fillna(0, ["n"])


def seed_means(views: DataFrame, keys: list[str], physical: str, source: str, seed: str, vector: str, error: str) -> DataFrame:
    """``keys, seed_key, views, mean, error``: views of one physical seed averaged, errors by root mean square.

    Seeds without a physical id go by source and seed. Dimensions are summed in long form, before the shuffle.
    """
    key = F.coalesce(F.col(physical), F.concat(F.lit("source:"), F.col(source).cast("string"), F.lit(":seed:"), F.col(seed).cast("string")))
    long = views.select(*keys, key.alias("seed_key"), F.posexplode(F.arrays_zip(F.col(vector).alias("x"), F.col(error).alias("e"))).alias("at", "p"))
    sums = long.groupBy(*keys, "seed_key", "at").agg(F.avg("p.x").alias("m"), F.sqrt(F.avg(F.col("p.e") * F.col("p.e"))).alias("e"), F.count("*").alias("n"))
    found = sums.groupBy(*keys, "seed_key").agg(F.max("n").alias("views"), F.array_sort(F.collect_list(F.struct("at", "m", "e"))).alias("l"))
    return found.select(*keys, "seed_key", "views", F.transform("l", lambda x: x["m"]).alias("mean"), F.transform("l", lambda x: x["e"]).alias("error"))


def size_statistics(sizes: DataFrame, keys: list[str], value: str, error: str) -> DataFrame:
    """``keys, n, mean, sd, se``: the standard error keeps the shared measurement error, which more seeds don't lessen."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return sizes.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.when(F.count("*") > 1, sd).otherwise(0.0).alias("sd"), F.sqrt(F.when(F.count("*") > 1, sd * sd).otherwise(0.0) / F.count("*") + F.avg(F.col(error) * F.col(error))).alias("se"))


def robust_component(seeds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, centre, scale, variance, se, low, high`` of one measurement of each key.

    Values are clipped to four robust scales around the median; the variance is that of the clipped values plus 5 % of the
    squared scale; ``low`` and ``high`` are the 95 % predictive limits. Medians come from running counts by ranges.
    """
    from grainframe.operators.ordered import counted_quantiles, value_counts
    from grainframe.sources.workspace import Workspace

    work = Workspace(seeds.sparkSession, "component")
    counts = work.save(value_counts(seeds, keys, value), "counts")
    centre = work.save(counted_quantiles(counts, keys, value, {"centre": (0.5, "linear")}), "centre")
    away = join_nulls(counts, centre, keys).groupBy(*keys, F.abs(F.col(value) - F.col("centre")).alias("away")).agg(F.sum("n").alias("n"))
    scale = counted_quantiles(away, keys, "away", {"mad": (0.5, "linear")}).withColumn("scale", F.greatest(F.lit(1e-8), 1.4826 * F.col("mad"))).drop("mad")
    both = work.save(join_nulls(centre, scale, keys), "scales")
    clipped = join_nulls(counts, both, keys).withColumn("x__", F.col("centre") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(value) - F.col("centre")) / F.col("scale"))) * F.col("scale"))
    moments = work.save(clipped.groupBy(*keys, "centre", "scale").agg(F.sum("n").alias("n"), (F.sum(F.col("x__") * F.col("n")) / F.sum("n")).alias("mean__")), "moments")
    around = join_nulls(clipped.drop("centre", "scale").withColumnRenamed("n", "n__"), moments, keys).groupBy(*keys, "n", "centre", "scale").agg(F.sum(F.col("n__") * F.pow(F.col("x__") - F.col("mean__"), F.lit(2.0))).alias("squares__"))
    spread = F.when(F.col("n") > 1, F.col("squares__") / (F.col("n") - 1)).otherwise(F.col("scale") * F.col("scale")) + 0.05 * F.col("scale") * F.col("scale")
    held = around.withColumn("variance", spread)
    wide = 1.96 * F.sqrt("variance")
    return held.select(*keys, "n", "centre", "scale", "variance", F.sqrt(F.col("variance") / F.col("n")).alias("se"), (F.col("centre") - wide).alias("low"), (F.col("centre") + wide).alias("high"))
