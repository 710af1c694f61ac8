"""Robust statistics, calibration curves and thresholds. Long orders go by ranges (``ordered``), never through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainframe.operators.ordered import counted_quantiles, join_nulls, running_sums, value_counts
from grainframe.sources.workspace import Workspace

MAD_TO_SD = 1.4826


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def robust_scale(frame: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """``keys, centre, scale``: lower median, and the lower median of distances from it times 1.4826, ``floor`` at least.

    The rows are read once, for the counts of their values; distances take over the counts.
    """
    work = Workspace(frame.sparkSession, "robust")
    counts = work.save(value_counts(frame, keys, value), "counts")
    centre = work.save(counted_quantiles(counts, keys, value, {"centre": (0.5, "lower")}), "centre")
    away = join_nulls(counts, centre, keys).withColumn("away", F.abs(F.col(value) - F.col("centre"))).groupBy(*keys, "away").agg(F.sum("n").alias("n"))
    mad = counted_quantiles(away, keys, "away", {"mad": (0.5, "lower")})
    return join_nulls(centre, mad, keys).select(*keys, "centre", F.greatest(F.lit(floor), MAD_TO_SD * F.col("mad")).alias("scale"))


def reliability(frame: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    """One row for each of the equal score bins (empty ones too), with the expected calibration error and Brier score of all."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rows = frame.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    sums = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(outcome).cast("double")).alias("rate"), F.sum(F.pow(F.col(score) - F.col(outcome), 2)).alias("squares"))
    all_bins = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").fillna(0, ["n"])
    whole = Window.partitionBy(F.lit(1))  # as many rows as bins
    total = F.sum("n").over(whole)
    gap = F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))).over(whole), total)
    return all_bins.select("bin", "n", "mean_score", "rate", gap.alias("ece"), F.try_divide(F.sum("squares").over(whole), total).alias("brier"))


def curve_points(frame: DataFrame, score: str, outcome: str) -> DataFrame:
    """``score, tp, fp`` at the end of each tie of scores, from the highest: the running counts of both outcomes."""
    ties = frame.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(outcome) == 1).alias("p"), F.count_if(F.col(outcome) != 1).alias("q"))
    return running_sums(ties, [F.col("score").desc()], {"tp": F.col("p"), "fp": F.col("q")})


def roc_ap(frame: DataFrame, score: str, outcome: str) -> DataFrame:
    """One row: ``positives, negatives, auc, ap``. The area is by trapezoids from the origin; ap sums precision by recall steps."""
    points = curve_points(frame, score, outcome)
    whole = frame.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).agg(F.count_if(F.col(outcome) == 1).alias("positives"), F.count_if(F.col(outcome) != 1).alias("negatives"))
    sums = points.agg(F.sum(F.col("q").cast("double") * (2 * F.col("tp") - F.col("p")) / 2).alias("area"), F.sum(F.col("p").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    joined = whole.crossJoin(sums)  # one row by one row
    return joined.select("positives", "negatives", F.try_divide(F.col("area"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"), F.try_divide(F.col("steps"), F.col("positives").cast("double")).alias("ap"))


def mean_ranks(frame: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` and its rank from 0; equal values share the mean of their ranks."""
    ties = frame.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    found = running_sums(ties, [F.col(value)], {"upto": F.col("n")})
    return found.select(value, (F.col("upto") - F.col("n") + (F.col("n") - 1) / 2).alias(name))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(frame: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """``keys, n, rho``: correlation of the mean ranks of two columns (ranks over all rows), by ``keys``; null where ranks are constant."""
    rows = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = rows.join(mean_ranks(rows, a, "rank_a"), a).join(mean_ranks(rows, b, "rank_b"), b)
    return both.groupBy(*keys).agg(F.count("*").alias("n"), correlation("rank_a", "rank_b").alias("rho"))


def balanced_log_loss(frame: DataFrame, score: str, outcome: str, keys: list[str], edge: float = 1e-5) -> DataFrame:
    """Mean over both outcomes of their mean log loss; an outcome without rows is left out."""
    p = clamp(F.col(score), edge, 1 - edge)
    rows = frame.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    by_class = rows.groupBy(*keys, outcome).agg(F.avg(F.when(F.col(outcome) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("loss"), F.count("*").alias("n"))
    return by_class.groupBy(*keys).agg(F.avg("loss").alias("loss"), F.sum("n").alias("n"))


def reliability_margin(frame: DataFrame, keys: list[str], value: str, target: str, least_rows: int = 16, width: float = 0.2) -> DataFrame:
    """How far the target's lower median lies above the others' 90 % quantile (linear), in units of ``width``, 0 to 1.

    1 where either side has fewer than ``least_rows``. The rows are read once.
    """
    counts = Workspace(frame.sparkSession, "margin").save(value_counts(frame.where(F.col(target).isNotNull()), [*keys, target], value), "counts")
    found = join_nulls(counts.groupBy(*keys, target).agg(F.sum("n").alias("rows_")), counted_quantiles(counts, [*keys, target], value, {"middle_": (0.5, "lower"), "upper_": (0.9, "linear")}), [*keys, target])
    side = lambda c, here: F.max(F.when(F.col(target) if here else ~F.col(target), F.col(c)))
    zero = F.lit(0).cast("long")
    sums = found.groupBy(*keys).agg(F.coalesce(side("rows_", True), zero).alias("inside"), F.coalesce(side("rows_", False), zero).alias("outside"), side("middle_", True).alias("middle"), side("upper_", False).alias("upper"))
    margin = clamp((F.col("middle") - F.col("upper")) / width, 0.0, 1.0)
    few = (F.col("inside") < least_rows) | (F.col("outside") < least_rows)
    return sums.select(*keys, "inside", "outside", F.when(few, 1.0).otherwise(margin).alias("reliability"))


def otsu(frame: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """One row: the first bin of greatest variance between classes of a histogram over 0 to 1, and its threshold."""
    histogram = frame.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    up = Window.orderBy("bin")  # as many rows as bins
    whole = Window.partitionBy(F.lit(1))
    sums = histogram.select("bin", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).alias("m"), F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("all_m"))
    low, high = F.col("w"), F.col("total") - F.col("w")
    gap = F.col("m") * F.col("total") - F.col("all_m") * F.col("w")
    between = F.coalesce(F.try_divide(gap.cast("double") * gap.cast("double"), low.cast("double") * high), F.lit(0.0))
    best = sums.withColumn("between", between).agg(F.max(F.struct("between", (-F.col("bin")).alias("first"))).alias("b"))
    return best.select((-F.col("b.first")).alias("bin"), ((-F.col("b.first") + 1) / bins).alias("threshold"))


def frequency_table(frame: DataFrame, steps: dict[str, float], least: int = 1) -> DataFrame:
    """Rows by quantised columns (value / step, half to even), with their number and share."""
    cells = frame.groupBy(*(F.bround(F.col(c) / s).cast("long").alias(c) for c, s in steps.items())).agg(F.count("*").alias("n"))
    total = frame.agg(F.count("*").alias("total"))
    return cells.where(F.col("n") >= least).crossJoin(F.broadcast(total)).select(*steps, "n", (F.col("n") / F.col("total")).alias("share"))
