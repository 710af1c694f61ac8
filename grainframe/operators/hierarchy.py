"""Weights balanced by source, strata, hierarchies that shrink to their parents, pooled and per-group ratios.

Groups are first summed (combined before the shuffle); windows and joins only see the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.operators.ordered import join_nulls
from grainframe.sources.workspace import Workspace

PRIOR = 5


def source_balanced(rows: DataFrame, group: str, source: str, weight: str) -> DataFrame:
    """``rows`` with ``balanced``: within a group every source weighs the same, and all together 1."""
    sums = rows.groupBy(group, source).agg(F.sum(weight).alias("source_weight_"))
    sources = sums.groupBy(group).agg(F.count_distinct(source).alias("sources_"))
    joined = join_nulls(join_nulls(rows, sums, [group, source]), sources, [group])
    return joined.withColumn("balanced", F.try_divide(F.try_divide(F.col(weight).cast("double"), F.col("source_weight_").cast("double")), F.col("sources_").cast("double"))).drop("source_weight_", "sources_")


def balance_error(rows: DataFrame, group: str, source: str, weight: str) -> DataFrame:
    """``group, sources, largest, error``: the largest share of a source, and how far shares lie from equal ones."""
    sums = rows.groupBy(group, source).agg(F.sum(weight).alias("w"))
    totals = sums.groupBy(group).agg(F.sum("w").alias("total"), F.count("*").alias("sources"))
    share = F.try_divide(F.col("w").cast("double"), F.col("total").cast("double"))
    return join_nulls(sums, totals, [group]).groupBy(group, "sources").agg(F.max(share).alias("largest"), F.max(F.abs(share - 1.0 / F.col("sources"))).alias("error"))


def weight_signature(rows: DataFrame, group: str, source: str, weight: str) -> DataFrame:
    """``group, source, share, largest``: each source's part of its group's weight, and whether no other has more."""
    sums = Workspace(rows.sparkSession, "signature").save(rows.groupBy(group, source).agg(F.sum(weight).alias("w")), "sums")
    totals = sums.groupBy(group).agg(F.sum("w").alias("total"), F.max("w").alias("most"))
    joined = join_nulls(sums, totals, [group])
    return joined.select(group, source, F.try_divide(F.col("w").cast("double"), F.col("total").cast("double")).alias("share"), (F.col("w") == F.col("most")).alias("largest"))


def strata(rows: DataFrame, fields: dict[str, str], measures: dict[str, Column]) -> DataFrame:
    """``field, stratum`` and measures, for each field by itself: one pass of grouping sets. Missing is ``unknown``."""
    named = rows.select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(f"{f}__") for f, c in fields.items()))
    names = [f"{f}__" for f in fields]
    found = named.groupingSets([[F.col(n)] for n in names], *(F.col(n) for n in names)).agg(*(m.alias(k) for k, m in measures.items()), *(F.grouping(n).alias(f"{n}g") for n in names))
    field = F.coalesce(*(F.when(F.col(f"{f}__g") == 0, f) for f in fields))
    return found.select(field.alias("field"), F.coalesce(*names).alias("stratum"), *measures)


def shrunk_rollup(rows: DataFrame, levels: list[str], value: str, prior: int = PRIOR) -> DataFrame:
    """``depth, levels, n, mean, sd, shrunk`` of every prefix of the levels; a mean shrinks to its parent's by ``prior`` rows.

    Means and variances merge from the sums of the lowest level, which are written once; the rows are read once.
    """
    base = rows.groupBy(*levels).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    base = Workspace(rows.sparkSession, "rollup").save(base, "base")
    out, parent = None, None
    for depth in range(len(levels) + 1):
        keys = levels[:depth]
        means = base.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
        # the spread around the group's own mean, not a difference of large squares
        around = base.select(*levels, F.col("n").alias("n_"), F.col("mean").alias("mean_"), "v")
        around = join_nulls(around, means, keys)
        level = around.groupBy(*keys, "n", "mean").agg(F.sum(F.col("n_") * (F.col("v") + F.pow(F.col("mean_") - F.col("mean"), 2))).alias("squares"))
        level = level.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("sd"))
        if parent is None:
            level = level.withColumn("shrunk", F.col("mean"))
        else:
            above = parent.select(*keys[:-1], F.col("shrunk").alias("above"))
            level = join_nulls(level, above, keys[:-1])
            level = level.withColumn("shrunk", (F.col("n") * F.col("mean") + prior * F.col("above")) / (F.col("n") + prior)).drop("above")
        parent = level
        row = level.select(F.lit(depth).alias("depth"), *(F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in levels), "n", "mean", "sd", "shrunk")
        out = row if out is None else out.union(row)
    return out


def precision_recall(rows: DataFrame, group: str, said: str = "said", true: str = "true") -> DataFrame:
    """Counts and ratios by group and of all (``all``, with the mean of the groups' precisions); undefined ratios are null."""
    sums = rows.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("scope")).agg(
        F.count("*").alias("n"), F.count_if(F.col(said) & F.col(true)).alias("tp"), F.count_if(F.col(said) & ~F.col(true)).alias("fp"), F.count_if(~F.col(said) & F.col(true)).alias("fn")
    )
    precision = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    recall = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    pooled = sums.withColumn("p", precision).agg(F.lit("all").alias("scope"), *(F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn")), F.avg("p").alias("macro_precision"))
    return sums.withColumn("macro_precision", F.lit(None).cast("double")).union(pooled).withColumn("precision", precision).withColumn("recall", recall)
