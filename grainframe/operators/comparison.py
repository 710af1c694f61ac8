"""Grouped comparison of a candidate method with a reference: planned cells, paired values, bootstrap bounds.

Values are first averaged by independent group. A bootstrap draw takes groups with replacement; its indices are a table of
``rep, slot, ordinal``, made by a seeded generator in tasks, joined to the group means and summed by repetition. Draws are
repetitions times groups, both bounded by the plan; records are only ever grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.operators.ordered import linear_quantile, ranked
from grainframe.sources.workspace import Workspace

STATES = ("available", "failed", "abstained", "unavailable", "not_recorded")


def planned_cells(samples: DataFrame, methods: list[str], records: DataFrame) -> DataFrame:
    """``samples`` by method, each with its record's ``status`` and ``value``; a cell without a record is ``not_recorded``."""
    names = samples.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    cells = samples.crossJoin(F.broadcast(names))  # as many methods as the plan names
    joined = cells.join(records.select("sample_id", "method", "status", "value"), ["sample_id", "method"], "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("not_recorded")))


def outcome_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the number of cells in each of the five states, 0 where there are none."""
    return cells.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES))


def paired(cells: DataFrame, reference: str, candidate: str, keep: list[str]) -> DataFrame:
    """``sample_id, keep, reference, candidate`` of samples on which both methods are available and have a value."""
    good = cells.where((F.col("status") == "available") & F.col("value").isNotNull())
    side = lambda m, name: good.where(F.col("method") == m).select("sample_id", *(keep if name == "reference" else []), F.col("value").alias(name))
    return side(reference, "reference").join(side(candidate, "candidate"), "sample_id")


def group_means(pairs: DataFrame, scope: list[str], group: str) -> DataFrame:
    """``scope, group, reference, candidate, n``: means of each independent group."""
    return pairs.groupBy(*scope, group).agg(F.avg("reference").alias("reference"), F.avg("candidate").alias("candidate"), F.count("*").alias("n"))


def draws(groups: DataFrame, scope: list[str], repetitions: int, seed: int) -> DataFrame:
    """``scope, rep, slot, ordinal``: for each repetition as many draws as the scope has groups, from a seeded hash."""
    sizes = groups.groupBy(*scope).agg(F.count("*").alias("g"))
    slots = sizes.crossJoin(groups.sparkSession.range(repetitions).withColumnRenamed("id", "rep")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return slots.select(*scope, "rep", "slot", F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in scope), "rep", "slot"), F.col("g")).alias("ordinal"))


def bootstrap_bounds(groups: DataFrame, scope: list[str], group: str, draw_table: DataFrame, direction: str = "higher", weighted: bool = False) -> DataFrame:
    """``scope, reference, candidate, difference, bound``: estimates, and the one-sided 95 % bound of the difference.

    ``draw_table`` names groups by their place in order. Groups count alike, or by their number of images (``weighted``).
    """
    work = Workspace(groups.sparkSession, "bootstrap")
    weight = F.col("n").cast("double") if weighted else F.lit(1.0)
    placed = work.save(ranked(groups, [F.col(group)], "ordinal", scope).withColumn("w", weight), "groups")
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    estimates = placed.groupBy(*scope).agg(mean("reference").alias("reference"), mean("candidate").alias("candidate"))
    drawn = draw_table.join(placed, [*scope, "ordinal"]).groupBy(*scope, "rep").agg((mean("candidate") - mean("reference")).alias("delta"))
    bound = linear_quantile(drawn, scope, "delta", 0.05 if direction == "higher" else 0.95, "bound")
    joined = estimates.join(bound, scope, "left") if scope else estimates.crossJoin(bound)
    return joined.select(*scope, "reference", "candidate", (F.col("candidate") - F.col("reference")).alias("difference"), "bound")


def verdicts(bounds: DataFrame, coverage: DataFrame, scope: list[str], margin: float, least_groups: int, least_coverage: float, direction: str = "higher") -> DataFrame:
    """``scope, ... state``: pass or fail by the bound against the margin, inconclusive where a blocker stands.

    ``coverage``: ``scope, groups, pairs, total``.
    """
    joined = coverage.join(bounds, scope, "left")
    few, thin = F.col("groups") < least_groups, F.col("pairs") / F.col("total") < least_coverage
    good = F.col("bound") >= -margin if direction == "higher" else F.col("bound") <= margin
    blockers = F.concat_ws(",", F.when(few, "insufficient_paired_groups"), F.when(thin, "insufficient_paired_coverage"))
    return joined.withColumn("blockers", blockers).withColumn("state", F.when(few | thin | F.col("bound").isNull(), "inconclusive").when(good, "pass").otherwise("fail"))


def arm_spread(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, mean, spread``: mean and sample deviation of repeated runs; no spread for a single one."""
    return runs.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("spread"))


def best_epoch(history: DataFrame, keys: list[str], epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """``keys, epoch, loss`` of the least loss; the first on ties. Null losses don't count."""
    best = history.where(F.col(loss).isNotNull()).groupBy(*keys).agg(F.min(F.struct(loss, epoch)).alias("b"))
    return best.select(*keys, F.col(f"b.{epoch}").alias(epoch), F.col(f"b.{loss}").alias(loss))


def adoption(shared: DataFrame, separate: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, margin, adopt``: the shared arm's mean may fall short of the separate arm's by the larger spread of the two at most.

    A missing spread counts as none; without both means nothing is decided.
    """
    a = shared.select(*keys, F.col("mean").alias("a"), F.col("spread").alias("sa"))
    b = separate.select(*keys, F.col("mean").alias("b"), F.col("spread").alias("sb"))
    margin = F.greatest(F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0)))
    return a.join(b, keys).select(*keys, margin.alias("margin"), (F.col("a") >= F.col("b") - margin).alias("adopt"))
