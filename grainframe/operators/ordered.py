"""Ranks, running sums and exact quantiles of one long order, without putting the order into one task.

Spark deals the rows by range, on splitters it samples from the order itself, so neither an outlier nor a frequent value
makes a long range: ties are split by the rest of the order, equal rows by a number of their own. The ranges are written
once; sums over ranges are few enough for one window, and rows are then only ordered inside their own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainframe.sources.workspace import Workspace

#: Rows of a group whose median one task takes; above that it comes from ranges of a long order.
IN_GROUP = 200_000


def join_nulls(frame: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` by which null keys are keys too. ``other`` brings its other columns."""
    if not keys:
        return frame.crossJoin(F.broadcast(other))  # one row
    renamed = other.select(*(F.col(k).alias(f"{k}__") for k in keys), *(c for c in other.columns if c not in keys))
    on = None
    for k in keys:
        here = frame[k].eqNullSafe(renamed[f"{k}__"])
        on = here if on is None else on & here
    return frame.join(renamed, on, how).drop(*(f"{k}__" for k in keys))


def in_ranges(frame: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """``frame`` with ``cell``: the number of its range along ``keys`` and ``order``. Written once, as splitters are sampled."""
    numbered = frame.withColumn("row__", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*(F.col(k) for k in keys), *order, F.col("row__")).withColumn("cell", F.spark_partition_id())
    return Workspace(frame.sparkSession, "ordered").save(placed.drop("row__"), "ranges")


def running_sums(frame: DataFrame, order: list[Column], values: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``frame`` with inclusive running sums of ``values`` along ``order``, within ``keys``."""
    keys = keys or []
    held = in_ranges(frame.withColumns({f"{name}__own": value for name, value in values.items()}), order, keys)
    sums = held.groupBy(*keys, "cell").agg(*(F.sum(f"{n}__own").alias(f"{n}__sum") for n in values))
    over = Window.partitionBy(*keys).orderBy("cell")
    before = sums.select(*keys, "cell", *((F.sum(f"{n}__sum").over(over) - F.col(f"{n}__sum")).alias(f"{n}__before") for n in values))
    inside = Window.partitionBy(*keys, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_nulls(held, before, [*keys, "cell"])
    joined = joined.withColumns({n: F.col(f"{n}__before") + F.sum(f"{n}__own").over(inside) for n in values})
    return joined.drop("cell", *(f"{n}__{x}" for n in values for x in ("own", "before")))


def ranked(frame: DataFrame, order: list[Column], name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """``frame`` with its place in ``order``, from 0."""
    return running_sums(frame, order, {name: F.lit(1).cast("long")}, keys).withColumn(name, F.col(name) - 1)


def value_counts(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n``: how often each value occurs (combined before the shuffle). Null values don't count."""
    return frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def counted_quantiles(counts: DataFrame, keys: list[str], value: str, quantiles: dict[str, tuple[float, str]]) -> DataFrame:
    """``keys`` and quantiles of the values of ``counts`` (``keys, value, n``), each of a share and a kind.

    ``lower``: the least value that at least that share of the values doesn't exceed. ``linear``: interpolated between the
    two neighbouring values. ``counts`` is read once.
    """
    work = Workspace(counts.sparkSession, "quantiles")
    upto = work.save(running_sums(counts, [F.col(value)], {"upto": F.col("n")}, keys), "upto")
    joined = join_nulls(upto, upto.groupBy(*keys).agg(F.max("upto").alias("all_")), keys)
    found = []
    for name, (q, kind) in quantiles.items():
        place = (F.col("all_") - 1) * F.lit(q)
        if kind == "lower":
            found.append(F.min(F.when(F.col("upto") >= F.col("all_") * q, F.col(value))).alias(name))
        else:
            found += [F.min(F.when(F.col("upto") > f(place), F.col(value))).alias(f"{name}__{k}") for k, f in (("low", F.floor), ("high", F.ceil))]
    grouped = joined.groupBy(*keys, "all_").agg(*found)
    out = []
    for name, (q, kind) in quantiles.items():
        place, low, high = (F.col("all_") - 1) * F.lit(q), F.col(f"{name}__low"), F.col(f"{name}__high")
        out.append(F.col(name) if kind == "lower" else (low + (high - low) * (place - F.floor(place))).alias(name))
    return grouped.select(*keys, *out)


def lower_quantile(frame: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """``keys`` and the least value that at least a share ``q`` of the values doesn't exceed (``q`` = 0.5: lower median)."""
    return counted_quantiles(value_counts(frame, keys, value), keys, value, {name: (q, "lower")})


def linear_quantile(frame: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """``keys`` and the quantile ``q`` with linear interpolation between the two neighbouring values."""
    return counted_quantiles(value_counts(frame, keys, value), keys, value, {name: (q, "linear")})


def vector_medians(rows: DataFrame, keys: list[str], vector: str, name: str, kind: str) -> DataFrame:
    """``keys, name``: the median of each dimension of the vectors of a key, ``lower`` or ``linear``, exact at any size.

    Where no key has over ``IN_GROUP`` rows, a group's values are counted by one task; otherwise they come from ranges.
    """
    long = rows.select(*keys, F.posexplode(vector).alias("at__", "v__"))
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= IN_GROUP:
        median = "percentile_disc(0.5) WITHIN GROUP (ORDER BY v__)" if kind == "lower" else "percentile(v__, 0.5)"
        found = long.groupBy(*keys, "at__").agg(F.expr(median).alias("m__"))
    else:
        found = counted_quantiles(value_counts(long, [*keys, "at__"], "v__"), [*keys, "at__"], "v__", {"m__": (0.5, kind)})
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at__", "m__"))), lambda s: s["m__"]).alias(name))


def even_subsample(frame: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``k`` rows at even places of ``order`` (half to even), with their ``rank``; all rows where there are fewer."""
    placed = ranked(frame, order)
    last = placed.agg((F.count("*") - 1).alias("last"))
    wanted = frame.sparkSession.range(k).crossJoin(last).select(F.bround(F.col("id") * (F.col("last") / float(max(1, k - 1)))).cast("long").alias("rank")).distinct()
    return placed.join(F.broadcast(wanted), "rank")  # at most k rows


def longest_runs(frame: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """``key, longest, runs``: consecutive rows of equal ``value`` along ``order``, for each key.

    A key's rows may span ranges: each range gives its runs, and only a range's first and last run can go on in the next.
    """
    held = in_ranges(frame.select(key, value, *(c.alias(f"o{i}_") for i, c in enumerate(order))), [F.col(f"o{i}_") for i in range(len(order))], [key])
    inside = Window.partitionBy(key, "cell").orderBy(*(F.col(f"o{i}_") for i in range(len(order))))
    marked = held.withColumn("new_", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(inside))).cast("int"), F.lit(1)))
    marked = marked.withColumn("run_", F.sum(F.when(F.row_number().over(inside) == 1, 1).otherwise(F.col("new_"))).over(inside))
    runs = marked.groupBy(key, "cell", "run_").agg(F.count("*").alias("n"), F.first(value).alias("v"))
    of_cell = Window.partitionBy(key, "cell")
    ends = runs.withColumn("last_", F.max("run_").over(of_cell)).withColumn("edge_", (F.col("run_") == 1) | (F.col("run_") == F.col("last_")))
    inner = ends.where("NOT edge_").groupBy(key).agg(F.max("n").alias("longest"), F.count("*").alias("runs"))
    # at most two runs of each range: a few for each key
    along = Window.partitionBy(key).orderBy("cell", "run_")
    edges = ends.where("edge_").withColumn("joins_", (F.col("run_") == 1) & (F.lag("cell").over(along) < F.col("cell")) & F.col("v").eqNullSafe(F.lag("v").over(along)))
    edges = edges.withColumn("chain_", F.sum(F.when(F.coalesce("joins_", F.lit(False)), 0).otherwise(1)).over(along))
    joined = edges.groupBy(key, "chain_").agg(F.sum("n").alias("n")).groupBy(key).agg(F.max("n").alias("longest"), F.count("*").alias("runs"))
    return inner.union(joined).groupBy(key).agg(F.max("longest").alias("longest"), F.sum("runs").alias("runs"))
