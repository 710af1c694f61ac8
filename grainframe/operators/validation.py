"""Predictive coverage of populations by rows left out, without a fit for each row.

Without one row, the median of a group is one of three: it depends only on whether that row lies below, at or above the middle.
The same holds for the median of the distances from such a median. So a group's order, and that of the distances from its three
medians, give the robust interval of every row from all others of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.operators.ordered import join_nulls, ranked
from grainframe.sources.workspace import Workspace


def medians_without(values: DataFrame, keys: list[str], row_id: str, value: str, name: str) -> DataFrame:
    """``values`` with ``name``: the median (mean of middles) of its key's other values; null where there is no other.

    Values are put into one order by ranges; ties go by the id. Three values around the middle are all a key needs.
    """
    placed = ranked(values, [F.col(value), F.col(row_id)], "rank__", keys)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n__"))
    sized = join_nulls(placed, sizes, keys)
    first = F.floor((F.col("n__") - 2) / 2)  # the first of the middle places among the n - 1 others
    near = [F.max(F.when(F.col("rank__") == first + i, F.col(value))).alias(f"near{i}__") for i in range(3)]
    middles = sized.where(F.col("n__") > 1).groupBy(*keys).agg(*near)
    joined = join_nulls(sized, middles, keys, "left")
    even = F.col("n__") % 2 == 1  # others of an even number have two middles

    def at(place: int) -> Column:
        return F.when(F.col("rank__") > first + place, F.col(f"near{place}__")).otherwise(F.col(f"near{place + 1}__"))

    return joined.withColumn(name, F.when(even, (at(0) + at(1)) / 2).otherwise(at(0))).drop("rank__", "n__", "near0__", "near1__", "near2__")


def left_out_coverage(rows: DataFrame, group: str, row_id: str, vector: str, reach: float = 1.96, floor: float = 1e-8) -> DataFrame:
    """``group, n, tested, hits, coverage``: how many rows lie, in every dimension, within ``reach`` robust scales of the median of the others.

    A scale is 1.4826 times the median distance of the others from their median, ``floor`` at least. Groups of fewer than three rows
    test nothing; their coverage is null. Rows without a vector, or with a null in it, are left out; a null group is a group.
    """
    work = Workspace(rows.sparkSession, "coverage")
    sound = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False)) & (F.size(vector) > 0)
    held = rows.where(sound).select(F.col(group).alias("g__"), F.col(row_id).alias("i__"), F.posexplode(F.col(vector).cast("array<double>")).alias("at__", "v__"))
    held = work.save(held, "values")
    centred = work.save(medians_without(held, ["g__", "at__"], "i__", "v__", "m__"), "centres")
    centres = centred.where("m__ IS NOT NULL").select("g__", "at__", "m__").distinct()  # three of a group and dimension at most
    away = join_nulls(held, centres, ["g__", "at__"]).withColumn("d__", F.abs(F.col("v__") - F.col("m__")))
    scales = work.save(medians_without(away, ["g__", "at__", "m__"], "i__", "d__", "s__").select("g__", "at__", "m__", "i__", "s__"), "scales")
    judged = join_nulls(centred, scales, ["g__", "at__", "m__", "i__"], "left")
    inside = F.abs(F.col("v__") - F.col("m__")) <= reach * F.greatest(F.lit(floor), 1.4826 * F.col("s__"))
    by_row = judged.groupBy("g__", "i__").agg(F.min(F.coalesce(inside, F.lit(False)).cast("int")).alias("hit"))
    counts = by_row.groupBy("g__").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    tested = F.when(F.col("n") >= 3, F.col("n")).otherwise(F.lit(0))
    hits = F.when(F.col("n") >= 3, F.col("hits")).otherwise(F.lit(0))
    return counts.select(F.col("g__").alias(group), "n", tested.cast("long").alias("tested"), hits.cast("long").alias("hits"), F.try_divide(hits, tested).alias("coverage"))
