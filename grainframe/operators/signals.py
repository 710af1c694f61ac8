"""Series of evenly spaced samples ``key, t, v`` (t from 0 without gaps): peaks, pitch, wavelets, blended tiles, runs.

Neighbours meet by equi-joins on shifted places or by windows over blocks of a series, so a long series spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainframe.operators.ordered import counted_quantiles, join_nulls, ranked, value_counts
from grainframe.operators.suppression import suppress_near
from grainframe.sources.workspace import Workspace

BLOCK = 100_000
#: Samples whose part of a spectrum one transform gives.
SPECTRUM_BLOCK = 4096


def _neighbours(series: DataFrame, key: str, offsets: list[int], lengths: DataFrame | None = None) -> DataFrame:
    """``key, t, offset, v``: the sample at t + offset for each t; beyond an end, the mirrored one where ``lengths`` are given."""
    asked = series.select(key, "t", F.explode(F.array(*(F.lit(o) for o in offsets))).alias("offset")).withColumn("at", F.col("t") + F.col("offset"))
    if lengths is not None:
        last = F.col("len__") - 1
        asked = asked.join(lengths, key)
        mirrored = F.abs(F.col("at"))
        asked = asked.withColumn("at", F.when(mirrored > last, 2 * last - mirrored).otherwise(mirrored)).drop("len__")
    return asked.join(series.select(key, F.col("t").alias("at"), "v"), [key, "at"]).drop("at")


def wavelets(series: DataFrame, key: str, levels: int = 4) -> DataFrame:
    """``key, t, v``, ``d1`` to ``d<levels>`` and ``rest``: details of an undecimated B3-spline pyramid, and what remains.

    v = d1 + ... + rest. Each level smooths by 1, 4, 6, 4, 1 sixteenths at steps of twice the length before; ends are mirrored.
    """
    work = Workspace(series.sparkSession, "wavelets")
    lengths = work.save(series.groupBy(key).agg((F.max("t") + 1).alias("len__")), "lengths")
    shortest = lengths.agg(F.min("len__")).first()[0]
    if shortest is not None and shortest <= 2 * 2 ** (levels - 1):
        raise ValueError("a series must be longer than the widest step")
    out = current = work.save(series.select(key, "t", F.col("v").cast("double").alias("v")), "level-0")
    for level in range(levels):
        step = 2**level
        weights = F.element_at(F.create_map(*(F.lit(x) for k, w in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1)) for x in (k * step, w / 16))), F.col("offset"))
        smooth = _neighbours(current, key, [k * step for k in (-2, -1, 0, 1, 2)], lengths).groupBy(key, "t").agg(F.sum(F.col("v") * weights).alias("v"))
        smooth = work.save(smooth, f"level-{level + 1}")
        detail = current.join(smooth.withColumnRenamed("v", "s__"), [key, "t"]).select(key, "t", (F.col("v") - F.col("s__")).alias(f"d{level + 1}"))
        out = out.join(detail, [key, "t"])
        current = smooth
    return out.join(current.withColumnRenamed("v", "rest"), [key, "t"])


def tile_starts(length: int, tile: int, stride: int) -> list[int]:
    """Starts of tiles that cover a length: every ``stride``, and one that ends at the end."""
    if length <= tile:
        return [0]
    last = length - tile
    return sorted({*range(0, last + 1, stride), last})


def tiled(series: DataFrame, key: str, length: int, tile: int, overlap: int) -> DataFrame:
    """``series`` with a row for each tile that covers a sample: ``start``, and its Hann weight ``w`` (0.001 at least)."""
    starts = F.array(*(F.lit(s) for s in tile_starts(length, tile, tile - 2 * overlap)))
    held = series.withColumn("start", F.explode(F.filter(starts, lambda s: (F.col("t") >= s) & (F.col("t") < s + tile))))
    inside = F.col("t") - F.col("start") + 1
    return held.withColumn("w", F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(inside * (2 * math.pi / (tile + 1)))))


def blend(predicted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value``: predictions of all tiles over a place, averaged by weight ``w``."""
    return predicted.groupBy(*keys).agg((F.sum(F.col(value) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias(value))


def profile_peaks(series: DataFrame, key: str, pitch: float) -> DataFrame:
    """``key, t, place``: clear local maxima at least half a pitch apart, placed at the vertex of a parabola.

    A peak is the greatest within a quarter pitch, and above the 45 % quantile by 0.8 and by a tenth of the way to the 98 %
    quantile. Of peaks nearer than 0.48 pitches the higher stays, as in a pass by height (earlier places first on ties).
    """
    radius, gap = max(1, round(pitch * 0.24)), max(1.0, pitch * 0.48)
    work = Workspace(series.sparkSession, "peaks")
    held = work.save(series.select(key, "t", F.col("v").cast("double").alias("v")), "series")
    levels = counted_quantiles(value_counts(held, [key], "v"), [key], "v", {"base": (0.45, "linear"), "high": (0.98, "linear")})
    around = _neighbours(held, key, list(range(-radius, radius + 1))).groupBy(key, "t").agg(F.max("v").alias("top"), F.max(F.when(F.col("offset") == -1, F.col("v"))).alias("before"), F.max(F.when(F.col("offset") == 1, F.col("v"))).alias("after"))
    limit = F.col("base") + F.greatest(F.lit(0.8), (F.col("high") - F.col("base")) * 0.1)
    raw = join_nulls(held.join(around, [key, "t"]), levels, [key]).where((F.col("v") >= F.col("top") - 1e-6) & (F.col("v") >= limit))
    raw = work.save(raw.withColumn("id", F.struct(F.col(key).alias("k"), F.col("t").alias("t"))), "raw")
    kept = suppress_near(raw.withColumn("line", F.lit(0.0)), [key], "id", "t", "line", "v", gap).select("id")
    bend = F.col("before") - 2 * F.col("v") + F.col("after")
    shift = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("before") - F.col("after")) / bend))).otherwise(0.0)
    return raw.join(kept, "id", "left_semi").select(key, "t", (F.col("t") + F.coalesce(shift, F.lit(0.0))).alias("place"))


def lattice_pitch(places: DataFrame, key: str) -> DataFrame:
    """``key, n, pitch``: slope of place by index. Places off by more than a quarter pitch go, if enough remain, and it is fitted again."""
    work = Workspace(places.sparkSession, "pitch")
    held = work.save(ranked(places.select(key, "place"), [F.col("place")], "i", [key]), "ranked")
    fit = lambda frame: frame.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("place", "i").alias("slope"), F.regr_intercept("place", "i").alias("intercept"))
    first = fit(held)
    near = held.join(first, key).where(F.abs(F.col("place") - (F.col("slope") * F.col("i") + F.col("intercept"))) <= 0.25 * F.abs("slope")).select(key, "place", "i")
    again = fit(near).select(key, F.col("n").alias("kept"), F.col("slope").alias("again"))
    enough = F.col("kept") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))
    return first.join(again, key, "left").select(key, "n", F.when(enough, F.col("again")).otherwise(F.col("slope")).alias("pitch"))


def spectral_period(series: DataFrame, key: str, shortest: float, longest: float, pad: int = 16) -> DataFrame:
    """``key, period`` of the strongest peak of each key's spectrum between two periods; 0 where fewer than three frequencies lie there.

    Samples (``t`` from 0 on, ``v``) less their mean are padded to ``pad`` times their number, so that periods are finer than a
    sample; the peak is placed at the vertex of a parabola. Spectra add up: each block of ``SPECTRUM_BLOCK`` samples gives its part of the
    frequencies asked for, and parts are summed by frequency. Missing samples count as the mean.
    """
    held = series.where(F.col("v").isNotNull() & F.col("t").isNotNull()).select(key, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))
    sizes = held.groupBy(key).agg((F.max("t") + 1).alias("n"), F.avg("v").alias("mean"))
    sizes = sizes.withColumns({"low": F.ceil(F.col("n") * pad / longest), "high": F.least(F.floor(F.col("n") * pad / shortest), F.floor(F.col("n") * pad / 2))})
    centred = join_nulls(held, sizes, [key]).withColumn("v", F.col("v") - F.col("mean")).where("high - low >= 2")
    blocks = centred.groupBy(key, F.floor(F.col("t") / SPECTRUM_BLOCK).alias("block"), "n", "low", "high").agg(F.collect_list(F.struct("t", "v")).alias("samples"))
    kind = series.schema[key].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, n, low, high, samples = (row.column(c)[0].as_py() for c in range(1, 6))
                values = np.zeros(SPECTRUM_BLOCK)
                for s in samples:
                    values[s["t"] - block * SPECTRUM_BLOCK] += s["v"]
                size = n * pad
                asked = np.arange(max(low - 1, 0), min(high + 1, size // 2) + 1)
                # a block no longer than the padded series is transformed as it is, and turned to its place
                found = np.fft.rfft(values[: min(SPECTRUM_BLOCK, size)], n=size)[asked] * np.exp(-2j * np.pi * (asked * (block * SPECTRUM_BLOCK) % size) / size)
                same = pa.array(np.zeros(len(asked), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([row.column(0).take(same), pa.array(asked), pa.array(found.real), pa.array(found.imag)], names=[key, "harmonic", "re", "im"])

    sums = blocks.mapInArrow(part, f"`{key}` {kind}, harmonic bigint, re double, im double").groupBy(key, "harmonic").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    work = Workspace(series.sparkSession, "spectra")
    spectrum = work.save(sums.select(key, "harmonic", F.hypot("re", "im").alias("m")), "spectrum")
    sizes = work.save(sizes, "sizes")
    banded = join_nulls(spectrum, sizes.select(key, "low", "high"), [key]).where((F.col("harmonic") >= F.col("low")) & (F.col("harmonic") <= F.col("high")))
    best = banded.groupBy(key).agg(F.max(F.struct("m", (-F.col("harmonic")).alias("harmonic"))).alias("b")).select(key, (-F.col("b.harmonic")).alias("best"))
    at = lambda step: F.max(F.when(F.col("harmonic") == F.col("best") + step, F.col("m")))
    near = join_nulls(spectrum, best, [key]).groupBy(key, "best").agg(at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("a") - F.col("c")) / bend))).otherwise(0.0)
    shift = F.when(F.col("best") > 0, F.coalesce(shift, F.lit(0.0))).otherwise(0.0)
    joined = join_nulls(sizes.select(key, "n"), near.select(key, "best", shift.alias("shift")), [key], "left")
    return joined.select(key, F.coalesce(F.col("n") * pad / (F.col("best") + F.col("shift")), F.lit(0.0)).alias("period"))


def circular_false_run(ring: DataFrame, key: str, flag: str) -> DataFrame:
    """``key, longest``: the longest run of places around a ring (``t``) without ``flag``; all of it where there is none.

    Places with the flag cut the ring: a run is what lies between one and the next, the first following the last.
    """
    sizes = ring.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("marks"))
    order = Window.partitionBy(key).orderBy("t")  # the marks of one ring
    marks = ring.where(F.col(flag)).join(sizes, key).withColumn("next", F.coalesce(F.lead("t").over(order), F.first("t").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + F.col("n")))
    gaps = marks.groupBy(key).agg(F.max(F.col("next") - F.col("t") - 1).alias("gap"))
    return sizes.join(gaps, key, "left").select(key, F.coalesce("gap", "n").alias("longest"))


def normalised(values: DataFrame, keys: list[str], value: str, share: float, gamma: float, name: str) -> DataFrame:
    """``values`` with ``name``: (v / quantile) ** gamma, 0 to 1, by the linear quantile of each key's positive values; 0 without one."""
    top = counted_quantiles(value_counts(values.where(F.col(value) > 0), keys, value), keys, value, {"top__": (share, "linear")})
    joined = join_nulls(values, top, keys, "left") if keys else values.crossJoin(F.broadcast(top))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) / F.col("top__")))
    return joined.withColumn(name, F.coalesce(F.pow(scaled, F.lit(gamma)), F.lit(0.0))).drop("top__")
