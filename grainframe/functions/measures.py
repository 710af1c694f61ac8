"""Column functions of identities, units, colours and the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.functions.evidence import linear_to_srgb, srgb_to_linear

MAX_TEXT = 4096
STABLE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"


def identity(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of named values: keys in order, values as text, nulls left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].cast("string").alias(k) for k in sorted(fields)))), 256)


def identifier_problem(text: Column) -> Column:
    """Why a text is no stable identifier; null if it is one."""
    return (
        F.when(text.isNull() | (text == "") | (F.trim(text) != text), "not trimmed text").when(F.length(text) > MAX_TEXT, "too long")
        .when(text.contains("\x00"), "holds a NUL").when(~text.rlike(STABLE_ID), "not a stable identifier")
    )


def display_name(identifier: Column) -> Column:
    """``coat_pattern`` as ``Coat pattern``."""
    words = F.lower(F.regexp_replace(identifier, "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def scaled(value: Column, pixels_per_mm: Column, area: bool = False) -> Column:
    """A length or area in pixels as millimetres; null where either is out of its domain, or where the result vanishes."""
    found = F.try_divide(value, pixels_per_mm)
    found = F.try_divide(found, pixels_per_mm) if area else found
    fits = (value >= 0) & (pixels_per_mm > 0) & (found < float("inf")) & ((found > 0) | (value == 0))
    return F.when(fits & ~F.isnan(found), found)


def with_affine_rgb(rows: DataFrame, names: dict[str, str], colour: tuple[Column, Column, Column], matrix: list[list[float]], offset: list[float]) -> DataFrame:
    """``rows`` with a colour ``b, g, r`` (0 to 255) after an affine correction of linear red, green, blue, under ``names`` of b, g and r.

    Beyond gamut a colour is dimmed as a whole. It is made in steps whose values later steps use several times, so that
    none is written out again in the next.
    """
    held = rows.withColumns({f"{n}__": srgb_to_linear(c / 255.0) for n, c in zip("bgr", colour)})
    held = held.withColumns({f"moved_{n}__": sum((F.col(f"{c}__") * x for c, x in zip("rgb", row)), F.lit(shift)) for n, row, shift in zip("rgb", matrix, offset)})
    held = held.withColumn("peak__", F.greatest(F.lit(1.0), *(F.col(f"moved_{n}__") for n in "rgb")))
    held = held.withColumns({f"fit_{n}__": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"moved_{n}__") / F.col("peak__"))) for n in "rgb"})
    held = held.withColumns({name: linear_to_srgb(F.col(f"fit_{n}__")) * 255.0 for n, name in names.items()})
    return held.drop("peak__", *(f"{p}{n}__" for p in ("", "moved_", "fit_") for n in "rgb"))


def project(x: Column, y: Column, h: list[list[float]]) -> tuple[Column, Column]:
    """A point under a homography; nulls where it goes to infinity."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    return F.try_divide(h[0][0] * x + h[0][1] * y + h[0][2], w), F.try_divide(h[1][0] * x + h[1][1] * y + h[1][2], w)


def star_polygon(x: Column, y: Column, distances: Column) -> Column:
    """Corners (``struct<x, y>``) at even angles around a point, from an array of distances."""
    step = F.lit(6.283185307179586) / F.greatest(F.lit(1), F.size(distances))
    return F.transform(distances, lambda d, i: F.struct((x + d * F.cos(i * step)).alias("x"), (y + d * F.sin(i * step)).alias("y")))


def rotated_rays(distances: Column, quarter_turns: int) -> Column:
    """Ray distances after turning the image by quarters of a circle; the number of rays must be a multiple of four."""
    shift = F.floor(F.size(distances) / 4).cast("int") * (quarter_turns % 4)
    return F.concat(F.slice(distances, shift + 1, F.size(distances) - shift), F.slice(distances, F.lit(1), shift))


def ranking_score(pq: Column, f1: Column, boundary_f1: Column, relative_error: Column, absolute_error: Column) -> Column:
    """Score by which decoders are ranked; without a relative count error the absolute one counts."""
    return pq + 0.35 * f1 + 0.15 * boundary_f1 - 0.5 * F.coalesce(relative_error, absolute_error)


def kept_by_pattern(y: Column, x: Column, fraction: Column) -> Column:
    """Whether a cell is in a uniform pattern that keeps a fraction of all cells, the same wherever it is asked."""
    place = F.pmod((x.cast("long") * 73856093).bitwiseXOR(y.cast("long") * 19349663), F.lit(1000003))
    return (fraction >= 1) | ((fraction > 0) & (place < F.bround(fraction * 1000003)))
