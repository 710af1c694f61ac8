"""Column functions of evidence: colour, masses, supports and scores. All are plain expressions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray(b: Column, g: Column, r: Column) -> Column:
    return 0.114 * b + 0.587 * g + 0.299 * r


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def lab_of(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """8-bit ``L, a, b`` (each 0 to 255) of a colour of 0 to 255 a channel: sRGB, D65, lightness times 2.55, offsets of 128."""
    red, green, blue = (srgb_to_linear(c / 255.0) for c in (r, g, b))
    x = (0.4124564 * red + 0.3575761 * green + 0.1804375 * blue) / 0.95047
    y = 0.2126729 * red + 0.7151522 * green + 0.0721750 * blue
    z = (0.0193339 * red + 0.1191920 * green + 0.9503041 * blue) / 1.08883
    fx, fy, fz = (F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116) for v in (x, y, z))
    bound = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))
    return {"L": bound((116 * fy - 16) * 2.55), "a": bound(500 * (fx - fy) + 128), "b": bound(200 * (fy - fz) + 128)}


def with_delta_e_2000(rows: DataFrame, name: str, first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> DataFrame:
    """``rows`` with the CIEDE2000 colour difference of two Lab colours (the published formula, unit weights).

    It is made in steps whose values later steps use several times, so that none is written out again in the next.
    """
    rad = F.radians
    held = rows.withColumns({f"{n}{i}__": c.cast("double") for i, lab in ((1, first), (2, second)) for n, c in zip(("l", "a", "b"), lab)})
    held = held.withColumn("c7__", F.pow((F.hypot("a1__", "b1__") + F.hypot("a2__", "b2__")) / 2, F.lit(7.0)))
    held = held.withColumn("g__", 1.5 - 0.5 * F.sqrt(F.col("c7__") / (F.col("c7__") + 25.0**7)))
    held = held.withColumns({"a1__": F.col("a1__") * F.col("g__"), "a2__": F.col("a2__") * F.col("g__")})
    held = held.withColumns({"c1__": F.hypot("a1__", "b1__"), "c2__": F.hypot("a2__", "b2__"), "p1__": F.degrees(F.atan2("b1__", "a1__")), "p2__": F.degrees(F.atan2("b2__", "a2__"))})
    hue = lambda i: F.when((F.col(f"a{i}__") == 0) & (F.col(f"b{i}__") == 0), 0.0).when(F.col(f"p{i}__") < 0, F.col(f"p{i}__") + 360).otherwise(F.col(f"p{i}__"))
    held = held.withColumns({"h1__": hue(1), "h2__": hue(2), "gray__": F.col("c1__") * F.col("c2__") == 0})
    held = held.withColumns({"turn__": F.col("h2__") - F.col("h1__"), "both__": F.col("h1__") + F.col("h2__"), "cc__": (F.col("c1__") + F.col("c2__")) / 2, "l50__": F.pow((F.col("l1__") + F.col("l2__")) / 2 - 50, F.lit(2.0))})
    turn, both, gray_one = F.col("turn__"), F.col("both__"), F.col("gray__")
    dh = F.when(gray_one, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    mean = F.when(gray_one, both).when(F.abs(turn) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
    held = held.withColumns({"hm__": mean, "bh__": 2 * F.sqrt(F.col("c1__") * F.col("c2__")) * F.sin(rad(dh / 2)), "cc7__": F.pow("cc__", F.lit(7.0))})
    h = F.col("hm__")
    t = 1 - 0.17 * F.cos(rad(h - 30)) + 0.24 * F.cos(rad(2 * h)) + 0.32 * F.cos(rad(3 * h + 6)) - 0.20 * F.cos(rad(4 * h - 63))
    turned = -F.sin(rad(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0))))) * 2 * F.sqrt(F.col("cc7__") / (F.col("cc7__") + 25.0**7))
    held = held.withColumns({
        "dl__": (F.col("l2__") - F.col("l1__")) / (1 + 0.015 * F.col("l50__") / F.sqrt(20 + F.col("l50__"))),
        "dc__": (F.col("c2__") - F.col("c1__")) / (1 + 0.045 * F.col("cc__")),
        "dd__": F.col("bh__") / (1 + 0.015 * F.col("cc__") * t),
        "rt__": turned,
    })
    dl, dc, dd = F.col("dl__"), F.col("dc__"), F.col("dd__")
    made = [c for c in held.columns if c.endswith("__") and c not in rows.columns]
    return held.withColumn(name, F.sqrt(dl * dl + dc * dc + dd * dd + F.col("rt__") * dc * dd)).drop(*made)


def material_masses(seed: Column, background: Column, other: Column, temperature: float = 1.0, unknown_weight: float = 1.0) -> dict[str, Column]:
    """Masses of seed, nonseed, conflict and unknown from three supports in 0 to 1; they sum to 1.

    Nonseed support is the noisy-or of background and other material. Without any mass everything is unknown.
    """
    nonseed = 1 - (1 - background) * (1 - other)
    raw = {"seed": seed * (1 - nonseed), "nonseed": nonseed * (1 - seed), "conflict": 2 * seed * nonseed, "unknown": unknown_weight * (1 - seed) * (1 - nonseed)}
    raw = {k: F.pow(v, F.lit(1 / temperature)) for k, v in raw.items()}
    total = raw["seed"] + raw["nonseed"] + raw["conflict"] + raw["unknown"]
    return {k: F.when(total > 0, v / total).otherwise(1.0 if k == "unknown" else 0.0) for k, v in raw.items()}


def weighted_support(supports: list[Column], weights: list[float], authorities: list[Column] | None = None) -> Column:
    """Weighted mean of the supports that are there, each times its authority (0 to 1); null if none is.

    An authority below 1 takes support away without giving it to others. Supports without weight don't count.
    """
    authorities = authorities or [F.lit(1.0)] * len(supports)
    held = [(s, w, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))) for s, w, a in zip(supports, weights, authorities) if w > 0]
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w, _ in held), F.lit(0.0))
    value = sum((F.coalesce(s * a, F.lit(0.0)) * w for s, w, a in held), F.lit(0.0))
    return F.try_divide(value, F.nullif(total, F.lit(0.0)))


def conditional_masses(background: Column, other: Column, unknown_weight: float = 1.0) -> dict[str, Column]:
    """Masses of background, other, both and neither, given that a place is not seed; they sum to 1."""
    raw = {"background": background * (1 - other), "other": other * (1 - background), "both": 2 * background * other, "neither": unknown_weight * (1 - background) * (1 - other)}
    total = F.greatest(raw["background"] + raw["other"] + raw["both"] + raw["neither"], F.lit(1e-8))
    return {k: v / total for k, v in raw.items()}


def class_masses(scores: dict[str, Column], contrast: float, unknown: float = 0.08) -> dict[str, Column]:
    """Masses of competing classes: relative scores to the power of ``contrast``, times how known the strongest is.

    The strongest score s leaves unknown / (s + unknown) to none of them. Nothing with fewer than two classes.
    """
    if len(scores) < 2:
        return {}
    held = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for k, v in scores.items()}
    raised = {k: F.pow(F.greatest(v, F.lit(2.0**-23)), F.lit(float(contrast))) for k, v in held.items()}
    total = sum(list(raised.values())[1:], list(raised.values())[0])
    top = F.greatest(*held.values())
    return {k: v / total * (top / (top + unknown)) for k, v in raised.items()}


def mode_membership(values: list[Column], centre: list[float], scale: list[float], weights: list[float]) -> Column:
    """Gaussian membership of a colour in a mode: exp of minus half the weighted squared scaled distance."""
    parts = [w * F.pow((v - c) / s, F.lit(2.0)) for v, c, s, w in zip(values, centre, scale, weights)]
    return F.exp(-0.5 * sum(parts[1:], parts[0]))


def extension_pressure(distance: Column, half_life: float) -> Column:
    """Halves with each ``half_life`` of distance."""
    return F.pow(F.lit(2.0), -distance / half_life)


#: Limits of candidates: the first rule that fails gives the reason, in this order.
CANDIDATE_RULES = (
    ("instance_below_minimum_area", "area", "<"), ("instance_above_maximum_area", "area", ">"), ("instance_above_maximum_concavity", "concavity", ">"),
    ("instance_above_maximum_protrusion", "protrusion", ">"), ("instance_below_minimum_solidity", "solidity", "<"),
    ("instance_above_maximum_axis_ratio", "axis_ratio", ">"), ("instance_above_hard_maximum_width", "width_fraction", ">"),
)


def candidate_reason(limits: dict[str, float], annotated: Column) -> Column:
    """Why a candidate (area, concavity, protrusion, solidity, axis_ratio, width_fraction) is refused; null if it isn't.

    An ``annotated`` one may be of any small area.
    """
    beyond = [(reason, F.col(c) < limits[reason] if side == "<" else F.col(c) > limits[reason]) for reason, c, side in CANDIDATE_RULES]
    return first_reason([(reason, ~annotated & rule if reason == "instance_below_minimum_area" else rule) for reason, rule in beyond])


def shape_compatibility(values: list[Column], expected: list[float], variances: list[float], floors: list[float]) -> Column:
    """exp(-d / 2), d the mean squared distance from what is expected by variance (``floors`` at least), 40 at most."""
    parts = [F.pow(v - e, F.lit(2.0)) / max(var, f * f) for v, e, var, f in zip(values, expected, variances, floors)]
    return F.exp(-0.5 * F.least(sum(parts[1:], parts[0]) / len(parts), F.lit(40.0)))


def candidate_score(marker: Column, boundary: Column, area: Column, expected_area: Column, soft_minimum: Column, width: Column, concavity: Column, protrusion: Column, compatibility: Column, limits: dict[str, float], soft_width: float, annotated: Column) -> Column:
    """Score of a candidate, 0 to 1: evidence by marker, boundary and area, less penalties; 1 where annotated."""
    confidence = F.exp(-0.5 * F.pow(F.log(F.greatest(area / expected_area, F.lit(1e-4))) / 0.58, F.lit(2.0)))
    hard = limits["instance_above_hard_maximum_width"]
    narrow = F.when(width <= soft_width, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (width - soft_width) / max(1e-6, hard - soft_width)))
    low = lambda v, reason: F.greatest(F.lit(0.0), 1 - v / max(1e-6, limits[reason]))
    shape = F.pow(low(concavity, "instance_above_maximum_concavity") * low(protrusion, "instance_above_maximum_protrusion"), F.lit(0.25))
    score = (0.42 * marker + 0.36 * boundary + 0.22 * confidence) * F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), soft_minimum)) * narrow * shape * (0.65 + 0.35 * compatibility)
    return F.when(annotated, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def scale_bar_length(pixels_per_mm: Column, width: Column) -> Column:
    """The length of 1, 2, 5 or 10 times a power of ten that is nearest to 12 % of the width; 10 without a scale."""
    target = F.try_divide(width * 0.12, pixels_per_mm)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(target, F.lit(0.1)))))
    best = F.array_min(F.transform(F.array(*(F.lit(x) for x in (1.0, 2.0, 5.0, 10.0))), lambda m: F.struct(F.abs(m * power - target).alias("off"), (m * power).alias("length"))))
    return F.when(pixels_per_mm > 0, best["length"]).otherwise(10.0)


def other_values(current: Column, choices: list) -> Column:
    """Array of the values to try for a setting of few: all its ``choices`` but the current one, in their order; a flag has one."""
    return F.filter(F.array(*(F.lit(c) for c in choices)), lambda v: ~v.eqNullSafe(current))


def candidate_steps(current: Column, step: Column, low: Column, high: Column, pass_number: Column, whole: Column) -> Column:
    """Array of the values to try on either side of a setting: a step of 20 % or ``step``, halved with each pass, within limits.

    Whole-number settings move by one at least. The current value itself is left out.
    """
    size = F.greatest(step, F.abs(current) * 0.2) * F.pow(F.lit(0.5), pass_number)

    def side(way: int) -> Column:
        value = F.greatest(low, F.least(high, current + way * size))
        rounded = F.bround(value)
        by_one = F.greatest(low, F.least(high, current + way))
        return F.when(whole, F.when(rounded == current, by_one).otherwise(rounded)).otherwise(value)

    return F.filter(F.array_distinct(F.array(side(-1), side(1))), lambda v: v != current)


def overreach(distance: Column, scale: float) -> Column:
    """Cost of reaching too far: doubles with each ``scale``, up to eight times."""
    return F.pow(F.lit(2.0), F.least(distance / scale, F.lit(8.0))) - 1


def half_life_authority(reviewed: Column, area: Column, floor: float, half_life: float) -> Column:
    """Authority of automatic references: 1 with nothing reviewed, then halving towards ``floor``."""
    return F.when(reviewed <= 0, 1.0).otherwise(floor + (1 - floor) * F.pow(F.lit(2.0), -(reviewed / F.greatest(F.lit(1.0), area)) / max(0.05, half_life)))


def _turned(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))


def shoelace(points: Column) -> Column:
    """Area of a polygon from an array of ``struct<x, y>``; 0 for fewer than three points."""
    crossed = F.zip_with(points, _turned(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v)) / 2)


def perimeter(points: Column) -> Column:
    """Length around a polygon, back to its first point; 0 for a single point."""
    steps = F.zip_with(points, _turned(points), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def inside_convex(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a point is in a convex polygon (counter-clockwise, edges included)."""
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0 for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]])]
    out = sides[0]
    for side in sides[1:]:
        out = out & side
    return out


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; null if none does."""
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out
