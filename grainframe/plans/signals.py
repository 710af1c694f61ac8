"""Queries on series of samples, and on scalar functions of evidence, colour and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.functions import evidence
from grainframe.operators import signals
from grainframe.sources.tables import table
from grainframe.streaming import outcomes

LENGTH = 240


def _series(spark, sf_dir):
    """For each event type, 240 samples: events by the remainder of their number, plus a wave, so that there are peaks."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("event_type").alias("key"), (F.col("event_id") % LENGTH).alias("t")).agg(F.sum(F.floor(F.col("value") / 10)).alias("c"))
    keys = events.select(F.col("event_type").alias("key")).distinct()
    grid = keys.crossJoin(F.broadcast(spark.range(LENGTH).withColumnRenamed("id", "t")))
    wave = F.when(F.col("t") % 12 == 5, 40).when(F.col("t") % 12 == 4, 25).when(F.col("t") % 12 == 6, 22).otherwise(0)
    return grid.join(counts, ["key", "t"], "left").select("key", "t", (F.coalesce("c", F.lit(0)) % 17 + wave).cast("double").alias("v"))


SERIES_SQL = f"""c AS (SELECT event_type AS key, event_id % {LENGTH} AS t, CAST(sum(floor(value / 10)) AS BIGINT) AS c FROM events GROUP BY ALL), keys AS (SELECT DISTINCT event_type AS key FROM events),
s AS (SELECT key, g.t, CAST(coalesce(c, 0) % 17 + CASE g.t % 12 WHEN 5 THEN 40 WHEN 4 THEN 25 WHEN 6 THEN 22 ELSE 0 END AS DOUBLE) AS v FROM keys CROSS JOIN (SELECT t FROM range({LENGTH}) r(t)) g LEFT JOIN c USING (key, t))"""


def w05_profile_peaks(spark, sf_dir):
    """Clear peaks about twelve samples apart."""
    return signals.profile_peaks(_series(spark, sf_dir), "key", 12.0).select("key", "t", F.round("place", 6).alias("place"))


# radius 3, least gap 5.76: of raw peaks nearer than that, one pass by falling height keeps the higher
PEAKS_SQL = f"""{SERIES_SQL}, q AS (SELECT key, quantile_cont(v, 0.45) AS base, quantile_cont(v, 0.98) AS high FROM s GROUP BY key),
raw AS (SELECT s.key, s.t, s.v, row_number() OVER (PARTITION BY s.key ORDER BY s.v DESC, s.t) AS k FROM s JOIN q USING (key) WHERE s.v >= base + greatest(0.8, (high - base) * 0.1) AND s.v >= (SELECT max(o.v) FROM s o WHERE o.key = s.key AND abs(o.t - s.t) <= 3) - 1e-6),
r AS (SELECT key, k, [t] AS kept FROM raw WHERE k = 1 UNION ALL SELECT raw.key, raw.k, CASE WHEN len(list_filter(kept, lambda p: abs(p - raw.t) < 5.76)) = 0 THEN list_append(kept, raw.t) ELSE kept END FROM r JOIN raw ON raw.key = r.key AND raw.k = r.k + 1),
kept AS (SELECT key, unnest(arg_max(kept, k)) AS t FROM r GROUP BY key),
near AS (SELECT key, t, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s WINDOW w AS (PARTITION BY key ORDER BY t)),
places AS (SELECT key, t, t + CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a - 2 * v + b < 0 THEN greatest(-0.5, least(0.5, 0.5 * (a - b) / (a - 2 * v + b))) ELSE 0 END AS place FROM kept JOIN near USING (key, t))"""
W05_SQL = f"WITH RECURSIVE {PEAKS_SQL} SELECT key, t, round(place, 6) AS place FROM places"


def w06_lattice_pitch(spark, sf_dir):
    """The pitch of those peaks."""
    found = signals.lattice_pitch(signals.profile_peaks(_series(spark, sf_dir), "key", 12.0), "key")
    return found.withColumn("pitch", F.round("pitch", 6))


W06_SQL = f"""WITH RECURSIVE {PEAKS_SQL}, i AS (SELECT key, place, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS i FROM places), f AS (SELECT key, count(*) AS n, regr_slope(place, i) AS a, regr_intercept(place, i) AS b FROM i GROUP BY key),
g AS (SELECT key, count(*) AS n, regr_slope(place, i) AS a FROM i JOIN f USING (key) WHERE abs(place - (f.a * i + f.b)) <= 0.25 * abs(f.a) GROUP BY key)
SELECT key, f.n, round(CASE WHEN g.n >= greatest(3, f.n // 2) THEN g.a ELSE f.a END, 6) AS pitch FROM f LEFT JOIN g USING (key)"""


def cal06_spectral_period(spark, sf_dir):
    """The strongest period of each series between 3 and 30 samples."""
    return signals.spectral_period(_series(spark, sf_dir), "key", 3.0, 30.0).withColumn("period", F.round("period", 6))


CAL06_SQL = f"""WITH {SERIES_SQL}, m AS (SELECT key, avg(v) AS mean FROM s GROUP BY key), f AS (SELECT unnest(range({16 * LENGTH // 30 - 1}, {16 * LENGTH // 3 + 2})) AS k),
x AS MATERIALIZED (SELECT key, k, sqrt(pow(sum((v - mean) * cos(2 * pi() * k * t / {16 * LENGTH})), 2) + pow(sum((v - mean) * sin(2 * pi() * k * t / {16 * LENGTH})), 2)) AS m FROM s JOIN m USING (key) CROSS JOIN f GROUP BY ALL),
n AS (SELECT key, k, m, lag(m) OVER w AS a, lead(m) OVER w AS c FROM x WINDOW w AS (PARTITION BY key ORDER BY k))
SELECT key, round({16 * LENGTH} / (k + CASE WHEN a - 2 * m + c < 0 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * m + c))) ELSE 0 END), 6) AS period FROM n WHERE k BETWEEN {16 * LENGTH // 30} AND {16 * LENGTH // 3} QUALIFY row_number() OVER (PARTITION BY key ORDER BY m DESC, k) = 1"""


def k07_wavelet_1d(spark, sf_dir):
    """Three levels of details, and what remains; together the series."""
    found = signals.wavelets(_series(spark, sf_dir), "key", 3)
    return found.select("key", "t", *(F.round(c, 6).alias(c) for c in ("d1", "d2", "d3", "rest")))


def _smooth_sql(name, source, step):
    at = lambda k: f"(SELECT o.v FROM {source} o WHERE o.key = s.key AND o.t = CASE WHEN abs(s.t + {k}) > {LENGTH - 1} THEN {2 * (LENGTH - 1)} - abs(s.t + {k}) ELSE abs(s.t + {k}) END)"
    return f"{name} AS (SELECT key, t, ({at(-2 * step)} + 4 * {at(-step)} + 6 * v + 4 * {at(step)} + {at(2 * step)}) / 16 AS v FROM {source} s)"


K07_SQL = f"""WITH {SERIES_SQL}, {_smooth_sql('s1', 's', 1)}, {_smooth_sql('s2', 's1', 2)}, {_smooth_sql('s3', 's2', 4)}
SELECT key, t, round(s.v - s1.v, 6) AS d1, round(s1.v - s2.v, 6) AS d2, round(s2.v - s3.v, 6) AS d3, round(s3.v, 6) AS rest FROM s JOIN s1 USING (key, t) JOIN s2 USING (key, t) JOIN s3 USING (key, t)"""


def i13_tile_blend(spark, sf_dir):
    """Tiles of 64 with an overlap of 12; the model gives each sample less its tile's mean, and tiles are blended."""
    held = signals.tiled(_series(spark, sf_dir), "key", LENGTH, 64, 12)
    means = held.groupBy("key", "start").agg(F.avg("v").alias("m"))
    predicted = held.join(means, ["key", "start"]).withColumn("p", F.col("v") - F.col("m"))
    return signals.blend(predicted, ["key", "t"], "p").withColumn("p", F.round("p", 6))


I13_SQL = f"""WITH {SERIES_SQL}, k AS (SELECT unnest({signals.tile_starts(LENGTH, 64, 40)}) AS start), h AS (SELECT key, t, v, start, avg(v) OVER (PARTITION BY key, start) AS m, greatest(1e-3, 0.5 - 0.5 * cos((t - start + 1) * 2 * pi() / 65)) AS w FROM s JOIN k ON t >= start AND t < start + 64)
SELECT key, t, round(sum((v - m) * w) / greatest(sum(w), 1e-6), 6) AS p FROM h GROUP BY key, t"""


def w08_circular_false_run(spark, sf_dir):
    """The longest stretch around a ring without a sample of 14 or more."""
    ring = _series(spark, sf_dir).withColumn("flag", F.col("v") >= 44)
    return signals.circular_false_run(ring, "key", "flag")


W08_SQL = f"""WITH {SERIES_SQL}, m AS (SELECT key, t FROM s WHERE v >= 44), g AS (SELECT a.key, a.t, (SELECT min(CASE WHEN b.t > a.t THEN b.t - a.t ELSE b.t - a.t + {LENGTH} END) FROM m b WHERE b.key = a.key) - 1 AS gap FROM m a)
SELECT key, coalesce((SELECT max(gap) FROM g WHERE g.key = keys.key), {LENGTH}) AS longest FROM keys"""


def w09_normalised(spark, sf_dir):
    """Samples against the 98 % quantile of the positive ones, to the power of 0.6."""
    return signals.normalised(_series(spark, sf_dir), ["key"], "v", 0.98, 0.6, "n").select("key", "t", F.round("n", 6).alias("n"))


W09_SQL = f"WITH {SERIES_SQL}, q AS (SELECT key, quantile_cont(v, 0.98) AS q FROM s WHERE v > 0 GROUP BY key) SELECT key, t, round(coalesce(pow(least(1, greatest(0, v / q)), 0.6), 0), 6) AS n FROM s LEFT JOIN q USING (key)"


def c02_lab(spark, sf_dir):
    """8-bit Lab and gray of colours made of part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("b"), (F.col("p_partkey") * 13 % 256).alias("g"), (F.col("p_partkey") * 29 % 256).alias("r"))
    lab = evidence.lab_of(F.col("b"), F.col("g"), F.col("r"))
    return p.select("p_partkey", *(F.round(c, 5).alias(f"lab_{n.lower()}") for n, c in lab.items()), F.round(evidence.gray(F.col("b"), F.col("g"), F.col("r")), 5).alias("gray"))


C02_SQL = """WITH p AS (SELECT p_partkey, p_partkey * 7 % 256 AS b, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS r FROM part), l AS (SELECT *, CASE WHEN r / 255 <= 0.04045 THEN r / 255 / 12.92 ELSE pow((r / 255 + 0.055) / 1.055, 2.4) END AS lr, CASE WHEN g / 255 <= 0.04045 THEN g / 255 / 12.92 ELSE pow((g / 255 + 0.055) / 1.055, 2.4) END AS lg,
  CASE WHEN b / 255 <= 0.04045 THEN b / 255 / 12.92 ELSE pow((b / 255 + 0.055) / 1.055, 2.4) END AS lb FROM p),
x AS (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM l),
f AS (SELECT *, CASE WHEN x > 216 / 24389 THEN cbrt(x) ELSE (24389 / 27 * x + 16) / 116 END AS fx, CASE WHEN y > 216 / 24389 THEN cbrt(y) ELSE (24389 / 27 * y + 16) / 116 END AS fy, CASE WHEN z > 216 / 24389 THEN cbrt(z) ELSE (24389 / 27 * z + 16) / 116 END AS fz FROM x)
SELECT p_partkey, round(greatest(0, least(255, (116 * fy - 16) * 2.55)), 5) AS lab_l, round(greatest(0, least(255, 500 * (fx - fy) + 128)), 5) AS lab_a, round(greatest(0, least(255, 200 * (fy - fz) + 128)), 5) AS lab_b, round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 5) AS gray FROM f"""


def c10_weighted_support(spark, sf_dir):
    """Support of an order by sources with authorities, its masses, and those given that it is not seed."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.avg("l_discount") * 10).alias("a"), F.max(F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 12)).alias("b"), (F.min("l_quantity") / 50).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    seed = evidence.weighted_support([a, b, c], [2.0, 1.0, 0.0], [F.lit(1.0), c, F.lit(1.0)])
    held = lines.select("l_orderkey", "b", "c", seed.alias("s"))
    masses = evidence.material_masses(F.col("s"), F.coalesce("b", F.lit(0.0)), F.col("c"), 2.0, 0.7)
    held = held.select("l_orderkey", "s", "b", "c", masses["seed"].alias("seed"), masses["unknown"].alias("unknown"))
    parts = evidence.conditional_masses(F.coalesce("b", F.lit(0.0)), F.col("c"), 0.7)
    return held.select("l_orderkey", *(F.round(x, 6).alias(n) for n, x in (("support", F.col("s")), ("seed", F.col("seed")), ("unknown", F.col("unknown")), ("background", parts["background"]), ("neither", parts["neither"]))))


C10_SQL = """WITH l AS (SELECT l_orderkey, avg(l_discount) * 10 AS a, max(CASE WHEN l_tax > 0.02 THEN l_tax * 12 END) AS b, min(l_quantity) / 50 AS c FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey, coalesce(b, 0) AS b, c, (2 * a + coalesce(b * greatest(0, least(1, c)), 0)) / (2 + CASE WHEN b IS NULL THEN 0 ELSE 1 END) AS s FROM l),
n AS (SELECT *, 1 - (1 - b) * (1 - c) AS n FROM s), m AS (SELECT *, sqrt(s * (1 - n)) AS m1, sqrt(n * (1 - s)) AS m2, sqrt(2 * s * n) AS m3, sqrt(0.7 * (1 - s) * (1 - n)) AS m4, b * (1 - c) + c * (1 - b) + 2 * b * c + 0.7 * (1 - b) * (1 - c) AS cz FROM n), z AS (SELECT *, m1 / (m1 + m2 + m3 + m4) AS seed, m4 / (m1 + m2 + m3 + m4) AS unknown FROM m)
SELECT l_orderkey, round(s, 6) AS support, round(seed, 6) AS seed, round(unknown, 6) AS unknown, round(b * (1 - c) / cz, 6) AS background, round(0.7 * (1 - b) * (1 - c) / cz, 6) AS neither FROM z"""


def c09_class_masses(spark, sf_dir):
    """Masses of three competing classes of a part, its membership in a colour mode, and pressures by distance."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    masses = evidence.class_masses({"a": k % 10 / 10.0, "b": k % 7 / 7.0, "c": k % 13 / 12.0}, 3.0)
    mode = evidence.mode_membership([k % 100 + 0.0, F.col("p_size") + 0.0], [50.0, 25.0], [20.0, 10.0], [1.0, 0.5])
    return p.select("p_partkey", *(F.round(v, 6).alias(f"mass_{n}") for n, v in masses.items()), F.round(mode, 6).alias("mode"), F.round(evidence.extension_pressure(F.col("p_size") + 0.0, 8.0), 6).alias("pressure"), F.round(evidence.half_life_authority(F.col("p_size") - 20.0, F.lit(10.0), 0.2, 1.5), 6).alias("authority"))


C09_SQL = """WITH s AS (SELECT p_partkey AS k, p_size, greatest(p_partkey % 10 / 10, 0) AS a, p_partkey % 7 / 7 AS b, p_partkey % 13 / 12 AS c FROM part), t AS (SELECT *, pow(greatest(a, pow(2, -23)), 3) AS ra, pow(greatest(b, pow(2, -23)), 3) AS rb, pow(greatest(c, pow(2, -23)), 3) AS rc, greatest(a, b, c) AS top FROM s)
SELECT k AS p_partkey, round(ra / (ra + rb + rc) * (top / (top + 0.08)), 6) AS mass_a, round(rb / (ra + rb + rc) * (top / (top + 0.08)), 6) AS mass_b, round(rc / (ra + rb + rc) * (top / (top + 0.08)), 6) AS mass_c,
  round(exp(-0.5 * (pow((k % 100 - 50) / 20, 2) + 0.5 * pow((p_size - 25) / 10, 2))), 6) AS mode, round(pow(2, -p_size / 8), 6) AS pressure, round(CASE WHEN p_size <= 20 THEN 1 ELSE 0.2 + 0.8 * pow(2, -((p_size - 20) / 10) / 1.5) END, 6) AS authority FROM t"""

LIMITS = {"instance_below_minimum_area": 200.0, "instance_above_maximum_area": 2300.0, "instance_above_maximum_concavity": 0.9, "instance_above_maximum_protrusion": 0.85, "instance_below_minimum_solidity": 0.1, "instance_above_maximum_axis_ratio": 3.6, "instance_above_hard_maximum_width": 1.9}


def c29_candidate_score(spark, sf_dir):
    """Candidates by part: why they are refused, or how they score."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 50.0).alias("area"), (k % 100 / 100).alias("concavity"), (k % 37 / 40).alias("protrusion"), (1 - k % 20 / 20).alias("solidity"), (1 + k % 9 / 3).alias("axis_ratio"), (0.5 + k % 31 / 20).alias("width_fraction"),
        (k % 11 / 11).alias("marker"), (k % 17 / 17).alias("boundary"), (k % 50 == 0).alias("annotated"),
    )
    compatibility = evidence.shape_compatibility([F.col("axis_ratio"), F.col("solidity")], [1.6, 0.9], [0.04, 0.0001], [0.08, 0.04])
    score = evidence.candidate_score(F.col("marker"), F.col("boundary"), F.col("area"), F.lit(900.0), F.lit(300.0), F.col("width_fraction"), F.col("concavity"), F.col("protrusion"), compatibility, LIMITS, 1.2, F.col("annotated"))
    reason = evidence.candidate_reason(LIMITS, F.col("annotated"))
    return c.select("p_partkey", reason.alias("reason"), F.when(reason.isNull(), F.round(score, 6)).alias("score"))


C29_SQL = """WITH c AS (SELECT p_partkey, p_size * 50.0::DOUBLE AS area, p_partkey % 100 / 100 AS concavity, p_partkey % 37 / 40 AS protrusion, 1 - p_partkey % 20 / 20 AS solidity, 1 + p_partkey % 9 / 3 AS axis, 0.5 + p_partkey % 31 / 20 AS width, p_partkey % 11 / 11 AS marker, p_partkey % 17 / 17 AS boundary, p_partkey % 50 = 0 AS annotated FROM part),
r AS (SELECT *, CASE WHEN NOT annotated AND area < 200 THEN 'instance_below_minimum_area' WHEN area > 2300 THEN 'instance_above_maximum_area' WHEN concavity > 0.9 THEN 'instance_above_maximum_concavity' WHEN protrusion > 0.85 THEN 'instance_above_maximum_protrusion' WHEN solidity < 0.1 THEN 'instance_below_minimum_solidity'
  WHEN axis > 3.6 THEN 'instance_above_maximum_axis_ratio' WHEN width > 1.9 THEN 'instance_above_hard_maximum_width' END AS reason, exp(-0.5 * least(40, (pow(axis - 1.6, 2) / 0.04 + pow(solidity - 0.9, 2) / 0.0016) / 2)) AS compat FROM c),
s AS (SELECT p_partkey, reason, CASE WHEN annotated THEN 1 ELSE greatest(0, least(1, (0.42 * marker + 0.36 * boundary + 0.22 * exp(-0.5 * pow(ln(greatest(area / 900, 1e-4)) / 0.58, 2))) * least(1, area / 300) * CASE WHEN width <= 1.2 THEN 1 ELSE greatest(0, 1 - (width - 1.2) / 0.7) END
  * pow(greatest(0, 1 - concavity / 0.9) * greatest(0, 1 - protrusion / 0.85), 0.25) * (0.65 + 0.35 * compat))) END AS score FROM r) SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN round(score, 6) END AS score FROM s"""


def c22_polygons(spark, sf_dir):
    """Area and perimeter of quadrilaterals of parts, and which points lie in a fixed convex polygon."""
    k = F.col("p_partkey")
    corner = lambda x, y: F.struct((x + 0.0).alias("x"), (y + 0.0).alias("y"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(corner(k % 5, k % 3), corner(k % 7 + 10, k % 4), corner(k % 6 + 9, k % 8 + 8), corner(k % 2, k % 9 + 7)).alias("points"))
    inside = evidence.inside_convex(k % 20 + 0.0, k % 15 + 0.0, [(2.0, 2.0), (15.0, 3.0), (12.0, 12.0), (3.0, 9.0)])
    return p.select("p_partkey", F.round(evidence.shoelace(F.col("points")), 6).alias("area"), F.round(evidence.perimeter(F.col("points")), 6).alias("perimeter"), inside.alias("inside"))


C22_SQL = """WITH p AS (SELECT p_partkey AS k, [{'x': k % 5, 'y': k % 3}, {'x': k % 7 + 10, 'y': k % 4}, {'x': k % 6 + 9, 'y': k % 8 + 8}, {'x': k % 2, 'y': k % 9 + 7}] AS q FROM (SELECT *, p_partkey AS k FROM part)),
e AS (SELECT k, q[i] AS a, q[i % 4 + 1] AS b FROM p, range(1, 5) r(i))
SELECT k AS p_partkey, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 6) AS area, round(sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS perimeter,
  13 * (k % 15 - 2) - (k % 20 - 2) >= 0 AND -3 * (k % 15 - 3) - 9 * (k % 20 - 15) >= 0 AND -9 * (k % 15 - 12) + 3 * (k % 20 - 12) >= 0 AND -(k % 15 - 9) + 7 * (k % 20 - 3) >= 0 AS inside FROM e GROUP BY k"""


def c42_scale_bar(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 90 / 3.0).alias("ppm"), (F.col("p_size") * 97).alias("width"))
    return p.select("p_partkey", F.round(evidence.scale_bar_length(F.col("ppm"), F.col("width")), 6).alias("length"))


C42_SQL = """WITH t AS (SELECT p_partkey, p_partkey % 90 / 3 AS ppm, CASE WHEN p_partkey % 90 > 0 THEN p_size * 97 * 0.12::DOUBLE / (p_partkey % 90 / 3) END AS target FROM part), u AS (SELECT *, unnest([1, 2, 5, 10]) * pow(10, floor(log10(greatest(target, 0.1)))) AS len FROM t WHERE ppm > 0)
SELECT p_partkey, round(len, 6) AS length FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(len - target), len) = 1 UNION ALL SELECT p_partkey, 10 FROM t WHERE ppm <= 0"""


def o02_candidate_values(spark, sf_dir):
    """Values to try around each part's size (a whole number) and price, in the third pass."""
    p = table(spark, sf_dir, "part")
    size = evidence.candidate_steps(F.col("p_size") + 0.0, F.lit(2.0), F.lit(1.0), F.lit(50.0), F.lit(2), F.lit(True))
    price = evidence.candidate_steps(F.col("p_retailprice"), F.lit(5.0), F.lit(950.0), F.lit(1900.0), F.lit(2), F.lit(False))
    return p.select("p_partkey", F.size(size).alias("sizes"), F.round(F.array_min(size), 4).alias("least_size"), F.round(F.array_max(size), 4).alias("most_size"), F.size(price).alias("prices"), F.round(F.array_min(price), 4).alias("least_price"), F.round(F.array_max(price), 4).alias("most_price"))


O02_SQL = """WITH s AS (SELECT p_partkey, p_size AS v, greatest(2.0, abs(p_size) * 0.2::DOUBLE) * 0.25 AS st, p_retailprice AS w, greatest(5, p_retailprice * 0.2) * 0.25 AS wt FROM part), c AS (SELECT *, unnest([-1, 1]) AS d FROM s), x AS (SELECT p_partkey, v, w, round_even(greatest(1, least(50, v + d * st)), 0) AS a, greatest(1, least(50, v + d)) AS b, greatest(950, least(1900, w + d * wt)) AS p FROM c),
y AS (SELECT p_partkey, v, w, CASE WHEN a = v THEN b ELSE a END AS a, p FROM x)
SELECT p_partkey, CAST(count(DISTINCT a) FILTER (a <> v) AS INTEGER) AS sizes, min(a) FILTER (a <> v) AS least_size, max(a) FILTER (a <> v) AS most_size, CAST(count(DISTINCT p) FILTER (p <> w) AS INTEGER) AS prices, round(min(p) FILTER (p <> w), 4) AS least_price, round(max(p) FILTER (p <> w), 4) AS most_price FROM y GROUP BY p_partkey"""


def st06_sliding_counts(spark, sf_dir):
    """Events by windows of two days that start every day."""
    return outcomes.windowed_counts(table(spark, sf_dir, "events"), width="2 days", slide="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


ST06S_SQL = "SELECT strftime(date_trunc('day', ts) - to_days(d), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, (SELECT CAST(d AS INTEGER) AS d FROM range(2) r(d)) WHERE ts IS NOT NULL GROUP BY ALL"


def st06_sessions(spark, sf_dir):
    """Sessions of each user: events less than six hours apart."""
    found = outcomes.sessions(table(spark, sf_dir, "events"), "user_id", gap="6 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


ST06X_SQL = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "cal06_spectral_period": (cal06_spectral_period, CAL06_SQL),
    "w05_profile_peaks": (w05_profile_peaks, W05_SQL),
    "w06_lattice_pitch": (w06_lattice_pitch, W06_SQL),
    "w08_circular_false_run": (w08_circular_false_run, W08_SQL),
    "w09_normalised": (w09_normalised, W09_SQL),
    "k07_wavelet_1d": (k07_wavelet_1d, K07_SQL),
    "i13_tile_blend": (i13_tile_blend, I13_SQL),
    "c02_lab": (c02_lab, C02_SQL),
    "c09_class_masses": (c09_class_masses, C09_SQL),
    "c10_weighted_support": (c10_weighted_support, C10_SQL),
    "c22_polygons": (c22_polygons, C22_SQL),
    "c29_candidate_score": (c29_candidate_score, C29_SQL),
    "c42_scale_bar": (c42_scale_bar, C42_SQL),
    "o02_candidate_values": (o02_candidate_values, O02_SQL),
    "st06_sliding_counts": (st06_sliding_counts, ST06S_SQL),
    "st06_sessions": (st06_sessions, ST06X_SQL),
}
