"""Queries on overlap of labelings. Rows of ``lineitem`` stand for positions of two label rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.operators import matching, overlap, raster
from grainframe.sources.tables import table

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    prediction = F.col("l_orderkey") * 2 + (F.col("l_linenumber") > 5).cast("int")
    return lines.select(F.col("l_returnflag").alias("scope"), F.col("l_orderkey").alias("truth"), prediction.alias("prediction"))


CELLS_SQL = "cells AS (SELECT l_returnflag AS scope, l_orderkey AS truth, l_orderkey * 2 + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END AS prediction FROM lineitem)"
PAIRS_SQL = """counts AS (SELECT scope, truth, prediction, count(*) AS n FROM cells GROUP BY ALL),
ta AS (SELECT scope, truth, sum(n) AS truth_area FROM counts GROUP BY ALL), pa AS (SELECT scope, prediction, sum(n) AS prediction_area FROM counts GROUP BY ALL),
pairs AS (SELECT *, n / (truth_area + prediction_area - n) AS iou FROM counts JOIN ta USING (scope, truth) JOIN pa USING (scope, prediction))"""


def j01_overlap_iou(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    counts = overlap.overlap_counts(lines.select(F.col("l_suppkey").alias("truth"), (F.col("l_partkey") % 50).alias("prediction")), [])
    return overlap.overlap_iou(counts, []).select("truth", "prediction", "n", "truth_area", "prediction_area", F.round("iou", 6).alias("iou"))


J01_SQL = """WITH counts AS (SELECT l_suppkey AS truth, l_partkey % 50 AS prediction, count(*) AS n FROM lineitem GROUP BY ALL),
ta AS (SELECT truth, CAST(sum(n) AS BIGINT) AS truth_area FROM counts GROUP BY ALL), pa AS (SELECT prediction, CAST(sum(n) AS BIGINT) AS prediction_area FROM counts GROUP BY ALL)
SELECT truth, prediction, n, truth_area, prediction_area, round(n / (truth_area + prediction_area - n), 6) AS iou FROM counts JOIN ta USING (truth) JOIN pa USING (prediction)"""


def m03_match_cardinality(spark, sf_dir):
    """Matches at an IoU of 0.5 or more, by truth: of equal halves either may be taken, so the partner isn't shown."""
    pairs = overlap.overlap_iou(overlap.overlap_counts(_cells(spark, sf_dir), ["scope"]), ["scope"])
    return matching.matches(pairs, ["scope"]).select("scope", "truth", F.round("iou", 6).alias("iou"))


M03_SQL = f"WITH {CELLS_SQL}, {PAIRS_SQL} SELECT scope, truth, round(max(iou), 6) AS iou FROM pairs WHERE iou >= 0.5 GROUP BY scope, truth"


def m01_match_below_half(spark, sf_dir):
    """Pairs and sum of IoU of the best matching at 0.25, where neighbouring labels compete for each other along chains."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.col("l_returnflag").alias("scope"), F.col("l_orderkey").alias("truth"), (F.col("l_orderkey") + (F.col("l_linenumber") > 3).cast("int")).alias("prediction"))
    pairs = overlap.overlap_iou(overlap.overlap_counts(cells, ["scope"]), ["scope"])
    return matching.matches(pairs, ["scope"], 0.25).groupBy("scope").agg(F.count("*").alias("matches"), F.round(F.sum("iou"), 5).alias("iou_sum"))


# Each label meets two neighbours at most, so components are paths: the best choice along a path by dynamic programming.
M01_SQL = f"""WITH RECURSIVE cells AS (SELECT l_returnflag AS scope, l_orderkey AS truth, l_orderkey + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS prediction FROM lineitem), {PAIRS_SQL},
e AS (SELECT scope, truth, prediction, iou, CASE WHEN lag(truth) OVER w = truth OR lag(prediction) OVER w = prediction THEN 0 ELSE 1 END AS new FROM pairs WHERE iou >= 0.25 WINDOW w AS (PARTITION BY scope ORDER BY truth, prediction)),
c AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY truth, prediction) AS comp FROM e), p AS (SELECT scope, comp, iou, row_number() OVER (PARTITION BY scope, comp ORDER BY truth, prediction) AS pos FROM c),
r AS (SELECT scope, comp, pos, 1000 + iou AS take, 0.0::DOUBLE AS skip FROM p WHERE pos = 1 UNION ALL SELECT p.scope, p.comp, p.pos, skip + 1000 + p.iou, greatest(take, skip) FROM r JOIN p ON p.scope = r.scope AND p.comp = r.comp AND p.pos = r.pos + 1),
b AS (SELECT scope, comp, greatest(arg_max(take, pos), arg_max(skip, pos)) AS best FROM r GROUP BY ALL)
SELECT scope, CAST(sum(floor(best / 1000)) AS BIGINT) AS matches, round(sum(best - 1000 * floor(best / 1000)), 5) AS iou_sum FROM b GROUP BY scope"""

METRICS = ("precision", "recall", "f1", "mean_iou", "pq", "relative_count_error")


def m04_overlap_metrics(spark, sf_dir):
    found = overlap.instance_metrics(overlap.overlap_counts(_cells(spark, sf_dir), ["scope"]), ["scope"])
    return found.select(F.coalesce("scope", F.lit("pooled")).alias("scope"), "tp", "fp", "fn", "count_error", "splits", "merges", *(F.round(c, 6).alias(c) for c in METRICS))


M04_PARTS = f"""{CELLS_SQL}, {PAIRS_SQL}, best AS (SELECT scope, truth, max(iou) AS iou FROM pairs WHERE iou >= 0.5 GROUP BY ALL),
m AS (SELECT scope, count(*) AS tp, sum(iou) AS s FROM best GROUP BY scope),
sp AS (SELECT scope, count(*) AS splits FROM (SELECT scope, truth FROM pairs WHERE n >= 0.1 * truth_area GROUP BY ALL HAVING count(*) > 1) GROUP BY scope),
me AS (SELECT scope, count(*) AS merges FROM (SELECT scope, prediction FROM pairs WHERE n >= 0.1 * prediction_area GROUP BY ALL HAVING count(*) > 1) GROUP BY scope),
a AS (SELECT scope, truths, predictions, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s, coalesce(splits, 0) AS splits, coalesce(merges, 0) AS merges FROM (SELECT scope, count(*) AS truths FROM ta GROUP BY scope)
  JOIN (SELECT scope, count(*) AS predictions FROM pa GROUP BY scope) USING (scope) LEFT JOIN m USING (scope) LEFT JOIN sp USING (scope) LEFT JOIN me USING (scope)),
b AS (SELECT * FROM a UNION ALL SELECT 'pooled', sum(truths), sum(predictions), sum(tp), sum(s), sum(splits), sum(merges) FROM a)"""
M04_SQL = f"""WITH {M04_PARTS} SELECT scope, CAST(tp AS BIGINT) AS tp, CAST(predictions - tp AS BIGINT) AS fp, CAST(truths - tp AS BIGINT) AS fn, CAST(predictions - truths AS BIGINT) AS count_error, CAST(splits AS BIGINT) AS splits, CAST(merges AS BIGINT) AS merges,
  round(tp / predictions, 6) AS precision, round(tp / truths, 6) AS recall, round(2 * tp / (truths + predictions), 6) AS f1, round(CASE WHEN tp > 0 THEN s / tp ELSE 0 END, 6) AS mean_iou, round(2 * s / (truths + predictions), 6) AS pq,
  round(abs(predictions - truths) / truths, 6) AS relative_count_error FROM b"""


def ag19_macro_metrics(spark, sf_dir):
    found = overlap.instance_metrics(overlap.overlap_counts(_cells(spark, sf_dir), ["scope"]), ["scope"])
    macro = overlap.macro_metrics(found, ["scope"], ["precision", "recall", "f1", "pq"])
    return macro.select("n", *(F.round(f"macro_{c}", 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "pq")))


AG19_SQL = f"WITH {M04_PARTS} SELECT count(*) AS n, round(avg(tp / predictions), 6) AS macro_precision, round(avg(tp / truths), 6) AS macro_recall, round(avg(2 * tp / (truths + predictions)), 6) AS macro_f1, round(avg(2 * s / (truths + predictions)), 6) AS macro_pq FROM a"


def m05_split_merge(spark, sf_dir):
    return overlap.split_merge(overlap.overlap_counts(_cells(spark, sf_dir), ["scope"]), ["scope"])


M05_SQL = f"""WITH {CELLS_SQL}, {PAIRS_SQL}
SELECT scope, 'split' AS kind, truth AS label, count(*) AS partners FROM pairs WHERE n >= 0.1 * truth_area GROUP BY scope, truth HAVING count(*) > 1
UNION ALL SELECT scope, 'merge', prediction, count(*) FROM pairs WHERE n >= 0.1 * prediction_area GROUP BY scope, prediction HAVING count(*) > 1"""


HEIGHT, WIDTH = 40, 50


def _raster(spark, sf_dir, shift=0):
    """Label rasters of 40 x 50 cells by return flag; blocks of 8 x 10 cells share most of their labels."""
    lines = table(spark, sf_dir, "lineitem")
    y, x = F.col("l_orderkey") % HEIGHT, F.col("l_partkey") % WIDTH
    block = (y / 8).cast("int") * 5 + ((x + shift) / 10).cast("int") + 1
    cells = lines.select(F.col("l_returnflag").alias("image"), y.alias("y"), x.alias("x"), F.when(F.col("l_suppkey") % 10 < 8, block).alias("label"))
    return cells.groupBy("image", "y", "x").agg(F.max("label").alias("label")).where("label IS NOT NULL")


def _raster_sql(name, shift=0):
    return f"""{name} AS (SELECT l_returnflag AS image, l_orderkey % {HEIGHT} AS y, l_partkey % {WIDTH} AS x, max(CASE WHEN l_suppkey % 10 < 8 THEN l_orderkey % {HEIGHT} // 8 * 5 + (l_partkey % {WIDTH} + {shift}) // 10 + 1 END) AS label
  FROM lineitem GROUP BY ALL HAVING label IS NOT NULL)"""


def _boundary_sql(name, cells):
    return f"""{name} AS (SELECT DISTINCT c.image, c.y, c.x FROM {cells} c, (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)
  LEFT JOIN {cells} o ON o.image = c.image AND o.y = c.y + dy AND o.x = c.x + dx WHERE c.y + dy BETWEEN 0 AND {HEIGHT - 1} AND c.x + dx BETWEEN 0 AND {WIDTH - 1} AND o.label IS DISTINCT FROM c.label)"""


def k29_boundary(spark, sf_dir):
    """Cells of a label with a neighbour (of eight) of another one or none."""
    return raster.boundary(_raster(spark, sf_dir), ["image"], HEIGHT, WIDTH).select("image", "y", "x")


K29_SQL = f"WITH {_raster_sql('c0')}, {_boundary_sql('b0', 'c0')} SELECT * FROM b0"


def m06_boundary_agreement(spark, sf_dir):
    """Agreement within two cells of the boundaries of two labelings, one shifted by three cells; images named by a line's status have none."""
    lines = table(spark, sf_dir, "lineitem")
    images = lines.select(F.col("l_returnflag").alias("image")).union(lines.select("l_linestatus"))
    sides = [raster.boundary(_raster(spark, sf_dir, shift), ["image"], HEIGHT, WIDTH) for shift in (0, 3)]
    found = raster.boundary_agreement(*sides, ["image"], images=images)
    return found.select("image", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


M06_SQL = f"""WITH {_raster_sql('c0')}, {_raster_sql('c3', 3)}, {_boundary_sql('b0', 'c0')}, {_boundary_sql('b3', 'c3')},
p AS (SELECT image, avg(CASE WHEN EXISTS (SELECT 1 FROM b0 t WHERE t.image = b3.image AND pow(t.y - b3.y, 2) + pow(t.x - b3.x, 2) <= 4) THEN 1.0 ELSE 0 END) AS p FROM b3 GROUP BY image),
r AS (SELECT image, avg(CASE WHEN EXISTS (SELECT 1 FROM b3 t WHERE t.image = b0.image AND pow(t.y - b0.y, 2) + pow(t.x - b0.x, 2) <= 4) THEN 1.0 ELSE 0 END) AS r FROM b0 GROUP BY image),
i AS (SELECT l_returnflag AS image FROM lineitem UNION SELECT l_linestatus FROM lineitem), v AS (SELECT image, CASE WHEN p IS NULL AND r IS NULL THEN 1.0 ELSE coalesce(p, 0) END AS p, CASE WHEN p IS NULL AND r IS NULL THEN 1.0 ELSE coalesce(r, 0) END AS r FROM i LEFT JOIN p USING (image) LEFT JOIN r USING (image))
SELECT image, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-12, p + r), 6) AS f1 FROM v"""


def ag02_component_statistics(spark, sf_dir):
    found = raster.component_statistics(_raster(spark, sf_dir), ["image", "label"]).join(raster.major_extent(_raster(spark, sf_dir), ["image", "label"]), ["image", "label"])
    return found.select("image", "label", "area", "y0", "x0", "height", "width", *(F.round(c, 6).alias(c) for c in ("centre_y", "centre_x", "extent")))


AG02_SQL = f"""WITH {_raster_sql('c0')}, m AS (SELECT image, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width, avg(y) AS my, avg(x) AS mx, var_pop(y) AS a, var_pop(x) AS b, covar_pop(y, x) AS c FROM c0 GROUP BY ALL)
SELECT image, label, area, y0, x0, height, width, round(my, 6) AS centre_y, round(mx, 6) AS centre_x, round(4 * sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)), 6) AS extent FROM m"""


def g01_continuity(spark, sf_dir):
    """Connected pieces (of eight neighbours) of each label."""
    return raster.continuity(_raster(spark, sf_dir), ["image"])


G01_SQL = f"""WITH RECURSIVE {_raster_sql('c0')}, n AS (SELECT a.image, a.label, a.y * {WIDTH} + a.x AS i, b.y * {WIDTH} + b.x AS j FROM c0 a JOIN c0 b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT image, label, i, i AS j FROM n UNION SELECT r.image, r.label, r.i, n.j FROM r JOIN n ON r.image = n.image AND r.label = n.label AND r.j = n.i), c AS (SELECT image, label, i, min(j) AS root FROM r GROUP BY ALL)
SELECT image, label, count(DISTINCT root) AS pieces FROM c GROUP BY ALL"""


def p06_in_region(spark, sf_dir):
    return raster.in_region(_raster(spark, sf_dir), ["image", "label"], [(5.0, 5.0), (45.0, 5.0), (45.0, 35.0), (5.0, 35.0)]).select("image", "label", "area")


P06_SQL = f"WITH {_raster_sql('c0')} SELECT image, label, count(*) AS area FROM c0 GROUP BY ALL HAVING avg(x) BETWEEN 5 AND 45 AND avg(y) BETWEEN 5 AND 35"


def p09_small_removed(spark, sf_dir):
    return raster.small_removed(_raster(spark, sf_dir), ["image", "label"], 70)


P09_SQL = f"WITH {_raster_sql('c0')} SELECT * FROM c0 QUALIFY count(*) OVER (PARTITION BY image, label) >= 70"


def c24_hull_shapes(spark, sf_dir):
    """Convex area, perimeter, greatest and least extent of each label."""
    found = raster.hull_shapes(_raster(spark, sf_dir), ["image", "label"])
    return found.select("image", "label", *(F.round(c, 6).alias(c) for c in ("hull_area", "hull_perimeter", "feret_max", "feret_min")))


# An edge of the hull is a pair of points with all others on one side; of collinear ones only the longest.
C24_SQL = f"""WITH {_raster_sql('c0')}, q AS (SELECT image, label, y, unnest([min(x), max(x)]) AS x FROM c0 GROUP BY image, label, y), p AS (SELECT DISTINCT image, label, x, y FROM q),
e AS (SELECT a.image, a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS hi, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS lo, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS len
  FROM p a JOIN p b ON a.image = b.image AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.image = a.image AND c.label = a.label GROUP BY ALL HAVING lo >= 0),
h AS (SELECT *, row_number() OVER (PARTITION BY image, label, x1, y1 ORDER BY len DESC) AS k, row_number() OVER (PARTITION BY image, label, x2, y2 ORDER BY len DESC) AS j FROM e),
f AS (SELECT a.image, a.label, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS feret_max FROM p a JOIN p b ON a.image = b.image AND a.label = b.label GROUP BY ALL)
SELECT image, label, round(sum(x1 * y2 - x2 * y1) / 2, 6) AS hull_area, round(sum(len), 6) AS hull_perimeter, round(any_value(feret_max), 6) AS feret_max, round(min(hi / len), 6) AS feret_min FROM h JOIN f USING (image, label) WHERE k = 1 AND j = 1 GROUP BY image, label"""


def k31_relabel(spark, sf_dir):
    """Labels of each scope renumbered from 1."""
    return overlap.relabel(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", "label")


K31_SQL = "SELECT l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) AS label FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem)"


def ag05_instance_summary(spark, sf_dir):
    """Means of each instance, shares of its classes and its dominant class (first by name on ties)."""
    found = overlap.instance_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_quantity", "l_discount"], "l_returnflag", ["A", "N", "R"])
    return found.select("l_suppkey", "area", *(F.round(c, 6).alias(n) for c, n in (("mean_l_quantity", "mean_quantity"), ("mean_l_discount", "mean_discount"), ("share_A", "share_a"), ("share_N", "share_n"), ("share_R", "share_r"))), "dominant")


AG05_SQL = """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT l_suppkey, l_returnflag AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
SELECT l_suppkey, count(*) AS area, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount, round(count(*) FILTER (l_returnflag = 'A') / count(*), 6) AS share_a,
  round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS share_n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS share_r, any_value(dominant) AS dominant FROM lineitem JOIN d USING (l_suppkey) GROUP BY l_suppkey"""


def ag06_class_proportions(spark, sf_dir):
    """Shares of instances by their dominant class."""
    found = overlap.instance_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", [], "l_returnflag", [])
    return overlap.class_proportions(found, "dominant").withColumn("share", F.round("share", 6))


AG06_SQL = """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT l_suppkey, l_returnflag AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
SELECT dominant, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY dominant"""


def j14_unoutlined(spark, sf_dir):
    """Labels of a shifted labeling that are more than half free of the other's, numbered on from its largest."""
    existing = _raster(spark, sf_dir).where("label % 3 <> 0").withColumn("cell", F.col("y") * WIDTH + F.col("x"))
    predicted = _raster(spark, sf_dir, 3).withColumn("cell", F.col("y") * WIDTH + F.col("x"))
    return overlap.unoutlined(existing.select("image", "cell", "label"), predicted.select("image", "cell", "label"))


J14_SQL = f"""WITH {_raster_sql('c0')}, {_raster_sql('c3', 3)}, e AS (SELECT * FROM c0 WHERE label % 3 <> 0), s AS (SELECT p.image, p.label, count(*) AS area, count(*) FILTER (e.label IS NULL) AS free FROM c3 p LEFT JOIN e ON e.image = p.image AND e.y = p.y AND e.x = p.x GROUP BY ALL HAVING free * 2 > area)
SELECT image, label, (SELECT max(label) FROM e WHERE e.image = s.image) + row_number() OVER (PARTITION BY image ORDER BY label) AS new_label, area, free FROM s"""


def u01_mask_union(spark, sf_dir):
    """Cells of either labeling."""
    return raster.mask_union([_raster(spark, sf_dir), _raster(spark, sf_dir, 3)], ["image"])


U01_SQL = f"WITH {_raster_sql('c0')}, {_raster_sql('c3', 3)} SELECT image, y, x FROM c0 UNION SELECT image, y, x FROM c3"

def g10_hysteresis(spark, sf_dir):
    """Cells that those of labels divisible by four reach through cells of odd labels, in eight steps at most."""
    cells = _raster(spark, sf_dir).select("image", "y", "x", (F.col("label") % 4 == 0).alias("strong"), ((F.col("label") + F.col("y") * F.col("x")) % 3 != 0).alias("weak"))
    return raster.hysteresis(cells, ["image"], "strong", "weak")


G10_SQL = f"""WITH RECURSIVE {_raster_sql('c0')}, f AS (SELECT image, y, x, label % 4 = 0 AS strong, (label + y * x) % 3 <> 0 AS weak FROM c0),
r AS (SELECT image, y, x, 0 AS step FROM f WHERE strong UNION SELECT f.image, f.y, f.x, step + 1 FROM r JOIN f ON f.image = r.image AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1 WHERE step < 8 AND weak AND NOT strong)
SELECT image, y, x, min(step) AS step FROM r GROUP BY ALL"""


def k04_distance_transform(spark, sf_dir):
    """Distance of every cell to the nearest of the labels divisible by seven; images named by a line's status have none."""
    lines = table(spark, sf_dir, "lineitem")
    images = lines.select(F.col("l_returnflag").alias("image")).union(lines.select("l_linestatus")).select("image", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))
    found = raster.distance_transform(_raster(spark, sf_dir).where("label % 7 = 0"), ["image"], images)
    return found.select("image", "y", "x", F.round("distance", 6).alias("distance"))


K04_SQL = f"""WITH {_raster_sql('c0')}, i AS (SELECT l_returnflag AS image FROM lineitem UNION SELECT l_linestatus FROM lineitem), g AS (SELECT image, y, x FROM i CROSS JOIN range({HEIGHT}) a(y) CROSS JOIN range({WIDTH}) b(x))
SELECT g.image, g.y, g.x, round(sqrt(min(pow(g.y - c0.y, 2) + pow(g.x - c0.x, 2))), 6) AS distance FROM g LEFT JOIN c0 ON c0.image = g.image AND c0.label % 7 = 0 GROUP BY ALL"""

QUERIES = {
    "g10_hysteresis": (g10_hysteresis, G10_SQL),
    "k04_distance_transform": (k04_distance_transform, K04_SQL),
    "j01_overlap_iou": (j01_overlap_iou, J01_SQL),
    "m01_match_below_half": (m01_match_below_half, M01_SQL),
    "m03_match_cardinality": (m03_match_cardinality, M03_SQL),
    "m04_overlap_metrics": (m04_overlap_metrics, M04_SQL),
    "m05_split_merge": (m05_split_merge, M05_SQL),
    "m06_boundary_agreement": (m06_boundary_agreement, M06_SQL),
    "ag19_macro_metrics": (ag19_macro_metrics, AG19_SQL),
    "k29_boundary": (k29_boundary, K29_SQL),
    "k31_relabel": (k31_relabel, K31_SQL),
    "g01_continuity": (g01_continuity, G01_SQL),
    "p06_in_region": (p06_in_region, P06_SQL),
    "p09_small_removed": (p09_small_removed, P09_SQL),
    "c24_hull_shapes": (c24_hull_shapes, C24_SQL),
    "ag02_component_statistics": (ag02_component_statistics, AG02_SQL),
    "ag05_instance_summary": (ag05_instance_summary, AG05_SQL),
    "ag06_class_proportions": (ag06_class_proportions, AG06_SQL),
    "j14_unoutlined": (j14_unoutlined, J14_SQL),
    "u01_mask_union": (u01_mask_union, U01_SQL),
}
