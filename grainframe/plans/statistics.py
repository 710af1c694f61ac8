"""Queries on robust statistics, calibration and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.functions import evidence
from grainframe.operators import hierarchy, ordered, statistics
from grainframe.sources.tables import table


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


SCORED_SQL = "scored AS (SELECT doc_id, lang, least(n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"


def ag07_robust_scale(spark, sf_dir):
    found = statistics.robust_scale(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5)
    return found.select("l_returnflag", F.round("centre", 4).alias("centre"), F.round("scale", 4).alias("scale"))


AG07_SQL = """WITH c AS (SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS centre FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(any_value(centre), 4) AS centre, round(greatest(0.5, 1.4826 * quantile_disc(abs(l_extendedprice - centre), 0.5)), 4) AS scale FROM lineitem JOIN c USING (l_returnflag) GROUP BY l_returnflag"""


def ag22_reliability(spark, sf_dir):
    found = statistics.reliability(_scored(spark, sf_dir), "score", "quality")
    return found.select("bin", "n", *(F.round(c, 6).alias(c) for c in ("mean_score", "rate", "ece", "brier")))


AG22_SQL = f"""WITH {SCORED_SQL}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(quality) AS rate, sum(pow(score - quality, 2)) AS sq FROM scored WHERE quality IS NOT NULL GROUP BY 1),
f AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_score, rate, sq FROM range(10) r(i) LEFT JOIN b ON bin = i)
SELECT bin, n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate, round(sum(n * abs(mean_score - rate)) OVER () / sum(n) OVER (), 6) AS ece, round(sum(sq) OVER () / sum(n) OVER (), 6) AS brier FROM f"""


def w01_roc_ap(spark, sf_dir):
    found = statistics.roc_ap(_scored(spark, sf_dir), "score", "quality")
    return found.select("positives", "negatives", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


W01_SQL = f"""WITH {SCORED_SQL}, t AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q FROM scored WHERE quality IS NOT NULL GROUP BY score),
r AS (SELECT p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM t WINDOW w AS (ORDER BY score DESC))
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(sum(q * (2 * tp - p) / 2) / (sum(p) * sum(q)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap FROM r"""


def w02_spearman(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("spend_key", F.length("c_name") * 7919 + F.col("c_custkey") % 101)
    found = statistics.spearman(customers, "c_acctbal", "spend_key", ["c_mktsegment"])
    return found.select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


W02_SQL = """WITH c AS (SELECT *, length(c_name) * 7919 + c_custkey % 101 AS k FROM customer), r AS (SELECT c_mktsegment, avg(a) OVER (PARTITION BY c_acctbal) AS ra, avg(b) OVER (PARTITION BY k) AS rb
FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal) - 1 AS a, row_number() OVER (ORDER BY k) - 1 AS b FROM c)) SELECT c_mktsegment, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY c_mktsegment"""


def ag27_balanced_logloss(spark, sf_dir):
    return statistics.balanced_log_loss(_scored(spark, sf_dir), "score", "quality", ["lang"]).select("lang", "n", F.round("loss", 6).alias("loss"))


AG27_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT lang, quality, count(*) AS n, avg(CASE WHEN quality = 1 THEN -ln(greatest(1e-5, least(1 - 1e-5, score))) ELSE -ln(1 - greatest(1e-5, least(1 - 1e-5, score))) END) AS loss FROM scored WHERE quality IS NOT NULL GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(avg(loss), 6) AS loss FROM c GROUP BY lang"""


def ag28_reliability_margin(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("good", F.col("quality") == 1)
    found = statistics.reliability_margin(rows, ["lang"], "score", "good")
    return found.select("lang", "inside", "outside", F.round("reliability", 6).alias("reliability"))


AG28_SQL = f"""WITH {SCORED_SQL} SELECT lang, count(*) FILTER (quality = 1) AS inside, count(*) FILTER (quality <> 1) AS outside, round(CASE WHEN count(*) FILTER (quality = 1) < 16 OR count(*) FILTER (quality <> 1) < 16 THEN 1.0
ELSE greatest(0, least(1, (quantile_disc(score, 0.5) FILTER (quality = 1) - quantile_cont(score, 0.9) FILTER (quality <> 1)) / 0.2)) END, 6) AS reliability FROM scored GROUP BY lang"""


def ag29_otsu(spark, sf_dir):
    return statistics.otsu(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("v")), "v")


AG29_SQL = """WITH h AS (SELECT CAST(least(floor(l_quantity / 50 * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT bin, sum(n) OVER o AS w, sum(n * bin) OVER o AS m, sum(n) OVER () AS t, sum(n * bin) OVER () AS tm FROM h WINDOW o AS (ORDER BY bin))
SELECT bin, (bin + 1) / 256 AS threshold FROM s ORDER BY coalesce(CASE WHEN w * (t - w) > 0 THEN CAST(m * t - tm * w AS DOUBLE) * CAST(m * t - tm * w AS DOUBLE) / (CAST(w AS DOUBLE) * (t - w)) END, 0) DESC, bin LIMIT 1"""


def ag30_linear_quantile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = ordered.linear_quantile(lines, ["l_returnflag"], "l_extendedprice", 0.995, "q995")
    return found.select("l_returnflag", F.round("q995", 4).alias("q995"))


AG30_SQL = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.995), 4) AS q995 FROM lineitem GROUP BY l_returnflag"


def ag33_frequency_table(spark, sf_dir):
    return statistics.frequency_table(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), {"p_size": 4.0, "p_retailprice": 3.0}).withColumn("share", F.round("share", 6))


AG33_SQL = "SELECT CAST(round_even(p_size / 4.0::DOUBLE, 0) AS BIGINT) AS p_size, CAST(round_even(p_retailprice / 3.0::DOUBLE, 0) AS BIGINT) AS p_retailprice, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1, 2"


def t01_even_subsample(spark, sf_dir):
    """Five hundred rows at even places of the order."""
    from grainframe.plans.overlap import LINE_ORDER

    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return ordered.even_subsample(lines, [F.col(c) for c in LINE_ORDER], 500).select("rank", *LINE_ORDER[:4])


T01_SQL = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS rank FROM lineitem)
SELECT rank, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p WHERE rank IN (SELECT CAST(round_even(i * ((SELECT count(*) - 1 FROM lineitem) / 499.0::DOUBLE), 0) AS BIGINT) FROM range(500) r(i))"""


def ag09_source_balanced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = hierarchy.source_balanced(docs, "lang", "source", "n_chars")
    return found.select("doc_id", "lang", "source", F.round("balanced", 9).alias("balanced"))


AG09_SQL = """WITH s AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY ALL), k AS (SELECT lang, count(DISTINCT source) AS k FROM documents GROUP BY lang)
SELECT doc_id, d.lang, d.source, round(n_chars / w / k, 9) AS balanced FROM documents d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang AND d.source IS NOT DISTINCT FROM s.source JOIN k ON d.lang IS NOT DISTINCT FROM k.lang"""


def ag11_balance_error(spark, sf_dir):
    found = hierarchy.balance_error(table(spark, sf_dir, "documents"), "lang", "source", "n_chars")
    return found.select("lang", "sources", F.round("largest", 6).alias("largest"), F.round("error", 6).alias("error"))


AG11_SQL = """WITH s AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY ALL), t AS (SELECT lang, w / sum(w) OVER (PARTITION BY lang) AS share, count(*) OVER (PARTITION BY lang) AS k FROM s)
SELECT lang, any_value(k) AS sources, round(max(share), 6) AS largest, round(max(abs(share - 1.0::DOUBLE / k)), 6) AS error FROM t GROUP BY lang"""


def ag14_strata_grouping_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = hierarchy.strata(orders, {"segment": "c_mktsegment", "priority": "o_orderpriority", "status": "o_orderstatus"}, {"n": F.count("*"), "high": F.count_if(F.col("o_totalprice") > 100000)})
    return found.select("field", "stratum", "n", "high")


AG14_SQL = """WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) SELECT 'segment' AS field, coalesce(c_mktsegment, 'unknown') AS stratum, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS high FROM o GROUP BY 2
UNION ALL SELECT 'priority', coalesce(o_orderpriority, 'unknown'), count(*), count(*) FILTER (o_totalprice > 100000) FROM o GROUP BY 2 UNION ALL SELECT 'status', coalesce(o_orderstatus, 'unknown'), count(*), count(*) FILTER (o_totalprice > 100000) FROM o GROUP BY 2"""


def ag15_hierarchy_rollup(spark, sf_dir):
    geo = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    found = hierarchy.shrunk_rollup(rows, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")
    return found.select("depth", "r_name", "n_name", "c_mktsegment", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "shrunk")))


AG15_SQL = """WITH c AS (SELECT r_name, n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
l0 AS (SELECT count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, avg(c_acctbal) AS shrunk FROM c),
l1 AS (SELECT r_name, g.n, g.mean, g.sd, (g.n * g.mean + 5 * l0.shrunk) / (g.n + 5) AS shrunk FROM (SELECT r_name, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM c GROUP BY ALL) g, l0),
l2 AS (SELECT g.r_name, n_name, g.n, g.mean, g.sd, (g.n * g.mean + 5 * l1.shrunk) / (g.n + 5) AS shrunk FROM (SELECT r_name, n_name, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM c GROUP BY ALL) g JOIN l1 USING (r_name)),
l3 AS (SELECT g.r_name, g.n_name, c_mktsegment, g.n, g.mean, g.sd, (g.n * g.mean + 5 * l2.shrunk) / (g.n + 5) AS shrunk FROM (SELECT r_name, n_name, c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM c GROUP BY ALL) g JOIN l2 USING (r_name, n_name)),
u AS (SELECT 0 AS depth, NULL AS r_name, NULL AS n_name, NULL AS c_mktsegment, * FROM l0 UNION ALL SELECT 1, r_name, NULL, NULL, n, mean, sd, shrunk FROM l1 UNION ALL SELECT 2, r_name, n_name, NULL, n, mean, sd, shrunk FROM l2 UNION ALL SELECT 3, * FROM l3)
SELECT depth, r_name, n_name, c_mktsegment, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(shrunk, 4) AS shrunk FROM u"""


def ag20_micro_macro(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("lang", (F.col("score") >= 0.05).alias("said"), (F.col("quality") == 1).alias("true"))
    found = hierarchy.precision_recall(rows, "lang")
    return found.select("scope", "n", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "macro_precision")))


AG20_SQL = f"""WITH {SCORED_SQL}, g AS (SELECT coalesce(lang, 'unknown') AS scope, count(*) AS n, count(*) FILTER (score >= 0.05 AND quality = 1) AS tp, count(*) FILTER (score >= 0.05 AND quality <> 1) AS fp, count(*) FILTER (score < 0.05 AND quality = 1) AS fn FROM scored GROUP BY 1),
a AS (SELECT *, CAST(NULL AS DOUBLE) AS mp FROM g UNION ALL SELECT 'all', sum(n), sum(tp), sum(fp), sum(fn), avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) FROM g)
SELECT scope, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(mp, 6) AS macro_precision FROM a"""


def c11_material_decision(spark, sf_dir):
    from grainframe.plans.overlap import LINE_ORDER

    masses = evidence.material_masses(F.col("l_discount") / 0.1, F.col("l_tax") / 0.08, F.col("l_quantity") / 50)
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*LINE_ORDER, *(F.round(v, 6).alias(k) for k, v in masses.items()))


C11_SQL = """WITH v AS (SELECT *, l_discount / 0.1::DOUBLE AS s, 1 - (1 - l_tax / 0.08::DOUBLE) * (1 - l_quantity / 50) AS m FROM lineitem), r AS (SELECT *, s * (1 - m) AS a, m * (1 - s) AS b, 2 * s * m AS c, (1 - s) * (1 - m) AS d FROM v), t AS (SELECT *, a + b + c + d AS z FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(CASE WHEN z > 0 THEN a / z ELSE 0 END, 6) AS seed, round(CASE WHEN z > 0 THEN b / z ELSE 0 END, 6) AS nonseed,
  round(CASE WHEN z > 0 THEN c / z ELSE 0 END, 6) AS conflict, round(CASE WHEN z > 0 THEN d / z ELSE 1 END, 6) AS unknown FROM t"""


def c16_overreach(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cost = evidence.overreach(F.col("l_quantity"), 6.0)
    return lines.groupBy("l_suppkey").agg(F.round(F.avg(cost), 6).alias("cost"), F.round(F.max(cost), 6).alias("worst"))


C16_SQL = "SELECT l_suppkey, round(avg(pow(2, least(l_quantity / 6, 8)) - 1), 6) AS cost, round(max(pow(2, least(l_quantity / 6, 8)) - 1), 6) AS worst FROM lineitem GROUP BY l_suppkey"


def c04_ciede2000(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = (F.col("p_size") * 2.0, F.col("p_retailprice") % 60 - 30, F.col("p_partkey") % 80 - 40.0)
    found = evidence.with_delta_e_2000(part.select("p_partkey", "p_size", "p_retailprice"), "delta", first, (F.lit(50.0), F.lit(10.0), F.lit(-15.0)))
    return found.select("p_partkey", F.round("delta", 6).alias("delta"))


C04_SQL = """WITH x AS (SELECT p_partkey, p_size * 2.0::DOUBLE AS l1, p_retailprice % 60 - 30 AS a0, p_partkey % 80 - 40.0::DOUBLE AS b1 FROM part),
g AS (SELECT *, (sqrt(a0*a0 + b1*b1) + sqrt(325::DOUBLE)) / 2 AS cm FROM x), f AS (SELECT *, 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25, 7)))) AS k FROM g),
c AS (SELECT *, a0 * (1 + k) AS a1, 10 * (1 + k) AS a2 FROM f), d AS (SELECT *, sqrt(a1*a1 + b1*b1) AS c1, sqrt(a2*a2 + 225) AS c2, CASE WHEN a1 = 0 AND b1 = 0 THEN 0 ELSE degrees(atan2(b1, a1)) END AS p1, degrees(atan2(-15, a2)) AS p2 FROM c),
h AS (SELECT *, CASE WHEN p1 < 0 THEN p1 + 360 ELSE p1 END AS h1, CASE WHEN p2 < 0 THEN p2 + 360 ELSE p2 END AS h2 FROM d), t AS (SELECT *, h2 - h1 AS tn, h1 + h2 AS bo FROM h),
u AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN tn > 180 THEN tn - 360 WHEN tn < -180 THEN tn + 360 ELSE tn END AS dh, CASE WHEN c1 * c2 = 0 THEN bo WHEN abs(tn) <= 180 THEN bo / 2 WHEN bo < 360 THEN (bo + 360) / 2 ELSE (bo - 360) / 2 END AS hm, (l1 + 50) / 2 AS lm, (c1 + c2) / 2 AS cc FROM t),
w AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS bh, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS tt, -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(cc, 7) / (pow(cc, 7) + pow(25, 7))) AS rt FROM u),
y AS (SELECT p_partkey, (50 - l1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * cc) AS dc, bh / (1 + 0.015 * cc * tt) AS dd, rt FROM w)
SELECT p_partkey, round(sqrt(dl*dl + dc*dc + dd*dd + rt*dc*dd), 6) AS delta FROM y"""

QUERIES = {
    "ag07_robust_scale": (ag07_robust_scale, AG07_SQL),
    "ag09_source_balanced": (ag09_source_balanced, AG09_SQL),
    "ag11_balance_error": (ag11_balance_error, AG11_SQL),
    "ag14_strata_grouping_sets": (ag14_strata_grouping_sets, AG14_SQL),
    "ag15_hierarchy_rollup": (ag15_hierarchy_rollup, AG15_SQL),
    "ag20_micro_macro": (ag20_micro_macro, AG20_SQL),
    "ag22_reliability": (ag22_reliability, AG22_SQL),
    "ag27_balanced_logloss": (ag27_balanced_logloss, AG27_SQL),
    "ag28_reliability_margin": (ag28_reliability_margin, AG28_SQL),
    "ag29_otsu": (ag29_otsu, AG29_SQL),
    "ag30_linear_quantile": (ag30_linear_quantile, AG30_SQL),
    "ag33_frequency_table": (ag33_frequency_table, AG33_SQL),
    "t01_even_subsample": (t01_even_subsample, T01_SQL),
    "w01_roc_ap": (w01_roc_ap, W01_SQL),
    "w02_spearman": (w02_spearman, W02_SQL),
    "c04_ciede2000": (c04_ciede2000, C04_SQL),
    "c11_material_decision": (c11_material_decision, C11_SQL),
    "c16_overreach": (c16_overreach, C16_SQL),
}
