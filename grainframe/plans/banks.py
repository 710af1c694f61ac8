"""Queries on banks of prototypes, trait models and populations. Embeddings stand for descriptors, their labels for classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.operators import hierarchy, prototypes, shapes, training, traits, validation, vectors
from grainframe.sources.tables import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _long_sql(where="TRUE"):
    return f"e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {where})"


def _bank(spark, sf_dir):
    """A prototype for each label and fifth of the ids, with a scale of 0.5 to 0.9 and its count as weight."""
    rows = _vectors(spark, sf_dir).withColumn("source", F.col("vec_id") % 5)
    found = vectors.centroids(rows, ["label", "source"], "e")
    return found.select(F.col("label").alias("class"), "source", (F.col("label") * 10 + F.col("source")).alias("prototype"), "centre", F.transform("centre", lambda c: F.lit(0.5) + F.col("source") / 10).alias("scale"), F.col("n").cast("double").alias("weight"))


BANK_SQL = f"{_long_sql()}, c AS (SELECT label, vec_id % 5 AS source, label * 10 + vec_id % 5 AS prototype, i, avg(v) AS m, 0.5 + (vec_id % 5) / 10 AS s, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY ALL)"


def j10_prototype_similarity(spark, sf_dir):
    """The most similar prototype of every vector; one side has a third of the ids left out."""
    found = vectors.prototype_similarity(_vectors(spark, sf_dir), "e", _bank(spark, sf_dir), 0.8)
    return found.select("vec_id", "prototype", F.round("similarity", 6).alias("similarity"))


J10_SQL = f"""WITH {BANK_SQL}, d AS (SELECT vec_id, prototype, least(avg(pow((v - m) / (s * 0.8), 2)), 30) AS d, any_value(w) AS w FROM e JOIN c USING (i) GROUP BY vec_id, prototype),
x AS (SELECT vec_id, prototype, exp(-0.5 * d) * (0.78 + 0.22 * sqrt(w / (SELECT max(w) FROM c))) AS s FROM d) SELECT vec_id, prototype, round(s, 6) AS similarity FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, prototype) = 1"""


def ag12_loo_distance(spark, sf_dir):
    """Distance of each prototype to the nearest of its class from another source."""
    return vectors.leave_one_out(_bank(spark, sf_dir), "source").select("prototype", "source", F.round("distance", 6).alias("distance"))


AG12_SQL = f"""WITH {BANK_SQL}, d AS (SELECT a.prototype, a.source, b.prototype AS p, avg(pow((a.m - b.m) / b.s, 2)) AS d FROM c a JOIN c b ON a.label = b.label AND a.i = b.i AND a.source <> b.source GROUP BY ALL)
SELECT prototype, source, round(min(d), 6) AS distance FROM d GROUP BY ALL"""


def ag13_loo_capture_group(spark, sf_dir):
    """The same by capture group: two groups of two sources; the last source is in none."""
    bank = _bank(spark, sf_dir).withColumn("capture", F.when(F.col("source") < 4, F.floor(F.col("source") / 2)))
    return vectors.leave_one_out(bank, "capture").select("prototype", "capture", F.round("distance", 6).alias("distance"))


AG13_SQL = f"""WITH {BANK_SQL}, g AS (SELECT *, source // 2 AS capture FROM c WHERE source < 4), d AS (SELECT a.prototype, a.capture, b.prototype AS p, avg(pow((a.m - b.m) / b.s, 2)) AS d FROM g a JOIN g b ON a.label = b.label AND a.i = b.i AND a.capture <> b.capture GROUP BY ALL)
SELECT prototype, capture, round(min(d), 6) AS distance FROM d GROUP BY ALL"""


def g08_assign_round(spark, sf_dir):
    """One round of clustering: vectors to the nearest label mean, then medians and robust scales of what each got."""
    rows = _vectors(spark, sf_dir)
    bank = vectors.centroids(rows, ["label"], "e").withColumnRenamed("label", "cluster")
    found = vectors.median_update(vectors.assign_nearest(rows, "e", bank), "e")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 5)
    return found.select("cluster", "n", total("centre").alias("centre_sum"), total("scale").alias("scale_sum"), F.round(F.col("centre")[0], 6).alias("centre_0"))


G08_SQL = f"""WITH {_long_sql()}, c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), d AS (SELECT vec_id, c.label, sum(pow(v - m, 2)) AS d FROM e JOIN c USING (i) GROUP BY ALL), a AS (SELECT vec_id, label AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1),
m AS (SELECT cluster, i, quantile_cont(v, 0.5) AS m, count(*) AS n FROM e JOIN a USING (vec_id) GROUP BY ALL), s AS (SELECT cluster, i, greatest(0.045, 1.4826 * quantile_cont(abs(v - m.m), 0.5)) AS s FROM e JOIN a USING (vec_id) JOIN m USING (cluster, i) GROUP BY ALL)
SELECT cluster, max(n) AS n, round(sum(m), 5) AS centre_sum, round(sum(s), 5) AS scale_sum, round(max(m) FILTER (i = 1), 6) AS centre_0 FROM m JOIN s USING (cluster, i) GROUP BY cluster"""


def _weighted(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("w", (F.col("vec_id") * 37 % 101 + 1).cast("double"))


def _steps_sql(first, k, share="sqrt(any_value(n.w) / any_value(n.top))"):
    """Chosen rows of each label step by step, from the table ``ch0`` on."""
    parts = [first]
    for i in range(1, k):
        parts.append(f"""s{i} AS (SELECT n.label, n.vec_id, min(n.d) * (0.25 + 0.75 * {share}) AS score FROM (SELECT a.label, a.vec_id, b.vec_id AS p, sum(pow(a.v - b.v, 2)) AS d, any_value(a.w) AS w, any_value(a.top) AS top FROM x a JOIN x b ON a.label = b.label AND a.i = b.i AND b.vec_id IN (SELECT vec_id FROM ch{i - 1})
  WHERE a.vec_id NOT IN (SELECT vec_id FROM ch{i - 1}) GROUP BY a.label, a.vec_id, b.vec_id) n GROUP BY n.label, n.vec_id),
ch{i} AS (SELECT * FROM ch{i - 1} UNION ALL SELECT label, {i + 1} AS rank, vec_id FROM (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1))""")
    return ",\n".join(parts)


WEIGHTED_SQL = f"{_long_sql()}, x AS (SELECT *, CAST(vec_id * 37 % 101 + 1 AS DOUBLE) AS w, max(CAST(vec_id * 37 % 101 + 1 AS DOUBLE)) OVER (PARTITION BY label) AS top FROM e)"


def t06_farthest_first(spark, sf_dir):
    """Four vectors of each label, each far from those before it."""
    return vectors.farthest_first(_weighted(spark, sf_dir), ["label"], "vec_id", "e", "w", 4)


T06_SQL = f"WITH {WEIGHTED_SQL}, {_steps_sql('ch0 AS (SELECT label, 1 AS rank, vec_id FROM x WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY w DESC, vec_id) = 1)', 4)} SELECT label, rank, vec_id FROM ch3"


def t07_bounded_selection(spark, sf_dir):
    """Seven vectors of each label: the heaviest of each of five sources, then the farthest two."""
    rows = _weighted(spark, sf_dir).withColumn("source", F.col("vec_id") % 5)
    return vectors.bounded_selection(rows, ["label"], "vec_id", "e", "w", "source", 7)


# of a label with seven vectors or fewer all stay; distances are in units of each label's median absolute deviations
T07_SQL = f"""WITH {WEIGHTED_SQL.replace("x AS (", "y AS (")}, md AS (SELECT label, i, quantile_cont(v, 0.5) AS m, count(*) AS n FROM e GROUP BY ALL), sd AS (SELECT label, i, any_value(m) AS m, any_value(n) AS n, greatest(1e-6, 1.4826 * quantile_cont(abs(v - m), 0.5)) AS s FROM e JOIN md USING (label, i) GROUP BY label, i),
x AS (SELECT vec_id, label, i, (v - m) / s AS v, w, top FROM y JOIN sd USING (label, i) WHERE n > 7), {_steps_sql('ch0 AS (SELECT label, 0 AS rank, vec_id FROM x WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY label, vec_id % 5 ORDER BY w DESC, vec_id) = 1)', 3, 'any_value(n.w) / any_value(n.top)')}
SELECT label, vec_id FROM ch2 UNION ALL SELECT DISTINCT y.label, vec_id FROM y JOIN sd USING (label, i) WHERE n <= 7"""


def j15_exclude_source(spark, sf_dir):
    """Weights of documents by language, balanced again without two of the sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    gone = docs.select("source").distinct().where(F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 4 == 0)
    found = vectors.exclude_source(docs, "source", gone, "lang", "n_chars")
    return found.select("doc_id", "lang", "source", F.round("balanced", 9).alias("balanced"))


J15_SQL = """WITH d AS (SELECT * FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 <> 0), s AS (SELECT lang, source, sum(n_chars) AS w FROM d GROUP BY ALL), k AS (SELECT lang, count(DISTINCT source) AS k FROM d GROUP BY lang)
SELECT doc_id, lang, source, round(n_chars / w / k, 9) AS balanced FROM d JOIN s USING (lang, source) JOIN k USING (lang)"""


def j19_fallback(spark, sf_dir):
    """The most specific component of each customer's path of region, nation and segment."""
    geo = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    contexts = table(spark, sf_dir, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array("r_name", "n_name", "c_mktsegment").alias("path"))
    components = geo.where("n_nationkey % 3 = 0").select(F.array("r_name", "n_name").alias("path"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("component"))
    components = components.union(table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.array("r_name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    found = vectors.fallback(contexts, components)
    return found.select("c_custkey", "component", F.array_join("matched_path", "/").alias("matched_path"))


J19_SQL = """SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN r_regionkey <> 2 THEN 'r' || r_regionkey END AS component, CASE WHEN n_nationkey % 3 = 0 THEN r_name || '/' || n_name WHEN r_regionkey <> 2 THEN r_name END AS matched_path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def lb02_equal_quota(spark, sf_dir):
    """At most ceil(60 / suppliers) lines of each supplier, at even places of its order."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    found = vectors.equal_quota(lines, ["l_returnflag"], "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 400)
    return found


LB02_SQL = """WITH l AS (SELECT l_returnflag, l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM l),
q AS (SELECT l_suppkey, any_value(n) AS n, least(CAST(ceil(400 / (SELECT count(DISTINCT l_suppkey) FROM l)) AS BIGINT), any_value(n)) AS q FROM p GROUP BY l_suppkey), w AS (SELECT l_suppkey, CAST(round_even(i * CASE WHEN q > 1 THEN (n - 1) / (q - 1) ELSE 0 END, 0) AS BIGINT) AS k FROM q, range(1000) r(i) WHERE i < q)
SELECT l_returnflag, l_suppkey, l_orderkey, l_linenumber, l_partkey FROM p WHERE EXISTS (SELECT 1 FROM w WHERE w.l_suppkey = p.l_suppkey AND w.k = p.k)"""


def ag11_weight_signature(spark, sf_dir):
    """Each source's part of a language's weight, and the largest."""
    found = hierarchy.weight_signature(table(spark, sf_dir, "documents"), "lang", "source", "n_chars")
    return found.select("lang", "source", F.round("share", 6).alias("share"), "largest")


AG11W_SQL = """WITH s AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY ALL) SELECT lang, source, round(w / sum(w) OVER (PARTITION BY lang), 6) AS share, w = max(w) OVER (PARTITION BY lang) AS largest FROM s"""


def _model(spark, sf_dir):
    """A frozen linear model over three columns of lines; its numbers are fixed."""
    return spark.createDataFrame([("A", [0.9, -0.4, 0.1], 0.05), ("N", [-0.6, 0.3, 0.2], 0.1), ("R", [0.1, 0.2, -0.8], -0.1)], "class string, weights array<double>, bias double")


def tr03_linear_model(spark, sf_dir):
    """Predictions of a frozen model by order: standardised features, temperature, abstention by reason."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(F.max("l_quantity"), F.when(F.max("l_tax") > 0.07, F.lit(float("nan"))).otherwise(F.max("l_discount") * 100), F.count("*").cast("double")).alias("x"))
    found = vectors.predict_linear(lines, "l_orderkey", "x", _model(spark, sf_dir), [30.0, 5.0, 4.0], [12.0, 3.0, 2.0], 0.5, 0.6)
    return found.select("l_orderkey", "predicted", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"), "abstained", "reason")


TR03L_SQL = """WITH x AS (SELECT l_orderkey, (max(l_quantity) - 30) / 12 AS a, (max(l_discount) * 100 - 5) / 3 AS b, (count(*) - 4) / 2 AS c, max(l_tax) > 0.07 AS bad FROM lineitem GROUP BY l_orderkey),
z AS (SELECT l_orderkey, bad, unnest([{'k': 'A', 'z': (0.9 * a - 0.4 * b + 0.1 * c + 0.05) / 0.5}, {'k': 'N', 'z': (-0.6 * a + 0.3 * b + 0.2 * c + 0.1) / 0.5}, {'k': 'R', 'z': (0.1 * a + 0.2 * b - 0.8 * c - 0.1) / 0.5}]) AS l FROM x),
p AS (SELECT l_orderkey, bad, l.k AS k, exp(l.z) / sum(exp(l.z)) OVER (PARTITION BY l_orderkey) AS p FROM z), q AS (SELECT l_orderkey, any_value(bad) AS bad, arg_max(k, p) AS k, max(p) AS conf, -sum(p * ln(p)) AS h FROM p GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN NOT bad AND conf >= 0.6 THEN k END AS predicted, CASE WHEN NOT bad THEN round(conf, 6) END AS confidence, CASE WHEN NOT bad THEN round(h, 6) END AS entropy, bad OR conf < 0.6 AS abstained, CASE WHEN bad THEN 'invalid_features' WHEN conf < 0.6 THEN 'confidence_below_threshold' END AS reason FROM q"""


def _scored_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = {"low": F.col("c_custkey") % 7 + 1.0, "mid": F.col("c_custkey") % 11 + 1.0, "high": F.col("c_custkey") % 5 + 1.0}
    total = raw["low"] + raw["mid"] + raw["high"]
    names = F.array(*(F.lit(n) for n in raw))
    truth = F.element_at(names, (F.col("c_nationkey") % 3 + 1).cast("int"))
    return c.select("c_mktsegment", F.map_from_arrays(names, F.array(*(v / total for v in raw.values()))).alias("probabilities"), truth.alias("truth"))


SCORED_SQL = """p AS (SELECT c_custkey, c_mktsegment, ['low', 'mid', 'high'][c_nationkey % 3 + 1] AS truth, c_custkey % 7 + 1.0 AS l, c_custkey % 11 + 1.0 AS m, c_custkey % 5 + 1.0 AS h FROM customer), t AS (SELECT *, CAST(l + m + h AS DOUBLE) AS z FROM p),
s AS (SELECT *, CASE truth WHEN 'low' THEN l WHEN 'mid' THEN m ELSE h END / z AS pt, greatest(l, m, h) / z AS conf, CASE WHEN m >= l AND m >= h THEN 'mid' WHEN l >= h THEN 'low' ELSE 'high' END AS said FROM t)"""


def ag23_classifier_diagnostics(spark, sf_dir):
    found = traits.classifier_diagnostics(_scored_lines(spark, sf_dir), ["c_mktsegment"], 0.5)
    return found.select("c_mktsegment", "n", "accepted", *(F.round(c, 6).alias(c) for c in ("nll", "brier", "coverage", "accepted_error")))


AG23_SQL = f"""WITH {SCORED_SQL} SELECT c_mktsegment, count(*) AS n, count(*) FILTER (conf >= 0.5) AS accepted, round(avg(-ln(pt)), 6) AS nll, round(avg((l * l + m * m + h * h) / (z * z) - 2 * pt + 1), 6) AS brier, round(count(*) FILTER (conf >= 0.5) / count(*), 6) AS coverage,
  round(CASE WHEN count(*) FILTER (conf >= 0.5) > 0 THEN count(*) FILTER (conf >= 0.5 AND said <> truth) / count(*) FILTER (conf >= 0.5) END, 6) AS accepted_error FROM s GROUP BY c_mktsegment"""


def ag16_seed_means(spark, sf_dir):
    """Parts of an order as views of a seed; orders without an even key go by customer and key."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey").cast("string")).alias("physical"), "l_suppkey", "l_orderkey", F.array("l_quantity", "l_extendedprice").alias("x"), F.array("l_discount", "l_tax").alias("e"))
    found = traits.seed_means(lines, [], "physical", "l_suppkey", "l_orderkey", "x", "e")
    return found.select("seed_key", "views", *(F.round(F.col(c)[i], 5).alias(f"{c}_{i}") for c in ("mean", "error") for i in (0, 1)))


AG16_SQL = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE 'source:' || l_suppkey || ':seed:' || l_orderkey END AS seed_key, count(*) AS views, round(avg(l_quantity), 5) AS mean_0, round(avg(l_extendedprice), 5) AS mean_1,
  round(sqrt(avg(l_discount * l_discount)), 5) AS error_0, round(sqrt(avg(l_tax * l_tax)), 5) AS error_1 FROM lineitem GROUP BY 1"""


def ag17_robust_component(spark, sf_dir):
    found = traits.robust_component(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return found.select("c_mktsegment", "n", *(F.round(c, 4).alias(c) for c in ("centre", "scale", "variance", "se", "low", "high")))


AG17_SQL = """WITH c AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS centre FROM customer GROUP BY ALL), s AS (SELECT c_mktsegment, any_value(centre) AS centre, greatest(1e-8, 1.4826 * quantile_cont(abs(c_acctbal - centre), 0.5)) AS scale FROM customer JOIN c USING (c_mktsegment) GROUP BY c_mktsegment),
v AS (SELECT c_mktsegment, any_value(centre) AS centre, any_value(scale) AS scale, count(*) AS n, var_samp(centre + greatest(-4, least(4, (c_acctbal - centre) / scale)) * scale) + 0.05 * any_value(scale * scale) AS variance FROM customer JOIN s USING (c_mktsegment) GROUP BY c_mktsegment)
SELECT c_mktsegment, n, round(centre, 4) AS centre, round(scale, 4) AS scale, round(variance, 4) AS variance, round(sqrt(variance / n), 4) AS se, round(centre - 1.96 * sqrt(variance), 4) AS low, round(centre + 1.96 * sqrt(variance), 4) AS high FROM v"""


def ag18_size_statistics(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", (F.col("p_size") / 10).alias("error"))
    found = traits.size_statistics(sizes, ["p_brand"], "p_retailprice", "error")
    return found.select("p_brand", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "se")))


AG18_SQL = """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS sd, round(sqrt(coalesce(var_samp(p_retailprice), 0) / count(*) + avg(pow(p_size / 10, 2))), 6) AS se FROM part GROUP BY p_brand"""



PROTOTYPES, SUPPORT, ITERATIONS, FLOOR = 3, 6, 3, 0.045


def g07_robust_prototypes(spark, sf_dir):
    """Prototypes of each label's vectors, a dimension a row: a spread-out start, three rounds of medians, medoids and scales."""
    found = prototypes.fit_prototypes(_vectors(spark, sf_dir), "label", "vec_id", "e", PROTOTYPES, SUPPORT, ITERATIONS, FLOOR)
    long = found.select("label", "prototype", "medoid", "n", F.round("weight", 6).alias("weight"), F.posexplode(F.arrays_zip("centre", "scale")).alias("dimension", "c"))
    return long.select("label", "prototype", "medoid", "n", "weight", "dimension", F.round("c.centre", 6).alias("centre"), F.round("c.scale", 6).alias("scale"))


def _prototypes_sql():
    """The rounds written out one after another."""
    robust = lambda name, source, keys, v: f"{name}_c AS MATERIALIZED (SELECT {keys}, i, quantile_disc({v}, 0.5) AS c FROM {source} GROUP BY ALL), {name} AS MATERIALIZED (SELECT {keys}, i, any_value(c) AS c, greatest(1.4826 * quantile_disc(abs({v} - c), 0.5), {FLOOR}) AS s FROM {source} JOIN {name}_c USING ({keys}, i) GROUP BY {keys}, i)"
    parts = [_long_sql(), robust("scales", "e", "label", "v"), "z AS MATERIALIZED (SELECT vec_id, label, i, v, (v - c) / s AS z FROM e JOIN scales USING (label, i))"]
    parts.append(f"sizes AS (SELECT label, count(DISTINCT vec_id) AS n, least({PROTOTYPES}, greatest(1, count(DISTINCT vec_id) // {SUPPORT})) AS most FROM e GROUP BY label)")
    parts.append("near0 AS MATERIALIZED (SELECT vec_id, label, avg(z * z) AS near FROM z GROUP BY ALL)")
    for k in range(PROTOTYPES):
        parts.append(f"p{k} AS MATERIALIZED (SELECT label, vec_id AS picked FROM near{k} JOIN sizes USING (label) WHERE most > {k}{' AND near > 1e-8' if k else ''} QUALIFY row_number() OVER (PARTITION BY label ORDER BY near DESC, vec_id) = 1)")
        parts.append(f"d{k} AS (SELECT z.vec_id, z.label, sum(pow(z.z - o.z, 2)) AS d FROM z JOIN p{k} ON p{k}.label = z.label JOIN z o ON o.vec_id = picked AND o.i = z.i GROUP BY ALL)")
        parts.append(f"near{k + 1} AS MATERIALIZED (SELECT vec_id, label, {'least(near, d)' if k else 'd'} AS near FROM d{k} JOIN near{k} USING (vec_id, label))")
    parts.append("c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT z.label, {k} AS k, i, z AS c FROM p{k} JOIN z ON z.vec_id = picked" for k in range(PROTOTYPES)) + ")")
    for t in range(ITERATIONS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, label, k FROM (SELECT z.vec_id, z.label, k, sum(pow(z - c, 2)) AS d FROM z JOIN c{t} USING (label, i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if t < ITERATIONS:
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT label, k, i, coalesce(m, c) AS c FROM c{t} LEFT JOIN (SELECT label, k, i, quantile_disc(z, 0.5) AS m FROM z JOIN a{t} USING (vec_id, label) GROUP BY ALL) USING (label, k, i))")
    parts += [f"f AS MATERIALIZED (SELECT vec_id, label, k, i, v FROM z JOIN a{ITERATIONS} USING (vec_id, label))", robust("l", "f", "label, k", "v")]
    parts.append("far AS (SELECT vec_id, label, k, avg(pow((v - c) / s, 2)) AS d FROM f JOIN l USING (label, k, i) GROUP BY ALL), best AS (SELECT label, k, arg_min(vec_id, {'d': d, 'i': vec_id}) AS medoid, count(*) AS members FROM far GROUP BY ALL)")
    return "WITH " + ", ".join(parts) + " SELECT label, k AS prototype, medoid, members AS n, round(members / sizes.n, 6) AS weight, i - 1 AS dimension, round(c, 6) AS centre, round(s, 6) AS scale FROM l JOIN best USING (label, k) JOIN sizes USING (label)"


G07_SQL = _prototypes_sql()



STEPS, RATE, L2, HEATS = 4, 0.03, 0.01, (0.05, 20.0, 9)


def _trained(spark, sf_dir):
    """A model of the labels, trained on three quarters of the vectors and calibrated on the last."""
    rows = _vectors(spark, sf_dir)
    classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    model = training.train_softmax(rows.where("vec_id % 4 <> 0"), "e", "label", classes, STEPS, RATE, L2)
    return rows, training.calibrated(rows.where("vec_id % 4 = 0"), "e", "label", model, HEATS[:2], HEATS[2])


def tr02_softmax_training(spark, sf_dir):
    """Weights after four steps (dimension 0 is the bias), with the temperature chosen and its loss."""
    _, model = _trained(spark, sf_dir)
    found = model.frame(spark, "int").select(F.col("class").alias("label"), F.posexplode(F.concat(F.array("bias"), "weights")).alias("dimension", "weight"))
    return found.select("label", "dimension", F.round("weight", 6).alias("weight"), F.lit(round(model.temperature, 6)).alias("temperature"), F.lit(round(model.loss, 6)).alias("loss"))


def tr02_temperature_losses(spark, sf_dir):
    """Loss of that model at every temperature of the grid."""
    rows, model = _trained(spark, sf_dir)
    found = training.temperature_losses(rows.where("vec_id % 4 = 0"), "e", "label", model, training.temperatures(*HEATS))
    return found.select(F.round("temperature", 6).alias("temperature"), "n", F.round("loss", 6).alias("loss"))


def _training_sql():
    """The steps written out one after another; dimension 0 of every vector is 1."""
    parts = [_long_sql(), "s AS MATERIALIZED (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM e WHERE vec_id % 4 <> 0 GROUP BY i)"]
    parts.append("z AS MATERIALIZED (SELECT vec_id, label, i, (v - m) / CASE d WHEN 0 THEN 1 ELSE d END AS z FROM e JOIN s USING (i) UNION ALL SELECT vec_id, label, 0, 1 FROM embeddings)")
    parts.append("w0 AS (SELECT k, i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT DISTINCT label AS k FROM e) CROSS JOIN (SELECT DISTINCT i FROM z))")
    for t in range(1, STEPS + 1):
        parts.append(f"l{t} AS (SELECT vec_id, label, k, sum(z * w) AS l FROM z JOIN w{t - 1} USING (i) WHERE vec_id % 4 <> 0 GROUP BY ALL), p{t} AS MATERIALIZED (SELECT vec_id, k, exp(l - max(l) OVER r) / sum(exp(l)) OVER r * exp(max(l) OVER r) - CAST(k = label AS INT) AS p FROM l{t} WINDOW r AS (PARTITION BY vec_id))")
        parts.append(f"g{t} AS (SELECT k, i, avg(p * z) AS g FROM p{t} JOIN z USING (vec_id) GROUP BY ALL), u{t} AS (SELECT k, i, w, g + CASE WHEN i > 0 THEN {L2} * w ELSE 0 END AS g, m, v FROM w{t - 1} JOIN g{t} USING (k, i))")
        parts.append(f"w{t} AS MATERIALIZED (SELECT k, i, w - {RATE} / (1 - pow(0.9, {t})) * (0.9 * m + 0.1 * g) / (sqrt((0.999 * v + 0.001 * g * g) / (1 - pow(0.999, {t}))) + 1e-8) AS w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM u{t})")
    heats = ", ".join(map(repr, training.temperatures(*HEATS).tolist()))
    parts.append(f"t AS (SELECT unnest(CAST([{heats}] AS DOUBLE[])) AS t), lc AS MATERIALIZED (SELECT vec_id, label, k, sum(z * w) AS l FROM z JOIN w{STEPS} USING (i) WHERE vec_id % 4 = 0 GROUP BY ALL)")
    parts.append("x AS (SELECT t, vec_id, ln(sum(exp(l / t))) - max(CASE WHEN k = label THEN l END) / t AS x FROM lc CROSS JOIN t GROUP BY t, vec_id), f AS (SELECT t, count(*) AS n, avg(x) AS loss FROM x GROUP BY t)")
    return "WITH " + ", ".join(parts)


TR02_SQL = f"{_training_sql()} SELECT k AS label, i AS dimension, round(w, 6) AS weight, (SELECT round(arg_min(t, {{'a': loss, 'b': t}}), 6) FROM f) AS temperature, (SELECT round(min(loss), 6) FROM f) AS loss FROM w{STEPS}"
TR02T_SQL = f"{_training_sql()} SELECT round(t, 6) AS temperature, n, round(loss, 6) AS loss FROM f"



def sh06_contour_modes(spark, sf_dir):
    """Modes of each label's vectors, taken as signatures of closed contours, and how many of them hold out."""
    found = shapes.contour_modes(_vectors(spark, sf_dir), "label", "e", 4)
    flat = found.select("label", "n", "kept", F.round(F.aggregate("variances", F.lit(0.0), lambda s, v: s + v), 6).alias("variance"), F.posexplode_outer("mean").alias("place", "mean"))
    return flat.withColumn("mean", F.round("mean", 6))




def ag39_left_out_coverage(spark, sf_dir):
    """Parts of a brand that lie within the robust interval of the brand's other parts, by size, price and number."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_partkey") % 97).cast("double")).alias("v"))
    found = validation.left_out_coverage(parts, "p_brand", "p_partkey", "v")
    return found.withColumn("coverage", F.round("coverage", 6))


# every part against all others of its brand
AG39_SQL = """WITH p AS (SELECT p_brand, p_partkey, unnest([CAST(p_size AS DOUBLE), p_retailprice, p_partkey % 97]) AS v, unnest([1, 2, 3]) AS i FROM part),
m AS MATERIALIZED (SELECT a.p_brand, a.p_partkey, a.i, a.v, quantile_cont(b.v, 0.5) AS m FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.i = b.i AND a.p_partkey <> b.p_partkey GROUP BY ALL),
s AS (SELECT a.p_brand, a.p_partkey, a.i, abs(a.v - a.m) <= 1.96 * greatest(1e-8, 1.4826 * quantile_cont(abs(b.v - a.m), 0.5)) AS inside FROM m a JOIN p b ON a.p_brand = b.p_brand AND a.i = b.i AND a.p_partkey <> b.p_partkey GROUP BY a.p_brand, a.p_partkey, a.i, a.v, a.m),
h AS (SELECT p_brand, p_partkey, bool_and(inside) AS hit FROM s GROUP BY ALL), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
SELECT p_brand, any_value(n) AS n, CASE WHEN any_value(n) >= 3 THEN any_value(n) ELSE 0 END AS tested, count(*) FILTER (hit AND n >= 3) AS hits, CASE WHEN any_value(n) >= 3 THEN round(count(*) FILTER (hit) / any_value(n), 6) END AS coverage FROM n LEFT JOIN h USING (p_brand) GROUP BY p_brand"""

QUERIES = {
    "ag39_left_out_coverage": (ag39_left_out_coverage, AG39_SQL),
    "sh06_contour_modes": (sh06_contour_modes, None),
    "tr02_softmax_training": (tr02_softmax_training, TR02_SQL),
    "tr02_temperature_losses": (tr02_temperature_losses, TR02T_SQL),
    "g07_robust_prototypes": (g07_robust_prototypes, G07_SQL),
    "j10_prototype_similarity": (j10_prototype_similarity, J10_SQL),
    "ag11_weight_signature": (ag11_weight_signature, AG11W_SQL),
    "ag12_loo_distance": (ag12_loo_distance, AG12_SQL),
    "ag13_loo_capture_group": (ag13_loo_capture_group, AG13_SQL),
    "g08_assign_round": (g08_assign_round, G08_SQL),
    "t06_farthest_first": (t06_farthest_first, T06_SQL),
    "t07_bounded_selection": (t07_bounded_selection, T07_SQL),
    "j15_exclude_source": (j15_exclude_source, J15_SQL),
    "j19_fallback": (j19_fallback, J19_SQL),
    "lb02_equal_quota": (lb02_equal_quota, LB02_SQL),
    "tr03_linear_model": (tr03_linear_model, TR03L_SQL),
    "ag23_classifier_diagnostics": (ag23_classifier_diagnostics, AG23_SQL),
    "ag16_seed_means": (ag16_seed_means, AG16_SQL),
    "ag17_robust_component": (ag17_robust_component, AG17_SQL),
    "ag18_size_statistics": (ag18_size_statistics, AG18_SQL),
}
