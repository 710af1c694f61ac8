"""Queries on the smaller operators and on functions of identities, units and the plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.functions import evidence
from grainframe.functions import measures as fm
from grainframe.operators import measures, overlap, raster, traits
from grainframe.plans.overlap import CELLS_SQL, HEIGHT, PAIRS_SQL, WIDTH, _cells, _raster, _raster_sql
from grainframe.sources import library
from grainframe.sources.tables import table


def j02_overlap_above(spark, sf_dir):
    """Pairs that overlap by more than 0.3."""
    pairs = overlap.overlap_iou(overlap.overlap_counts(_cells(spark, sf_dir), ["scope"]), ["scope"])
    return overlap.overlap_above(pairs, 0.3).select("scope", "truth", "prediction", F.round("iou", 6).alias("iou"))


J02_SQL = f"WITH {CELLS_SQL}, {PAIRS_SQL} SELECT scope, truth, prediction, round(iou, 6) AS iou FROM pairs WHERE iou > 0.3"


def t02_thinned(spark, sf_dir):
    """A mask thinned to 0.05 cells for each reviewed one; the lines of a flag stand for reviewed cells."""
    reviewed = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("image")).agg((F.count("*") / 4).cast("long").alias("reviewed"))
    return measures.thinned(_raster(spark, sf_dir).select("image", "y", "x"), ["image"], reviewed, 0.5)


T02_SQL = f"""WITH {_raster_sql('c0')}, r AS (SELECT l_returnflag AS image, CAST(floor(count(*) / 4) AS BIGINT) AS reviewed FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), f AS (SELECT image, CASE WHEN coalesce(reviewed, 0) <= 0 THEN 1.0 ELSE least(1.0, 0.5 * reviewed / n) END AS f FROM (SELECT image, count(*) AS n FROM c0 GROUP BY image) LEFT JOIN r USING (image))
SELECT image, y, x FROM c0 JOIN f USING (image) WHERE f >= 1 OR (f > 0 AND xor(x * 73856093, y * 19349663) % 1000003 < round_even(f * 1000003, 0))"""


def w10_local_maxima(spark, sf_dir):
    """Cells whose count of lines is the greatest within three cells on each side."""
    lines = table(spark, sf_dir, "lineitem")
    grid = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("image")).crossJoin(F.broadcast(spark.range(HEIGHT * WIDTH))).select("image", F.floor(F.col("id") / WIDTH).alias("y"), (F.col("id") % WIDTH).alias("x"))
    counts = lines.groupBy((F.col("l_suppkey") % 5).cast("int").alias("image"), (F.col("l_orderkey") % HEIGHT).alias("y"), (F.col("l_partkey") % WIDTH).alias("x")).agg(F.sum("l_quantity").alias("v"))
    full = grid.join(counts, ["image", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return measures.local_maxima(full, ["image"], "v", 3, 20.0)


W10_SQL = f"""WITH g AS (SELECT r_regionkey AS image, i // {WIDTH} AS y, i % {WIDTH} AS x FROM region, range({HEIGHT * WIDTH}) r(i)), c AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS image, l_orderkey % {HEIGHT} AS y, l_partkey % {WIDTH} AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
f AS (SELECT image, y, x, coalesce(v, 0) AS v FROM g LEFT JOIN c USING (image, y, x)) SELECT * FROM f WHERE v >= 20 AND v >= (SELECT max(o.v) FROM f o WHERE o.image = f.image AND abs(o.y - f.y) <= 3 AND abs(o.x - f.x) <= 3) - 1e-6"""


def ag32_radial_profile(spark, sf_dir):
    """Mean coordinate sum of each label by four rings around the image's middle, and how far the cells lie from it."""
    distance = F.hypot(F.col("y") - HEIGHT / 2, F.col("x") - WIDTH / 2)
    cells = _raster(spark, sf_dir).withColumn("v", (F.col("y") * 3 + F.col("x")).cast("double"))
    found = measures.radial_profile(cells, ["image", "label"], distance, 4, 35.0, "v")
    return found.groupBy("image", "label", "bin").agg(F.count("*").alias("n"), F.round(F.max("profile"), 6).alias("profile"), F.round(F.max(F.abs("residual")), 6).alias("worst"))


AG32_SQL = f"""WITH {_raster_sql('c0')}, b AS (SELECT image, label, CAST(least(floor(sqrt(pow(y - {HEIGHT / 2}, 2) + pow(x - {WIDTH / 2}, 2)) / 35 * 4), 3) AS INTEGER) AS bin, y * 3 + x AS v FROM c0), m AS (SELECT *, avg(v) OVER (PARTITION BY image, label, bin) AS m FROM b)
SELECT image, label, bin, count(*) AS n, round(max(m), 6) AS profile, round(max(abs(v - m)), 6) AS worst FROM m GROUP BY ALL"""


def ag34_chip_means(spark, sf_dir):
    """Mean colours of chips; suppliers stand for chips of a nation's chart."""
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("image"), (F.col("l_suppkey") % 12).alias("mask"), *((F.col("l_partkey") * k % 256).alias(c) for c, k in (("b", 7), ("g", 13), ("r", 29))))
    found = measures.chip_means(cells, ["image"], ["b", "g", "r"])
    return found.select("image", "mask", "n", *(F.round(c, 6).alias(c) for c in ("b", "g", "r")))


AG34_SQL = "SELECT l_orderkey % 3 AS image, l_suppkey % 12 AS mask, count(*) AS n, round(avg(l_partkey * 7 % 256) / 255, 6) AS b, round(avg(l_partkey * 13 % 256) / 255, 6) AS g, round(avg(l_partkey * 29 % 256) / 255, 6) AS r FROM lineitem WHERE l_suppkey % 12 > 0 GROUP BY 1, 2"


def ag31_positive_percentile(spark, sf_dir):
    """The 90 % quantile of positive discounts by flag."""
    return measures.positive_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", 0.9, "q90").withColumn("q90", F.round("q90", 6))


AG31_SQL = "SELECT l_returnflag, round(quantile_cont(l_discount, 0.9), 6) AS q90 FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag"


def ag40_timing_sums(spark, sf_dir):
    found = measures.timing_sums(table(spark, sf_dir, "events").withColumn("seconds", F.when(F.col("event_id") % 7 != 0, F.col("value"))), ["event_type"], "seconds")
    return found.select("event_type", "runs", F.round("seconds", 4).alias("seconds"), F.round("longest", 6).alias("longest"))


AG40_SQL = "SELECT event_type, count(*) AS runs, round(sum(value), 4) AS seconds, round(max(value), 6) AS longest FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL GROUP BY event_type"


def u05_key_differences(spark, sf_dir):
    """Customers of even orders against customers of odd ones."""
    o = table(spark, sf_dir, "orders")
    return measures.key_differences(o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 4 = 1"), ["o_custkey"])


U05_SQL = """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 0), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 1)
SELECT o_custkey, 'missing' AS problem FROM a WHERE o_custkey NOT IN (SELECT * FROM b) UNION ALL SELECT o_custkey, 'unknown' FROM b WHERE o_custkey NOT IN (SELECT * FROM a)"""


def w03_rank_disagreement(spark, sf_dir):
    """Disagreement of the orders of parts by key and by size and price."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", (F.col("p_partkey") % 17).alias("k"))
    return measures.rank_disagreement(parts, [("p_partkey", "p_retailprice"), ("size", "k"), ("k", "p_retailprice")]).withColumn("disagreement", F.round("disagreement", 6))


W03_SQL = """WITH p AS (SELECT p_partkey AS a, p_size AS b, p_retailprice AS c, p_partkey % 17 AS d FROM part), o AS (SELECT a, b, c, d, row_number() OVER (ORDER BY a) AS ra, row_number() OVER (ORDER BY b) AS rb, row_number() OVER (ORDER BY c) AS rc, row_number() OVER (ORDER BY d) AS rd FROM p),
r AS (SELECT avg(ra) OVER (PARTITION BY a) AS ra, avg(rb) OVER (PARTITION BY b) AS rb, avg(rc) OVER (PARTITION BY c) AS rc, avg(rd) OVER (PARTITION BY d) AS rd FROM o) SELECT count(*) AS n, round(1 - (corr(ra, rc) + corr(rb, rd) + corr(rd, rc)) / 3, 6) AS disagreement FROM r"""


def t15_first_best(spark, sf_dir):
    """The first order of each customer that reaches its greatest price (in thousands)."""
    trials = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("score"))
    return measures.first_best(trials, ["o_custkey"], "o_orderkey", "score")


T15_SQL = "SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 100000) AS BIGINT) AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 100000) DESC, o_orderkey) = 1"


def _gated(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        k.alias("sample_id"), (k % 9 != 0).alias("reviewed"), F.when(k % 8 != 0, "a").alias("annotation_author"), F.lit("r1").alias("annotation_revision"), F.when(k % 5 == 0, "development").otherwise("reference_assisted").alias("analysis_mode"),
        F.md5(F.col("text").cast("binary")).alias("source_sha256"), F.when(k % 11 != 0, "p").otherwise(" ").alias("recipe_sha256"), F.when(k % 13 == 0, "unknown").otherwise("targets_excluded_from_all_preprocessing").alias("target_audit"), F.when(k % 17 != 0, "q").alias("references_sha256"),
    )


def q04_evaluation_gate(spark, sf_dir):
    return measures.evaluation_gate(_gated(spark, sf_dir), "reference_assisted")


Q04_SQL = """SELECT doc_id AS sample_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 8 = 0 THEN 'not reviewed and attributed' WHEN doc_id % 5 = 0 THEN 'other preprocessing' WHEN text IS NULL OR doc_id % 11 = 0 THEN 'no provenance' WHEN doc_id % 13 = 0 THEN 'targets may have had influence' WHEN doc_id % 17 = 0 THEN 'no references' END AS problem
FROM documents WHERE problem IS NOT NULL"""


def q05_dataset_identity(spark, sf_dir):
    """Identities of the documents of each language, by id and source."""
    docs = table(spark, sf_dir, "documents")
    parts = [measures.dataset_identity(docs.where(F.col("lang") == lang), "doc_id", ["source"]).withColumn("lang", F.lit(lang)) for lang in ("en", "de")]
    return parts[0].union(parts[1])


Q05_SQL = """WITH d AS (SELECT lang, sha256('{"doc_id":"' || doc_id || '","source":"' || source || '"}') AS h FROM documents WHERE lang IN ('en', 'de')), s AS (SELECT lang, count(*) AS n, CAST(sum(CAST(('0x' || h[1:15])::BIGINT AS HUGEINT)) AS VARCHAR) AS a, CAST(sum(CAST(('0x' || h[16:30])::BIGINT AS HUGEINT)) AS VARCHAR) AS b FROM d GROUP BY lang)
SELECT lang, n AS rows, sha256(n || ':' || a || ':' || b) AS identity FROM s"""


def j18_source_identity(spark, sf_dir):
    """Whether labels and documents of an id are of one source; a third of the labels names another."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.when(k % 3 == 0, "other").when(k % 7 != 0, F.col("source")).alias("source"))
    return measures.mismatched_sources(labels, docs, "doc_id", "source").groupBy("state").agg(F.count("*").alias("n"))


J18_SQL = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'different' WHEN doc_id % 7 = 0 OR source IS NULL THEN 'not recorded' ELSE 'same' END AS state, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def j20_resolve_pins(spark, sf_dir):
    """Pins of customers to versions of their nation's library, by status."""
    k = F.col("c_custkey")
    pins = table(spark, sf_dir, "customer").select(k.alias("project"), F.col("c_nationkey").cast("string").alias("species"), F.when(k % 10 != 0, "main").alias("library"), (k % 4).cast("int").alias("version"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("digest"), F.when(k % 11 == 0, "x").otherwise(F.col("c_nationkey").cast("string")).alias("context_species"), F.when(k % 5 == 0, "v2").otherwise("v1").alias("vocabulary"))
    versions = table(spark, sf_dir, "nation").crossJoin(spark.range(3)).select(F.col("n_nationkey").cast("string").alias("species"), F.lit("main").alias("library"), F.col("id").cast("int").alias("version"), F.when((F.col("n_nationkey") == 3) & (F.col("id") == 1), "e").otherwise(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("digest"), F.lit("v1").alias("vocabulary"), (F.col("id") == 0).alias("retired"))
    return library.resolve(pins, versions).select("project", "status")


J20_SQL = """SELECT c_custkey AS project, CASE WHEN c_custkey % 10 = 0 THEN 'no pin' WHEN c_custkey % 11 = 0 THEN 'other species' WHEN c_custkey % 4 = 3 THEN 'missing' WHEN c_nationkey = 3 AND c_custkey % 4 = 1 THEN 'changed' WHEN c_custkey % 4 = 0 THEN 'retired' WHEN c_custkey % 5 = 0 THEN 'incompatible_trait_vocabulary' ELSE 'compatible' END AS status FROM customer"""


def j06_with_predictions(spark, sf_dir):
    """Orders by what a model said of them: predicted, abstained, not predicted."""
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_tax") > 0.06).alias("abstained"))
    return traits.with_predictions(table(spark, sf_dir, "orders"), said, ["o_orderkey"]).groupBy("o_orderstatus", "trait_state").agg(F.count("*").alias("n"))


J06_SQL = """SELECT o_orderstatus, CASE WHEN a IS NULL THEN 'not_predicted' WHEN a THEN 'abstained' ELSE 'predicted' END AS trait_state, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, max(l_tax) > 0.06 AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY ALL"""

MATRIX, SHIFT = [[1.1, -0.05, 0.02], [0.03, 0.95, 0.01], [-0.02, 0.04, 1.2]], [0.01, -0.02, 0.03]
HOMOGRAPHY = [[1.1, 0.02, 3.0], [-0.03, 0.97, -2.0], [0.0004, 0.0002, 1.0]]


def c35_plane_and_colour(spark, sf_dir):
    """Corrected colours, projected places, star polygons and units of parts."""
    k = F.col("p_partkey")
    b, g, r = k * 7 % 256, k * 13 % 256, k * 29 % 256
    x, y = fm.project(k % 100 + 0.0, F.col("p_size") + 0.0, HOMOGRAPHY)
    rays = F.array(*(((k * m) % 9 + 1.0) for m in (1, 2, 3, 5, 7, 11, 13, 17)))
    from grainframe.functions.evidence import shoelace

    # a row takes far longer than its reading, so rows are dealt to all cores; rays and polygons are made once, not for each use
    rows = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism).withColumn("rays__", rays)
    rays = F.col("rays__")
    rows = rows.withColumn("polygon__", fm.star_polygon(F.lit(3.0), F.lit(4.0), rays))
    parts = fm.with_affine_rgb(rows, {"b": "b", "g": "g", "r": "r"}, (b, g, r), MATRIX, SHIFT)
    return parts.select(
        "p_partkey", *(F.round(n, 5).alias(n) for n in "bgr"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(shoelace(F.col("polygon__")), 5).alias("star"),
        fm.rotated_rays(rays, 1)[0].alias("ray"), F.round(fm.scaled(F.col("p_size") - 2.0, k % 5 + 0.0, True), 6).alias("area"), fm.identifier_problem(F.when(k % 6 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_brand"))).alias("problem"),
        fm.display_name(F.regexp_replace("p_type", " ", "_")).alias("shown"), fm.identity({"name": F.col("p_name"), "size": F.col("p_size")}).alias("identity"),
    )


def _linear(c):
    return f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"


def _encoded(c):
    return f"255 * CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END"


C35_SQL = f"""WITH p AS (SELECT *, p_partkey AS k, p_partkey * 7 % 256 AS bb, p_partkey * 13 % 256 AS gg, p_partkey * 29 % 256 AS rr, p_partkey % 100 AS px FROM part), l AS (SELECT *, {_linear('rr')} AS lr, {_linear('gg')} AS lg, {_linear('bb')} AS lb FROM p),
m AS (SELECT *, 1.1 * lr - 0.05 * lg + 0.02 * lb + 0.01 AS mr, 0.03 * lr + 0.95 * lg + 0.01 * lb - 0.02 AS mg, -0.02 * lr + 0.04 * lg + 1.2 * lb + 0.03 AS mb, 0.0004 * px + 0.0002 * p_size + 1 AS w FROM l), n AS (SELECT *, greatest(1, mr, mg, mb) AS pk FROM m),
o AS (SELECT *, greatest(0, least(1, mr / pk)) AS r1, greatest(0, least(1, mg / pk)) AS g1, greatest(0, least(1, mb / pk)) AS b1, [k * 1 % 9 + 1, k * 2 % 9 + 1, k * 3 % 9 + 1, k * 5 % 9 + 1, k * 7 % 9 + 1, k * 11 % 9 + 1, k * 13 % 9 + 1, k * 17 % 9 + 1] AS ray FROM n)
SELECT p_partkey, round({_encoded('b1')}, 5) AS b, round({_encoded('g1')}, 5) AS g, round({_encoded('r1')}, 5) AS r, round((1.1 * px + 0.02 * p_size + 3) / w, 6) AS x, round((-0.03 * px + 0.97 * p_size - 2) / w, 6) AS y,
  round(sin(pi() / 4) / 2 * list_sum(list_transform(range(1, 9), lambda i: ray[i] * ray[i % 8 + 1])), 5) AS star, CAST(ray[3] AS DOUBLE) AS ray, CASE WHEN p_size >= 2 AND k % 5 > 0 THEN round((p_size - 2) / pow(k % 5, 2), 6) END AS area,
  CASE WHEN k % 6 = 0 THEN 'not trimmed text' WHEN NOT regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9_.:-]{{0,127}}') THEN 'not a stable identifier' END AS problem, upper(p_type[1]) || lower(p_type[2:]) AS shown, sha256('{{"name":"' || p_name || '","size":"' || p_size || '"}}') AS identity FROM o"""


def m11_ranking_score(spark, sf_dir):
    """Score of decoders by segment; four columns of customers stand for metrics."""
    k = F.col("c_custkey")
    score = fm.ranking_score(k % 10 / 10, k % 7 / 7, k % 5 / 5, F.when(k % 3 != 0, k % 4 / 4), k % 6 + 0.0)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(score), 6).alias("score"))


M11_SQL = "SELECT c_mktsegment, round(avg(c_custkey % 10 / 10 + 0.35::DOUBLE * (c_custkey % 7 / 7) + 0.15::DOUBLE * (c_custkey % 5 / 5) - 0.5 * CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 / 4 ELSE c_custkey % 6 END), 6) AS score FROM customer GROUP BY c_mktsegment"

def ag04_median_extent(spark, sf_dir):
    """Median major extent of the labels of each image."""
    return raster.median_extent(_raster(spark, sf_dir), ["image"], "label").withColumn("extent", F.round("extent", 6))


AG04_SQL = f"""WITH {_raster_sql('c0')}, v AS (SELECT image, label, var_pop(y) AS a, var_pop(x) AS b, covar_pop(y, x) AS c FROM c0 GROUP BY ALL), e AS (SELECT image, 4 * sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + pow(c, 2))) AS e FROM v)
SELECT image, count(*) AS labels, round(quantile_cont(e, 0.5), 6) AS extent FROM e GROUP BY image"""


def p02_connected_instances(spark, sf_dir):
    """Orders as instances, reviewed or not, that are connected and not excluded."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed_id"), F.when(F.col("o_orderkey") % 17 == 0, "damaged").when(F.col("o_orderkey") % 5 == 0, " ").alias("shape_exclusion_reason"))
    return traits.connected_instances(orders.select("seed_id"), orders, orders.where("seed_id % 23 = 0"), ["seed_id"])


P02_SQL = "SELECT o_orderkey AS seed_id FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0"


def _banks(spark, sf_dir):
    """Documents of sources of even numbers as one bank, all others as another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("weight"))
    even = F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 2 == 0
    return [docs.where(even), docs.where(~even)]


def u02_merged_banks(spark, sf_dir):
    """Both banks united, weights balanced by source within a language, with the place of each source."""
    found = library.reindexed(library.merged(_banks(spark, sf_dir), "lang", "source", "weight"), "source")
    return found.select("doc_id", "source_index", F.round("balanced", 9).alias("balanced"))


U02_SQL = """WITH d AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS w, dense_rank() OVER (ORDER BY source) - 1 AS source_index FROM documents WHERE regexp_extract(source, '([0-9]+)', 1) <> ''), n AS (SELECT lang, count(DISTINCT source) AS n FROM d GROUP BY lang), s AS (SELECT lang, source, sum(w) AS s FROM d GROUP BY ALL)
SELECT doc_id, source_index, round(w / s / n, 9) AS balanced FROM d JOIN n USING (lang) JOIN s USING (lang, source)"""


def u04_repeated_sources(spark, sf_dir):
    """Sources that a third bank repeats, and in how many banks they are."""
    banks = _banks(spark, sf_dir)
    return library.repeated_sources([*banks, banks[0].where("lang = 'en'"), banks[1].where("doc_id % 2 = 0")], "source")


U04_SQL = """WITH d AS (SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 = 0 AS even FROM documents WHERE regexp_extract(source, '([0-9]+)', 1) <> ''), b AS (SELECT source, 0 AS k FROM d UNION SELECT source, 1 FROM d WHERE even AND lang = 'en' UNION SELECT source, 2 FROM d WHERE NOT even AND doc_id % 2 = 0)
SELECT source, count(*) AS banks FROM b GROUP BY source HAVING count(*) > 1"""


def c32_identifier_problem(spark, sf_dir):
    """Why texts, addresses, names and sources are no stable identifiers, and how many are or aren't."""
    names = [("documents", "source"), ("documents", "text"), ("pages", "url"), ("customer", "c_name"), ("orders", "o_orderpriority")]
    texts = [table(spark, sf_dir, t).select(F.lit(c).alias("column"), F.col(c).alias("value")) for t, c in names]
    every = texts[0]
    for more in texts[1:]:
        every = every.union(more)
    return every.groupBy("column", fm.identifier_problem(F.col("value")).alias("problem")).agg(F.count("*").alias("n"))


C32_SQL = """WITH t AS (SELECT 'source' AS "column", source AS v FROM documents UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT "column", CASE WHEN v IS NULL OR v = '' OR trim(v) <> v THEN 'not trimmed text' WHEN length(v) > 4096 THEN 'too long' WHEN contains(v, chr(0)) THEN 'holds a NUL' WHEN NOT regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$') THEN 'not a stable identifier' END AS problem, count(*) AS n FROM t GROUP BY ALL"""


def o02_other_values(spark, sf_dir):
    """What else to try for the status and the priority of an order, and for whether it is a large one."""
    o = table(spark, sf_dir, "orders")
    tried = [evidence.other_values(F.col("o_orderstatus"), ["F", "O", "P"]), evidence.other_values(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), evidence.other_values(F.col("o_totalprice") > 100000, [False, True])]
    return o.select("o_orderkey", *(F.concat_ws(",", c.cast("array<string>")).alias(n) for c, n in zip(tried, ("status", "priority", "large"))))


O02V_SQL = """SELECT o_orderkey, array_to_string(list_filter(['F', 'O', 'P'], lambda v: v IS DISTINCT FROM o_orderstatus), ',') AS status, array_to_string(list_filter(['1-URGENT', '2-HIGH'], lambda v: v IS DISTINCT FROM o_orderpriority), ',') AS priority, CASE WHEN o_totalprice > 100000 THEN 'false' ELSE 'true' END AS large FROM orders"""

QUERIES = {
    "ag04_median_extent": (ag04_median_extent, AG04_SQL),
    "p02_connected_instances": (p02_connected_instances, P02_SQL),
    "u02_merged_banks": (u02_merged_banks, U02_SQL),
    "u04_repeated_sources": (u04_repeated_sources, U04_SQL),
    "c32_identifier_problem": (c32_identifier_problem, C32_SQL),
    "o02_other_values": (o02_other_values, O02V_SQL),
    "j02_overlap_above": (j02_overlap_above, J02_SQL),
    "j06_with_predictions": (j06_with_predictions, J06_SQL),
    "j18_source_identity": (j18_source_identity, J18_SQL),
    "j20_resolve_pins": (j20_resolve_pins, J20_SQL),
    "t02_thinned": (t02_thinned, T02_SQL),
    "t15_first_best": (t15_first_best, T15_SQL),
    "u05_key_differences": (u05_key_differences, U05_SQL),
    "w03_rank_disagreement": (w03_rank_disagreement, W03_SQL),
    "w10_local_maxima": (w10_local_maxima, W10_SQL),
    "ag31_positive_percentile": (ag31_positive_percentile, AG31_SQL),
    "ag32_radial_profile": (ag32_radial_profile, AG32_SQL),
    "ag34_chip_means": (ag34_chip_means, AG34_SQL),
    "ag40_timing_sums": (ag40_timing_sums, AG40_SQL),
    "c35_plane_and_colour": (c35_plane_and_colour, C35_SQL),
    "m11_ranking_score": (m11_ranking_score, M11_SQL),
    "q04_evaluation_gate": (q04_evaluation_gate, Q04_SQL),
    "q05_dataset_identity": (q05_dataset_identity, Q05_SQL),
}
