"""Queries on audits of manifests, and on the grouped comparison of methods. Documents stand for samples of a study."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.operators import audits, comparison
from grainframe.sources.tables import table


def _samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit("available").alias("truth_state"))
    k = F.col("doc_id")
    null = F.lit(None).cast("string")
    role = F.when(k % 3 == 0, "development").when(k % 3 == 1, "validation").otherwise("locked_test")
    lot = F.when(k % 10 != 0, F.concat_ws("/", "source", "lang", F.floor(k / 6).cast("string")))
    return d.join(labelled, "doc_id", "left").select(
        k.alias("sample_id"), F.md5(F.col("text").cast("binary")).alias("source_sha256"), role.alias("split_role"), F.coalesce("truth_state", F.lit("unavailable")).alias("truth_state"),
        lot.alias("biological_lot_id"), null.alias("specimen_group_id"), null.alias("physical_specimen_id"),
        F.when(k % 7 != 0, F.concat(F.lit("c"), F.floor(k / 4).cast("string"))).alias("capture_session_id"), null.alias("capture_group_id"),
    )


SAMPLES_SQL = """samples AS (SELECT doc_id AS id, md5(text) AS src, CASE doc_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'validation' ELSE 'locked_test' END AS role, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'available' ELSE 'unavailable' END AS truth,
  CASE WHEN doc_id % 10 <> 0 THEN concat_ws('/', source, lang, CAST(doc_id // 6 AS VARCHAR)) END AS lot, CASE WHEN doc_id % 7 <> 0 THEN 'c' || (doc_id // 4) END AS capture FROM documents),
keyed AS (SELECT id, 'biological_lot_id' AS kind, lot AS v FROM samples WHERE lot IS NOT NULL UNION ALL SELECT id, 'capture_session_id', capture FROM samples WHERE capture IS NOT NULL),
wide AS (SELECT * FROM keyed UNION ALL SELECT id, 'source_sha256', src FROM samples WHERE src IS NOT NULL)"""


def _closure_sql(name, keys):
    return f"""{name}_e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM {keys} x JOIN {keys} y USING (kind, v)), {name}_r AS (SELECT id AS a, id AS b FROM samples UNION SELECT r.a, e.b FROM {name}_r r JOIN {name}_e e ON r.b = e.a),
{name} AS (SELECT a AS id, min(b) AS comp FROM {name}_r GROUP BY a), {name}_k AS (SELECT DISTINCT comp, kind FROM (SELECT kind, v, min(comp) AS comp FROM {keys} JOIN {name} USING (id) GROUP BY kind, v HAVING count(*) > 1))"""


def q01_leakage_audit(spark, sf_dir):
    """Findings against an evaluation on the third of documents that is locked; flagged labels stand for accesses."""
    access = table(spark, sf_dir, "labels").where("quality = 0 AND doc_id % 5 <> 1").select((F.col("doc_id") % 17).alias("access_id"), F.col("doc_id").alias("sample_id"))
    return audits.leakage_audit(_samples(spark, sf_dir), access, access_log_complete=False)


Q01_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, {_closure_sql('grp', 'keyed')}, {_closure_sql('acc', 'wide')},
touched AS (SELECT DISTINCT doc_id % 17 AS access_id, id, role, comp FROM labels JOIN samples ON id = doc_id JOIN acc USING (id) WHERE quality = 0 AND doc_id % 5 <> 1 AND comp IN (SELECT comp FROM acc JOIN samples USING (id) WHERE role = 'locked_test')),
how AS (SELECT access_id, kind FROM touched JOIN acc_k USING (comp) UNION SELECT access_id, 'direct_locked_test_sample' FROM touched WHERE role = 'locked_test'),
u AS (SELECT 'no_locked_test_samples' AS code, '' AS key, 0 AS n_ids, '' AS roles, '' AS kinds WHERE NOT EXISTS (SELECT 1 FROM samples WHERE role = 'locked_test')
UNION ALL SELECT 'access_log_incomplete', '', 0, '', ''
UNION ALL SELECT 'biological_group_missing', '', count(*), '', '' FROM samples WHERE lot IS NULL HAVING count(*) > 0
UNION ALL SELECT 'capture_group_missing', '', count(*), '', '' FROM samples WHERE capture IS NULL HAVING count(*) > 0
UNION ALL SELECT 'locked_test_truth_unavailable', '', count(*), 'locked_test', '' FROM samples WHERE role = 'locked_test' AND truth <> 'available' HAVING count(*) > 0
UNION ALL SELECT 'source_content_crosses_splits', src, count(*), string_agg(DISTINCT role, ',' ORDER BY role), '' FROM samples GROUP BY src HAVING count(*) > 1 AND count(DISTINCT role) > 1
UNION ALL SELECT 'related_groups_cross_splits', CAST(comp AS VARCHAR), count(*), string_agg(DISTINCT role, ',' ORDER BY role), coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM grp_k WHERE grp_k.comp = grp.comp), '') FROM samples JOIN grp USING (id) GROUP BY comp HAVING count(*) > 1 AND count(DISTINCT role) > 1
UNION ALL SELECT 'locked_test_access_recorded', CAST(access_id AS VARCHAR), count(DISTINCT id), (SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT role AS r FROM touched i WHERE i.access_id = t.access_id UNION SELECT 'locked_test')), coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM how WHERE how.access_id = t.access_id), '') FROM touched t GROUP BY access_id)
SELECT code, key, CAST(n_ids AS BIGINT) AS n_ids, roles, kinds FROM u"""


def ag38_manifest_counts(spark, sf_dir):
    return audits.manifest_counts(_samples(spark, sf_dir))


AG38_SQL = f"WITH {SAMPLES_SQL} SELECT role AS split_role, count(*) AS n, count(*) FILTER (truth = 'available') AS truth_available, count(*) FILTER (truth = 'unavailable') AS truth_unavailable FROM samples GROUP BY role"


def t12_bounded_findings(spark, sf_dir):
    """The first seven documents of each source and language, and how many more there are."""
    found = audits.bounded_ids(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", 7)
    return found.select("lang", "source", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "omitted")


T12_SQL = """SELECT lang, source, array_to_string(list_sort(list(DISTINCT doc_id))[1:7], ',') AS ids, CAST(greatest(0, count(DISTINCT doc_id) - 7) AS INTEGER) AS omitted FROM documents GROUP BY lang, source"""


def t13_first_ids(spark, sf_dir):
    """The first thirty ids of all sources' lists."""
    return audits.first_ids(table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "source"), [F.col("doc_id")], 30)


T13_SQL = "SELECT doc_id, source FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 30"


def q03_dataset_audit(spark, sf_dir):
    """Errors and warnings of documents taken as a learning dataset."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    k = F.col("doc_id")
    split = F.when(k % 41 == 0, "holdout").when(k % 5 == 0, "test").when(k % 5 == 1, "validation").otherwise("train")
    some = lambda rule: F.when(rule, "path").otherwise("")
    return audits.dataset_audit(d.select(
        F.concat(F.lit("s"), (k - F.when(k % 97 == 1, 1).otherwise(0)).cast("string")).alias("identifier"), F.when(k % 53 == 0, " ").otherwise(F.concat_ws("/", "source", (k / 8).cast("int").cast("string"))).alias("group"), split.alias("split"), F.col("lang").alias("species"),
        F.col("quality").isNotNull().alias("reviewed"), F.when(F.col("quality") == 1, "reviewer").alias("annotation_author"), F.md5(F.col("text").cast("binary")).alias("source_sha256"), F.md5(F.substring("text", 1, 30).cast("binary")).alias("feature_sha256"),
        some(k % 11 == 0).alias("pattern_boundary"), some(k % 22 == 0).alias("pattern_valid"), some(k % 13 == 0).alias("physical_boundary"), some(k % 26 == 0).alias("physical_valid"),
    ))


Q03_SQL = """WITH s AS (SELECT 's' || (doc_id - CASE WHEN doc_id % 97 = 1 THEN 1 ELSE 0 END) AS identifier, CASE WHEN doc_id % 53 = 0 THEN ' ' ELSE concat_ws('/', source, CAST(doc_id // 8 AS VARCHAR)) END AS grp, CASE WHEN doc_id % 41 = 0 THEN 'holdout' WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'validation' ELSE 'train' END AS split, lang,
  quality IS NOT NULL AS reviewed, quality, md5(text) AS src, md5(substring(text, 1, 30)) AS feat, doc_id AS k FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'duplicate_identifier' AS code, identifier AS key, count(*) AS n FROM s GROUP BY identifier HAVING count(*) > 1
UNION ALL SELECT 'invalid_split', identifier, count(*) FROM s WHERE split = 'holdout' GROUP BY identifier UNION ALL SELECT 'missing_group', identifier, count(*) FROM s WHERE trim(grp) = '' GROUP BY identifier
UNION ALL SELECT 'group_crosses_splits', grp, count(DISTINCT split) FROM s GROUP BY grp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'source_crosses_splits', src, count(DISTINCT split) FROM s WHERE src IS NOT NULL GROUP BY src HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'features_cross_splits', feat, count(DISTINCT split) FROM s WHERE feat IS NOT NULL GROUP BY feat HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'conflicting_species', src, count(DISTINCT lang) FROM s WHERE src IS NOT NULL GROUP BY src HAVING count(DISTINCT lang) > 1
UNION ALL SELECT 'pattern_without_validity', identifier, count(*) FROM s WHERE k % 11 = 0 AND k % 22 <> 0 GROUP BY identifier UNION ALL SELECT 'physical_paths_unpaired', identifier, count(*) FROM s WHERE (k % 13 = 0) <> (k % 26 = 0) GROUP BY identifier
UNION ALL SELECT 'warn_reviewed_without_author', identifier, count(*) FROM s WHERE reviewed AND quality IS DISTINCT FROM 1 GROUP BY identifier UNION ALL SELECT 'warn_unreviewed', '', count(*) FROM s WHERE NOT reviewed HAVING count(*) > 0"""


def _cells(spark, sf_dir):
    """Orders as records of two methods on customers; a method's value is the share of an order's price."""
    o = table(spark, sf_dir, "orders")
    method = F.when(F.col("o_orderkey") % 2 == 0, "reference").otherwise("candidate")
    records = o.groupBy(F.col("o_custkey").alias("sample_id"), method.alias("method")).agg(F.round(F.max("o_totalprice") / 500000, 6).alias("value"), F.max("o_orderkey").alias("k"))
    status = F.when(F.col("k") % 13 == 0, "failed").when(F.col("k") % 17 == 0, "abstained").otherwise("available")
    records = records.withColumn("status", status).withColumn("value", F.when(F.col("status") == "available", F.col("value")))
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("group"))
    return comparison.planned_cells(samples, ["reference", "candidate"], records)


CELLS_SQL = """records AS (SELECT o_custkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN 'reference' ELSE 'candidate' END AS method, round(max(o_totalprice) / 500000, 6) AS v, max(o_orderkey) AS k FROM orders GROUP BY ALL),
rec AS (SELECT sample_id, method, CASE WHEN k % 13 = 0 THEN 'failed' WHEN k % 17 = 0 THEN 'abstained' ELSE 'available' END AS status, v FROM records),
cells AS (SELECT c_custkey AS sample_id, c_mktsegment AS stratum, c_nationkey AS grp, m.method, coalesce(status, 'not_recorded') AS status, CASE WHEN status = 'available' THEN v END AS value FROM customer CROSS JOIN (SELECT unnest(['reference', 'candidate']) AS method) m LEFT JOIN rec ON rec.sample_id = c_custkey AND rec.method = m.method)"""


def j03_planned_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("sample_id", "method", "status", F.round("value", 6).alias("value"))


J03_SQL = f"WITH {CELLS_SQL} SELECT sample_id, method, status, round(value, 6) AS value FROM cells"


def ag26_outcome_counts(spark, sf_dir):
    return comparison.outcome_counts(_cells(spark, sf_dir), ["stratum", "method"])


AG26_SQL = f"""WITH {CELLS_SQL} SELECT stratum, method, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in comparison.STATES)} FROM cells GROUP BY stratum, method"""


def j04_paired(spark, sf_dir):
    found = comparison.paired(_cells(spark, sf_dir), "reference", "candidate", ["stratum", "group"])
    return found.select("sample_id", "stratum", F.col("group").alias("grp"), F.round("reference", 6).alias("reference"), F.round("candidate", 6).alias("candidate"))


PAIRED_SQL = "pairs AS (SELECT sample_id, a.stratum, a.grp, a.value AS reference, b.value AS candidate FROM cells a JOIN cells b USING (sample_id) WHERE a.method = 'reference' AND b.method = 'candidate' AND a.value IS NOT NULL AND b.value IS NOT NULL)"
J04_SQL = f"WITH {CELLS_SQL}, {PAIRED_SQL} SELECT sample_id, stratum, grp, round(reference, 6) AS reference, round(candidate, 6) AS candidate FROM pairs"


def q02_paired_bootstrap(spark, sf_dir):
    """Bounds of the candidate's loss by segment over nations as groups, with draws that both engines can make."""
    cells = _cells(spark, sf_dir)
    pairs = comparison.paired(cells, "reference", "candidate", ["stratum", "group"])
    groups = comparison.group_means(pairs, ["stratum"], "group")
    sizes = groups.groupBy("stratum").agg(F.count("*").alias("g"))
    slots = sizes.crossJoin(spark.range(200).withColumnRenamed("id", "rep")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    draw = slots.select("stratum", "rep", "slot", ((F.col("rep") * 7919 + F.col("slot") * 104729 + F.col("rep") * F.col("slot") * 31) % F.col("g")).alias("ordinal"))
    bounds = comparison.bootstrap_bounds(groups, ["stratum"], "group", draw, "higher", weighted=True)
    coverage = groups.groupBy("stratum").agg(F.count("*").alias("groups"), F.sum("n").alias("pairs")).join(cells.groupBy("stratum").agg(F.count_distinct("sample_id").alias("total")), "stratum")
    found = comparison.verdicts(bounds, coverage, ["stratum"], 0.02, 5, 0.5)
    return found.select("stratum", "groups", "pairs", "total", *(F.round(c, 6).alias(c) for c in ("reference", "candidate", "difference", "bound")), "blockers", "state")


Q02_SQL = f"""WITH {CELLS_SQL}, {PAIRED_SQL}, g AS (SELECT stratum, grp, avg(reference) AS r, avg(candidate) AS c, count(*) AS n, row_number() OVER (PARTITION BY stratum ORDER BY grp) - 1 AS ord FROM pairs GROUP BY stratum, grp), z AS (SELECT stratum, count(*) AS g, sum(n) AS pairs, sum(r * n) / sum(n) AS r, sum(c * n) / sum(n) AS c FROM g GROUP BY stratum),
dr AS (SELECT stratum, rep, (rep * 7919 + slot * 104729 + rep * slot * 31) % z.g AS ord FROM z, range(200) a(rep), range(1000) b(slot) WHERE slot < z.g), de AS (SELECT dr.stratum, rep, sum(c * n) / sum(n) - sum(r * n) / sum(n) AS delta FROM dr JOIN g ON g.stratum = dr.stratum AND g.ord = dr.ord GROUP BY dr.stratum, rep),
b AS (SELECT stratum, quantile_cont(delta, 0.05) AS bound FROM de GROUP BY stratum), t AS (SELECT stratum, count(DISTINCT sample_id) AS total FROM cells GROUP BY stratum),
f AS (SELECT *, g < 5 AS few, pairs / total < 0.5 AS thin FROM z JOIN b USING (stratum) JOIN t USING (stratum))
SELECT stratum, g AS groups, CAST(pairs AS BIGINT) AS pairs, total, round(r, 6) AS reference, round(c, 6) AS candidate, round(c - r, 6) AS difference, round(bound, 6) AS bound, concat_ws(',', CASE WHEN few THEN 'insufficient_paired_groups' END, CASE WHEN thin THEN 'insufficient_paired_coverage' END) AS blockers,
  CASE WHEN few OR thin THEN 'inconclusive' WHEN bound >= -0.02 THEN 'pass' ELSE 'fail' END AS state FROM f"""


def ag21_arm_spread(spark, sf_dir):
    """Mean and spread of runs by arm; customers stand for runs of a segment's arm."""
    runs = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0 OR c_mktsegment <> 'BUILDING'")
    found = comparison.arm_spread(runs, ["c_nationkey", "c_mktsegment"], "c_acctbal")
    return found.select("c_nationkey", "c_mktsegment", "n", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


AG21_SQL = "SELECT c_nationkey, c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS spread FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment <> 'BUILDING' GROUP BY ALL"


def m12_adoption(spark, sf_dir):
    """Whether one segment's mean holds against another's within their spread, by nation."""
    found = comparison.arm_spread(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")
    side = lambda s: found.where(F.col("c_mktsegment") == s)
    return comparison.adoption(side("BUILDING"), side("MACHINERY"), ["c_nationkey"]).withColumn("margin", F.round("margin", 4))


M12_SQL = """WITH a AS (SELECT c_nationkey, c_mktsegment AS s, avg(c_acctbal) AS m, coalesce(stddev_samp(c_acctbal), 0) AS d FROM customer GROUP BY ALL)
SELECT x.c_nationkey, round(greatest(x.d, y.d), 4) AS margin, x.m >= y.m - greatest(x.d, y.d) AS adopt FROM a x JOIN a y ON x.c_nationkey = y.c_nationkey AND x.s = 'BUILDING' AND y.s = 'MACHINERY'"""


def w11_best_epoch(spark, sf_dir):
    """The order of least price of each customer, the first of equal ones."""
    found = comparison.best_epoch(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return found.withColumn("o_totalprice", F.round("o_totalprice", 4))


W11_SQL = "SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1"

QUERIES = {
    "q01_leakage_audit": (q01_leakage_audit, Q01_SQL),
    "q02_paired_bootstrap": (q02_paired_bootstrap, Q02_SQL),
    "q03_dataset_audit": (q03_dataset_audit, Q03_SQL),
    "ag38_manifest_counts": (ag38_manifest_counts, AG38_SQL),
    "t12_bounded_findings": (t12_bounded_findings, T12_SQL),
    "t13_first_ids": (t13_first_ids, T13_SQL),
    "j03_planned_cells": (j03_planned_cells, J03_SQL),
    "j04_paired": (j04_paired, J04_SQL),
    "ag26_outcome_counts": (ag26_outcome_counts, AG26_SQL),
    "ag21_arm_spread": (ag21_arm_spread, AG21_SQL),
    "m12_adoption": (m12_adoption, M12_SQL),
    "w11_best_epoch": (w11_best_epoch, W11_SQL),
}
