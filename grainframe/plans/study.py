"""Queries on joins, selection, audits and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainframe.functions import evidence
from grainframe.operators import audits, components, joins, ordered, suppression, traits, vectors
from grainframe.sources.tables import table
from grainframe.streaming import outcomes


def _points(spark, sf_dir):
    """Customers as points of a plane for each nation, with radii of 2 to 6."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") % 300, 2).alias("x"), (F.col("c_custkey") % 211).cast("double").alias("y"), (F.col("c_custkey") % 5 + 2).cast("double").alias("radius"), F.round(F.col("c_acctbal") / 100, 3).alias("score"))


POINTS_SQL = "points AS (SELECT c_nationkey AS image, c_custkey AS id, round(c_acctbal % 300, 2) AS x, CAST(c_custkey % 211 AS DOUBLE) AS y, CAST(c_custkey % 5 + 2 AS DOUBLE) AS radius, round(c_acctbal / 100, 3) AS score FROM customer)"


def j08_contact_pairs(spark, sf_dir):
    """Points of an image that touch: apart by at most their radii together times 1.5."""
    found = suppression.contact_pairs(_points(spark, sf_dir), ["image"], "id", "x", "y", "radius", 1.5, 6.0)
    return found.withColumn("confidence", F.round("confidence", 6))


J08_SQL = f"""WITH {POINTS_SQL} SELECT a.image, a.id AS a, b.id AS b, round(1 - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / ((a.radius + b.radius) * 1.5), 6) AS confidence FROM points a JOIN points b ON a.image = b.image AND a.id < b.id
WHERE (a.x <> b.x OR a.y <> b.y) AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= (a.radius + b.radius) * 1.5"""


def t03_greedy_suppression(spark, sf_dir):
    """Points that remain when each, by falling score, takes out those nearer than 12."""
    return suppression.suppress_near(_points(spark, sf_dir), ["image"], "id", "x", "y", "score", 12.0).select("image", "id")


# One pass by falling score: a point is out if a kept one before it is near.
T03_SQL = f"""WITH RECURSIVE {POINTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS k FROM points),
r AS (SELECT image, k, [{{'i': id, 'x': x, 'y': y}}] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.image, o.k, CASE WHEN len(list_filter(kept, lambda p: sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) < 12)) = 0 THEN list_append(kept, {{'i': o.id, 'x': o.x, 'y': o.y}}) ELSE kept END FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1),
f AS (SELECT image, arg_max(kept, k) AS kept FROM r GROUP BY image) SELECT image, unnest(kept).i AS id FROM f"""


def p08_circle_support(spark, sf_dir):
    """Points with a supplier of their nation within 40: the nearest one and its distance."""
    peaks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image"), F.col("s_suppkey").alias("peak"), F.round(F.col("s_acctbal") % 300, 2).alias("x"), (F.col("s_suppkey") * 7 % 211).cast("double").alias("y"))
    found = suppression.nearest_point(_points(spark, sf_dir), peaks, ["image"], "id", "peak", "x", "y", 40.0)
    return found.where("near_id IS NOT NULL").select("id", "near_id", F.round("distance", 6).alias("distance"))


P08_SQL = f"""WITH {POINTS_SQL}, peaks AS (SELECT s_nationkey AS image, s_suppkey AS peak, round(s_acctbal % 300, 2) AS x, CAST(s_suppkey * 7 % 211 AS DOUBLE) AS y FROM supplier),
d AS (SELECT id, peak, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM points p JOIN peaks q USING (image)) SELECT id, peak AS near_id, round(d, 6) AS distance FROM d WHERE d <= 40 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, peak) = 1"""


def j09_nearest(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return joins.nearest(customers, suppliers, "nation", "balance", "s_suppkey").select("c_custkey", "near_id", F.round("distance", 4).alias("distance"))


J09_SQL = """SELECT c_custkey, s_suppkey AS near_id, round(abs(c_acctbal - s_acctbal), 4) AS distance FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) = 1"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def tr03_softmax_abstain(spark, sf_dir):
    """Class of each vector by its distance to the class means; it abstains below a probability of 0.2."""
    rows = _vectors(spark, sf_dir)
    bank = vectors.centroids(rows, ["label"], "e").withColumnRenamed("label", "class")
    found = vectors.predict_nearest(rows, "vec_id", "e", bank, 0.2)
    return found.select("vec_id", "predicted", F.round("confidence", 6).alias("probability"), F.round("entropy", 6).alias("entropy"), "reason")


TR03_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS l, i, avg(v) AS m FROM e GROUP BY ALL),
d AS (SELECT vec_id, l, -sum((v - m) * (v - m)) AS z FROM e JOIN c USING (i) GROUP BY ALL), x AS (SELECT vec_id, l, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM d), p AS (SELECT vec_id, l, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM x)
SELECT vec_id, CASE WHEN max(p) >= 0.2 THEN arg_max(l, p) END AS predicted, round(max(p), 6) AS probability, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, CASE WHEN max(p) < 0.2 THEN 'confidence_below_threshold' END AS reason FROM p GROUP BY vec_id"""


def j16_disjoint_splits(spark, sf_dir):
    """Identities (text, source, and text whatever its white space) that rows of the held-out third share with the others."""
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), F.concat_ws("/", "source", "lang").alias("lot"), F.md5(F.regexp_replace("text", r"[ \t-\r]+", " ").cast("binary")).alias("words_md5"), (F.col("doc_id") % 3).alias("split"))
    return audits.held_out_overlap(docs.where("split <> 2"), docs.where("split = 2"), ["text_md5", "lot", "words_md5"])


J16_SQL = """WITH d AS (SELECT md5(text) AS a, concat_ws('/', source, lang) AS b, md5(regexp_replace(text, '[ \t-\r]+', ' ', 'g')) AS c, doc_id % 3 AS split FROM documents),
l AS (SELECT unnest(['text_md5', 'lot', 'words_md5']) AS identity, unnest([a, b, c]) AS value, split = 2 AS held FROM d)
SELECT identity, value, count(*) FILTER (NOT held) AS n_left, count(*) FILTER (held) AS n_right FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING n_left > 0 AND n_right > 0"""


def g03_independent_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return components.independent_groups(docs, "doc_id", {"text": F.md5(F.col("text").cast("binary")), "lot": F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 10).cast("string"))})


GROUPS_SQL = """k AS (SELECT doc_id, 't' || md5(text) AS key FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, 's' || concat_ws('/', source, CAST(doc_id // 10 AS VARCHAR)) FROM documents),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (key)), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a)"""
G03_SQL = f"WITH RECURSIVE {GROUPS_SQL} SELECT * FROM g"


def g03_group_digests(spark, sf_dir):
    """Identity of each group of several: SHA-256 of its sorted members."""
    found = g03_independent_groups(spark, sf_dir)
    return components.group_digests(found, "component", "doc_id").where("members > 1")


G03D_SQL = f"""WITH RECURSIVE {GROUPS_SQL} SELECT component, count(*) AS members, sha256('["' || string_agg(CAST(doc_id AS VARCHAR), '","' ORDER BY CAST(doc_id AS VARCHAR)) || '"]') AS digest FROM g GROUP BY component HAVING count(*) > 1"""


def g06_downstream(spark, sf_dir):
    """Nations reachable along edges n -> 2n + 1 and n -> 3n modulo 25 from the first nation of each region."""
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("source"), F.explode(F.array((F.col("n_nationkey") * 2 + 1) % 25, F.col("n_nationkey") * 3 % 25)).alias("target")).where("source % 4 <> 3")
    starts = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("start")).select("start")
    return components.closure(edges, starts)


G06_SQL = """WITH RECURSIVE e AS (SELECT n_nationkey AS s, unnest([(n_nationkey * 2 + 1) % 25, n_nationkey * 3 % 25]) AS t FROM nation WHERE n_nationkey % 4 <> 3),
r AS (SELECT min(n_nationkey) AS start, min(n_nationkey) AS node FROM nation GROUP BY n_regionkey UNION SELECT r.start, e.t FROM r JOIN e ON r.node = e.s) SELECT start, node FROM r"""


def w04_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
    return last.select("user_id", "event_type", F.col("last.event_id").alias("event_id"), F.round("last.value", 6).alias("value"))


W04_SQL = "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def w07_longest_run(spark, sf_dir):
    """Longest run of a user's consecutive events of one type."""
    return ordered.longest_runs(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


W07_SQL = """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) AS runs FROM c GROUP BY user_id"""


def w12_coalesce_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_type")).alias("outcome_revision"), F.floor(F.col("value") / 50).cast("string").alias("payload"))
    return outcomes.coalesce_outcomes(rows)


W12_SQL = """SELECT user_id || '-' || event_type AS outcome_revision, CASE WHEN count(DISTINCT p) = 1 AND count(p) = count(*) THEN min(p) END AS payload, count(*) AS copies, count(DISTINCT p) > 1 OR (count(p) > 0 AND count(p) < count(*)) AS withheld
FROM (SELECT *, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS p FROM events) GROUP BY 1"""


def i14_method_priority(spark, sf_dir):
    """First available method of each customer: by status O, F, P, then the latest order."""
    found = traits.method_priority(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["O", "F", "P"], -F.col("o_orderkey"))
    return found.select("o_custkey", "priority", (-F.col("tie")).alias("o_orderkey"))


I14_SQL = """SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS priority, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderkey DESC) = 1"""


def _seeds(spark, sf_dir):
    """Orders as annotated seeds: conditions from priorities and flags, review facts from keys."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    conditions = F.array_compact(F.array(F.when(k % 5 == 0, "cracked"), F.when(k % 7 == 0, "mouldy")))
    return o.select(
        (F.col("o_custkey") % 20).alias("image"), k.alias("seed_id"), conditions.alias("conditions"), (k % 3 != 0).alias("conditions_reviewed"), (k % 11 != 0).alias("shape_reviewed"),
        F.when(k % 13 == 0, "partial").otherwise("complete").alias("outline_visibility"), F.when(k % 17 == 0, "touching").otherwise("").alias("shape_exclusion_reason"), (k % 19 == 0).alias("touches_edge"),
        F.element_at(F.array(*(F.lit(p) for p in ("flat", "side", "oblique", "unset"))), (k % 4 + 1).cast("int")).alias("pose"),
    )


SEEDS_SQL = """seeds AS (SELECT o_custkey % 20 AS image, o_orderkey AS seed_id, o_orderkey % 5 = 0 AS cracked, o_orderkey % 3 <> 0 AS reviewed, ['flat', 'side', 'oblique', 'unset'][o_orderkey % 4 + 1] AS pose,
  CASE WHEN o_orderkey % 11 = 0 THEN 'outline or pose not set' WHEN o_orderkey % 13 = 0 THEN 'outline not complete' WHEN o_orderkey % 17 = 0 THEN 'excluded from modelling' WHEN o_orderkey % 19 = 0 THEN 'touches the image edge' END AS exclusion FROM orders),
labelled AS (SELECT *, CASE WHEN cracked THEN 'cracked' WHEN reviewed THEN 'not_cracked' END AS label FROM seeds)"""


def p05_trait_label(spark, sf_dir):
    """Seeds by image, class and reason not to use them."""
    return traits.class_counts(_seeds(spark, sf_dir), traits.condition_label("cracked"), ["image"])


P05_SQL = f"WITH {SEEDS_SQL} SELECT image, label, exclusion, count(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY ALL"


def ag25_split_counts(spark, sf_dir):
    """Usable seeds by split and class."""
    counts = traits.class_counts(_seeds(spark, sf_dir), traits.condition_label("cracked"), ["image"])
    splits = spark.range(20).select(F.col("id").alias("image"), F.when(F.col("id") % 4 == 0, "calibration").when(F.col("id") % 9 != 1, "train").alias("split")).where("split IS NOT NULL")
    return traits.split_counts(counts, splits, ["image"])


AG25_SQL = f"""WITH {SEEDS_SQL}, s AS (SELECT i AS image, CASE WHEN i % 4 = 0 THEN 'calibration' WHEN i % 9 <> 1 THEN 'train' END AS split FROM range(20) r(i))
SELECT split, label, count(*) AS n FROM labelled JOIN s USING (image) WHERE split IS NOT NULL AND label IS NOT NULL AND exclusion IS NULL GROUP BY ALL"""


def p17_evidence_problem(spark, sf_dir):
    return traits.evidence_problem(ag25_split_counts(spark, sf_dir))


P17_SQL = f"""WITH c AS ({AG25_SQL}), l AS (SELECT label, coalesce(sum(n) FILTER (split = 'train'), 0) AS t, coalesce(sum(n) FILTER (split = 'calibration'), 0) AS k FROM c GROUP BY label), s AS (SELECT count(*) AS classes, count(*) FILTER (t > 0) AS in_training, count(*) FILTER (k > 0) AS in_calibration FROM l)
SELECT *, CASE WHEN classes = 0 THEN 'no usable seeds' WHEN classes < 2 THEN 'only one class' WHEN in_training < classes THEN 'a class has no training seeds' WHEN in_calibration = 0 THEN 'no calibration seeds' END AS problem FROM s"""


def p01_shape_eligible(spark, sf_dir):
    """Why seeds are not for the shape model, and how many are; disconnected ones are taken out before."""
    seeds = _seeds(spark, sf_dir)
    broken = seeds.where("seed_id % 23 = 0").select("seed_id")
    kept = traits.connected_instances(seeds, seeds, broken, ["seed_id"])
    good = traits.eligible_instances(seeds, broken, ["seed_id"]).select("seed_id", F.lit(True).alias("eligible"))
    found = kept.join(good, "seed_id", "left").withColumn("reason", traits.shape_exclusion())
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.count("eligible").alias("eligible"))


P01_SQL = """WITH s AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'shape reference not reviewed' WHEN o_orderkey % 13 = 0 THEN 'outline visibility is partial' WHEN o_orderkey % 4 = 3 THEN 'pose is not explicitly reviewed' END AS reason FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 17 <> 0)
SELECT reason, count(*) AS n, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS eligible FROM s GROUP BY reason"""


def j07_effective_annotations(spark, sf_dir):
    """The last event of each known user, with a default for users without one; users above 60 don't exist."""
    events = table(spark, sf_dir, "events").where("user_id % 5 <> 0").select("user_id", "ts", "event_id", "event_type", "value")
    ids = table(spark, sf_dir, "events").select("user_id").where("user_id <= 60")
    found = traits.effective_annotations(ids, events, ["user_id"], ["ts", "event_id"], {"event_id": F.lit(None), "event_type": F.lit("unset"), "value": F.lit(0.0)})
    return found.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), "annotated")


J07_SQL = """WITH i AS (SELECT DISTINCT user_id FROM events WHERE user_id <= 60), l AS (SELECT * FROM events WHERE user_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, coalesce(event_type, 'unset') AS event_type, round(coalesce(value, 0), 6) AS value, event_id IS NOT NULL AS annotated FROM i LEFT JOIN l USING (user_id)"""


def p07_first_reason(spark, sf_dir):
    reason = evidence.first_reason([("too_small", F.col("l_quantity") < 5), ("too_large", F.col("l_quantity") > 45), ("discounted", F.col("l_discount") > 0.08)])
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


P07_SQL = "SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN 'too_small' WHEN l_quantity > 45 THEN 'too_large' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL"


def p16_review_state(spark, sf_dir):
    """Orders by status and decision; a decision counts only on the revision (the order's priority) it was made on."""
    decided = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", "excluded").otherwise("accepted")).alias("decision"))
    revision = F.element_at(F.array(*(F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    states = traits.review_states(table(spark, sf_dir, "orders"), decided.withColumn("o_orderpriority", revision), ["o_orderkey"], "o_orderpriority")
    return states.groupBy("o_orderstatus", "state").agg(F.count("*").alias("n"))


P16_SQL = """WITH d AS (SELECT l_orderkey AS o_orderkey, ['1-URGENT', '2-HIGH', '3-MEDIUM'][l_orderkey % 3 + 1] AS o_orderpriority, max(CASE WHEN l_returnflag = 'R' THEN 'excluded' ELSE 'accepted' END) AS d FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT o_orderstatus, coalesce(d, 'unreviewed') AS state, count(*) AS n FROM orders LEFT JOIN d USING (o_orderkey, o_orderpriority) GROUP BY ALL"""


def q07_geometry_coverage(spark, sf_dir):
    """Metric geometry of suppliers: at places (of seven) measured in both directions, within an error of 0.1."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 7).alias("place"), F.when(F.col("l_linestatus") == "O", "horizontal").otherwise("vertical").alias("direction"), (F.col("l_tax") - F.col("l_discount")).alias("error"))
    found = audits.geometry_coverage(lines, ["l_suppkey"], "place", "direction", F.col("error"), 0.095)
    return found.withColumn("worst", F.round("worst", 6))


Q07_SQL = """WITH p AS (SELECT l_suppkey, l_partkey % 7 AS place, count(DISTINCT l_linestatus = 'O') AS d, max(abs(l_tax - l_discount)) AS w FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, count(*) AS locations, count(*) FILTER (d >= 2) AS covered, max(w) AS worst FROM p GROUP BY l_suppkey)
SELECT l_suppkey, locations, covered, locations >= 3 AND covered = locations AS sufficient, round(worst, 6) AS worst, locations >= 3 AND covered = locations AND worst <= 0.095 AS within FROM s"""


def st06_windowed_counts(spark, sf_dir):
    return outcomes.windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


ST06_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"

QUERIES = {
    "j07_effective_annotations": (j07_effective_annotations, J07_SQL),
    "j08_contact_pairs": (j08_contact_pairs, J08_SQL),
    "j09_nearest": (j09_nearest, J09_SQL),
    "j16_disjoint_splits": (j16_disjoint_splits, J16_SQL),
    "tr03_softmax_abstain": (tr03_softmax_abstain, TR03_SQL),
    "t03_greedy_suppression": (t03_greedy_suppression, T03_SQL),
    "p08_circle_support": (p08_circle_support, P08_SQL),
    "g03_independent_groups": (g03_independent_groups, G03_SQL),
    "g03_group_digests": (g03_group_digests, G03D_SQL),
    "g06_downstream": (g06_downstream, G06_SQL),
    "w04_last_wins": (w04_last_wins, W04_SQL),
    "w07_longest_run": (w07_longest_run, W07_SQL),
    "w12_coalesce_outcomes": (w12_coalesce_outcomes, W12_SQL),
    "i14_method_priority": (i14_method_priority, I14_SQL),
    "p01_shape_eligible": (p01_shape_eligible, P01_SQL),
    "p05_trait_label": (p05_trait_label, P05_SQL),
    "ag25_split_counts": (ag25_split_counts, AG25_SQL),
    "p17_evidence_problem": (p17_evidence_problem, P17_SQL),
    "p07_first_reason": (p07_first_reason, P07_SQL),
    "p16_review_state": (p16_review_state, P16_SQL),
    "q07_geometry_coverage": (q07_geometry_coverage, Q07_SQL),
    "st06_windowed_counts": (st06_windowed_counts, ST06_SQL),
}
