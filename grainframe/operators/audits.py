"""Audits of study manifests: leakage between splits, access to locked tests, rules on learning datasets.

Every rule is one grouped pass or one join, and gives findings ``code, key, ids``; findings of all rules are united. Ids of
a finding are bounded lists with the number left out, so no group is collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.operators.components import connected_components
from grainframe.operators.ordered import ranked
from grainframe.sources.workspace import Workspace

LOCKED = "locked_test"
BIOLOGICAL = ("biological_lot_id", "specimen_group_id", "physical_specimen_id")
CAPTURE = ("capture_session_id", "capture_group_id")
MAX_IDS = 1024
MAX_FINDINGS = 256


def bounded_ids(members: DataFrame, keys: list[str], item: str, limit: int = MAX_IDS) -> DataFrame:
    """``keys, ids, omitted``: the first ``limit`` distinct items of each key in order, and how many more there are.

    Ranks are taken by ranges of the order, so a key of very many items isn't collected; only its first ones are.
    """
    distinct = members.select(*keys, item).distinct()
    placed = ranked(distinct, [F.col(item)], "place_", keys)
    held = placed.groupBy(*keys).agg(F.count("*").alias("n_"), F.array_sort(F.collect_list(F.when(F.col("place_") < limit, F.col(item)))).alias("ids"))
    return held.select(*keys, "ids", F.greatest(F.lit(0), F.col("n_") - limit).cast("int").alias("omitted"))


def first_ids(frame: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of an order: the merge of sorted lists. Spark keeps ``limit`` rows of each task."""
    return frame.orderBy(*order).limit(limit)


def related_samples(samples: DataFrame, kinds: tuple[str, ...], work: Workspace, name: str) -> DataFrame:
    """``sample_id, component`` of samples related by an equal value of a kind, directly or through others."""
    pairs = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"))) for k in kinds)))
    keyed = work.save(samples.select("sample_id", F.explode(pairs).alias("g")), f"{name}-keys")
    links = keyed.join(keyed.groupBy("g").agg(F.min("sample_id").alias("b")), "g").select(F.col("sample_id").alias("a"), "b")
    return connected_components(links, work, name).select(F.col("node").alias("sample_id"), "component")


def component_kinds(samples: DataFrame, components: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``component, kind`` of the kinds by which samples of a component are related (a value held by two or more)."""
    pairs = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"))) for k in kinds)))
    values = samples.select("sample_id", F.explode(pairs).alias("g")).join(components, "sample_id")
    return values.groupBy("g").agg(F.count("*").alias("n"), F.min("component").alias("component")).where("n > 1").select("component", F.col("g.kind").alias("kind")).distinct()


def _finding(code: str, frame: DataFrame, key: Column, n: Column, roles: Column, kinds: Column) -> DataFrame:
    return frame.select(F.lit(code).alias("code"), key.cast("string").alias("key"), n.cast("long").alias("n_ids"), roles.alias("roles"), kinds.alias("kinds"))


def _none() -> Column:
    return F.lit("")


def _set(column: Column) -> Column:
    """The few distinct values of a column (roles, kinds), sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def leakage_audit(samples: DataFrame, access: DataFrame, access_log_complete: bool = True) -> DataFrame:
    """``code, key, n_ids, roles, kinds`` of what stands against an evaluation on the locked test; no row: nothing does.

    ``samples``: sample_id, source_sha256, split_role, truth_state, and the group columns. ``access``: access_id, sample_id.
    Related groups are found by group columns alone; access also follows equal sources. Nothing is guessed from missing groups.
    """
    work = Workspace(samples.sparkSession, "leakage")
    kinds = (*BIOLOGICAL, *CAPTURE)
    held = work.save(samples.select("sample_id", "source_sha256", "split_role", "truth_state", *kinds), "samples")
    locked = held.where(F.col("split_role") == LOCKED)
    one = held.sparkSession.range(1)
    parts = [_finding("no_locked_test_samples", locked.agg(F.count("*").alias("n")).where("n = 0"), _none(), F.lit(0), _none(), _none())]
    if not access_log_complete:
        parts.append(_finding("access_log_incomplete", one, _none(), F.lit(0), _none(), _none()))
    for code, columns in (("biological_group_missing", BIOLOGICAL), ("capture_group_missing", CAPTURE)):
        missing = held.where(F.coalesce(*(F.col(c) for c in columns)).isNull()).agg(F.count("*").alias("n")).where("n > 0")
        parts.append(_finding(code, missing, _none(), F.col("n"), _none(), _none()))
    no_truth = locked.where(~F.col("truth_state").eqNullSafe(F.lit("available"))).agg(F.count("*").alias("n")).where("n > 0")
    parts.append(_finding("locked_test_truth_unavailable", no_truth, _none(), F.col("n"), F.lit(LOCKED), _none()))
    crossing = held.groupBy("source_sha256").agg(F.count("*").alias("n"), F.count_distinct("split_role").alias("r"), _set(F.col("split_role")).alias("roles")).where("n > 1 AND r > 1")
    parts.append(_finding("source_content_crosses_splits", crossing, F.col("source_sha256"), F.col("n"), F.col("roles"), _none()))

    related = work.save(related_samples(held, kinds, work, "groups"), "related")
    by_kind = component_kinds(held, related, kinds).groupBy("component").agg(_set(F.col("kind")).alias("kinds"))
    spread = held.join(related, "sample_id").groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("split_role").alias("r"), _set(F.col("split_role")).alias("roles")).where("n > 1 AND r > 1")
    spread = spread.join(by_kind, "component", "left")
    parts.append(_finding("related_groups_cross_splits", spread, F.col("component"), F.col("n"), F.col("roles"), F.coalesce("kinds", _none())))

    wide = (*kinds, "source_sha256")
    reach = related_samples(held, wide, work, "access")
    # a sample without relations is a component of its own
    reach = work.save(held.select("sample_id", "split_role").join(reach, "sample_id", "left").withColumn("component", F.coalesce("component", "sample_id")), "reach")
    targets = reach.where(F.col("split_role") == LOCKED).select("component").distinct()
    touched = work.save(access.select("access_id", "sample_id").distinct().join(reach, "sample_id").join(targets, "component", "left_semi"), "touched")
    relations = touched.select("access_id", "component").distinct().join(component_kinds(held, reach, wide), "component").select("access_id", "kind")
    direct = touched.where(F.col("split_role") == LOCKED).select("access_id", F.lit("direct_locked_test_sample").alias("kind"))
    how = relations.union(direct).groupBy("access_id").agg(_set(F.col("kind")).alias("kinds"))
    roles = touched.select("access_id", "split_role").union(touched.select("access_id", F.lit(LOCKED))).groupBy("access_id").agg(_set(F.col("split_role")).alias("roles"))
    found = touched.groupBy("access_id").agg(F.count("*").alias("n")).join(roles, "access_id").join(how, "access_id", "left")
    parts.append(_finding("locked_test_access_recorded", found, F.col("access_id"), F.col("n"), F.col("roles"), F.coalesce("kinds", _none())))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def manifest_counts(samples: DataFrame) -> DataFrame:
    """``split_role, n, truth_available, truth_unavailable`` for the three roles, empty ones too."""
    roles = samples.sparkSession.createDataFrame([("development",), ("validation",), (LOCKED,)], "split_role string")
    seen = samples.groupBy("split_role").agg(F.count("*").alias("n"), F.count_if(F.col("truth_state") == "available").alias("truth_available"), F.count_if(F.col("truth_state") == "unavailable").alias("truth_unavailable"))
    return roles.join(seen, "split_role", "left").fillna(0)


def dataset_audit(samples: DataFrame) -> DataFrame:
    """``code, key, n``: errors of a learning dataset, one row a rule and what it found.

    ``samples``: identifier, group, split, species, reviewed, annotation_author, source_sha256, feature_sha256,
    pattern_boundary, pattern_valid, physical_boundary, physical_valid. Warnings start with ``warn_``.
    """
    held = samples
    splits = F.count_distinct("split")
    one_id = lambda code, rule: held.where(rule).groupBy(F.col("identifier").alias("key")).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "key", "n")
    grouped = lambda code, by, frame, found: frame.groupBy(by.alias("key")).agg(found.alias("n")).where("n > 1").select(F.lit(code).alias("code"), "key", "n")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    parts = [
        grouped("duplicate_identifier", F.col("identifier"), held, F.count("*")),
        one_id("invalid_split", ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))),
        one_id("missing_group", blank("group")),
        grouped("group_crosses_splits", F.col("group"), held, splits),
        grouped("source_crosses_splits", F.col("source_sha256"), held.where("source_sha256 IS NOT NULL"), splits),
        grouped("features_cross_splits", F.col("feature_sha256"), held.where("feature_sha256 IS NOT NULL"), splits),
        grouped("conflicting_species", F.col("source_sha256"), held.where("source_sha256 IS NOT NULL"), F.count_distinct("species")),
        one_id("pattern_without_validity", ~blank("pattern_boundary") & blank("pattern_valid")),
        one_id("physical_paths_unpaired", blank("physical_boundary") != blank("physical_valid")),
        one_id("warn_reviewed_without_author", F.col("reviewed") & blank("annotation_author")),
        held.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_samples").alias("code"), F.lit("").alias("key"), "n"),
        held.agg(F.count_if(~F.col("reviewed")).alias("n")).where("n > 0").select(F.lit("warn_unreviewed").alias("code"), F.lit("").alias("key"), "n"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def held_out_overlap(left: DataFrame, right: DataFrame, identities: list[str]) -> DataFrame:
    """``identity, value, n_left, n_right`` of identities that rows of both sides have: one equi-join for each identity."""
    out = None
    for name in identities:
        counts = [side.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias(n)) for side, n in ((left, "n_left"), (right, "n_right"))]
        found = counts[0].join(counts[1], "value").select(F.lit(name).alias("identity"), "value", "n_left", "n_right")
        out = found if out is None else out.union(found)
    return out


def geometry_coverage(observations: DataFrame, keys: list[str], location: str, direction: str, error: Column, limit: float) -> DataFrame:
    """``keys, locations, covered, sufficient, worst, within``: metric geometry by named places and directions.

    Coverage suffices with at least three locations that all have both directions; the largest relative error then decides.
    """
    seen = observations.groupBy(*keys, location).agg(F.count_distinct(direction).alias("directions"), F.max(F.abs(error)).alias("worst"))
    found = seen.groupBy(*keys).agg(F.count("*").alias("locations"), F.count_if(F.col("directions") >= 2).alias("covered"), F.max("worst").alias("worst"))
    sufficient = (F.col("locations") >= 3) & (F.col("covered") == F.col("locations"))
    return found.select(*keys, "locations", "covered", sufficient.alias("sufficient"), "worst", (sufficient & (F.col("worst") <= limit)).alias("within"))
