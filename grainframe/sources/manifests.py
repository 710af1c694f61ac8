"""Study files as tables with fixed schemas: masks, learning samples, trait vocabularies, run outcomes, annotation bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASKS = "image_path string, image_sha256 string, width int, height int, mask_path string, coordinate_space string, mask_sha256 string, instance_count int, dish_instance_count int, external_reference_count int, reviewed boolean, notes string"
SAMPLE = (
    "identifier string, features string, instances string, species string, `group` string, split string, reviewed boolean, annotation_author string, annotation_revision string, component_sha256 map<string,string>,"
    " provenance map<string,string>, pattern_boundary string, pattern_valid string, physical_boundary string, physical_valid string, image string, notes string"
)
TRAITS = "version int, traits array<struct<identifier string, title string, kind string>>"
OUTCOME = "outcome_revision string, state string, reason_code string, last_started_node string, payload string"


def mask_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a mask, with ``problem``: the first thing wrong with the entry, or null. A mask that isn't reviewed is no truth."""
    rows = spark.read.schema(MASKS).json(path, multiLine=True)
    digest = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    problem: Column = (
        F.when(F.col("image_path").isNull() | F.col("mask_path").isNull(), "no path").when(digest("image_sha256") | digest("mask_sha256"), "no digest")
        .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "no frame").when(F.col("instance_count") < F.coalesce("dish_instance_count", F.lit(0)), "more instances in the dish than in all")
    )
    return rows.withColumn("problem", problem).withColumn("is_truth", F.coalesce("reviewed", F.lit(False)) & problem.isNull())


def learning_samples(spark: SparkSession, path: str) -> DataFrame:
    """``dataset_id`` and the samples of learning manifests, one row each, ready for ``audits.dataset_audit``."""
    held = spark.read.schema(f"dataset_id string, version int, samples array<struct<{SAMPLE}>>").json(path, multiLine=True)
    rows = held.select("dataset_id", F.explode_outer("samples").alias("s")).where("s IS NOT NULL").select("dataset_id", "s.*")
    return rows.withColumns({"source_sha256": F.try_element_at("provenance", F.lit("source_sha256")), "feature_sha256": F.try_element_at("component_sha256", F.lit("features"))})


def trait_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``version, place, identifier, title, kind`` of the traits in order; ``usable`` is false for identifiers that are unfit or repeated."""
    held = spark.read.schema(TRAITS).json(path, multiLine=True).select("version", F.posexplode("traits").alias("place", "t")).select("version", "place", "t.*")
    counts = held.groupBy("version", "identifier").agg(F.count("*").alias("n"))
    joined = held.join(counts, ["version", "identifier"], "left")
    title = F.coalesce("title", F.initcap(F.regexp_replace("identifier", "_", " ")))
    return joined.select("version", "place", "identifier", title.alias("title"), "kind", (F.coalesce(F.col("identifier").rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False)) & (F.coalesce("n", F.lit(1)) == 1)).alias("usable"))


def outcomes(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Run outcomes of a folder of JSON lines: append-only, so as a table or as a stream of new files."""
    reader = (spark.readStream if stream else spark.read).schema(OUTCOME)
    return reader.json(folder)


def match_annotations(bundle: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of a bundle with the ``image`` they belong to, by the image's SHA-256 (``image_sha256``), whatever its name.

    Those without an image keep a null; an image that is there under several names gives its first.
    """
    known = images.groupBy("image_sha256").agg(F.min("image").alias("image"))
    return bundle.join(known, "image_sha256", "left")
