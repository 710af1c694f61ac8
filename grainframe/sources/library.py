"""A library of prototype banks by species, as write-once versions, resolved by exact pin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainframe.operators.hierarchy import source_balanced
from grainframe.operators.ordered import join_nulls, ranked
from grainframe.sources.workspace import write_revision

_RETIRED = "retired"


def _folder(root: str, species: str, library: str) -> str:
    return f"{root}/banks/species={species}/library={library}"


def publish(bank: DataFrame, root: str, species: str, library: str, version: int) -> str:
    """Writes a version of a bank; one that is there is never replaced."""
    return write_revision(bank, _folder(root, species, library), f"v{version}")


def retire(spark: SparkSession, root: str, species: str, library: str, version: int) -> None:
    """Marks a version as retired. It can still be loaded by its pin; nothing is deleted."""
    row = spark.createDataFrame([(species, library, version)], "species string, library string, version int")
    row.write.mode("append").parquet(f"{root}/{_RETIRED}")


def load(spark: SparkSession, root: str, species: str, library: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{_folder(root, species, library)}/revision=v{version}")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``species, library, version, retired`` of all published versions, from their folders alone."""
    found = spark.read.option("basePath", f"{root}/banks").parquet(f"{root}/banks").select("species", "library", F.regexp_extract("revision", "v([0-9]+)", 1).cast("int").alias("version")).distinct()
    try_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_RETIRED}")
    if not try_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(try_path):
        return found.withColumn("retired", F.lit(False))
    gone = spark.read.parquet(f"{root}/{_RETIRED}").distinct().withColumn("retired", F.lit(True))
    return found.join(gone, ["species", "library", "version"], "left").withColumn("retired", F.coalesce("retired", F.lit(False)))


def resolve(pins: DataFrame, versions: DataFrame) -> DataFrame:
    """``pins`` (project, species, library, version, digest, context_species, vocabulary) with the ``status`` of each.

    ``versions``: species, library, version, digest, vocabulary, retired. A pin holds by exact version and digest.
    """
    held = versions.select("species", "library", "version", F.col("digest").alias("digest__"), F.col("vocabulary").alias("vocabulary__"), "retired")
    joined = pins.join(held, ["species", "library", "version"], "left")
    status: Column = (
        F.when(F.col("library").isNull(), "no pin").when(~F.col("context_species").eqNullSafe(F.col("species")), "other species").when(F.col("digest__").isNull(), "missing")
        .when(F.col("digest__") != F.col("digest"), "changed").when(F.col("retired"), "retired").when(F.col("vocabulary__") != F.col("vocabulary"), "incompatible_trait_vocabulary").otherwise("compatible")
    )
    return joined.withColumn("status", status).drop("digest__", "vocabulary__", "retired")


def _tagged(banks: list[DataFrame]) -> DataFrame:
    if len({tuple(sorted((f.name, f.dataType.simpleString()) for f in b.schema)) for b in banks}) > 1:
        raise ValueError("banks of different schemas can't be merged")
    return reduce(DataFrame.unionByName, (b.withColumn("bank__", F.lit(i)) for i, b in enumerate(banks)))


def repeated_sources(banks: list[DataFrame], source: str) -> DataFrame:
    """``source, banks``: sources that are in several banks, and in how many."""
    return _tagged(banks).groupBy(source).agg(F.count_distinct("bank__").alias("banks")).where("banks > 1")


def merged(banks: list[DataFrame], group: str, source: str, weight: str) -> DataFrame:
    """Banks of one schema united, their weights balanced by source within ``group``; other schemas and repeated sources are an error."""
    if twice := repeated_sources(banks, source).limit(1).collect():
        raise ValueError(f"source {twice[0][source]} is in several banks")
    return source_balanced(_tagged(banks).drop("bank__"), group, source, weight)


def reindexed(bank: DataFrame, source: str, name: str = "source_index") -> DataFrame:
    """``bank`` with the place of each row's source among all its sources in order, from 0. Sources are counted, not collected."""
    places = ranked(bank.select(source).distinct(), [F.col(source)], name)
    return join_nulls(bank, places, [source])


def export_bundle(result: DataFrame, folder: str, revision: str) -> str:
    """A result in one new revision folder, as CSV for readers, JSON for programs and Parquet for Spark."""
    for kind in ("csv", "json", "parquet"):
        writer = result.write.mode("errorifexists")
        writer.format(kind).option("header", "true").save(f"{folder}/revision={revision}/{kind}")
    return f"{folder}/revision={revision}"
