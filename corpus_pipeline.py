"""The corpus pipeline: quality rules, near-dedup, pseudonyms, mixing to target weights, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainframe.llm import bpe, near_dedup, pii, quality_rules, source_mixing
from grainframe.llm.common import Workspace, table

#: Share of the tokens that survive the stages before it that mixing takes, in percent; no document is taken twice.
MIX_PERCENT = 95


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %), of repeated rows, and of copies without an id."""
    return near_dedup.without_near_duplicates(docs).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data, under the session's key; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, pii.key_of(spark, pii.TEST_KEY), counts=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken under the token budgets of the tree of domain, language and source."""
    return source_mixing.take_mixed(docs, MIX_PERCENT, 1).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and whether they decode to the text."""
    found = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", keep_by_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_to_weights),
    ("bpe", to_tokens),
]

#: SQL can express neither the rules' references nor the sketches, ciphers and merges: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
