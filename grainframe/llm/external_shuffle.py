"""Two-pass external shuffle into shards.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash of all their columns. Rows that are
equal in every column would meet in one bucket: where their copies fill more than a ``HOT_SHARE`` of a bucket, they are
counted, and as many copies are dealt out anew by their number. So places hang on the rows alone, not on files, partitions
or the order of tasks. Pass 2 takes one bucket at a time,
puts its records in a fixed order, shuffles them by Fisher-Yates under a seed of the bucket, and writes them. The buckets
one after another are a random order of all records; it is cut into shards whose counts are at most one apart (law
``rows``). A record's rank comes from prefix sums over bucket counts, taken in two levels, so that no task sees more than
``RUN`` counts and a summary row for each ``RUN`` buckets.

Defined results: a null text has no bytes (its record still has 8) and checksum 0. Rows are told apart by two 64-bit hashes
of all columns; equal rows are interchangeable. An empty table gives no shards. Extra columns travel along; those made here replace others of
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainframe.llm.common import Workspace, columns_of, free_name, table, without
from grainframe.llm.runs import sorted_runs

SHARDS = 24
SEED = 20240607
#: Bytes of a bucket: what one task shuffles in memory.
BUCKET_BYTES = 16_000_000
RECORD_BYTES = 8
#: Equal rows that fill more than this part of a bucket are scattered by their number.
HOT_SHARE = 8
RUN = 1024
_MADE = ("size", "text_crc32", "bucket", "position", "shard", "slot")


def _offsets(buckets: DataFrame) -> DataFrame:
    """``bucket, offset, total``: records in all earlier buckets, and in all of them, from ``bucket, n``."""
    runs = buckets.groupBy(F.floor(F.col("bucket") / RUN).alias("run")).agg(F.sum("n").alias("n"))
    over_runs = Window.orderBy("run")
    runs = runs.select("run", (F.sum("n").over(over_runs) - F.col("n")).alias("earlier"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("run").orderBy("bucket")
    own = buckets.withColumn("run", F.floor(F.col("bucket") / RUN)).withColumn("within", F.sum("n").over(inside) - F.col("n"))
    return own.join(runs, "run").select("bucket", (F.col("earlier") + F.col("within")).alias("offset"), "total")


def external_shuffle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in shuffled order, with ``size, text_crc32, bucket, position, shard, slot``."""
    work = Workspace(docs.sparkSession, "external-shuffle")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = without(docs, *_MADE)
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in base.schema.fields]
    names, first, second, number = base.columns, *(free_name(base, n) for n in ("row_hash", "row_hash_2", "copy"))
    # nulls are skipped by hashes, so each column is hashed with whether it is one
    known = [x for c in plain for x in (c.isNull(), c)]
    base = base.withColumn("size", F.octet_length(data).cast("long") + RECORD_BYTES).withColumn("text_crc32", F.crc32(data))
    base = base.withColumn(first, F.xxhash64(F.lit(seed), *known)).withColumn(second, F.xxhash64(*known, F.lit(seed)))
    equal = base.groupBy(first, second).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    summed = equal.agg(F.sum(F.col("n") * F.col("size")), F.max(F.when(F.col("n") > 1, F.col("n") * F.col("size")))).first()
    n_buckets = max(1, -(-(summed[0] or 0) // bucket_bytes))
    dealt = base.withColumn(number, F.lit(0))
    if (summed[1] or 0) * HOT_SHARE > bucket_bytes:
        hot = work.save(equal.where((F.col("n") > 1) & (F.col("n") * F.col("size") * HOT_SHARE > bucket_bytes)).select(first, second, F.col("n").cast("int").alias(number)), "hot")
        rows = F.struct(*(F.col(f"`{c}`") for c in [*names, "size", "text_crc32"]))
        copies = base.join(hot, [first, second]).groupBy(first, second, number).agg(F.first(rows).alias("row"))
        copies = copies.select("row.*", first, second, F.explode(F.sequence(F.lit(0), F.col(number) - 1)).alias(number))
        dealt = dealt.join(hot, [first, second], "left_anti").unionByName(copies)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), first, number), F.lit(n_buckets))).drop(second, number)
    kept = [c for c in dealt.columns if c != first]

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in sorted_runs(batches, ["bucket"]):
            order = np.random.default_rng([seed, records["bucket"][0].as_py()]).permutation(records.num_rows)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            # each record carries its place; the writer needs them in order
            for part in records.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=4096):
                at = place[order[: part.num_rows]]
                order = order[part.num_rows :]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(at)], names=[*kept, "position"])

    laid = dealt.repartition("bucket").sortWithinPartitions("bucket", doc_id, "text_crc32", "size", first).mapInArrow(fisher_yates, f"{columns_of(dealt.select(*(f'`{c}`' for c in kept)))}, position bigint")
    written = work.save(laid, "buckets")
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    ranked = written.join(_offsets(counts), "bucket").withColumn("rank", F.col("offset") + F.col("position"))
    shard = F.expr(f"(rank * {shards}L) div total")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    slot = F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", slot.cast("long")).drop("rank", "offset", "total")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard; the files of a shard together hold its records by slot."""
    shuffled.write.partitionBy("shard").parquet(path)


def op2(spark, sf_dir: str) -> DataFrame:
    """``op2_external_shuffle``: the place of every document in 24 shards."""
    found = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
