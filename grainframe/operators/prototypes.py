"""Robust prototypes of the rows of each key: a spread-out start, rounds of assignment and medians, then medoids and scales.

All keys are fitted at once. A round is one map over the rows, which holds each against the centres of its key, and medians by
key, cluster and dimension. Centres are a model of at most ``maximum`` vectors a key: where those of all keys together pass
``MAX_CENTRE_BYTES``, keys are taken in blocks that don't. Plans don't grow with the rounds, as each is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from grainframe.operators.ordered import join_nulls, vector_medians
from grainframe.operators.vectors import squared_distance
from grainframe.sources.workspace import Workspace

MAX_CENTRE_BYTES = 64_000_000
#: Differences between rows and centres that a task holds at once.
CHUNK = 4_000_000


def robust_centres(rows: DataFrame, keys: list[str], vector: str, floor: float) -> DataFrame:
    """``keys, centre, scale``: lower medians, and 1.4826 times the lower median distance from them (``floor`` at least)."""
    centres = vector_medians(rows, keys, vector, "centre", "lower")
    away = join_nulls(rows, centres, keys).select(*keys, F.zip_with(vector, "centre", lambda v, c: F.abs(v - c)).alias("away__"))
    mads = vector_medians(away, keys, "away__", "mad__", "lower")
    return join_nulls(centres, mads, keys).select(*keys, "centre", F.transform("mad__", lambda m: F.greatest(1.4826 * m, F.lit(floor))).alias("scale"))


def assign(rows: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """``rows`` with ``cluster``: the nearest of their key's ``centres`` (``key``, cluster, centre), the first on ties.

    Rows of a key without centres are left out.
    """
    total = centres.agg(F.sum(8 * F.size("centre") + 64)).first()[0] or 0
    blocks = max(1, -(-total // MAX_CENTRE_BYTES))
    at, schema = rows.columns.index(key), StructType([*rows.schema.fields, StructField("cluster", IntegerType())])
    out = None
    for block in range(blocks):
        mine = lambda frame: frame if blocks == 1 else frame.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
        held: dict = {}
        for row in mine(centres).select(key, "cluster", "centre").orderBy("cluster").toLocalIterator():
            held.setdefault(row[0], []).append((row[1], row[2]))
        shared = rows.sparkSession.sparkContext.broadcast({k: (np.array([c for c, _ in v]), np.array([c for _, c in v])) for k, v in held.items()})
        found = mine(rows).mapInArrow(_assigner(shared, at, rows.columns.index(vector)), schema)
        out = found if out is None else out.union(found)
    return out


def _assigner(shared, at: int, vector: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(at).to_pylist(), dtype=object)
            values = batch.column(vector)
            matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            cluster = np.full(len(keys), -1, dtype=np.int32)
            for key in set(keys.tolist()):
                if key in shared.value:
                    ids, centres = shared.value[key]
                    rows = np.flatnonzero(keys == key)
                    step = max(1, CHUNK // centres.size)
                    for i in range(0, len(rows), step):
                        part = rows[i : i + step]
                        gaps = matrix[part][:, None, :] - centres[None]
                        cluster[part] = ids[np.einsum("ijk,ijk->ij", gaps, gaps).argmin(axis=1)]
            known = pa.array(cluster >= 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], names=[*batch.schema.names, "cluster"]).filter(known)

    return run


def spread_start(rows: DataFrame, key: str, row_id: str, vector: str, sizes: DataFrame, work: Workspace) -> DataFrame:
    """``key, cluster, centre``: the vector farthest from the origin, then always the one farthest from all before it.

    ``sizes``: ``key, most``, the number of vectors of each key. A key ends early where every row is one of its vectors. Rows
    carry their least distance, so a round is one pass; ties take the lower id.
    """
    square = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)
    held = work.save(join_nulls(rows, sizes, [key]).withColumn("near__", square / F.size(vector)), "near-0")
    top = sizes.agg(F.max("most")).first()[0] or 0
    chosen = None
    for rank in range(top):
        limit = F.lit(True) if rank == 0 else F.col("near__") > 1e-8
        best = held.where((F.col("most") > rank) & limit).groupBy(key).agg(F.min(F.struct((-F.col("near__")).alias("d"), F.col(row_id).alias("i"), F.col(vector).alias("v"))).alias("b"))
        picked = work.save(best.select(key, F.lit(rank).alias("cluster"), F.col("b.v").alias("centre")), f"start-{rank}")
        if picked.isEmpty():
            break
        chosen = picked if chosen is None else chosen.union(picked)
        if rank + 1 < top:
            distance = squared_distance(F.col(vector), F.col("centre"))
            nearer = distance if rank == 0 else F.least("near__", distance)
            held = work.save(join_nulls(held, picked.drop("cluster"), [key]).withColumn("near__", nearer).drop("centre"), f"near-{rank + 1}")
            work.drop(f"near-{rank}")
    return chosen if chosen is not None else rows.select(key, F.lit(0).alias("cluster"), F.col(vector).alias("centre")).limit(0)


def fit_prototypes(rows: DataFrame, key: str, row_id: str, vector: str, maximum: int, min_support: int, iterations: int = 4, floor: float = 0.045) -> DataFrame:
    """``key, prototype, medoid, centre, scale, n, weight`` of at most ``maximum`` prototypes of each key.

    A key has one prototype for every ``min_support`` rows, one at least. Vectors are standardised by median and MAD; medians
    move the centres until none moves, ``iterations`` times at most; a centre without rows stays. What is assigned to a
    centre in the end gives its prototype: lower medians and robust scales of the vectors themselves, the row nearest to them in
    these scales (the lower id on ties), their number and share. Prototypes without rows are left out.

    Rows whose vector is null, or holds a null or a value that isn't finite, are left out. A null key is a key.
    """
    if maximum < 1 or iterations < 1:
        raise ValueError("at least one prototype and one iteration")
    work = Workspace(rows.sparkSession, "prototypes")
    finite = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    held = work.save(rows.where(finite).select(key, F.col(row_id).alias("id__"), F.transform(vector, lambda v: v.cast("double")).alias("v__")), "rows")
    scales = work.save(robust_centres(held, [key], "v__", floor), "scales")
    zipped = F.zip_with(F.zip_with("v__", "centre", lambda v, c: v - c), "scale", lambda g, s: g / s)
    standard = work.save(join_nulls(held, scales, [key]).select(key, "id__", "v__", zipped.alias("z__")), "standardised")
    counts = work.save(standard.groupBy(key).agg(F.count("*").alias("all__")), "counts")
    most = F.least(F.lit(maximum), F.greatest(F.lit(1), F.floor(F.col("all__") / max(1, min_support)))).cast("int")
    centres = work.save(spread_start(standard.select(key, "id__", "z__"), key, "id__", "z__", counts.select(key, most.alias("most")), work), "centres-0")
    for step in range(1, iterations + 1):
        assigned = assign(standard.select(key, "z__"), key, "z__", centres)
        assigned = work.save(assigned, f"assigned-{step}")
        moved = join_nulls(centres, vector_medians(assigned, [key, "cluster"], "z__", "moved__", "lower"), [key, "cluster"], "left")
        moved = work.save(moved.select(key, "cluster", F.coalesce("moved__", "centre").alias("centre"), (F.coalesce("moved__", "centre") != F.col("centre")).alias("moved__")), f"centres-{step}")
        centres = moved.drop("moved__")
        work.drop(f"assigned-{step}")
        if moved.where("moved__").isEmpty():
            break
    final = work.save(assign(standard, key, "z__", centres).drop("z__"), "assigned")
    local = work.save(robust_centres(final, [key, "cluster"], "v__", floor), "local")
    gap = F.zip_with(F.zip_with("v__", "centre", lambda v, c: v - c), "scale", lambda g, s: (g / s) * (g / s))
    away = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size("v__")
    medoids = join_nulls(final, local, [key, "cluster"]).groupBy(key, "cluster").agg(F.min(F.struct(away.alias("d"), F.col("id__").alias("i"))).alias("b"), F.count("*").alias("n"))
    joined = join_nulls(join_nulls(local, medoids, [key, "cluster"]), counts, [key])
    return joined.select(key, F.col("cluster").alias("prototype"), F.col("b.i").alias("medoid"), "centre", "scale", "n", (F.col("n") / F.col("all__")).alias("weight"))
