"""Contour modes of populations: smooth closed signatures, their mean, their principal modes, and how many of these hold out.

A smoothed signature is a few Fourier coefficients, so all work is on vectors of at most 25 numbers: their sums and products
are added up by key in Spark, and a key's modes are one small eigenproblem. Leaving a row out changes these sums by
a rank-one term, so no fit is repeated over rows: each row takes itself out of its key's sums and solves its own small problem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from grainframe.operators.ordered import join_nulls
from grainframe.sources.workspace import Workspace

HARMONICS = 12
#: A further mode has to lower the held-out error to this share.
GAIN = 0.97


def basis(length: int) -> np.ndarray:
    """Orthonormal columns: the constant, then cosine and sine of each harmonic that smoothing keeps."""
    top = min(HARMONICS, max(3, length // 16), length // 2)
    at = 2 * np.pi * np.arange(length) / length
    columns = [np.ones(length)]
    for k in range(1, top + 1):
        columns.append(np.cos(k * at))
        if 2 * k < length:
            columns.append(np.sin(k * at))
    return np.array([c / np.sqrt((c * c).sum()) for c in columns]).T


def aligned(signatures: np.ndarray) -> np.ndarray:
    """Coefficients of smoothed signatures, each turned by half a ring if that comes first in order (by 8 digits)."""
    b = basis(signatures.shape[1])
    smooth = signatures @ b @ b.T
    turned = np.roll(smooth, signatures.shape[1] // 2, axis=1)
    keep = np.array([tuple(np.round(x, 8)) <= tuple(np.round(y, 8)) for x, y in zip(smooth, turned)], dtype=bool)
    return np.where(keep[:, None], smooth, turned) @ b


def _modes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest on, and their vectors as rows, each with its largest part positive."""
    values, vectors = np.linalg.eigh(scatter)
    vectors = vectors.T[::-1]
    largest = np.abs(vectors).argmax(axis=1)
    return np.maximum(values[::-1], 0.0), vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def contour_modes(rows: DataFrame, key: str, signature: str, maximum: int) -> DataFrame:
    """``key, n, kept, mean, modes, variances``: the mean signature of a key and its first ``kept`` modes with their variances.

    Signatures are of one length. Up to ``maximum`` modes are tried: starting from none, a number of modes replaces the best so
    far if the mean squared error of rows left out falls to ``GAIN`` of it. Two rows or fewer keep what they have. Rows without a signature, or with
    one that holds a null or no finite number, are left out. A mode's sign is such that its largest coefficient is positive.
    """
    work = Workspace(rows.sparkSession, "contours")
    finite = F.coalesce(F.forall(signature, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size(signature) > 1)
    held = rows.where(finite).select(key, F.col(signature).cast("array<double>").alias("s__"))
    lengths = held.agg(F.min(F.size("s__")), F.max(F.size("s__"))).first()
    kind = rows.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("n", LongType()), StructField("kept", LongType()), StructField("mean", ArrayType(DoubleType())), StructField("modes", ArrayType(ArrayType(DoubleType()))), StructField("variances", ArrayType(DoubleType()))])
    if lengths[0] is None:
        return rows.sparkSession.createDataFrame([], out)
    if lengths[0] != lengths[1]:
        raise ValueError("signatures differ in length")
    length = lengths[0]
    width = basis(length).shape[1]

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = aligned(batch.column(1).flatten().to_numpy().reshape(-1, length))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "c__"])

    coded = work.save(held.mapInArrow(coefficients, StructType([StructField(key, kind), StructField("c__", ArrayType(DoubleType()))])), "coefficients")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number, sums and products of a task's rows by key."""
        sums: dict = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows_ = np.array(batch.column(1).flatten().to_numpy().reshape(len(keys), -1))
            for k in set(keys):
                x = rows_[[i for i, other in enumerate(keys) if other == k]]
                sums[k] = sums.get(k, 0) + np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(total), batch.schema.field(0).type), pa.array(np.arange(len(total))), pa.array(total)], names=[key, "at", "v"])

    summed = coded.mapInArrow(partial, StructType([StructField(key, kind), StructField("at", LongType()), StructField("v", DoubleType())])).groupBy(key, "at").agg(F.sum("v").alias("v"))
    totals = work.save(summed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("t__")), "totals")

    def centred(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, mean = t[0], t[1 : width + 1] / t[0]
        return n, mean, t[width + 1 :].reshape(width, width) - n * np.outer(mean, mean)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Squared error of each row under 0, 1, ... modes of the other rows of its key."""
        for batch in batches:
            found = []
            for c, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, mean, scatter = centred(np.array(t))
                tried = int(min(maximum, n - 1))
                gap = np.array(c) - mean
                _, modes = _modes(scatter - n / (n - 1) * np.outer(gap, gap))
                away = gap * n / (n - 1)
                explained = np.concatenate([[0.0], np.cumsum((modes[:tried] @ away) ** 2)])
                found.append(((away @ away - explained) / length).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "e__"])

    many = join_nulls(coded, totals.where("t__[0] > 2"), [key]).select(key, "c__", "t__")
    errors = many.mapInArrow(left_out, StructType([StructField(key, kind), StructField("e__", ArrayType(DoubleType()))]))
    errors = errors.select(key, F.posexplode("e__").alias("at", "v")).groupBy(key, "at").agg(F.avg("v").alias("v"))
    errors = errors.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("e__"))

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = basis(length)
        for frame in frames:
            made = []
            for t, error in zip(frame["t__"], frame["e__"]):
                n, mean, scatter = centred(np.array(t))
                best = 0 if error is not None else int(min(maximum, n - 1))
                for k in range(1, 0 if error is None else len(error)):
                    if error[k] <= error[best] * GAIN:
                        best = k
                values, modes = _modes(scatter)
                best = min(best, width)
                made.append((int(n), best, (b @ mean).tolist(), (modes[:best] @ b.T).tolist(), (values[:best] / max(n - 1, 1)).tolist()))
            yield pd.DataFrame({key: frame[key], **{name: [m[i] for m in made] for i, name in enumerate(("n", "kept", "mean", "modes", "variances"))}})

    return join_nulls(totals, errors, [key], "left").select(key, "t__", "e__").mapInPandas(fitted, out)
