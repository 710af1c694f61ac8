"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled text. A whole text is compressed with each; the
normalised difference of the two sizes, (bad - good) / (bad + good), becomes a score by a logistic calibration that also
sees how far the text compresses by itself (a text of few repeated words fits either dictionary). Dictionaries and
calibration learn from two disjoint halves of a bounded sample of labelled rows; scoring is one map over all documents.

Only ``SAMPLE_PER_CLASS`` labelled documents of each label reach the driver, those of smallest hash, without texts of more
than ``SAMPLE_MAX_BYTES`` (the only place where a length bound applies); two dictionaries and four weights go out.

Defined results: a null or empty text gets the score of difference 0. If a class has too few samples for a dictionary,
the score of every document is the share of good labels (0.5 without labels). Null labels and labels other than 0 and 1
teach nothing. Documents without a label are scored like all others; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import columns_of, crc32_of, free_name, table, without

SAMPLE_PER_CLASS = 3000
SAMPLE_MAX_BYTES = 32_768
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5
#: Compressed to less than this share of its size, a text repeats itself.
DENSE = 0.30


@dataclass
class CompressionModel:
    """Two dictionaries and the calibration: weights of (1, difference, density, difference * density)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    constant: float = 0.5

    def scorer(self):
        """A function from texts as bytes to scores; compressors are built once per task."""
        if not self.good or not self.bad:
            return lambda texts: np.full(len(texts), self.constant)
        pair = [_compressor(d) for d in (self.good, self.bad)]
        weights = np.array(self.weights)

        def score(texts: list[bytes]) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(_features(texts, *pair) @ weights, -30, 30)))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    a = np.array([len(good.compress(t)) if t else 0 for t in texts], dtype=float)
    b = np.array([len(bad.compress(t)) if t else 0 for t in texts], dtype=float)
    n = np.array([len(t) for t in texts], dtype=float)
    difference = np.where(a + b > 0, (b - a) / np.maximum(1, a + b), 0.0) * 20
    density = np.where(n > 0, np.maximum(0.0, np.log(DENSE / np.maximum(1e-6, a / np.maximum(1, n)))), 0.0)
    return np.stack([np.ones(len(texts)), difference, density, difference * density], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method for the penalised log likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(crc32_of(F.col(doc_id)) % FOLDS == 0, F.lit(False))


def train_compression_model(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id") -> CompressionModel:
    """Dictionaries from one half of the sampled rows, the calibration from the other half.

    The sample is drawn from ``labels`` (``key`` and ``label``), so that only its bounded list of keys meets the texts.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("key").cast("string"), F.lit(17))
    # a share by hash comes first, so that the number of tasks doesn't multiply the rows that are sorted in one place
    share = {y: min(1.0, 4 * SAMPLE_PER_CLASS / max(1, shares.get(y, 0))) for y in (0, 1)}
    part = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(18)), F.lit(1 << 20))
    drawn = [rows.where((F.col("y") == y) & (part < int(share[y] * (1 << 20)))).orderBy(order, "key").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).join(F.broadcast(drawn[0].union(drawn[1])), "key")
    found = chosen.where(F.octet_length("t").between(1, SAMPLE_MAX_BYTES)).select("y", "t", order.alias("k")).collect()
    texts = {y: [bytes(r["t"]) for r in sorted(found, key=lambda r: (r["k"], r["t"])) if r["y"] == y] for y in (0, 1)}
    constant = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    halves = {y: (t[::2], t[1::2]) for y, t in texts.items()}
    try:
        good, bad = (zstandard.train_dictionary(DICTIONARY_BYTES, halves[y][0]).as_bytes() for y in (1, 0))
    except (zstandard.ZstdError, ValueError):
        return CompressionModel(b"", b"", (0.0,) * 4, constant)
    pair = _compressor(good), _compressor(bad)
    if not halves[0][1] or not halves[1][1]:
        return CompressionModel(b"", b"", (0.0,) * 4, constant)
    x = np.concatenate([_features(halves[y][1], *pair) for y in (0, 1)])
    y = np.concatenate([np.full(len(halves[y][1]), float(y)) for y in (0, 1)])
    weights = _logistic(x, y)
    # the sample holds as many of each class as there are; the prior of all labelled rows shifts the constant
    odds = np.log(max(1, shares.get(1, 0)) / max(1, shares.get(0, 0))) - np.log(len(halves[1][1]) / len(halves[0][1]))
    weights[0] += odds
    return CompressionModel(good, bad, tuple(map(float, weights)), constant)


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, from the whole text alone."""
    base = without(docs, score)
    names = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = scorer([x.as_py() or b"" for x in batch.column(len(names))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, score])

    source = base.select("*", F.col(text).cast("binary").alias(free_name(base, "text_bytes")))
    return source.mapInArrow(run, f"{columns_of(base)}, `{score}` double")


def op1(spark, sf_dir: str) -> DataFrame:
    """``op1_quality_classifier``: the score of every document; labels are learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    model = train_compression_model(docs, labels)
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
