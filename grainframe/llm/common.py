"""What the corpus operators share: reading tables, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import platform
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainframe.sources.workspace import Workspace  # noqa: F401  (the operators take it from here)

#: A word of a text, as every contract here takes it: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key of its own for each row: the file it is read from and its place there, the same in every pass.

    Rows that are not read as they are, but come from a shuffle or from memory, are saved first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.children().size() or node.metadataOutput().isEmpty():
        docs = Workspace(docs.sparkSession, "keyed").save(docs, "rows")
    return docs.select("*", F.concat_ws(":", F.xxhash64("_metadata.file_path").cast("string"), F.col("_metadata.row_index").cast("string")).alias(name))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back to the system as it goes: workers live on for later stages."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        if platform.libc_ver()[0] == "glibc":
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(run(batches)):
            yield batch
            if i % 8 == 7:
                pa.default_memory_pool().release_unused()
        trim()

    return lean_run


def byte_lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Places and numbers of consecutive rows whose lengths add up to ``limit`` at most; a longer row is a slice by itself."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of a value's UTF-8 text."""
    return F.crc32(column.cast("string").cast("binary"))


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``frame`` has that name (Spark compares without case)."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(frame: DataFrame, *made: str) -> DataFrame:
    """``frame`` without the columns that an operator is about to make, so that its own never clash."""
    made_lower = {c.lower() for c in made}
    return frame.select(*(F.col(f"`{c}`") for c in frame.columns if c.lower() not in made_lower))


def columns_of(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def words_of(data: bytes | None) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six ASCII white-space bytes of the word pattern."""
    return data.split() if data else []


WORD_BYTES = re.compile(WORD.encode())
