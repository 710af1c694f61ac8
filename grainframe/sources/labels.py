"""Label rasters and files read as tables: NumPy archives as cells, files checked by digest, tiles of a raster.

Files come by Spark's binary reader, one task a file; a raster leaves its task as rows of cells.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "image string, y int, x int, label int"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified, content`` of the files below ``path``. Content is only read where it is asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def label_cells(held: DataFrame, shape: tuple[int, int] | None = None, array: str = "labels") -> DataFrame:
    """``image, y, x, label`` of the labelled cells of archives (``path, content``): ``.npy``, or ``.npz`` with ``array``.

    A raster must be of two dimensions and whole numbers from 0 to 65535, and of ``shape`` where one is given; others are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held_ = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                labels = held_[array] if hasattr(held_, "files") else held_
                if labels.ndim != 2 or not np.issubdtype(labels.dtype, np.integer) or (shape and labels.shape != shape):
                    raise ValueError(f"{path}: no label raster of the expected shape")
                if labels.size and (labels.min() < 0 or labels.max() > 65535):
                    raise ValueError(f"{path}: labels beyond 16 bits")
                y, x = np.nonzero(labels)
                for i in range(0, len(y), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(y[part])), *(pa.array(v, pa.int32()) for v in (y[part], x[part], labels[y[part], x[part]]))], names=["image", "y", "x", "label"])

    return held.select("path", "content").mapInArrow(run, CELL)


def method_of(path: str = "image") -> Column:
    """The folder a file is in: masks of methods to compare lie in a folder for each."""
    return F.element_at(F.split(F.col(path), "/"), -2)


def verified(expected: DataFrame, held: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """``expected`` (``key, digest``) with ``status``: present, missing, or changed by the SHA-256 of what ``held`` has."""
    found = held.select(F.col(key).alias("key__"), F.sha2("content", 256).alias("digest__"))
    joined = expected.join(found, F.col(key) == F.col("key__"), "left")
    status = F.when(F.col("digest__").isNull(), "missing").when(F.col("digest__") == F.lower(digest), "present").otherwise("changed")
    return joined.withColumn("status", status).drop("key__", "digest__")


def within_budget(listed: DataFrame, entries: int, size: int) -> DataFrame:
    """``listed`` (``path, length, modified``) with ``kept``: the newest files, at most ``entries`` of at most ``size`` bytes together."""
    from grainframe.operators.ordered import running_sums

    order = [F.col("modified").desc(), F.col("path")]
    placed = running_sums(listed.drop("content"), order, {"place": F.lit(1).cast("long"), "bytes": F.col("length")})
    return placed.withColumn("kept", (F.col("place") <= entries) & (F.col("bytes") <= size)).drop("place", "bytes")


def tiles_of(images: DataFrame, tile: int, per_image: int, seed: int, epoch: int) -> DataFrame:
    """``image, tile, y0, x0``: places of tiles of images (``image, height, width``), drawn anew each epoch, the same each time."""
    drawn = images.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    place = lambda side, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "image", "tile", F.lit(salt)), F.greatest(F.lit(1), F.col(side) - tile + 1)).cast("int")
    return drawn.select("image", "tile", place("height", "y").alias("y0"), place("width", "x").alias("x0"))


def tile_cells(cells: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Cells of each tile, with places of their own. Tiles of an image are few, so the join is on the image."""
    joined = cells.join(tiles, "image").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + tile) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + tile))
    return joined.select("image", "tile", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "label")


def crops(cells: DataFrame, values: DataFrame, keys: list[str], padding: int) -> DataFrame:
    """``keys, y, x, value, inside`` of the box of each label with ``padding`` around it: what a crop of it shows.

    Boxes are cut into blocks of cells, so a label meets the values of its own blocks by an equi-join.
    """
    from grainframe.operators.raster import component_statistics

    image = [k for k in keys if k != "label"]
    boxes = component_statistics(cells, keys).select(*keys, *((F.col(f"{c}0") - padding).alias(f"{c}_from") for c in "yx"), (F.col("y0") + F.col("height") - 1 + padding).alias("y_to"), (F.col("x0") + F.col("width") - 1 + padding).alias("x_to"))
    block = lambda c: F.floor(c / 64).cast("long")
    dealt = boxes.withColumn("by", F.explode(F.sequence(block(F.col("y_from")), block(F.col("y_to"))))).withColumn("bx", F.explode(F.sequence(block(F.col("x_from")), block(F.col("x_to")))))
    held = values.withColumns({"by": block(F.col("y")), "bx": block(F.col("x"))})
    joined = held.join(dealt, [*image, "by", "bx"]).where(F.col("y").between(F.col("y_from"), F.col("y_to")) & F.col("x").between(F.col("x_from"), F.col("x_to")))
    own = cells.select(*keys, "y", "x", F.lit(True).alias("inside"))
    return joined.select(*keys, "y", "x", "value").join(own, [*keys, "y", "x"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
