"""Intermediate tables in the folder that driver and executors share, and write-once revisions of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows that one task sorts or groups at a time; from there on shuffles have more partitions.
TASK_ROWS = 500_000

_OPEN: list["Workspace"] = []


def dealt(frame: DataFrame, rows: int, *by: Column | str) -> DataFrame:
    """``frame`` of ``rows`` rows dealt by ``by``, into as many partitions as keep a task's memory the same at any size."""
    if rows <= TASK_ROWS:
        return frame.repartition(*by)
    usual = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(usual, -(-rows // TASK_ROWS)), *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster executors couldn't read one, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="grainframe-"))
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Tables that cut lineage: each is written once as Parquet in the shared folder and read back.

    A lost executor costs the tasks it ran, never a table. ``drop`` frees tables that no later step reads; ``clear`` frees
    all of the process, once results have been written elsewhere.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grainframe/{label}-{uuid.uuid4().hex[:12]}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        frame.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def save_large(self, frame: DataFrame, name: str, rows: int) -> DataFrame:
        """Saves a frame whose shuffles take about ``rows`` rows, with more partitions than the session's where these are many."""
        conf, key = self.spark.conf, "spark.sql.shuffle.partitions"
        usual = conf.get(key)
        conf.set(key, str(max(int(usual), -(-rows // TASK_ROWS))))
        try:
            return self.save(frame, name)
        finally:
            conf.set(key, usual)

    def append(self, frame: DataFrame, name: str) -> None:
        """Adds rows to a table that ``read`` gives back whole, so that many steps leave one short plan."""
        frame.write.mode("append").parquet(self.path(name))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))


def clear() -> None:
    """Deletes all workspaces of this process. Frames that read them can't be used any more."""
    while _OPEN:
        work = _OPEN.pop()
        work._delete(work.root)


def write_revision(frame: DataFrame, folder: str, revision: str, format: str = "parquet") -> str:
    """A result under its revision; one that is there already is never replaced."""
    path = f"{folder}/revision={revision}"
    frame.write.mode("errorifexists").format(format).save(path)
    return path
