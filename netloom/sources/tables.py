"""Table readers and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of stored tables that still stand.
_stored: list[str] = []
#: Stored tables are long runs of keys, which Parquet packs to a few hundredths of what a hash table of their rows takes.
UNPACKED, FACTOR = "64.0", "spark.sql.sources.fileCompressionFactor"
#: Rows of one task in the joins of a large table, and with how many such tasks it counts as large.
TASK_ROWS, LARGE = 250_000, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut, and the reader has sizes and prunes columns."""
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As checkpointed(), with the folder, which remove() takes once nothing reads it any more."""
    path = new_folder(df.sparkSession)
    real_sizes(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def real_sizes(spark: SparkSession) -> None:
    """Plans of the session take Parquet for as large as its rows are in memory, so that no table of many rows is sent whole
    through the driver to all tasks; while a join runs, Spark still sends a side that proves small. A factor that the user
    has set stays."""
    if float(spark.conf.get(FACTOR)) == 1.0:
        spark.conf.set(FACTOR, UNPACKED)


def tasks_for(rows: DataFrame) -> int | None:
    """How many tasks the joins of a stored table are dealt over, so that a task's memory does not grow with the table; None
    for a table that Spark's own choice deals well. Spark deals anew what has fewer parts than shuffles have by default."""
    tasks = -(-rows.count() // TASK_ROWS)
    return max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if tasks > LARGE else None


def new_folder(spark: SparkSession) -> str:
    """A folder for one table in the shared folder."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes these stored tables, or all that still stand; call it when the results built on them are stored."""
    for path in paths or tuple(_stored):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _stored:
            _stored.remove(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a machine-local one is made only where all of Spark runs in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()
