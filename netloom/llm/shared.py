"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import contextvars
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders of tables written in this process and not yet removed.
_written: list[str] = []
#: Where folders written in this context are noted besides, if anywhere.
noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder only where the session has none; a machine-local one only if all of Spark runs in this process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (sc.master.startswith("local") and "cluster" not in sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut, so that a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one table in the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for one table, which remove_written() removes."""
    path = f"{shared_folder(spark)}-{name.replace(' ', '-')}"
    _written.append(path)
    if (notes := noted.get()) is not None:
        notes.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder, with these options of the writer, and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def salted(big: DataFrame, small: DataFrame, on: str, by: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """big joined with the rows of small, one for each value of `on`: small is repeated, so that a value with a large part of big is dealt over `salts` tasks."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return left.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [on, "__salt"], how).drop("__salt")


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a long column __id for the key, and a table (__key, __id) if the key is no integer; rows with a null key go."""
    rows = docs.where(F.col(key).isNotNull())
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return rows.withColumn("__id", F.col(key).cast("long")), None
    keys = written(rows.select(F.col(key).alias("__key")).distinct().withColumn("__id", F.monotonically_increasing_id()), "keys")
    return rows.join(keys, F.col(key) == F.col("__key")).drop("__key"), keys


def remove_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes these tables of new_folder(), or all of them; call it when the results built on them are stored."""
    for path in list(_written if paths is None else paths):
        if path in _written:
            _written.remove(path)
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

