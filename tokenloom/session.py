"""Session helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that may be shipped to every executor. Larger ones take the shuffle route.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
#: The session setting for the bytes of an Arrow batch on its way to Python, and its value inside ``small_batches``.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one below the session's warehouse.

    Both are folders that every executor sees; a machine-local one would not be.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tokenloom-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the planner true sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, queries hand texts to Python in Arrow batches of BATCH_BYTES (one row at least), not of ten thousand rows.

    A batch is held by the executor and by the Python worker at once. A bound that the caller has set stays.
    """
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def python_workers(spark: SparkSession) -> int:
    """How many Python workers, each with its own copy of a broadcast, an executor runs at once: its cores."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        return context.defaultParallelism
    return int(context.getConf().get("spark.executor.cores", "8"))


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """True when ``df`` has few enough rows of ``row_bytes`` to be broadcast.

    Counts no further than the bound, so the check itself stays cheap.
    """
    limit = MAX_BROADCAST_BYTES if limit is None else limit
    max_rows = limit // max(1, row_bytes)
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check; without it the join shuffles both sides."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module's own, once nothing reads it any more."""
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def require_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None) -> None:
    """An error for a table past the broadcast bound: a caller may ask for a broadcast, not for an unbounded one."""
    if not fits_broadcast(df, row_bytes, limit):
        raise ValueError(f"the table is past the broadcast bound of {MAX_BROADCAST_BYTES if limit is None else limit} bytes")


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The Hadoop file system that serves ``path``."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """Write one small file."""
    stream = file_system(spark, path).create(hadoop_path(spark, path), True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's content, ``None`` where there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Put a small file in the place of the one before in one step: readers see the old one or the new one."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, fresh, content)
    context = spark.sparkContext
    rename = context._jvm.org.apache.hadoop.fs.Options.Rename
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path(spark, path).toUri(), context._jsc.hadoopConfiguration())
    files.rename(hadoop_path(spark, fresh), hadoop_path(spark, path), options)


#: The number of tasks small test files are spread over, if the caller sets it; by default rows stay where they are read.
INPUT_PARTITIONS = "tokenloom.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the number of tasks the caller named in ``tokenloom.inputPartitions``, whatever the input's size."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
