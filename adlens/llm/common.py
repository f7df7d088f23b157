"""What several operators share: the shared folder, cutting lineage, row keys, table reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a temporary folder serves a session on one machine; on a
    cluster that is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="adlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; otherwise they lie on the executors' disks until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again, so that no later failure recomputes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_deleted(spark):
        df.write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found.written_at = path  # for discard()
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() or laid_out() wrote, when nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def laid_out(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written to the shared folder in buckets of a long key without nulls, and read again: a join on the key shuffles only
    the other side. The catalogue does not keep the table."""
    spark = df.sparkSession
    n, table_ = int(spark.conf.get("spark.sql.shuffle.partitions")), f"adlens_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table_)
    found = spark.table(table_)
    spark.sql(f"DROP TABLE {table_}")  # external: the files stay
    found.written_at = path
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that df has no column of, whatever the case."""
    taken, found, k = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def trimmed() -> None:
    """Gives a worker process's free memory back, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that hold per_task rows each, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)
