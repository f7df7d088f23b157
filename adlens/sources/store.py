"""What outlives a run: rows added by run, and tables that are replaced as a whole behind a pointer.

Both can be repeated: a run that is done again replaces its own rows, and a snapshot counts once its pointer is written,
so a run that dies halfway leaves what was there before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators import ads as A
from adlens.operators import resolve as R


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """K1: adds the rows of a run to a dataset; a run of the same name is replaced, the others stay as they are."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs' rows with their `run`."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn("run", F.col("run").cast("string"))


def version(spark: SparkSession, path: str) -> int:
    """The number of the snapshot that counts; 0 before the first."""
    try:
        return spark.read.schema("version int").parquet(f"{path}/pointer").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def snapshot(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """The table as the last snapshot has it, or as an earlier one had it; None before the first."""
    at = version(spark, path) if at is None else at
    return spark.read.parquet(f"{path}/v{at}") if at else None


def replace(df: DataFrame, path: str) -> int:
    """Writes df as the next snapshot and points at it; its number."""
    spark = df.sparkSession
    at = version(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{at}")
    spark.createDataFrame([(at,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return at


def upsert_aliases(incoming: DataFrame, path: str) -> DataFrame:
    """Merges incoming aliases (pos and the alias columns) into the stored ones, which become the next snapshot; the
    outcome of each key (added, filled, kept or conflict) with the row that counts now."""
    spark = incoming.sparkSession
    old = snapshot(spark, path)
    known = spark.createDataFrame([], incoming.schema).select("pos", *R.ALIAS_COLUMNS) if old is None else old.select("pos", *R.ALIAS_COLUMNS)
    merged = R.merge_aliases(known, incoming.select("pos", *R.ALIAS_COLUMNS))
    at = replace(merged.withColumn("pos", F.xxhash64("key")), path)
    return snapshot(spark, path, at)


def upsert_ads(incoming: DataFrame, path: str) -> DataFrame:
    """Ads of a run (as `ads.read_records` gives them) merged by id into the stored ones: what was seen first stays and is
    filled by later sights. Doing a run twice changes nothing."""
    spark = incoming.sparkSession
    old = snapshot(spark, path)
    seen = incoming.withColumn("turn", F.lit(version(spark, path) + 1))
    both = seen if old is None else old.select(*seen.columns).unionByName(seen)
    order = F.struct("turn", "pos").alias("pos")
    first = A.dedupe(both.select(*[order if c == "pos" else F.col(c) for c in both.columns]))
    flat = first.select(*[F.col("pos.pos").alias("pos") if c == "pos" else F.col(c) for c in first.columns])
    return snapshot(spark, path, replace(flat.select(*seen.columns), path))
