"""Intermediate results on shared storage: the checkpoint folder, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one key above which its rows are ranked in several tasks.
HOT = 100_000
_WRITTEN: list[str] = []


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master without one gets a temporary folder, which ends with the process."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spindrift-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of their own: lineage ends there, any executor may be lost, and the planner knows the true size. Deleted with the application."""
    path = f"{ensure_checkpoints(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_within(df: DataFrame, key: str, order: list[Column], hot: int = HOT, keys: DataFrame | None = None) -> DataFrame:
    """Adds ``rank``: the place of each row among those of its key, from 1.

    Keys of up to ``hot`` rows are ranked by a window. Larger ones are range-partitioned by the same order, so no task gets a whole key, and ranked inside each
    part from where the parts before it end. ``keys`` may name a cheaper table with at least as many rows of each key, to count them in.
    """
    inside = Window.partitionBy(key).orderBy(*order)
    sizes = (df if keys is None else keys).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(key)
    if not sizes.limit(1).count():
        return df.withColumn("rank", F.row_number().over(inside))
    big = written(sizes)
    parts = written(df.join(big, key, "left_semi").repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy(key, "part").agg(F.count("*").alias("n")).select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) + F.col("before")
    large = parts.join(offset, [key, "part"]).withColumn("rank", n.cast("int")).select(*df.columns, "rank")
    small = df.join(big, key, "left_anti").withColumn("rank", F.row_number().over(inside)).select(*df.columns, "rank")
    return written(small.unionByName(large))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores before a stage of heavy work: a scan that came in fewer partitions, or an aggregate, which may have been coalesced to one."""
    want = df.sparkSession.sparkContext.defaultParallelism
    scan = "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return df if scan and df.rdd.getNumPartitions() >= want else df.repartition(want)


@atexit.register
def _clear() -> None:
    context = SparkContext._active_spark_context
    for path in _WRITTEN if context is not None else ():
        try:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the cluster may be gone already
            return
