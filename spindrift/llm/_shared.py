"""Helpers the training-data operators share: lineage cuts, input spreading, column guards."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder that ends
    with the process.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_ROOTS: list[str] = []


@atexit.register
def _clear() -> None:
    """Tables that results were still read from go with the application."""
    context = SparkContext._active_spark_context
    for root in _ROOTS:
        try:
            if context is not None:
                p = context._jvm.org.apache.hadoop.fs.Path(root)
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
            else:
                shutil.rmtree(root.removeprefix("file:"), True)
        except Exception:  # noqa: BLE001 - the cluster may be gone already
            return


class Cuts:
    """Written tables that cut the lineage of iterative jobs.

    Parquet in the shared folder instead of RDD checkpoints: it survives the loss of any executor
    alike, takes less disk, and gives the planner the true size of each intermediate table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self._count = 0
        self._live: dict[str, DataFrame] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spindrift_path = path
        self._live[path] = out
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_spindrift_path", None)
            if path and self._live.pop(path, None) is not None:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but those ``kept``, which the result is read from."""
        paths = {getattr(t, "_spindrift_path", None) for t in kept}
        self.drop(*[t for path, t in list(self._live.items()) if path not in paths])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all cores before a stage of heavy work: a scan that came in fewer partitions, or an aggregate, which may have been coalesced to one."""
    want = df.sparkSession.sparkContext.defaultParallelism
    scan = "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return df if scan and df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)


def word_codes(words: Sequence[str]) -> np.ndarray:
    """A 64-bit code of each word; every different word is hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    coded = pa.array(words, pa.string()).dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(t) for t in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[coded.indices.to_numpy()]


def bit_table(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Table of 2 ** bits bits in which each 64-bit hash sets the one of its leading bits.

    At most 2 ** (bits - 6) rows reach the driver, whatever the number of hashes; with very many the table fills up and thins less.
    """
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 AS int))")
    at = F.shiftright(F.shiftrightunsigned(column, 64 - bits), 6)
    rows = hashes.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("set")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def known_bits(hashes: DataFrame, column: str, bits: int):
    """The bit table as a broadcast variable."""
    return hashes.sparkSession.sparkContext.broadcast(bit_table(hashes, column, bits))


def known(c: str | Column) -> Column:
    """NULL for the empty string, which means unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
