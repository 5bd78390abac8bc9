"""Incremental rescans: which files changed, and the new version of the track table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import latest


def is_hit(sig_new: str = "new_signature", sig_old: str = "quick_signature") -> Column:
    """Size and modification time (ns) are as stored, and so is the signature unless none was stored."""
    return F.coalesce((F.col("new_size") == F.col("filesize")) & (F.col("new_mtime_ns") == F.col("mtime_ns")) & ((F.coalesce(sig_old, F.lit("")) == "") | (F.col(sig_new) == F.col(sig_old))), F.lit(False))


def is_hit_by_time() -> Column:
    """The older rule: size equal and modification time within a millisecond."""
    return F.coalesce((F.col("new_size") == F.col("filesize")) & (F.abs(F.col("new_mtime") - F.col("mtime")) < 0.001), F.lit(False))


def partition_by_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files: filepath, new_size, new_mtime_ns, new_signature. Adds cache_hit; only four columns of the cache are read."""
    slim = cache.select("filepath", "filesize", "mtime_ns", "quick_signature")
    return files.join(slim, "filepath", "left").withColumn("cache_hit", is_hit()).select(*files.columns, "cache_hit")


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return partition_by_cache(files, cache).filter(~F.col("cache_hit")).drop("cache_hit")


def lookup(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("filepath").distinct(), "filepath", "left_semi")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The next version: new rows replace those of their filepath and keep its id. Of several new rows the latest counts."""
    fresh = latest(new)
    ids = cache.select("filepath", F.col("id").alias("old_id"))
    fresh = fresh.join(ids, "filepath", "left").withColumn("id", F.coalesce("old_id", "id")).drop("old_id")
    return cache.join(fresh.select("filepath"), "filepath", "left_anti").unionByName(fresh.select(*cache.columns))


def fitted(rows: DataFrame, schema) -> DataFrame:
    """Rows in the table's columns: those they lack are NULL, mtime comes from ``modified``, and last_scanned is now where it is not known."""
    have = set(rows.columns)
    if "mtime" not in have and "modified" in have:
        rows = rows.withColumns({"mtime": F.col("modified").cast("double"), "mtime_ns": (F.unix_micros("modified") * 1000)})
        have |= {"mtime", "mtime_ns"}
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    out = rows.select(*cols)
    return out.withColumn("last_scanned", F.coalesce("last_scanned", F.current_timestamp().cast(out.schema["last_scanned"].dataType)))


def remove(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("filepath").distinct(), "filepath", "left_anti")


def write_version(df: DataFrame, root: str, version: int, files: int | None = None) -> str:
    """Each version is a folder of its own; readers of the previous one are not disturbed. ``files`` compacts."""
    path = f"{root}/v{version:08d}"
    (df.coalesce(files) if files else df).write.mode("errorifexists").parquet(path)
    return path


def cleared(cache: DataFrame) -> DataFrame:
    """The empty next version."""
    return cache.limit(0)


def stored_size(spark, path: str) -> int:
    """Bytes of a written version, from the listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def progress(found: str = "found", scanned: str = "scanned", seconds: str = "seconds") -> list[Column]:
    """progress_percent (0 to 100), files_per_second and eta_seconds of a scan; 0 where nothing can be said."""
    f, s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in (found, scanned, seconds))
    speed = F.when((t > 0) & (s > 0), s / t).when((t > 0) & (f > 0), f / t).otherwise(0.0)
    return [
        F.when(f > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), s / f * 100.0))).otherwise(0.0).alias("progress_percent"), speed.alias("files_per_second"),
        F.when((speed > 0) & (f > s) & (s > 0), (f - s) / speed).otherwise(0.0).alias("eta_seconds"),
    ]


def scan_counters(status: DataFrame) -> DataFrame:
    """status: one row per file with 'hit', 'done' or 'failed'."""
    s = F.col("status")
    return status.agg(F.count("*").alias("found"), F.count_if(s == "hit").alias("from_cache"), F.count_if(s.isin("hit", "done")).alias("scanned"), F.count_if(s == "failed").alias("failed"))
