"""Sources and sinks: audio folders, sessions, manifests, reports, synthetic libraries."""

from __future__ import annotations

import json
import os
import random
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import replace_file
from ..functions.columns import AUDIO_EXTENSIONS, LOSSLESS_FORMATS, extension
from ..functions.kernels import file_signature

FILES = "filepath string, filesize bigint, modified timestamp"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder. Contents are not read: only listing columns are selected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return raw.select(path.alias("filepath"), F.col("length").alias("filesize"), F.col("modificationTime").alias("modified")).filter(extension("filepath").isin(*AUDIO_EXTENSIONS) & (F.col("filesize") > 0))


def _stat(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for p in pdf["filepath"]:
            try:
                st = os.stat(p)
                rows.append((p, st.st_size, st.st_mtime_ns, file_signature(p)))
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["filepath", "new_size", "new_mtime_ns", "new_signature"])


def stat_files(files: DataFrame) -> DataFrame:
    """Size, modification time in ns and quick signature of each file; unreadable and vanished ones drop out."""
    return files.select("filepath").mapInPandas(_stat, "filepath string, new_size bigint, new_mtime_ns bigint, new_signature string")


def metadata_rules(df: DataFrame) -> DataFrame:
    """Format and losslessness from extension and codec; bit rates over 1000 are in bit/s; lossless ones without a bit rate get it from size and duration."""
    ext = F.upper(F.regexp_replace(extension("filepath"), r"^\.", ""))
    codec = F.lower(F.coalesce("codec", F.lit("")))
    fmt = F.when(codec.contains("flac"), "FLAC").when(codec.contains("mp3"), "MP3").when(codec.contains("wav"), "WAV").when(codec.contains("ogg"), "OGG").when(codec.contains("mp4"), "M4A").otherwise(ext)
    lossless = F.when(codec.contains("mp3"), False).when(codec.contains("flac") | codec.contains("wav"), True).otherwise(ext.isin(*LOSSLESS_FORMATS))
    rate = F.when(F.col("bitrate") > 1000, F.floor(F.col("bitrate") / 1000)).otherwise(F.col("bitrate")).cast("int")
    rate = F.when(lossless & (F.coalesce(rate, F.lit(0)) == 0) & (F.col("duration") > 0), F.floor(F.col("filesize") * 8 / (F.col("duration") * 1000)).cast("int")).otherwise(rate)
    return df.withColumns({"format": fmt, "is_lossless": lossless, "bitrate": rate})


def _fingerprint(seconds: float, timeout: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shutil.which("fpcalc")
        for pdf in parts:
            rows = []
            for p in pdf["filepath"]:
                if not tool:
                    rows.append((p, None, None, "fpcalc is not installed"))
                    continue
                try:
                    got = json.loads(subprocess.run([tool, "-raw", "-json", "-length", f"{seconds:g}", p], capture_output=True, timeout=timeout, check=True).stdout)
                    rows.append((p, float(got["duration"]), [int(x) & 0xFFFFFFFF for x in got["fingerprint"]], None))
                except (OSError, ValueError, KeyError, subprocess.SubprocessError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filepath", "duration", "fingerprint", "error"])

    return run


def fingerprints(files: DataFrame, *, seconds: float = 60.0, timeout: float = 30.0) -> DataFrame:
    """Fingerprints by the external tool: filepath, duration, fingerprint, error. A missing tool and every failure are named in ``error``, with a NULL fingerprint."""
    return files.select("filepath").mapInPandas(_fingerprint(seconds, timeout), "filepath string, duration double, fingerprint array<bigint>, error string")


def eligibility(tracks: DataFrame, min_duration: float = 5.0, spectral: bool = True) -> DataFrame:
    """Adds wants_fingerprint (before the duration is known, or long enough), keeps_fingerprint (long enough in the end) and wants_spectrum (lossless, if asked)."""
    d = F.coalesce("duration", F.lit(0.0))
    return tracks.withColumns({"wants_fingerprint": (d <= 0) | (d >= min_duration), "keeps_fingerprint": d >= min_duration, "wants_spectrum": F.lit(spectral) & F.coalesce("is_lossless", F.lit(False))})


MEMBER = "struct<filepath:string,filesize:bigint,bitrate:int,quality_score:double,action:string>"
SESSION = f"folder string, groups array<struct<group_id:string,primary_type:string,best_track_path:string,best_track_reason:string,average_similarity:double,space_saving_bytes:bigint,requires_manual_review:boolean,tracks:array<{MEMBER}>>>"


def save_session(groups: DataFrame, folder: str, path: str) -> bool:
    """Write a session document (an application file of one user's groups) beside the old one and swap them; the old one stays as .bak."""

    def write(f) -> None:
        f.write('{"folder": ' + json.dumps(folder) + ', "groups": [')
        for i, r in enumerate(groups.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            f.write((", " if i else "") + r.j)
        f.write("]}")
        if os.path.exists(path):
            shutil.copy2(path, f"{path}.bak")

    try:
        replace_file(path, write)
        return True
    except OSError:
        return False


def load_session(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a saved session with at least two tracks; the backup if the document is unreadable, else none."""
    for p in (path, f"{path}.bak"):
        try:
            with open(p, encoding="utf-8") as f:
                if not isinstance(json.load(f), dict):
                    continue
        except (OSError, ValueError):
            continue
        doc = spark.read.schema(SESSION).option("multiLine", True).json(p)
        g = doc.select("folder", F.explode("groups").alias("g")).select("folder", "g.*").filter(F.size("tracks") >= 2)
        return g.withColumn("requires_manual_review", F.coalesce("requires_manual_review", F.lit(False)) | F.col("primary_type").isin("POSSIBLE_DUPLICATE", "LOW_CONFIDENCE_REVIEW"))
    return spark.createDataFrame([], SESSION).select("folder", F.explode("groups").alias("g")).select("folder", "g.*")


def clean_temporary(folder: str) -> int:
    old = [f for f in os.listdir(folder) if f.endswith(".json.tmp")]
    for f in old:
        os.remove(os.path.join(folder, f))
    return len(old)


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema("track_a_path string, track_b_path string, expected_category string, note string").option("header", True).option("enforceSchema", False).csv(path)
    df = df.filter((F.trim("track_a_path") != "") & (F.trim("track_b_path") != ""))
    return df.limit(limit) if limit else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A report as CSV with a header. One file only when asked: a report of a person's size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


#: Headers of the reports.
REPORT_HEADER = ("Grupo ID", "Tipo Duplicado", "Acción Recomendada", "Ruta Archivo", "Formato", "Bitrate", "Duración", "Tamaño bytes", "Puntaje Calidad", "Razón")
DELETION_HEADER = ("Timestamp", "Operación", "Archivo", "Estado", "Resultado", "Detalles")


def report_rows(groups: DataFrame, members: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per member for the report, under ``REPORT_HEADER``: what to do with it, its facts, and the reason beside the best."""
    from ..operators.journal import cli_label

    g = groups.select("group_id", "primary_type", "best_track_path", "best_track_reason", F.coalesce("requires_manual_review", F.lit(False)).alias("requires_manual_review"))
    t = tracks.select("filepath", "format", "bitrate", "duration", "filesize", "quality_score")
    rows = members.filter("filepath IS NOT NULL").select("group_id", "filepath").distinct().join(g, "group_id").join(t, "filepath")
    rows = rows.withColumn("is_best", F.coalesce(F.col("filepath") == F.col("best_track_path"), F.lit(False)))
    out = ("group_id", "primary_type", cli_label(), "filepath", "format", "bitrate", "duration", "filesize", "quality_score", F.when(F.col("is_best"), F.col("best_track_reason")).otherwise(""))
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(h) for c, h in zip(out, REPORT_HEADER)])


def deletion_log(journal: DataFrame) -> DataFrame:
    """One row per state that an operation took, under ``DELETION_HEADER``."""
    done = F.when(F.col("state") == "COMPLETED", "OK").when(F.col("state").isin("FAILED", "ABORTED"), "ERROR").otherwise("")
    out = ("updated_at", "action", "filepath", "state", done, F.coalesce("target_path", F.lit("")))
    return journal.filter("op_id IS NOT NULL").distinct().select(*[(F.col(c) if isinstance(c, str) else c).alias(h) for c, h in zip(out, DELETION_HEADER)])


def inventory(files: DataFrame, root: str) -> DataFrame:
    """relative_path, parent ("(raíz)" for the root), name, suffix of each file below ``root``."""
    from ..functions.columns import below, filename, parent

    rel = F.substring(F.col("filepath"), len(root.rstrip("/")) + 2, 1 << 20)
    up = parent(rel)
    return files.filter(below("filepath", root)).select(rel.alias("relative_path"), F.when(up == "", "(raíz)").otherwise(up).alias("parent"), filename(rel).alias("name"), extension(rel).alias("suffix"))


#: Scenarios of synthetic libraries: name prefix, frames of a track, size and duration; and of clusters: share, sizes, replaced frames.
SCENARIOS = {
    "A": {"prefix": "track_A", "single": (80, 10_000_000, 180.0)},
    "B": {"prefix": "song_B", "single": (80, 12_000_000, 210.0), "cluster": (100, 15_000_000, 200.0), "share": 0.25, "sizes": (2, 4), "replaced": (2, 5)},
    "C": {"prefix": "dense_C", "cluster": (100, 20_000_000, 190.0), "share": None, "sizes": (10, 15), "replaced": (1, 4)},
    "D": {"prefix": "adv_D", "single": (70, 10_000_000, 180.0), "common": [0x5555AAAA + k for k in range(10)]},
}


def scenario(name: str, n: int, seed: int = 42) -> tuple[list[tuple[str, int, float, list[int]]], list[tuple[str, str]]]:
    """A seeded synthetic library (A: no duplicates, B: a normal library, C: dense clusters, D: frames that all share) and its true pairs.

    Rows: filepath, filesize, duration, fingerprint. The draws follow one fixed order, so counts can be compared across engines.
    """
    rng, s = random.Random(seed), SCENARIOS[name]
    frame = lambda: rng.randint(1, 0x7FFFFFFF)
    rows: list[tuple[str, int, float, list[int]]] = []
    pairs: list[tuple[str, str]] = []

    def add(kind: str, frames: list[int]) -> None:
        _, size, seconds = s[kind]
        rows.append((f"{s['prefix']}_{len(rows):06d}.flac", size + len(rows), seconds, frames))

    while len(rows) < n:
        clustered = "cluster" in s and (s["share"] is None or rng.random() < s["share"] and n - len(rows) >= 2)
        if not clustered:
            add("single", s.get("common", []) + [frame() for _ in range(s["single"][0])])
            continue
        first, k = len(rows), min(rng.randint(*s["sizes"]), n - len(rows))
        base = [frame() for _ in range(s["cluster"][0])]
        for _ in range(k):
            copy = base.copy()
            for _ in range(rng.randint(*s["replaced"])):
                value_at = (frame(), rng.randint(0, len(base) - 1))
                copy[value_at[1]] = value_at[0]
            add("cluster", copy)
        paths = [r[0] for r in rows[first:]]
        pairs += [(a, b) for i, a in enumerate(paths) for b in paths[i + 1 :]]
    return rows, pairs
