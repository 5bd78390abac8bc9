"""The track table: its schema, and how older tables are brought to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.types import struct

TRACK = struct(
    "id bigint, filepath string, filesize bigint, mtime double, mtime_ns bigint, quick_signature string, sha256 string, audio_hash string, duration double, "
    "format string, bitrate int, samplerate int, channels int, bit_depth int, is_lossless boolean, spectral_cutoff double, fake_lossless_confidence double, "
    "spectral_assessment string, quality_score double, quality_details string, fingerprint array<bigint>, title string, artist string, album string, last_scanned timestamp"
)
RENAMED = {"is_fake_lossless": "fake_lossless_confidence", "fingerprint_raw": "fingerprint"}
DUPLICATE_TYPES = ("EXACT_HASH", "EXACT_AUDIO", "ACOUSTIC_DUPLICATE", "POSSIBLE_DUPLICATE", "LOW_CONFIDENCE_REVIEW", "NO_MATCH", "UNCERTAIN")
ASSESSMENTS = ("no_lossy_evidence", "suspected_transcode", "unknown", "not_analyzed")
ACTIONS = ("UNSET", "KEEP", "DELETE")


def conform(df: DataFrame) -> DataFrame:
    """A table of any earlier shape in the present schema: legacy columns renamed with their values, missing ones NULL, extra ones kept. Idempotent."""
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in TRACK.fields]
    return df.select(*own, *[c for c in df.columns if c not in TRACK.names])


def missing_columns(df: DataFrame) -> list[str]:
    return [n for n in TRACK.names if n not in df.columns]


def with_load_defaults(df: DataFrame) -> DataFrame:
    """Values a loaded row shows: NULL, 0 and '' alike give way to the defaults (0 Hz becomes 44,100 Hz)."""
    def default(c: str, v):
        zero = F.lit("") if isinstance(v, str) else F.lit(0)
        return F.coalesce(F.nullif(F.col(c), zero), F.lit(v)).alias(c)

    filled = {"samplerate": 44100, "channels": 2, "bit_depth": 16, "bitrate": 0, "duration": 0.0, "format": "", "quality_score": 0.0, "spectral_cutoff": 0.0, "fake_lossless_confidence": 0.0, "title": "", "artist": "", "album": "", "sha256": "", "audio_hash": "", "quick_signature": "", "quality_details": ""}
    ns = F.coalesce("mtime_ns", (F.col("mtime") * 1e9).cast("bigint")).alias("mtime_ns")
    out = []
    for c in df.columns:
        if c == "mtime_ns":
            out.append(ns)
        elif c == "is_lossless":
            out.append(F.coalesce(c, F.lit(False)).alias(c))
        elif c == "fingerprint":
            out.append(F.coalesce(c, F.array().cast("array<bigint>")).alias(c))
        elif c == "spectral_assessment":
            out.append(known_or(c, ASSESSMENTS, "unknown").alias(c))
        else:
            out.append(default(c, filled[c]) if c in filled else F.col(c))
    return df.select(*out)


def known_or(c: str, allowed, fallback: str):
    """An enumeration's value, or the safe one for anything else."""
    return F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(F.lit(fallback))


def latest(tracks: DataFrame) -> DataFrame:
    """The last scan of each file: last_scanned (NULL first), then id. A pre-aggregating max_by, no window."""
    row = F.struct(*tracks.columns)
    return tracks.filter("filepath IS NOT NULL").groupBy("filepath").agg(F.max_by(row, F.struct("last_scanned", "id")).alias("r")).select("r.*")
