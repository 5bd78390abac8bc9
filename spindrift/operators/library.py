"""Library and quality views: filters, searches, orders, pages, totals, the quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import below, display_title, holds, filename

FAKE_ABOVE = 50.0
SORTS = {
    "title": [F.lower, "title"], "artist_album": [F.lower, "artist", "album"], "score": [None, "quality_score"], "bitrate": [None, "bitrate"], "size": [None, "filesize"], "duration": [None, "duration"],
}


def in_folder(tracks: DataFrame, folder: str) -> DataFrame:
    return tracks.filter(below("filepath", folder))


def search(tracks: DataFrame, text: str, fmt: str | None = None) -> DataFrame:
    hit = holds(text, filename("filepath"), F.col("title"), F.col("artist"), F.col("album"), F.col("format")) if text else F.lit(True)
    return tracks.filter(hit & (F.upper("format") == fmt.upper() if fmt else F.lit(True)))


def _conf() -> Column:
    return F.coalesce("fake_lossless_confidence", F.lit(0.0))


def quality_tab(tracks: DataFrame, name: str) -> DataFrame:
    lossless, n = F.coalesce("is_lossless", F.lit(False)), lambda c: F.coalesce(c, F.lit(0))
    rule = {"all": F.lit(True), "fake": _conf() > FAKE_ABOVE, "lossless": lossless & (_conf() <= FAKE_ABOVE), "low": ~lossless & ~(n("bitrate") >= 192), "hires": ~((n("samplerate") < 48000) & (n("bit_depth") <= 16))}
    return tracks.filter(rule[name])


def quality_search(tracks: DataFrame, text: str) -> DataFrame:
    return tracks.filter(holds(text, filename("filepath"), F.col("title"), F.col("artist"), F.col("format"), F.col("quality_details")))


def quality_ordered(tracks: DataFrame, tab: str) -> DataFrame:
    """The fake tab by confidence, high to low; the others by score, low to high."""
    return tracks.orderBy(F.desc_nulls_last("fake_lossless_confidence") if tab == "fake" else F.asc_nulls_last("quality_score"), F.asc_nulls_first("filepath"), "id")


def diagnosis() -> Column:
    """A label by the first rule that fits."""
    lossless, rate = F.coalesce("is_lossless", F.lit(False)), F.coalesce("bitrate", F.lit(0))
    return (
        F.when(lossless & (_conf() > FAKE_ABOVE), "fake_lossless").when(lossless & (F.coalesce("samplerate", F.lit(0)) >= 88200), "hi_res").when(lossless & (F.coalesce("bit_depth", F.lit(0)) > 16), "hi_res")
        .when(lossless, "lossless").when(rate >= 256, "high_bitrate").when(rate >= 192, "medium_bitrate").otherwise("low_bitrate")
    )


def ordered(df: DataFrame, mode: str, tie: str = "filepath") -> DataFrame:
    fold, *cols = SORTS[mode]
    keys = [F.lower(c) for c in cols] if fold else [F.desc_nulls_last(c) for c in cols]
    return df.orderBy(*keys, tie, "id") if "id" in df.columns else df.orderBy(*keys, tie)


def page(df: DataFrame, number: int, size: int, total: int | None = None) -> DataFrame:
    """A page of an ordered table, from 0; numbers beyond the last page give the last one when ``total`` is known."""
    if total is not None:
        number = min(number, max(0, (total - 1) // size))
    return df.offset(max(0, number) * size).limit(size)


def format_stats(tracks: DataFrame) -> DataFrame:
    """Files and bytes by format; unknown ones together, either case together."""
    f = F.upper(F.coalesce(F.nullif("format", F.lit("")), F.lit("UNKNOWN")))
    return tracks.groupBy(f.alias("format")).agg(F.count("*").alias("files"), F.coalesce(F.sum("filesize"), F.lit(0)).cast("bigint").alias("bytes"))


def top_formats(tracks: DataFrame, k: int = 5) -> DataFrame:
    return format_stats(tracks).orderBy(F.desc("files"), "format").limit(k)


def quality_kpis(tracks: DataFrame) -> DataFrame:
    lossless = F.coalesce("is_lossless", F.lit(False))
    return tracks.agg(
        F.count("*").alias("tracks"), F.coalesce(F.sum("filesize"), F.lit(0)).cast("bigint").alias("bytes"), F.avg(F.when(F.col("quality_score") > 0, F.col("quality_score"))).alias("average_score"),
        F.count_if(lossless & (_conf() <= FAKE_ABOVE)).alias("true_lossless"), F.count_if(_conf() > FAKE_ABOVE).alias("fake_lossless"), F.count_if(~lossless & (F.col("bitrate") > 0) & (F.col("bitrate") < 192)).alias("low_bitrate"),
    )


def quality_score() -> Column:
    """Score before rounding: container, bitrate, depth and rate; a suspected transcode loses by its confidence. 5 to 100."""
    lossless, conf = F.coalesce("is_lossless", F.lit(False)), _conf()
    fake = (F.coalesce("spectral_assessment", F.lit("unknown")) == "suspected_transcode") | (conf > FAKE_ABOVE)
    fmt, rate = F.upper(F.coalesce("format", F.lit(""))), F.coalesce("bitrate", F.lit(0))
    share = conf / 100.0
    container = F.when(lossless & fake, F.greatest(F.lit(10.0), 45.0 - share * 35.0)).when(lossless, 45.0).when(fmt.isin("AAC", "M4A", "OGG", "OPUS"), 32.0).when(fmt == "MP3", 28.0).otherwise(20.0)
    stream = F.when(lossless & fake, F.greatest(F.lit(5.0), 30.0 - share * 18.8)).when(lossless, 30.0).otherwise(F.when(rate > 0, F.least(F.lit(320), rate)).otherwise(128) / 320.0 * 28.0)
    bits, hz = F.coalesce("bit_depth", F.lit(0)), F.coalesce("samplerate", F.lit(0))
    depth = F.when(bits >= 24, 8.0).when(bits == 16, 5.0).otherwise(0.0)
    sampling = F.when(hz >= 96000, 7.0).when(hz >= 48000, 5.0).when(hz >= 44100, 4.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(5.0), container + stream + depth + sampling))


def cutoff_and_confidence() -> Column:
    """struct(cutoff_hz, confidence) as older callers expect it: the found cutoff, or 16 kHz, of a suspected transcode; half the sample rate of a clean one; else 0."""
    a, hz = F.col("spectral_assessment"), F.coalesce(F.col("samplerate"), F.lit(0)) / 2.0
    found = F.coalesce(F.nullif("spectral_cutoff", F.lit(0.0)), F.lit(16000.0))
    pair = lambda x, y: F.struct(x.cast("double").alias("cutoff_hz"), y.cast("double").alias("confidence"))
    return F.when(a == "suspected_transcode", pair(found, _conf())).when(a == "no_lossy_evidence", pair(hz, F.lit(0))).otherwise(pair(F.lit(0), F.lit(0)))


def quality_details() -> Column:
    lossless = F.coalesce("is_lossless", F.lit(False))
    return F.array_join(F.array_compact(F.array(
        F.when(lossless & (_conf() > FAKE_ABOVE), "suspected transcode").when(lossless, "lossless").otherwise(F.upper(F.coalesce("format", F.lit("")))),
        F.when(~lossless & (F.col("bitrate") > 0), F.format_string("%d kbps", "bitrate")), F.when(F.col("bit_depth") > 0, F.format_string("%d bit", "bit_depth")), F.when(F.col("samplerate") > 0, F.format_string("%d Hz", "samplerate")),
    )), " • ")


def titled(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("display_title", display_title())
