"""Derived columns: names, sizes and durations as text, predicates over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_EXTENSIONS = (".mp3", ".flac", ".wav", ".m4a", ".aac", ".ogg", ".opus", ".wma", ".alac", ".aiff", ".ape", ".wv")
LOSSLESS_FORMATS = ("FLAC", "WAV", "ALAC", "AIFF", "APE", "WV", "DSD", "DFF", "DSF")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filename(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent(path: str | Column) -> Column:
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(filename(path), r"(?<=.)(\.[^.]+)$", 1))


def display_title(title="title", artist="artist", path="filepath") -> Column:
    """"artist - title", else the title, else the file's name without its extension."""
    t, a = F.nullif(_c(title), F.lit("")), F.nullif(_c(artist), F.lit(""))
    return F.when(t.isNotNull() & a.isNotNull(), F.concat(a, F.lit(" - "), t)).otherwise(F.coalesce(t, stem(path)))


def duration_text(seconds: str | Column) -> Column:
    s = F.coalesce(_c(seconds), F.lit(0.0)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def size_text(size: str | Column) -> Column:
    """KB below 1 MiB, else MB, with one decimal."""
    b = F.coalesce(_c(size), F.lit(0))
    return F.when(b < 1048576, F.format_string("%.1f KB", b / 1024.0)).otherwise(F.format_string("%.1f MB", b / 1048576.0))


def total_text(size: str | Column) -> Column:
    """A sum of sizes: B, KB, MB, GB or TB, whichever is the largest that leaves at least 1, with two decimals from GB on."""
    b = F.coalesce(_c(size), F.lit(0)).cast("double")
    steps = [(1 << 40, "%.2f TB"), (1 << 30, "%.2f GB"), (1 << 20, "%.1f MB"), (1 << 10, "%.1f KB")]
    out = F.format_string("%.0f B", b)
    for least, text in reversed(steps):
        out = F.when(b >= least, F.format_string(text, b / float(least))).otherwise(out)
    return out


def specs_text() -> Column:
    """Sample rate in kHz, bit depth and channels, of what is known."""
    hz = F.when(F.col("samplerate") > 0, F.format_string("%.1f kHz", F.col("samplerate") / 1000.0))
    return F.array_join(F.array_compact(F.array(hz, F.when(F.col("bit_depth") > 0, F.format_string("%d bit", "bit_depth")), F.when(F.col("channels") > 0, F.format_string("%d ch", "channels")))), " / ")


def plain_path(path: str | Column) -> Column:
    """Slashes of one kind, none doubled and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(_c(path), "\\", "/"), "/+", "/"), "(?<=.)/$", "")


def eta_text(seconds: str | Column) -> Column:
    s = _c(seconds).cast("long")
    return F.when(s < 60, F.format_string("~%ds", s)).when(s < 3600, F.format_string("~%dm", F.floor(s / 60))).otherwise(F.format_string("~%dh %dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)))


def prefix_pattern(folder: str) -> str | None:
    """LIKE pattern, escaped with ^, of all paths below a folder; None (everything) for an empty one."""
    p = folder.replace("\\", "/").rstrip("/")
    if not p:
        return None
    for ch in "^%_":
        p = p.replace(ch, "^" + ch)
    return p + "/%"


def below(path: str | Column, folder: str) -> Column:
    """True for paths below the folder; slashes of either kind, letters A-Z of either case."""
    p = folder.replace("\\", "/").rstrip("/")
    if not p:
        return F.lit(True)
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\\", "abcdefghijklmnopqrstuvwxyz/")
    return F.startswith(fold(_c(path)), fold(F.lit(p + "/")))


def holds(text: str, *cols: str) -> Column:
    """True if any column contains the text, in either case."""
    q = text.strip().lower()
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.contains(F.lower(_c(c)), F.lit(q)), F.lit(False))
    return out | F.lit(q == "")


def first_tag(tags: str | Column, *names: str) -> Column:
    """The first non-empty tag among aliases; keys of the map in either case."""
    low = F.map_from_entries(F.transform(F.map_entries(_c(tags)), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*[F.nullif(F.trim(F.element_at(low, F.lit(n.lower()))), F.lit("")) for n in names], F.lit(""))
