"""Problem 6: one surviving record per duplicate group, built from consistent bundles of fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats that may decide a bundle; any other value counts as unknown. This bounds the candidates of a group.
FORMATS = ("MP3", "FLAC", "WAV", "M4A", "AAC", "OGG", "OPUS", "WMA", "ALAC", "AIFF", "APE", "WV")
FAKE_ABOVE = 50.0

#: Fields that depend on each other are taken together or not at all.
BUNDLES = {
    "file": ("filepath", "filesize", "mtime", "mtime_ns", "quick_signature", "sha256", "id"),
    "stream": ("format", "bitrate", "samplerate", "channels", "bit_depth", "is_lossless"),
    "signal": ("audio_hash", "duration", "spectral_cutoff", "fake_lossless_confidence", "quality_score"),
    "tags": ("title", "artist", "album"),
}
#: Functional dependencies between bundles, as the columns in which chosen bundles must agree:
#: the file decides its format, the format decides whether it is lossless.
AGREE = ("fmt", "lossless")


def latest_scans(tracks: DataFrame, paths: DataFrame) -> DataFrame:
    """The latest row of each wanted filepath: last_scanned (NULL first), then id. No window, so hot paths pre-aggregate."""
    wanted = tracks.join(paths.select("filepath").distinct(), "filepath", "left_semi")
    row = F.struct(*[wanted[c] for c in dict.fromkeys(f for b in BUNDLES.values() for f in b)])
    return wanted.groupBy(F.col("filepath").alias("path")).agg(F.max_by(row, F.struct("last_scanned", "id")).alias("r")).select("r.*")


def _down(c: str) -> list[Column]:
    """High to low with NULL last, for a minimum."""
    v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return [v.isNull(), -v]


def _unknown(*cols: str) -> Column:
    """The number of fields without a value, to prefer the most complete."""
    return sum((F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 1).otherwise(0) for c in cols), F.lit(0))


def _order(bundle: str) -> Column:
    """Sort key whose minimum is the most trusted candidate of a bundle."""
    fake = F.coalesce(F.nanvl(F.col("fake_lossless_confidence"), F.lit(0.0)), F.lit(0.0)) > FAKE_ABOVE
    by_file = [fake, *_down("quality_score"), *_down("bitrate"), *_down("filesize"), F.col("filepath")]
    if bundle == "file":
        keys = by_file
    elif bundle == "tags":
        lost = sum((F.when(F.col(c).contains("�"), 1).otherwise(0) for c in BUNDLES["tags"]), F.lit(0))
        keys = [_unknown(*BUNDLES["tags"]), lost, *by_file]
    else:
        keys = [_unknown(*BUNDLES[bundle]), *by_file]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _filled(bundle: str) -> Column:
    return F.lit(len(BUNDLES[bundle])) - _unknown(*BUNDLES[bundle])


def choose_bundles(options: list[list[tuple]]) -> list[int]:
    """Branch and bound over the bundles' candidates, in their trust order.

    ``options[b]`` lists (agree_0, ..., agree_n, trust) of bundle b, best trust first. The first bundle's
    trust outweighs all others together. Chosen candidates must agree wherever both know a value.
    Returns an index per bundle; -1 where no candidate of that bundle fits.
    """
    best_from = [0.0] * (len(options) + 1)
    for b in range(len(options) - 1, -1, -1):
        best_from[b] = best_from[b + 1] + max((o[-1] for o in options[b]), default=0.0)
    best: tuple[float, list[int]] = (-1.0, [-1] * len(options))
    width = max((len(o[0]) - 1 for o in options if o), default=0)

    def go(b: int, fixed: list, total: float, picks: list[int]) -> None:
        nonlocal best
        if total + best_from[b] <= best[0]:
            return
        if b == len(options):
            best = (total, picks)
            return
        for i, o in enumerate(options[b]):
            if all(fixed[k] is None or o[k] is None or fixed[k] == o[k] for k in range(width)):
                go(b + 1, [o[k] if fixed[k] is None else fixed[k] for k in range(width)], total + o[-1], [*picks, i])
        go(b + 1, fixed, total, [*picks, -1])

    go(0, [None] * width, 0.0, [])
    return best[1]


def _picker(names: list[str]):
    """Batches of (group_id, opts, all) to the chosen bundles' fields, taken from the very lists the choice was made on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks: list[list[int | None]] = [[] for _ in BUNDLES]
            begin = 0
            for opts in batch.column(1).to_pylist():
                options, source = [], []
                for b in BUNDLES:
                    order = sorted(range(len(opts)), key=lambda i: opts[i][f"{b}_at"])
                    # completeness first, then the rank; the file bundle's rank outweighs all the rest
                    if b == "file":
                        trust = [1e6 * (len(order) - r) for r in range(len(order))]
                    else:
                        trust = [opts[i][f"{b}_known"] + (len(order) - r) / (len(order) + 1) for r, i in enumerate(order)]
                    options.append([(opts[i]["fmt"], opts[i]["lossless"], t) for i, t in zip(order, trust)])
                    source.append(order)
                for k, i in enumerate(choose_bundles(options)):
                    picks[k].append(begin + source[k][i] if i >= 0 else None)
                begin += len(opts)
            flat = batch.column(2).flatten()
            out = [batch.column(0)]
            for (b, fields), at in zip(BUNDLES.items(), picks):
                chosen = pc.struct_field(flat, b).take(pa.array(at, pa.int64()))
                out += [pc.struct_field(chosen, f) for f in fields]
            yield pa.record_batch(out, names=names)

    return run


def surviving_records(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """One surviving record per group, bundle by bundle.

    Members count once per group and only with a row in ``tracks`` (its latest scan). The file bundle
    follows: not suspected fake (confidence above 50; NULL is 0) first, then quality_score, bitrate,
    filesize high to low with NULL last, then filepath low to high. The other bundles are the most
    complete ones whose format and losslessness agree with it. Groups with no such member, or a NULL group_id,
    give no row; empty strings and NULL are unknown; ties cannot remain, as filepath is unique per group.

    Candidates are pre-aggregated: of those alike in the columns that constrain the choice only the most
    trusted can be in an optimum, so a group of any size comes down to at most 13 x 3 candidates, exactly.
    Result: group_id, and the fields of all bundles.
    """
    m = members.select("group_id", "filepath").filter("group_id IS NOT NULL AND filepath IS NOT NULL").distinct()
    fmt = F.upper(F.trim("format"))
    rows = m.join(latest_scans(tracks, m), "filepath").withColumns({"fmt": F.when(fmt.isin(*FORMATS), fmt), "lossless": F.col("is_lossless")})
    aggs = []
    for b, fields in BUNDLES.items():
        aggs += [F.min(_order(b)).alias(f"{b}_order"), F.min_by(F.struct(*fields), _order(b)).alias(b), F.min_by(_filled(b), _order(b)).alias(f"{b}_known")]
    few = rows.groupBy("group_id", *AGREE).agg(*aggs)
    packed = few.groupBy("group_id").agg(F.collect_list(F.struct(*AGREE, *(c for b in BUNDLES for c in (f"{b}_order", b, f"{b}_known")))).alias("all"))
    # Python gets ranks instead of sort keys, and the candidates in the same row: the list's order differs between evaluations
    for b in BUNDLES:
        packed = packed.withColumn(f"{b}_sorted", F.sort_array(F.col(f"all.{b}_order")))
    rank = lambda x, b: F.array_position(F.col(f"{b}_sorted"), x[f"{b}_order"]).alias(f"{b}_at")
    opts = F.transform("all", lambda x: F.struct(*(x[c].alias(c) for c in AGREE), *(c for b in BUNDLES for c in (rank(x, b), x[f"{b}_known"].alias(f"{b}_known")))))
    slim = packed.select("group_id", opts.alias("opts"), F.transform("all", lambda x: F.struct(*(x[b].alias(b) for b in BUNDLES))).alias("all"))
    kinds = dict(rows.dtypes)
    names = ["group_id", *(f for fs in BUNDLES.values() for f in fs)]
    return slim.mapInArrow(_picker(names), ", ".join(f"{n} {kinds[n]}" for n in names))


def records(spark, sf_dir: str) -> DataFrame:
    """p6_records: the whole surviving record of each group."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return surviving_records(read("group_members"), read("tracks"))


def found(spark, sf_dir: str) -> DataFrame:
    """p6_found: the surviving file of each group."""
    return records(spark, sf_dir).select("group_id", "filepath")


SQL = """
WITH m AS (SELECT DISTINCT group_id, filepath FROM group_members WHERE group_id IS NOT NULL AND filepath IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY last_scanned DESC NULLS LAST, id DESC) AS rn FROM tracks) WHERE rn = 1)
SELECT group_id, filepath FROM (
  SELECT m.group_id, m.filepath, row_number() OVER (PARTITION BY m.group_id ORDER BY
    coalesce(fake_lossless_confidence, 0) > 50, quality_score DESC NULLS LAST, bitrate DESC NULLS LAST, filesize DESC NULLS LAST, m.filepath) AS rn
  FROM m JOIN t USING (filepath)) WHERE rn = 1
"""
