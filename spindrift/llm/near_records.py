"""Problem 5: near-duplicate records by probability-Jaccard sketches, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Cuts, spread

#: 32 bands of 2 registers: of pairs alike by 0.5, one in 10,000 shares no band; above that, fewer.
BANDS, ROWS = 32, 2
SEED = 0x5EED
#: A cell is this part of the greatest distance of positions; so many cells make a block, and classes meet within a block.
REACH, BLOCK = 2, 16


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: 64 well-mixed bits of each 64-bit integer."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prob_minhash(values: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int, registers: int, seed: int = SEED) -> np.ndarray:
    """ProbMinHash sketches of weighted sets, all rows at once.

    ``values[i]`` with ``weights[i]`` > 0 belongs to record ``row[i]``; a value stands at most once per record.
    Each element is a Poisson process of rate ``weight``: its arrivals come at exponential gaps and each hits a
    uniformly drawn register; a register keeps the element of its earliest arrival, so two records agree in a
    register with the probability Jaccard similarity of their weights. An element ends as soon as its next
    arrival is later than every register of its record. Returns uint64 [rows, registers].
    """
    first = np.full(rows * registers, np.inf)
    kept = np.zeros(rows * registers, dtype=np.uint64)
    live = np.flatnonzero(weights > 0)
    v = _mix(values[live].astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    r, w, t, step = row[live].astype(np.int64), weights[live].astype(float), np.zeros(len(live)), 0
    with np.errstate(over="ignore"):
        while len(v):
            step += 1
            bits = _mix(v + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
            t = t + gap / w
            slot = r * registers + (_mix(bits) % np.uint64(registers)).astype(np.int64)
            better = t < first[slot]
            np.minimum.at(first, slot[better], t[better])
            won = better & (t == first[slot])
            kept[slot[won]] = v[won]
            last = first.reshape(rows, registers).max(axis=1)
            go = t < last[r]
            v, r, w, t = v[go], r[go], w[go], t[go]
    return kept.reshape(rows, registers)


def _lists(batch: pa.RecordBatch, v: str, w: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, weight) of all elements of a batch; a NULL weight list stands for weights of 1."""
    vs, ws = batch.column(batch.schema.get_field_index(v)), batch.column(batch.schema.get_field_index(w))
    counts = np.diff(vs.offsets.to_numpy())
    row = np.repeat(np.arange(len(batch)), counts)
    values = vs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weights = np.ones(len(values))
    given = np.asarray(ws.is_valid())
    if given.any():
        weights[given[row]] = ws.flatten().to_numpy(zero_copy_only=False)
    return row, values, weights


def _band_rows(bands: int, width: int, seed: int):
    """Classes to one row per band and place: key, cls, total, cell, beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            row, values, weights = _lists(batch, "v", "w")
            sketch = prob_minhash(values.view(np.uint64), weights, row, n, bands * width, seed).reshape(n, bands, width)
            places = batch.column(batch.schema.get_field_index("cells"))
            at = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
            cell = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            block, beyond = cell // BLOCK, np.zeros(len(cell), dtype=bool)
            # near the end of its block a class also stands in the next one, to meet the classes there
            last = np.flatnonzero(cell % BLOCK >= BLOCK - REACH)
            at, cell = np.concatenate([at, at[last]]), np.concatenate([cell, cell[last]])
            block, beyond = np.concatenate([block, block[last] + 1]), np.concatenate([beyond, np.ones(len(last), dtype=bool)])
            with np.errstate(over="ignore"):
                h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, axis=0)
                for k in range(width):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, k])
                key = _mix(h[at] + _mix(block.view(np.uint64))[:, None])
            each = lambda c: pa.array(np.repeat(c, bands))
            col = lambda c: batch.column(batch.schema.get_field_index(c)).take(each(at))
            yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), col("cls"), col("total"), each(cell.astype(np.int32)), each(beyond)], names=["key", "cls", "total", "cell", "beyond"])

    return run


def similar_sets(classes: DataFrame, *, bands: int = BANDS, rows: int = ROWS, threshold: float, seed: int = SEED) -> DataFrame:
    """Pairs of classes whose weighted Jaccard similarity (sum of minima over sum of maxima) reaches ``threshold``.

    ``classes``: one row per cls with v array<long>, w array<double> (NULL: all 1), total weight, and cells, the different
    cells of its rows' positions; no value twice in a row. Candidates share at least one band in cells at most ``REACH`` apart.
    The key of a band holds a block of cells, so classes of far positions never meet, and totals and cells are compared inside the
    join: only pairs that may reach the threshold leave it. A band that very many classes share is one key of a plain join of two
    exchanges, which adaptive execution splits. Every candidate is verified on the whole sets. Result: cls_a < cls_b, similarity.
    """
    slots = "key long, cls long, total double, cell int, beyond boolean"
    keys = spread(classes.select("cls", "v", "w", "total", "cells")).mapInArrow(_band_rows(bands, rows, seed), slots)
    may = (
        (F.col("a.cls") < F.col("b.cls")) & ~(F.col("a.beyond") & F.col("b.beyond")) & (F.abs(F.col("a.cell") - F.col("b.cell")) <= REACH)
        & (F.least("a.total", "b.total") >= F.greatest("a.total", "b.total") * (threshold - 1e-9))
    )
    met = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & may)
    pairs = met.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()
    side = lambda s: classes.select(F.col("cls").alias(f"cls_{s}"), F.col("v").alias(f"v{s}"), F.col("w").alias(f"w{s}"))
    both = pairs.join(side("a"), "cls_a").join(side("b"), "cls_b")
    return both.mapInArrow(_verify(threshold), "cls_a long, cls_b long, similarity double")


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            parts = [_lists(batch, f"v{x}", f"w{x}") for x in "ab"]
            total = [np.bincount(r, w, n) for r, _, w in parts]
            row = np.concatenate([p[0] for p in parts])
            v, w = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            order = np.lexsort((v, row))
            row, v, w = row[order], v[order], w[order]
            same = (row[1:] == row[:-1]) & (v[1:] == v[:-1])
            part = np.bincount(row[1:][same], np.minimum(w[1:], w[:-1])[same], n)
            sim = part / np.maximum(total[0] + total[1] - part, 1e-300)
            keep = sim >= threshold - 1e-12
            cols = [batch.column(batch.schema.get_field_index(c)).filter(pa.array(keep)) for c in ("cls_a", "cls_b")]
            yield pa.record_batch([*cols, pa.array(sim[keep])], names=["cls_a", "cls_b", "similarity"])

    return run


def near_duplicates(
    records: DataFrame, id_col: str, values: Column, *, weights: Column | None = None, position: Column | None = None, within: float | None = None,
    threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group near-duplicate records of weighted sets.

    ``values``: array<long> of each row without repeated values; with ``weights`` an array<double> beside it, else each counts 1.
    Rows with equal sets form one class and are sketched and compared once. With ``position`` and ``within``, records are alike only when
    their positions are known and differ by at most ``within``.
    NULL sets, NULL ids and empty sets take no part; sets of one value are compared like any other; a repeated id
    is a record of its own each time it stands with another set.
    Returns (members: id, cls, position; links: cls_a, cls_b, similarity, with cls_a < cls_b;
    copies: cls of every class with several rows).
    """
    cuts = Cuts(records.sparkSession)
    place = position if position is not None else F.lit(0.0)
    rows_in = records.select(records[id_col].alias("id"), (F.sort_array(values) if weights is None else values).alias("v"), (weights if weights is not None else F.lit(None).cast("array<double>")).alias("w"), place.cast("double").alias("position"))
    rows_in = rows_in.filter("id IS NOT NULL AND size(v) > 0")
    if weights is not None:
        # pairs in the order of the values, whatever order they came in; weights of 1 are left out
        both = F.array_sort(F.arrays_zip("v", "w"))
        rows_in = rows_in.withColumn("z", both).withColumns({"v": F.col("z.v"), "w": F.when(F.exists("z", lambda x: x["w"] != 1.0), F.col("z.w"))}).drop("z")
    if position is not None:
        rows_in = rows_in.filter("position IS NOT NULL AND NOT isnan(position)")
    cell = F.floor(F.col("position") / F.lit(within / REACH * (1 + 1e-9))).cast("int") if position is not None and within else F.lit(0)
    # a 64-bit hash names a set; a second one shows whether two sets ever share it
    digest = [F.xxhash64("v", "w", F.lit(k)) for k in (seed, seed + 1)]
    total = F.when(F.col("w").isNull(), F.size("v").cast("double")).otherwise(F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    named = rows_in.select("id", "position", digest[0].alias("cls"), digest[1].alias("check"), "v", "w", total.alias("total"), cell.alias("cell"))
    members = cuts.write(named.select("id", "cls", "position", "cell", "check"))
    # cells are as many as positions are apart, not as rows are many
    facts = members.groupBy("cls").agg(F.collect_set("cell").alias("cells"), F.count("*").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    facts = cuts.write(facts)
    if facts.filter("c0 <> c1").limit(1).count():
        raise RuntimeError("two different sets share a 64-bit hash: choose another seed")
    sets = named.select("cls", "v", "w", "total").dropDuplicates(["cls"])
    classes = cuts.write(sets.join(facts.select("cls", "cells"), "cls"))
    links = similar_sets(classes, bands=bands, rows=rows, threshold=threshold, seed=seed)
    return members.select("id", "cls", "position"), links, facts.filter("n > 1").select("cls")


def expand_pairs(members: DataFrame, links: DataFrame, copies: DataFrame, within: float | None) -> DataFrame:
    """All pairs of rows of linked classes, and of one class, whose positions differ by at most ``within``.

    Positions are cut into cells of that width and each row meets its own cell and the next, so a class
    of any size is joined cell by cell and not as a whole. id_a < id_b.
    """
    own = copies.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    turned = F.explode(F.array(F.struct("cls_a", "cls_b"), F.struct(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"))))
    all_links = links.select(turned.alias("x")).select("x.*").unionByName(own)
    cell = F.floor(F.col("position") / within).cast("long") if within else F.lit(0).cast("long")
    left = members.select(F.col("cls").alias("cls_a"), F.col("id").alias("id_a"), F.col("position").alias("pa"), cell.alias("cell"))
    near = F.explode(F.array(*[cell + k for k in ((-1, 0, 1) if within else (0,))])).alias("cell")
    right = members.select(F.col("cls").alias("cls_b"), F.col("id").alias("id_b"), F.col("position").alias("pb"), near)
    out = left.join(all_links, "cls_a").join(right, ["cls_b", "cell"]).filter("id_a < id_b")
    if within:
        out = out.filter(F.abs(F.col("pa") - F.col("pb")) <= within)
    return out.select("id_a", "id_b")


def found(spark, sf_dir: str) -> DataFrame:
    """p5_found: pairs of tracks with at least half of their distinct non-zero fingerprint values in common."""
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("id", "duration", "fingerprint").filter(F.size("fingerprint") >= 20)
    values = F.array_distinct(F.filter("fingerprint", lambda x: x.isNotNull() & (x != 0)))
    members, links, copies = near_duplicates(tracks, "id", values, position=F.col("duration"), within=5.0, threshold=0.5)
    return expand_pairs(members, links, copies, 5.0)


SQL = """
WITH t AS (SELECT id, duration, list_distinct(list_filter(fingerprint, lambda x: x <> 0)) AS fp FROM tracks
           WHERE len(fingerprint) >= 20 AND duration IS NOT NULL),
v AS (SELECT id, duration, len(fp) AS n, unnest(fp) AS x FROM t)
SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.x = b.x AND a.id < b.id AND abs(a.duration - b.duration) <= 5.0
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 2 >= a.n + b.n - count(*)
"""
