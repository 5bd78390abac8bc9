"""Problem 7: evaluation passages inside training texts, by spaced-seed hashing and verification."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cuts, has_bit, known_bits, spread, word_codes

# Masks over consecutive words; "1" is compared, "0" is ignored. Each spans at most 12 words, so a run of 12
# equal words hits every mask; with one or two replaced words in any places inside a run of 12 at least one mask still hits.
MASKS = ("110100110101", "111010001011", "10110111", "11011011", "111001000111")
SPAN = 12
#: Documents' hashes are thinned by a table of 2 ** FILTER_BITS bits (16 MB) that the test passages' hashes set, however many there are.
FILTER_BITS = 27
#: Words that are hashed in one pass.
PASS_WORDS = 500_000
WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def seed_hashes(codes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the mask's compared words at every start."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, number + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
    return h


def _passes(ids: list, texts: list) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, codes, first word of each text) of as many texts at a time as hold ``PASS_WORDS`` words, or of one longer text."""
    at, tokens, starts = 0, [], [0]
    for k, text in enumerate(texts):
        tokens += words(text)
        starts.append(len(tokens))
        if len(tokens) >= PASS_WORDS or k == len(texts) - 1:
            yield ids[at : k + 1], word_codes(tokens), np.array(starts, dtype=np.int64)
            at, tokens, starts = k + 1, [], [0]


def _text_seeds(masks: Sequence[str], bits: Callable[[], np.ndarray] | None, names: tuple[str, str, str]):
    """Texts to the seed hashes of all their positions: (hash, id, number of the word); with ``bits``, only those that set one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits() if bits else None
        for batch in batches:
            for ids, codes, starts in _passes(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.repeat(np.arange(len(ids)), np.diff(starts))
                ids = np.array(ids, dtype=np.int64)
                for k, mask in enumerate(masks):
                    h = seed_hashes(codes, mask, k)
                    on = row[: len(h)] == row[len(mask) - 1 :][: len(h)]  # not across the end of a text
                    if table is not None:
                        on &= has_bit(table, h, FILTER_BITS)
                    at = np.flatnonzero(on)
                    cols = [pa.array(h[at].view(np.int64)), pa.array(ids[row[at]]), pa.array((at - starts[row[at]]).astype(np.int32))]
                    yield pa.record_batch(cols, names=list(names))

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [word_codes(words(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["item_id", "codes"])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, substitutions: int) -> tuple[int, int, int, int]:
    """On the diagonal doc[i] ~ item[i - shift]: (longest run of equal words, longest stretch with at most so many
    replaced words and equal words at both ends, replaced words in it, its start in the document)."""
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    miss = np.flatnonzero(~same)
    edges = np.concatenate(([-1], miss, [len(same)]))
    exact = int(np.max(np.diff(edges) - 1)) if len(same) else 0
    best = (0, 0, lo)
    for i in range(len(edges) - 1):
        j = min(i + substitutions + 1, len(edges) - 1)
        a, b = edges[i] + 1, edges[j] - 1
        while a <= b and not same[a]:
            a += 1
        while b >= a and not same[b]:
            b -= 1
        if b - a + 1 > best[0]:
            best = (int(b - a + 1), int((~same[a : b + 1]).sum()), int(lo + a))
    return exact, *best


def _verify(substitutions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_doc, last_text, doc = None, None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            codes = batch.column(4)
            flat, ends = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), codes.offsets.to_numpy()
            ends = ends - ends[0]
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), ends, ends[1:])
            for d, i, shifts, text, begin, end in rows:
                if last_doc != d or last_text != text:
                    last_doc, last_text, doc = d, text, word_codes(words(text))
                results = [overlap(doc, flat[begin:end], s, substitutions) for s in shifts]
                for col, x in zip(out, (d, i, max(r[0] for r in results), *max(r[1:] for r in results))):
                    col.append(x)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.int32()) for c in out[2:])],
                names=["doc_id", "item_id", "exact_words", "overlap_words", "replaced_words", "doc_at"],
            )

    return run


def leaked_passages(
    documents: DataFrame, items: DataFrame, *, text: str = "text", passage: str = "passage", masks: Sequence[str] = MASKS, substitutions: int = 2, exact: int | None = None,
) -> DataFrame:
    """Documents that share text with test passages, word by word with replaced words tolerated.

    Spaced-seed hashes of all positions of all documents meet those of all passages; each meeting gives a diagonal,
    and around it the overlap is verified on the words themselves. Whole texts are read; no hash, position or partner is dropped.
    With ``exact``, only overlaps of that many equal words in a row are wanted: such a run meets every mask at each of its starts inside
    the run, so diagonals with fewer meetings go before any text is joined, which loses none.
    NULL and empty texts have no words; a text shorter than the shortest mask has no hash; items with equal
    passages each get their rows; a repeated doc_id with another text is verified for each text. Only the named columns are read.

    Result, one row per document and item with a common seed: doc_id, item_id, exact_words (longest run of equal words),
    overlap_words, replaced_words, doc_at (longest stretch with at most ``substitutions`` replaced words: its words, how many
    of them are replaced, and the number of the document's word where it begins). With ``exact``, rows of shorter runs are left out.
    """
    cuts = Cuts(documents.sparkSession)
    docs = documents.select("doc_id", F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    tests = items.select("item_id", F.col(passage).alias("passage")).filter("item_id IS NOT NULL AND passage IS NOT NULL")
    seeds = cuts.write(tests.mapInArrow(_text_seeds(masks, None, ("h", "item_id", "item_at")), "h long, item_id long, item_at int"))
    sent = known_bits(seeds, "h", FILTER_BITS)
    hits = spread(docs).mapInArrow(_text_seeds(masks, lambda: sent.value, ("h", "doc_id", "doc_at")), "h long, doc_id long, doc_at int")
    met = hits.join(seeds, "h").groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n"))
    if exact:
        met = met.filter(F.col("n") >= sum(max(0, exact - len(m) + 1) for m in masks))
    diagonals = met.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))
    passages = tests.mapInArrow(_codes, "item_id long, codes array<long>")
    # documents first: they come in order, so a document's words are split once for all its items
    pairs = diagonals.join(docs, "doc_id").join(passages, "item_id").select("doc_id", "item_id", "shifts", "text", "codes")
    found = pairs.mapInArrow(_verify(substitutions), "doc_id long, item_id long, exact_words int, overlap_words int, replaced_words int, doc_at int")
    return found.filter(F.col("exact_words") >= exact) if exact else found


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/test_items.parquet")


def leaks(spark, sf_dir: str) -> DataFrame:
    """p7_leaks: every verified overlap of at least 12 words, with up to two words replaced."""
    return leaked_passages(*_tables(spark, sf_dir)).filter(F.col("overlap_words") >= SPAN)


def found(spark, sf_dir: str) -> DataFrame:
    """p7_found: documents with at least 12 consecutive words of an item's passage."""
    return leaked_passages(*_tables(spark, sf_dir), exact=SPAN).select("doc_id", "item_id")
