"""Problem 8: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
import os
import warnings
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Cuts, spread

#: Where the vocabulary files of public tokenizers lie; a parameter of every function that counts tokens.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that goes with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block at most; a small mix takes smaller ones, so that its smallest source still has ``LEAST_BLOCKS`` of them.
BLOCK_TOKENS, LEAST_BLOCKS = 2_000, 200
SHARD_TOKENS = 50_000_000
#: Longer texts are cut here before encoding at white space, as the encoder's time grows faster than the text.
PIECE_CHARS = 100_000


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, *, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the whole text; NULL and empty texts have 0 tokens."""
    slim = documents.select(F.col("doc_id").cast("long"), F.col("source"), F.col(text).alias("text"))
    return spread(slim).mapInArrow(_counter(os.path.join(tokenizers, vocabulary)), "doc_id long, source string, n_tokens long")


def sainte_lague(weights: Mapping, seats: int, caps: Mapping | None = None) -> dict:
    """Seats to the highest quotients weight / (2 x seats so far + 1); ties go to the smaller key.

    Whole seats below the exact share are given at once, as the method never leaves a party more than about a seat
    from its share, then the rest one by one. No party gets more than its cap.
    """
    keys = sorted(k for k, w in weights.items() if w > 0)
    total = sum(weights[k] for k in keys)
    most = {k: caps[k] if caps else seats for k in keys}
    got = {k: max(0, min(most[k], int(seats * weights[k] / total) - len(keys))) if total else 0 for k in keys}
    heap = [(-weights[k] / (2 * got[k] + 1), k) for k in keys if got[k] < most[k]]
    heapq.heapify(heap)
    left = seats - sum(got.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return {k: got.get(k, 0) for k in weights}


def mix(documents: DataFrame, targets: DataFrame, *, block_tokens: int | None = None, shard_tokens: int = SHARD_TOKENS, total_tokens: int | None = None, seed: int = 42, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Draw a mix in which each source has its target share of the tokens.

    Every source is cut into shards by a seeded hash and every shard, in seeded order, into blocks of
    ``block_tokens`` tokens (by default 2,000, or less for a small mix; a document belongs to the block where it begins). Sainte-Lague quotas give each
    source its number of blocks, and each shard of a source its part of them; they are filled with whole blocks by their
    real tokens, up to half a block (or half a longer document) from the quota; a quota above the tokens there are takes whole passes first. ``total_tokens`` defaults to the most that all shares and repeat caps permit; a higher wish is
    lowered to that with a warning.
    Only one number per shard reaches the driver: a shard holds ``shard_tokens`` tokens, so 100 TB of text give under a million.

    NULL and empty texts, sources without a target or of a share or a cap of 0 or NULL are not drawn; target shares are
    taken relative to their sum; a repeated target row counts once; a NULL doc_id is left out. Ties in the seeded hash
    go by doc_id.
    Result: doc_id, source, n_tokens, block (shard and number), copies (1 to max_repeats).
    """
    cuts = Cuts(documents.sparkSession)
    goals = {r.source: (r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    counted = count_tokens(documents, tokenizers=tokenizers).filter((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isin(*goals))
    counted = cuts.write(counted)
    sizes = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = {s: goals[s][0] for s in sizes}
    schema = "doc_id long, source string, n_tokens long, shard long, block long, copies int"
    if not shares:
        return documents.sparkSession.createDataFrame([], schema)
    whole = sum(shares.values())
    most = min(sizes[s] * goals[s][1] * whole / shares[s] for s in shares)
    if total_tokens and total_tokens > most:
        warnings.warn(f"{total_tokens} tokens asked for; shares and repeat caps permit {int(most)}", stacklevel=2)
    total = min(total_tokens, most) if total_tokens else most
    block_tokens = block_tokens or max(1, min(BLOCK_TOKENS, int(total * min(shares.values()) / whole / LEAST_BLOCKS)))
    n_shards = {s: max(1, round(sizes[s] / shard_tokens)) for s in sizes}
    pairs = [F.lit(x) for s, n in n_shards.items() for x in (s, n)]
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = counted.withColumns({"o": order, "shard": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.element_at(F.create_map(*pairs), F.col("source")))})
    before = Window.partitionBy("source", "shard").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cuts.write(placed.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) / block_tokens).cast("long")).drop("o"))
    there = {(r.source, r.shard): (r.n, r.blocks) for r in blocks.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n"), F.ceil(F.sum("n_tokens") / block_tokens).alias("blocks")).collect()}
    # by source, then by shard
    wanted = round(total / block_tokens)
    owned = {s: sum(b for (x, _), (_, b) in there.items() if x == s) for s in shares}
    caps = {s: owned[s] * goals[s][1] for s in shares}
    quota = sainte_lague(shares, wanted, caps)
    rows = []
    for s in shares:
        by_shard = sainte_lague({k: n for (x, k), (n, _) in there.items() if x == s}, quota[s], {k: b * goals[s][1] for (x, k), (_, b) in there.items() if x == s})
        for k, q in by_shard.items():
            passes, rest = divmod(q * block_tokens, there[s, k][0])
            rows.append((s, k, passes, rest, goals[s][1]))
    quotas = documents.sparkSession.createDataFrame(rows, "source string, shard long, passes long, rest long, most long")
    # seeded order of the blocks of a shard; they are taken by their own tokens, as a block in which a long document begins holds more
    # than block_tokens and leaves the numbers behind it empty
    drawn = blocks.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed + 2)), "block").rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.withColumn("upto", upto).join(quotas, ["source", "shard"])
    copies = F.least("most", F.col("passes") + F.when(F.col("upto") * 2 - F.col("t") <= F.col("rest") * 2, 1).otherwise(0)).cast("int")
    chosen = drawn.select("source", "shard", "block", copies.alias("copies")).filter("copies > 0")
    return blocks.join(chosen, ["source", "shard", "block"]).select("doc_id", "source", "n_tokens", "shard", "block", "copies")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source got: documents, drawn tokens, actual and target share, the most copies of a document."""
    got = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens")).first()[0]
    return targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"]).select("source", "documents", "tokens", (F.col("tokens") / F.lit(total)).alias("actual_share"), "target_share", "most_copies", "max_repeats")


def _read(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def drawn(spark, sf_dir: str) -> DataFrame:
    """p8_mix: the documents of the mix and their copies."""
    return mix(*_read(spark, sf_dir))


def report(spark, sf_dir: str) -> DataFrame:
    """p8_shares: target and actual shares."""
    docs, targets = _read(spark, sf_dir)
    return shares(mix(docs, targets), targets)
