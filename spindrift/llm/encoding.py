"""Problem 3: text decoded with the wrong character encoding, found and restored.

Every distinct clean word of the corpus is garbled under all encoding chains; document tokens are
hash-joined against that table and replaced by the verified original.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cuts, spread

# Encodings a text may have had, and encodings it may have been read in.
TRUE_ENCODINGS = ("cp1252", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "shift_jis", "euc_jp")
READ_ENCODINGS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2")
#: Encodings in which UTF-8 bytes are read again and again.
REPEATED = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437")
MAX_DEPTH = 3
LOST = "�"
#: Tokens end at ASCII characters other than letters and digits, and at the wide spaces no single-byte encoding holds.
SEPARATORS = r"\x00-/:-@\[-`{-\x7f" + "\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
# Characters beside letters that plain words hold, and where.
OPENING, CLOSING, INSIDE, FREE = "“‘«„‚¿¡（［「", "”’»、。，？！）］」", "’·・ー", "–—…½¼¾º™＆－，＿"


@lru_cache(maxsize=None)
def _decoder(name: str) -> list[str]:
    """The 256 characters of a single-byte encoding; undefined bytes keep their number, as many programs do."""
    return [bytes([i]).decode(name, "ignore") or chr(i) for i in range(256)]


def _read(raw: bytes, name: str) -> str:
    table = _decoder(name)
    return "".join([table[x] for x in raw])


def garbled_forms(word: str) -> Iterator[tuple[str, str]]:
    """(garbled, chain) of a word under every chain of encodings that changes it."""
    raw = word.encode("utf-8")
    for reading in READ_ENCODINGS:
        text, chain = _read(raw, reading), f"utf-8>{reading}"
        yield text, chain
        if reading in REPEATED:
            for depth in range(2, MAX_DEPTH + 1):
                text, chain = _read(text.encode("utf-8"), reading), f"{chain}>utf-8>{reading}"
                yield text, chain
                if depth == 2 and reading in ("cp1252", "latin-1"):
                    other = "latin-1" if reading == "cp1252" else "cp1252"
                    yield _read(_read(raw, reading).encode("utf-8"), other), f"utf-8>{reading}>utf-8>{other}"
    for true in TRUE_ENCODINGS:
        try:
            raw = word.encode(true)
        except UnicodeEncodeError:
            continue
        for reading in READ_ENCODINGS:
            if reading != true:
                yield _read(raw, reading), f"{true}>{reading}"
        text = raw.decode("utf-8", "replace")
        yield text, f"{true}>utf-8"


def ungarbled(token: str) -> str | None:
    """The original of a token by undoing UTF-8 and Japanese chains; strict decoding is the proof. None if no chain fits."""
    frontier = [token]
    for true in ("euc_jp", "shift_jis"):
        try:
            back = token.encode("cp1252").decode(true)
        except UnicodeError:
            continue
        if len(back) > 1 and all("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in back):
            return back
    for _ in range(MAX_DEPTH):
        further = []
        for text in frontier:
            for reading in READ_ENCODINGS:
                table = _encoder(reading)
                try:
                    back = bytes([table[c] for c in text]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue
                if back == text:
                    continue
                if not oddness(back):
                    return back
                further.append(back)
        frontier = list(dict.fromkeys(further))
    return None


@lru_cache(maxsize=None)
def _encoder(name: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(_decoder(name))}


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "A" if 0x530 <= o < 0x590 else "-"


def oddness(word: str) -> int:
    """How many features of the word no clean word has: control characters, signs inside words, mixed alphabets, capitals after small letters."""
    odd, scripts, run, last = 0, set(), 0, ""
    for i, ch in enumerate(word):
        cat = unicodedata.category(ch)
        if cat[0] == "L" and ch not in "ªº":
            scripts.add(_script(ch))
            wide = ch > "\x7f" and _script(ch) == "L"
            run = run + 1 if wide else 0
            odd += run == 4
            odd += ch > "\x7f" and cat == "Lu" and last == "Ll" and _script(ch) != "-"
            odd += cat in ("Lm",) and ch not in "ー々"
            last = cat
            continue
        run = 0
        if ch < "\x80" or cat in ("Mn", "Nl") or "！" <= ch <= "～" or "｡" <= ch <= "ﾟ":
            last = cat
            continue
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        if ch in INSIDE and before.isalpha():
            pass
        elif ch in OPENING:
            odd += before.isalpha()
        elif ch in CLOSING:
            odd += after.isalpha() and ord(after) < 0x3000
        elif ch in FREE:
            odd += before.isalpha() and after.isalpha() or ch in "½¼¾" and (before.isalpha() or after.isalpha())
        else:
            odd += 1
        last = cat
    return odd + max(0, len(scripts - {"-"}) - 1)


def _cases(word: str) -> set[str]:
    return {word, word.upper(), word.lower(), word.title() if word.isalpha() else word}


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _half_keys(text: str) -> list[int]:
    """Keys of both halves; a text with one character lost still has one of them."""
    n, h = len(text), len(text) // 2
    return [_key(f"{n}{side}{part}") for side, part in (("<", text[:h]), (">", text[h:])) if LOST not in part]


def _form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct tokens, keys of all garbled forms of the clean ones; of UTF-8 chains also of their halves."""
    for batch in batches:
        keys: list[int] = []
        words: list[int] = []
        for word, wid in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if oddness(word):
                continue
            own = set()
            for form in _cases(word):
                for text, chain in garbled_forms(form):
                    if text != form:
                        own.add(_key(text))
                        if chain.startswith("utf-8") and chain.count(">") < 4:
                            own.update(_half_keys(text))
            keys += own
            words += [wid] * len(own)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(words, pa.int64())], names=["k", "wid"])


def _token_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(0).to_pylist()
        keys = [[_key(t), *(_half_keys(t) if LOST in t else ())] for t in tokens]
        yield pa.record_batch([pa.array([k for ks in keys for k in ks], pa.int64()), pa.array([t for t, ks in zip(tokens, keys) for _ in ks], pa.string())], names=["k", "token"])


def _like(garbled: str, token: str) -> bool:
    return garbled == token or LOST in token and len(garbled) == len(token) and all(x == y or y == LOST for x, y in zip(garbled, token))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Garble the met word again: the token must be among its forms, but for characters the token has lost."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for token, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fits = [(chain.count(">"), form) for form in _cases(word) for text, chain in garbled_forms(form) if form != token and _like(text, token)]
            depth, form = min(fits, default=(None, None))
            for col, x in zip(out, (form, depth, token)):
                col.append(x)
        yield pa.record_batch([pa.array(out[2], pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), batch.column(2)], names=["token", "original", "depth", "n_original"])


def _undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        odd = [oddness(t) for t in tokens]
        yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(odd, pa.int32()), pa.array([ungarbled(t) if o else None for t, o in zip(tokens, odd)], pa.string())], names=["token", "n", "odd", "undone"])


def token_counts(values: DataFrame) -> DataFrame:
    """Distinct tokens with a non-ASCII character and how many rows hold them. ``values``: value, n."""
    tokens = values.select(F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(f"[^{SEPARATORS}]+"), F.lit(0)))).alias("token"), "n")
    return tokens.filter(F.col("token").rlike(r"[^\x00-\x7f]")).groupBy("token").agg(F.sum("n").alias("n"))


def restore_values(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Restored forms of all distinct values of ``fields`` that were decoded with a wrong encoding.

    Result: value, restored, lost: ``restored`` has verified originals in place of the garbled tokens;
    ``lost`` is true where some characters could not be given back for sure: restored still holds U+FFFD there, or
    the most frequent of several words that fit. Chains garbled more than ``MAX_DEPTH`` times are not undone.
    A token is garbled if a clean word of the corpus gives it under a chain of encodings and is either
    clean where the token is not, or more frequent; or if undoing UTF-8 chains strictly gives a clean word (names
    that stand nowhere else); or if it holds U+FFFD. NULL, '' and pure ASCII values are never garbled. Only U+0020
    and ASCII punctuation part tokens, so texts of any length are taken whole. Values are compared by code point.
    """
    cuts = Cuts(rows.sparkSession)
    stacked = rows.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("value"))
    values = cuts.write(stacked.filter(F.col("value").rlike(r"[^\x00-\x7f]")).groupBy("value").agg(F.count("*").alias("n")))
    tokens = cuts.write(token_counts(values).withColumn("wid", F.monotonically_increasing_id()))
    undone = spread(tokens).mapInArrow(_undo, "token string, n long, odd int, undone string")
    # the table of garbled forms travels as pairs of numbers; words come back for those that met a token
    forms = spread(tokens).mapInArrow(_form_keys, "k long, wid long")
    met = forms.join(tokens.mapInArrow(_token_keys, "k long, token string"), "k").select("wid", "token").distinct()
    words = tokens.select("wid", F.col("token").alias("word"), F.col("n").alias("n_original"))
    verified = met.join(words, "wid").filter("word <> token").select("token", "word", "n_original").mapInArrow(_verify, "token string, original string, depth int, n_original long")
    # best original of each garbled form: the most frequent, then the shortest chain
    matched = undone.join(verified.filter("original IS NOT NULL"), "token", "left")
    trusted = F.col("original").isNotNull() & ((F.col("odd") > 0) | (F.col("n_original") > F.col("n")))
    best = matched.groupBy("token").agg(
        F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("undone").alias("undone"),
        F.min_by(F.when(trusted, F.col("original")), F.when(trusted, F.struct(-F.col("n_original"), "depth", "original"))).alias("original"),
        # characters are lost and several words fit: the most frequent is a guess
        (F.min(F.when(trusted, F.col("original"))) < F.max(F.when(trusted, F.col("original")))).alias("several"),
    )
    fixes = best.withColumn("fix", F.coalesce("original", "undone", F.when(F.col("token").contains(LOST), F.col("token")))).filter("fix IS NOT NULL")
    pieces = values.select("value", F.posexplode(F.regexp_extract_all("value", F.lit(f"[^{SEPARATORS}]+|[{SEPARATORS}]+"), F.lit(0))).alias("pos", "token"))
    hit = pieces.join(cuts.write(fixes.select("token", "fix", (F.col("token").contains(LOST) & F.coalesce("several", F.lit(False))).alias("guess"))), "token")
    hit = hit.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("pos", "fix"))).alias("at"), F.bool_or("guess").alias("guess"))
    whole = F.regexp_extract_all("value", F.lit(f"[^{SEPARATORS}]+|[{SEPARATORS}]+"), F.lit(0))
    restored = F.array_join(F.transform(whole, lambda x, i: F.coalesce(F.element_at("at", i), x)), "")
    out = cuts.write(hit.select("value", restored.alias("restored"), "guess").withColumn("lost", F.col("guess") | F.col("restored").contains(LOST)).drop("guess"))
    cuts.drop_others(out)
    return out


def garbled_cells(rows: DataFrame, id_col: str, fields: Iterable[str]) -> DataFrame:
    """Every garbled value of a row: id, field, value, restored, lost."""
    fields = list(fields)
    cells = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select("id", "c.field", "c.value")
    return cells.filter(F.col("value").rlike(r"[^\x00-\x7f]")).join(restore_values(rows, fields), "value").select("id", "field", "value", "restored", "lost")


FIELDS = ("title", "artist", "album")


def restored(spark, sf_dir: str) -> DataFrame:
    """p3_restored: garbled values of tracks and their originals."""
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("id", *FIELDS)
    return garbled_cells(tracks, "id", FIELDS)


def found(spark, sf_dir: str) -> DataFrame:
    return restored(spark, sf_dir).select("id", "field")
