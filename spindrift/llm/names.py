"""Problem 4: variant spellings of one name, by sparse cosine joins of character n-grams and average linkage."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from types import MappingProxyType

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import encoding, plain_form
from ._shared import Cuts, spread
from .components import connected_components

NGRAM = 4
#: Least cosine of two names that are linked, least average cosine of two clusters that merge.
COSINE, LINK = 0.3, 0.2
#: A word with at most this share of the names of a like word is a typing error of it (in check_l's albums recurring errors have under 0.03, the rarest like word of its own 0.125).
ERROR_SHARE = 0.08
#: Other names, told apart by the first letters of their words, that show a word to be one of its own.
OTHERS = 3
#: Words that stand for each other do so beside this many different other words, and in this share of the names that hold them.
ALTERNATES, ALTERNATE_SHARE = 3, 0.05
#: Typing errors that two spellings may differ by, over all their words.
MOST_EDITS = 3
#: Components up to this many names are clustered in one task each; larger ones by distributed rounds, with the same result.
LOCAL_NAMES = 400
#: Vectors under one n-gram that are compared in one group.
HOT_GRAM = 20_000

# Letters without a canonical decomposition, and their base letters.
BASE = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "þ": "th", "æ": "ae", "œ": "oe", "ð": "d", "ı": "i"}
# Roman numerals with their numbers, and words before a numeral.
ROMAN = {r: str(i) for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split(), 1)}
COUNTED = frozenset("vol volume volumes no nr num number symphony part book disc".split())
_QUOTED = re.compile(r"(?<=\S )[“\"„«(][^\s“”\"„«»()]+[”\"“»)](?= \S)")
_WORD = re.compile(r"[^\W_]+\.?|[&+@]")


@lru_cache(maxsize=200_000)
def base_letters(text: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(BASE.get(c, c) for c in flat)


def tokens(name: str) -> list[str]:
    """Words in lower case without accents; a full stop stays on abbreviations, Roman numerals after a word that is counted become digits.

    One quoted word inside a name is a familiar form beside the full one and is left out.
    """
    out: list[str] = []
    for m in _WORD.finditer(base_letters(_QUOTED.sub(" ", name).replace("’", "").replace("'", ""))):
        t = m.group()
        bare = t.rstrip(".")
        if bare in ROMAN and out and out[-1].rstrip(".") in COUNTED:
            t = ROMAN[bare]
        elif len(bare) == 1:
            t = bare
        out.append(t)
    return out


def canonical(name: str) -> str:
    """Equal for spellings that differ only in case, accents, punctuation and word order."""
    return " ".join(sorted(t.rstrip(".") for t in tokens(name)))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def _shortens(a: str, b: str) -> bool:
    """a abbreviates b: a full stop, the same first letter, its letters in order in b."""
    bare = a.rstrip(".")
    if not a.endswith(".") or not 2 <= len(bare) < len(b) or bare[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in bare)


def _cost(a: str, b: str, known: Mapping[str, int]) -> float | None:
    """Edits between two words that may be writings of one (0.5: an initial or abbreviation), or None. ``known``: names of each word of its own."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 0.0
    if x.isdigit() or y.isdigit() or not (x.isalnum() and y.isalnum()):
        return None
    if len(x) == 1 or len(y) == 1:
        return 0.5 if x[0] == y[0] else None
    if _shortens(a, y) or _shortens(b, x):
        return 0.5
    if x in known and y in known and min(known[x], known[y]) > ERROR_SHARE * max(known[x], known[y]):
        return None  # two words of their own, neither rare enough against the other to be its typing error
    n = min(len(x), len(y))
    most = 0 if n < 3 else 1 if n < 5 else 2 if n < 8 else 4
    e = edits(x, y, most) if most else 1
    return float(e) if e <= most else None


def _joined(mine: Sequence[str], other: Sequence[str]) -> list[str]:
    """My words, with neighbours that the other side writes as one word, or as their initials, written so too."""
    out, i, theirs = [], 0, {t.rstrip(".") for t in other} - {t.rstrip(".") for t in mine}
    while i < len(mine):
        pair = [t.rstrip(".") for t in mine[i : i + 2]]
        if len(pair) == 2 and theirs:
            both, short = "".join(pair), pair[0][0] + pair[1][0]
            hit = both if both in theirs else short if short in theirs and len(pair[0]) > 1 else None
            if hit:
                out.append(hit)
                i += 2
                continue
        out.append(mine[i])
        i += 1
    return out


def difference(a: Sequence[str], b: Sequence[str], known: Mapping[str, int] = MappingProxyType({})) -> tuple[str, str, float, str] | None:
    """What two spellings do not share: (words of a alone, words of b alone, edits between their matched words, the other words of a).

    Equal words are matched first, then the cheapest pairs that may be writings of one word. Lone initials may stay unmatched.
    None if numbers differ, which no spelling does.
    """
    ra, rb = _joined(a, b), _joined(b, a)
    left: dict[str, list[int]] = {}
    for j, t in enumerate(rb):
        left.setdefault(t.rstrip("."), []).append(j)
    rest_a = [t for t in ra if not (left.get(t.rstrip(".")) and left[t.rstrip(".")].pop() >= 0)]
    rest_b = [rb[j] for j in sorted(j for js in left.values() for j in js)]
    numbers = lambda ts: sorted(t.rstrip(".") for t in ts if t.rstrip(".").isdigit())
    if numbers(rest_a) != numbers(rest_b):
        return None
    costs = sorted((c, i, j) for i, x in enumerate(rest_a) for j, y in enumerate(rest_b) if (c := _cost(x, y, known)) is not None)
    on_a, on_b, total = set(), set(), 0.0
    for c, i, j in costs:
        if i not in on_a and j not in on_b:
            on_a.add(i)
            on_b.add(j)
            total += c
    alone = lambda ts, on: sorted(w for i, t in enumerate(ts) if i not in on and (len(w := t.rstrip(".")) > 1 or not w.isalnum()))
    la, lb = alone(rest_a, on_a), alone(rest_b, on_b)
    shared = sorted(w for t in a if len(w := t.rstrip(".")) > 1 and w not in la)
    return " ".join(la), " ".join(lb), total, " ".join(shared)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(1).to_pylist()
        toks = [tokens(n) for n in names]
        keys = [" ".join(sorted(t.rstrip(".") for t in ts)) or n for ts, n in zip(toks, names)]
        cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.string()), pa.array(toks, pa.list_(pa.string()))]
        yield pa.record_batch(cols, names=["field", "name", "n", "key", "tokens"])


def ngram_codes(toks: Sequence[str]) -> list[int]:
    """31-bit codes of the n-grams inside each word, the word's ends marked; the order of the words does not count."""
    grams = set()
    for t in toks:
        p = f"#{t.rstrip('.')}#"
        grams.update(p[i : i + NGRAM] for i in range(max(1, len(p) - NGRAM + 1)))
    return sorted({xxhash.xxh32_intdigest(g) >> 1 for g in grams})


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [ngram_codes(t) for t in batch.column(2).to_pylist()]
        counts = np.array([len(c) for c in codes], dtype=np.int64)
        rows = pa.array(np.repeat(np.arange(len(codes)), counts))
        cols = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([c for cs in codes for c in cs], pa.int32())]
        yield pa.record_batch(cols, names=["field", "node", "gram"])


def weighted_vectors(grams: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """field, node, grams array<int>, ws array<float>: the n-grams of each node that other nodes have too, as a vector of length 1, heaviest first.

    The weight is the inverse document frequency ln(1 + nodes / df); n-grams of one node only count for the length.
    """
    total = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("field"))
    df = grams.groupBy("field", "gram").agg(F.count("*").alias("df"))
    weighed = grams.join(df, ["field", "gram"]).withColumn("w", F.log(1 + total / F.col("df")))
    # a vector is short (the n-grams of one name), so it is handled as one array
    entry = F.when(F.col("df") > 1, F.struct("w", "gram"))
    vec = weighed.groupBy("field", "node").agg(F.sort_array(F.collect_list(entry), False).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return vec.select("field", "node", F.col("v.gram").cast("array<int>").alias("grams"), F.transform("v", lambda x: (x["w"] / F.col("length")).cast("float")).alias("ws"))


def _meetings(cosine: float):
    """Vectors in the order of (field, gram, part), longest rest first, to the pairs of one gram that have it as their first common one and reach ``cosine``."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda n: rows.column(n).combine_chunks()
        flat = lambda n, t: col(n).to_numpy(zero_copy_only=False).astype(t)
        gram, part, field, node, at, l, side = (flat(n, t) for n, t in (("gram", np.int64), ("part", np.int64), ("fieldno", np.int64), ("node", np.int64), ("at", np.int64), ("l", float), ("side", np.int64)))
        n, size = len(rows), np.diff(col("grams").offsets.to_numpy())
        row, where = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        kinds, code = np.unique(col("grams").flatten().to_numpy(), return_inverse=True)
        codes, ws = np.full((n, size.max()), len(kinds)), np.zeros((n, size.max()))
        codes[row, where], ws[row, where] = code, col("ws").flatten().to_numpy()
        own = ws[np.arange(n), at]
        rest = np.sqrt(np.maximum(l * l - own * own, 0))
        group = np.cumsum(np.append(0, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]) | (field[1:] != field[:-1])))
        # the rests descend within a group, so those long enough for a row are the ones up to a place
        place = 4 * group - l
        until = np.searchsorted(place, 4 * group - (cosine - 1e-5) / l, "right")
        many = np.maximum(until - np.arange(n) - 1, 0)
        before, begin = np.append(0, np.cumsum(many)), 0
        table = np.zeros((max(1, 4_000_000 // (len(kinds) + 1)), len(kinds) + 1))
        while begin < n:
            # so many rows at a time as fit the table, and as have a million partners
            end = min(n, begin + len(table), max(begin + 1, int(np.searchsorted(before, before[begin] + 1_000_000, "right")) - 1))
            i = np.repeat(np.arange(begin, end), many[begin:end])
            j = i + 1 + np.arange(before[begin], before[end]) - before[i]
            # after the gram itself, the product of two rests is at most that of their lengths; in a group of two parts of a gram, only rows of different parts meet
            near = np.flatnonzero((own[i] * own[j] + rest[i] * rest[j] >= cosine - 1e-5) & ((side[i] < 0) | (side[i] != side[j])) & (node[i] != node[j]))
            if len(near):
                mine = (np.arange(end - begin)[:, None], codes[begin:end])
                table[mine] = ws[begin:end]
                for k in range(0, len(near), 50_000):
                    x, y = i[near[k : k + 50_000]], j[near[k : k + 50_000]]
                    met = table[(x - begin)[:, None], codes[y]]
                    c = (met * ws[y]).sum(axis=1)
                    on = np.flatnonzero((c >= cosine - 1e-7) & ((met > 0).argmax(axis=1) == at[y]))
                    x, y, c = x[on], y[on], c[on]
                    if len(on):
                        yield pa.record_batch([rows.column("field").combine_chunks().take(pa.array(x)), pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])), pa.array(c)], names=["field", "a", "b", "cosine"])
                table[mine] = 0
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.select(["fieldno", "gram", "part"])
            head, tail = (tuple(c[k].as_py() for c in keys.columns) for k in (0, len(batch) - 1))
            cut = 0
            if rows >= 20_000:
                if head != last:
                    yield from pairs(pa.Table.from_batches(held))
                    held, rows = [], 0
                elif tail != head:
                    cut = int(np.argmax(np.any([np.asarray(c) != h for c, h in zip(keys.columns, head)], axis=0)))
                    yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, rows = [], 0
            held.append(batch.slice(cut))
            rows, last = rows + len(batch) - cut, tail
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def cosine_pairs(vectors: DataFrame, *, cosine: float = COSINE, top_n: int | None = None) -> DataFrame:
    """All pairs of nodes of one field whose vectors (as ``weighted_vectors`` gives them) reach that cosine: field, a < b, cosine.

    Each vector stands under its heaviest n-grams, up to where the rest is shorter than ``cosine``. In one order of all n-grams the product
    of two vectors is at most that of their lengths from the first common n-gram on; so a pair that reaches ``cosine`` has that n-gram
    among both heads. It is taken up there, once, and only if the bound holds, and its exact product is computed on the spot: what is
    shuffled are the vectors under their n-grams, never the meetings. Under each n-gram the longest rests come first, so that rows whose bound
    fails are not looked at. Vectors of an n-gram of more than ``HOT_GRAM`` are split into parts, and each two of these meet in a group of
    their own. ``top_n`` keeps the pairs that are among the best of at least one of their nodes.
    """
    lengths = F.transform("ws", lambda x, i: F.sqrt(F.aggregate(F.slice("ws", i + 1, F.size("ws")), F.lit(0.0), lambda acc, y: acc + y * y)).cast("float"))
    heads = vectors.withColumn("ls", lengths).select("field", "node", "grams", "ws", F.posexplode("ls").alias("at", "l")).filter(F.col("l") >= cosine - 1e-6)
    post = heads.select("field", F.get("grams", F.col("at")).alias("gram"), "node", "at", "l", "grams", "ws")
    hot = post.groupBy("field", "gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_GRAM).select("field", "gram", F.ceil(F.col("n") / HOT_GRAM).cast("int").alias("parts"))
    split = post.join(hot, ["field", "gram"], "left").withColumn("mine", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), "parts").cast("int")))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumn("other", other)
    # the part meets itself without sides, any other with its two sides
    part = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
    side = F.when((F.col("other") < 0) | (F.col("other") == F.col("mine")), F.lit(-1)).otherwise(F.col("mine"))
    ready = split.select(F.xxhash64("field").alias("fieldno"), "field", "gram", part.alias("part"), side.alias("side"), "node", "at", "l", "grams", "ws")
    keys = ("fieldno", "gram", "part")
    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, F.desc("l"))
    out = ordered.mapInArrow(_meetings(cosine), "field string, a long, b long, cosine double")
    if top_n:
        out = out.join(_best(out.select("a", "b", F.col("cosine").alias("s")), top_n).select("a", "b"), ["a", "b"]).select("field", "a", "b", "cosine")
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the words of each pair do not share; pairs of different numbers are left out."""
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("ta", "tb", "ka", "kb")}
        known = [{k["word"]: k["df"] for k in (x or []) + (y or [])} for x, y in zip(c["ka"], c["kb"])]
        got = [difference(x, y, k) for x, y, k in zip(c["ta"], c["tb"], known)]
        on = [i for i, d in enumerate(got) if d is not None]
        kept = [batch.column(batch.schema.get_field_index(x)).take(pa.array(on, pa.int64())) for x in ("field", "a", "b", "cosine")]
        kept += [pa.array([got[i][k] for i in on], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.string()))]
        yield pa.record_batch(kept, names=["field", "a", "b", "cosine", "alone_a", "alone_b", "edits", "shared"])


def alternates(diffs: DataFrame, words: DataFrame) -> DataFrame:
    """field, x, y: words that stand for each other (familiar forms, abbreviations, "&" and "and", words that may be left out), both ways.

    Learned from all pairs that differ in nothing else: ``x`` gives way to ``y`` beside at least ``ALTERNATES`` different other words, and in at
    least ``ALTERNATE_SHARE`` of the names that hold ``x``. Given names of relatives change too, but any one for any other and so rarely.
    Two words within typing errors of each other are never learned: ``_cost`` tells errors from words by their shares.
    """
    one = diffs.filter("edits <= 1 AND alone_a <> alone_b")
    ways = F.explode(F.array(F.struct(F.col("alone_a").alias("x"), F.col("alone_b").alias("y")), F.struct(F.col("alone_b").alias("x"), F.col("alone_a").alias("y"))))
    counted = one.select("field", "shared", ways.alias("z")).select("field", "shared", "z.*").filter("x <> ''").groupBy("field", "x", "y").agg(F.countDistinct("shared").alias("n"))
    shorter = F.least(F.length("x"), F.length("y"))
    slips = F.when(shorter < 3, 0).when(shorter < 5, 1).when(shorter < 8, 2).otherwise(4)
    counted = counted.filter((F.col("n") >= ALTERNATES) & (F.contains(F.concat("x", "y"), F.lit(" ")) | (F.col("y") == "") | (F.levenshtein("x", "y") > slips)))
    df = words.groupBy("field", "word").agg(F.count("*").alias("df"))
    rarest = counted.select("field", "x", "y", F.explode(F.split("x", " ")).alias("word")).join(df, ["field", "word"]).groupBy("field", "x", "y").agg(F.min("df").alias("df"))
    good = counted.join(rarest, ["field", "x", "y"]).filter(F.col("n") >= ALTERNATE_SHARE * F.col("df")).select("field", "x", "y")
    return good.unionByName(good.select("field", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def average_linkage(ids: Sequence[int], weights: dict[int, float], links: dict[tuple[int, int], float], least: float = LINK) -> dict[int, int]:
    """Weighted average linkage on sparse similarities (0 where there is no link). Cluster of each id, named by its smallest id."""
    size = {i: weights[i] for i in ids}
    near: dict[int, dict[int, float]] = {i: {} for i in ids}
    for (a, b), s in links.items():
        near[a][b] = near[b][a] = s * weights[a] * weights[b]
    members = {i: [i] for i in ids}
    while True:
        best = None
        for a, row in near.items():
            for b, num in row.items():
                if a < b:
                    key = (round(num / (size[a] * size[b]), 9), -a, -b)
                    if best is None or key > best:
                        best = key
        if best is None or best[0] < least:
            break
        a, b = -best[1], -best[2]
        for c, num in near.pop(b).items():
            del near[c][b]
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + num
        size[a] += size.pop(b)
        members[a] += members.pop(b)
    return {m: min(ms) for ms in members.values() for m in ms}


def _local(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = {(int(a), int(b)): float(s) for a, b, s in zip(pdf.a, pdf.b, pdf.s)}
        w = dict(zip(pdf.a.astype(int), pdf.wa)) | dict(zip(pdf.b.astype(int), pdf.wb))
        got = average_linkage(sorted(w), w, links, least)
        return pd.DataFrame({"node": list(got), "cluster": list(got.values())})

    return run


def _rounds(spark, cuts: Cuts, edges: DataFrame, least: float) -> DataFrame:
    """The same clustering for components of any size: in every round all pairs of clusters that are each other's best merge."""
    weight = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("wa").alias("w")), F.struct(F.col("b").alias("node"), F.col("wb").alias("w")))).alias("x")).select("x.*").distinct()
    of = cuts.write(weight.select("node", F.col("node").alias("cluster"), "w"))
    num = cuts.write(edges.select("a", "b", (F.col("s") * F.col("wa") * F.col("wb")).alias("num")))
    while True:
        sizes = of.groupBy("cluster").agg(F.sum("w").alias("size"))
        avg = num.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
        good = avg.withColumn("avg", F.round(F.col("num") / (F.col("sa") * F.col("sb")), 9)).filter(F.col("avg") >= least)
        rank = F.struct("avg", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        ends = good.select(rank.alias("r"), F.explode(F.array("a", "b")).alias("c"))
        top = ends.groupBy("c").agg(F.max("r").alias("r"))
        merge = cuts.write(top.groupBy("r").agg(F.count("*").alias("k")).filter("k = 2").select((-F.col("r.na")).alias("into"), (-F.col("r.nb")).alias("gone")))
        if not merge.limit(1).count():
            return of.select("node", "cluster")
        of = cuts.write(of.join(merge.withColumnRenamed("gone", "cluster"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"), "w"))
        m = merge.select("into", "gone")
        moved = num.join(m.select(F.col("gone").alias("a"), F.col("into").alias("ia")), "a", "left").join(m.select(F.col("gone").alias("b"), F.col("into").alias("ib")), "b", "left")
        moved = moved.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"), "num").filter("a <> b")
        num = cuts.write(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("num").alias("num")))


def _own_words(cuts: Cuts, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, node, word) of all words, and (field, word, df) of those that are words of their own and no typing errors.

    A word of its own stands beside at least ``OTHERS`` different sets of first letters (so initials, familiar forms of the
    same letter and most errors in the other words do not count as other names) and is not rare against a word one
    typing error away. Both are free of the number of rows: an error that recurs stays rare against its original.
    """
    bare = nodes.select("field", "node", F.array_distinct(F.transform("tokens", lambda t: F.rtrim(t, F.lit(".")))).alias("ws"))
    words = bare.select("field", "node", F.explode("ws").alias("word"), "ws").filter("length(word) > 1 OR word IN ('&', '+', '@')")
    beside = F.array_join(F.sort_array(F.transform(F.filter("ws", lambda t: t != F.col("word")), lambda t: F.substring(t, 1, 1))), "")
    stands = words.withColumn("beside", beside).groupBy("field", "word").agg(F.count("*").alias("df"), F.countDistinct("beside").alias("others"))
    often = cuts.write(stands.filter(F.col("others") >= OTHERS).select("field", "word", "df"))
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    near = often.filter("length(word) >= 3").select("field", "word", "df", F.explode(F.array_union(less, F.array("word"))).alias("part")).distinct()
    more = near.select("field", "part", F.col("df").alias("most"))
    errors = near.join(more, ["field", "part"]).filter(F.col("df") <= ERROR_SHARE * F.col("most")).select("field", "word").distinct()
    return words.select("field", "node", "word"), cuts.write(often.join(errors, ["field", "word"], "left_anti"))


def link_spellings(spellings: DataFrame, *, cosine: float = COSINE, link: float = LINK, local_names: int = LOCAL_NAMES, top_n: int | None = None) -> DataFrame:
    """Entity of every spelling: field, name, n, entity (a number that all spellings of one entity share).

    ``spellings``: field, name, n (rows that hold the name). NULL and '' are no names, rows of no field are left out; repeated rows add up. Spellings
    equal but for case, accents, punctuation and word order are one node. Nodes are joined by the cosine of their weighted n-gram
    vectors; a pair that reaches ``cosine`` is a link unless a veto on its words holds: different numbers, more than ``MOST_EDITS`` typing
    errors, or words that stand on one side only and are no known alternates. Average linkage of the cosines, weighted by rows and 0
    where there is no link, groups the nodes. ``top_n`` keeps each node's best partners only; None, the default, keeps every link, as an
    entity may have any number of spellings. A name without letters or digits is an entity of its own. Nodes are numbered by a hash of
    their text, by which ties are broken, so the result does not depend on the partitioning.
    """
    spark = spellings.sparkSession
    cuts = Cuts(spark)
    clean = spellings.filter("field IS NOT NULL AND name <> ''").groupBy("field", "name").agg(F.sum("n").cast("long").alias("n"))
    named = cuts.write(spread(clean).mapInArrow(_nodes, "field string, name string, n long, key string, tokens array<string>"))
    grouped = named.groupBy("field", "key").agg(F.sum("n").cast("double").alias("w"), F.max_by("tokens", F.struct("n", "name")).alias("tokens"))
    nodes = cuts.write(grouped.withColumn("node", F.xxhash64("field", "key")))
    sizes = {r.field: r.n for r in nodes.groupBy("field").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return named.select("field", "name", "n", F.lit(None).cast("long").alias("entity"))
    if nodes.groupBy("node").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two names share a 64-bit hash")
    words, own = _own_words(cuts, nodes)
    common = words.join(own, ["field", "word"]).groupBy("node").agg(F.collect_list(F.struct("word", "df")).alias("known"))
    grams = cuts.write(spread(nodes.select("field", "node", "tokens")).mapInArrow(_grams, "field string, node long, gram int"))
    vectors = cuts.write(weighted_vectors(grams, sizes))
    facts = cuts.write(nodes.select("node", "tokens").join(common, "node", "left"))
    side = lambda s: facts.select(F.col("node").alias(s), *[F.col(c).alias(c[0] + s) for c in ("tokens", "known")])
    met = cuts.write(cosine_pairs(vectors, cosine=cosine)).join(side("a"), "a").join(side("b"), "b").select("field", "a", "b", "cosine", "ta", "tb", "ka", "kb")
    diffs = cuts.write(met.mapInArrow(_compare, "field string, a long, b long, cosine double, alone_a string, alone_b string, edits double, shared string"))
    stand_in = cuts.write(alternates(diffs, words))
    near = diffs.filter(F.col("edits") <= MOST_EDITS).join(stand_in.select("field", F.col("x").alias("alone_a"), F.col("y").alias("alone_b"), F.lit(True).alias("known")), ["field", "alone_a", "alone_b"], "left")
    links = near.filter("known OR alone_a = alone_b").select("a", "b", F.col("cosine").alias("s"))
    if top_n:
        links = _best(links, top_n)
    weigh = lambda s: nodes.select(F.col("node").alias(s), F.col("w").alias(f"w{s}"))
    edges = cuts.write(links.join(weigh("a"), "a").join(weigh("b"), "b").select("a", "b", "s", "wa", "wb"))
    label = cuts.write(connected_components(edges, "a", "b"))
    small = label.groupBy("label").agg(F.count("*").alias("names"))
    placed = cuts.write(edges.join(label.select(F.col("node").alias("a"), "label"), "a").join(small, "label"))
    tasks = spark.sparkContext.defaultParallelism
    local = placed.filter(F.col("names") <= local_names).repartition(tasks, "label").groupBy("label").applyInPandas(_local(link), "node long, cluster long")
    clusters = local
    if placed.filter(F.col("names") > local_names).limit(1).count():
        clusters = local.unionByName(_rounds(spark, cuts, placed.filter(F.col("names") > local_names).select("a", "b", "s", "wa", "wb"), link))
    entity = nodes.join(clusters, "node", "left").select("field", "key", F.coalesce("cluster", "node").alias("entity"))
    out = cuts.write(named.join(entity, ["field", "key"]).select("field", "name", "n", "entity"))
    cuts.drop_others(out)
    return out


def _best(links: DataFrame, n: int) -> DataFrame:
    """Links that are among the ``n`` best of at least one of their ends."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    best = both.withColumn("r", rank).filter(F.col("r") <= n)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").distinct()


FIELDS = ("artist", "album")


def _plain_spellings(spark, sf_dir: str) -> DataFrame:
    """Distinct non-empty values of artist and album that are neither garbled (p3) nor not plain (p1)."""
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("id", *encoding.FIELDS)
    cells = tracks.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in FIELDS])).alias("c")).select("c.*")
    cuts = Cuts(spark)
    values = cuts.write(cells.filter("name <> ''").groupBy("field", "name").agg(F.count("*").alias("n")))
    wide = values.filter(F.col("name").rlike(r"[^\x20-\x7e]"))
    unplain = plain_form.plain_forms(wide.select("name"), "name", ["name"]).filter((F.col("value") != F.col("plain")) | plain_form.mixed_word("plain")).select(F.col("value").alias("name"))
    garbled = encoding.restore_values(tracks, encoding.FIELDS).select(F.col("value").alias("name"))
    return values.join(unplain.unionByName(garbled).distinct(), "name", "left_anti")


def entities(spark, sf_dir: str) -> DataFrame:
    """p4_entities: every plain spelling and its entity."""
    return link_spellings(_plain_spellings(spark, sf_dir))


def found(spark, sf_dir: str) -> DataFrame:
    """p4_found: pairs of spellings of one entity."""
    e = entities(spark, sf_dir)
    a, b = e.select("field", "entity", F.col("name").alias("name_a")), e.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).filter("name_a < name_b").select("field", "name_a", "name_b")
