"""Record operators against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm._shared import Cuts
from spindrift.llm import components, names, near_records, survivor


def _union(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            p[y] = x
    return {n: find(n) for n in p}


def test_components(spark):
    rng = random.Random(1)
    name = lambda i: f"n{i:03d}"
    chain = [(name(i), name(i + 1)) for i in range(60)]
    star = [(name(500), name(501 + i)) for i in range(40)]
    noise = [(name(100 + rng.randrange(80)), name(100 + rng.randrange(80))) for _ in range(60)]
    edges = chain + star + noise + chain[:5] + [(b, a) for a, b in star[:5]] + [(None, "x"), ("x", None), ("y", "y"), (None, None)]
    df = spark.createDataFrame([(a, b, "z") for a, b in edges], "p string, q string, node string")
    want = _union(edges)
    for hub in (50_000, 7):
        assert {r.node: r.label for r in components.connected_components(df, "p", "q", hub_links=hub).collect()} == want
    assert components.connected_components(df.limit(0), "p", "q").count() == 0


def test_prob_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    v = np.arange(60, dtype=np.uint64)
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    values, weights, row = np.concatenate([v, v[10:]]), np.concatenate([a, b[10:]]), np.array([0] * 60 + [1] * 50)
    s = near_records.prob_minhash(values, weights, row, 2, 8192)
    x, y = dict(zip(v.tolist(), a)), dict(zip(v[10:].tolist(), b[10:]))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = [rng.getrandbits(31) + 1 for _ in range(40)]
        at = rng.uniform(100, 200)
        for k in range(4):
            c = list(base)
            for _ in range(rng.choice([0, 0, 2, 8, 14])):
                c[rng.randrange(40)] = rng.getrandbits(31)
            rows.append((len(rows), c + c[:3], at + rng.choice([0, 3, 9])))
    rows += [(900, None, 1.0), (901, [], 1.0), (902, [5], None), (903, [7], 2.0), (904, [7], 2.0), (None, [7], 2.0)]
    df = spark.createDataFrame(rows, "id bigint, fp array<bigint>, d double")
    items = F.array_distinct("fp")
    got = {tuple(r) for r in near_records.expand_pairs(*near_records.near_duplicates(df, "id", items, position=F.col("d"), within=5.0, threshold=0.5), 5.0).collect()}
    want = set()
    for (i, x, p), (j, y, q) in itertools.combinations([r for r in rows if r[0] is not None and r[1] and r[2] is not None], 2):
        if abs(p - q) <= 5 and len({*x} & {*y}) * 2 >= len({*x} | {*y}):
            want.add((min(i, j), max(i, j)))
    assert got == want
    assert near_records.expand_pairs(*near_records.near_duplicates(df.limit(0), "id", items, position=F.col("d"), within=5.0, threshold=0.5), 5.0).count() == 0


def test_pairs_across_cells_and_blocks(spark):
    """Sets at positions on both sides of every cell and block end, exactly and just beyond the greatest distance apart."""
    base = list(range(1, 41))
    rows = []
    for k in range(60):
        at = k * 2.5 + (0.0, 1.25, 2.4999)[k % 3]
        rows += [(len(rows), base + [1000 + k], at), (len(rows) + 1, base + [2000 + k], at + 5.0), (len(rows) + 2, base + [3000 + k], at - 5.0001)]
    df = spark.createDataFrame(rows, "id bigint, fp array<bigint>, d double")
    got = near_records.expand_pairs(*near_records.near_duplicates(df, "id", F.col("fp"), position=F.col("d"), within=5.0, threshold=0.5), 5.0)
    want = {(i, j) for (i, _, p), (j, _, q) in itertools.combinations(rows, 2) if abs(p - q) <= 5.0}
    assert {tuple(r) for r in got.collect()} == want


def test_weights_count(spark):
    df = spark.createDataFrame([(1, [(1, 5.0), (2, 1.0)]), (2, [(1, 5.0), (3, 1.0)]), (3, [(1, 0.1), (3, 9.0)])], "id bigint, i array<struct<v:bigint,w:double>>")
    members, links, _ = near_records.near_duplicates(df, "id", F.col("i.v"), weights=F.col("i.w"), threshold=0.5, bands=64)
    of = {r.cls: r.id for r in members.collect()}
    assert {tuple(sorted((of[r.cls_a], of[r.cls_b]))): round(r.similarity, 3) for r in links.collect()} == {(1, 2): 0.714}


def test_survivor_matches_brute_force(spark):
    rng = random.Random(6)
    pick = lambda *v: rng.choice([None, *v])
    tracks = [(i, f"/p{i % 40}", pick(1, 2, 3), pick(80.0, 90.0, float("nan")), pick(128, 320), pick(0.0, 60.0), pick("MP3", "flac", "zzz"), pick(True, False), pick(5, 7)) for i in range(70)]
    T = spark.createDataFrame(tracks, "id bigint, filepath string, last_scanned int, quality_score double, bitrate int, fake_lossless_confidence double, format string, is_lossless boolean, filesize bigint")
    for c in ("mtime", "duration", "spectral_cutoff"):
        T = T.withColumn(c, F.lit(1.0))
    for c in ("mtime_ns", "samplerate", "channels", "bit_depth"):
        T = T.withColumn(c, F.lit(1))
    for c in ("quick_signature", "sha256", "audio_hash", "title", "artist", "album"):
        T = T.withColumn(c, F.lit(""))
    members = [(f"g{i % 9}", f"/p{rng.randrange(45)}") for i in range(60)] + [("g0", None), (None, "/p1"), ("only_gone", "/p99")]
    M = spark.createDataFrame(members, "group_id string, filepath string")
    last = {}
    for t in tracks:
        key = (t[2] is not None, t[2] or 0, t[0])
        if t[1] not in last or key > last[t[1]][0]:
            last[t[1]] = (key, t)
    nan = lambda x: None if x is None or x != x else x
    down = lambda x: (nan(x) is None, -(nan(x) or 0))
    want = {}
    for g, p in set(members):
        if g and p in last:
            t = last[p][1]
            k = ((t[5] or 0) > 50, down(t[3]), down(t[4]), down(t[8]), p)
            want[g] = min(want.get(g, k), k)
    got = {r.group_id: r.filepath for r in survivor.surviving_records(M, T).collect()}
    assert got == {g: k[-1] for g, k in want.items()}
    assert survivor.surviving_records(M.limit(0), T).count() == 0


def test_branch_and_bound_is_optimal():
    rng = random.Random(9)
    for _ in range(60):
        opts = [sorted([(rng.choice([None, 1, 2]), rng.choice([None, True, False]), rng.random()) for _ in range(rng.randrange(0, 5))], key=lambda o: -o[-1]) for _ in range(3)]
        best = 0.0
        for combo in itertools.product(*[[None, *o] for o in opts]):
            chosen = [c for c in combo if c]
            if all(len({c[k] for c in chosen if c[k] is not None}) <= 1 for k in (0, 1)):
                best = max(best, sum(c[-1] for c in chosen))
        picks = survivor.choose_bundles(opts)
        assert abs(sum(opts[b][i][-1] for b, i in enumerate(picks) if i >= 0) - best) < 1e-9


def test_differences_of_spellings():
    diff = lambda a, b: (d := names.difference(names.tokens(a), names.tokens(b))) and d[:3]
    assert diff("M. Belkandorfi", "Belkandorfi, Maria") == ("", "", 0.5)
    assert diff("Maria Belkandrofi", "Maria Belkandorfi") == ("", "", 1.0)
    assert diff("Maria K. Belkandorfi", "Maria Belkandorfi") == ("", "", 0.0)
    assert diff("Gruntal Big Band", "Gruntal Bigband") == ("", "", 0.0)
    assert diff("Gruntal Chmbr. Orch.", "Gruntal Chamber Orchestra") == ("", "", 1.0)
    assert diff("Oleg Belkandorfi", "Maria Belkandorfi") == ("oleg", "maria", 0.0)
    assert diff("Maria Belkandorfi & Oleg Gruntal", "Maria Belkandorfi") == ("& gruntal oleg", "", 0.0)
    assert diff("Gruntal, Vol. 1", "Gruntal, Vol. 2") is None and diff("Gruntal, Vol. II", "Gruntal, Vol. 2") == ("", "", 0.0)
    assert diff("Maria “Mia” Belkandorfi", "Maria Belkandorfi") == ("", "", 0.0)
    words = [f"word{chr(97 + i)}x{chr(97 + i)}{i}abc"[:9] for i in range(26)]
    assert names.difference(words, list(reversed(words)))[:3] == ("", "", 0.0)  # any number of words


def test_spellings_are_linked_locally_and_by_rounds(spark):
    rows = [("artist", n, k) for n, k in [("Maria Belkandorfi", 50), ("Belkandorfi, Maria", 5), ("Maria Belkandrofi", 3), ("M. Belkandorfi", 4), ("MARIA BELKANDORFI", 2), ("Oleg Belkandorfi", 30), ("Oleg Belkandofri", 2), ("Gruntalis Quartet", 9), ("", 4), ("???", 1)]]
    rows += [("artist", None, 3), ("artist", "Maria Belkandorfi", 1), ("album", "Maria Belkandorfi", 7)]
    df = spark.createDataFrame(rows, "field string, name string, n bigint")
    results = []
    for size in (400, 1):
        got = names.link_spellings(df, local_names=size).collect()
        groups = {}
        for r in got:
            groups.setdefault((r.field, r.entity), set()).add(r.name)
        results.append(sorted(map(sorted, groups.values())))
    assert results[0] == results[1]
    assert ["Belkandorfi, Maria", "M. Belkandorfi", "MARIA BELKANDORFI", "Maria Belkandorfi", "Maria Belkandrofi"] in results[0]
    assert ["Oleg Belkandofri", "Oleg Belkandorfi"] in results[0] and ["???"] in results[0]
    assert names.link_spellings(df.limit(0)).count() == 0


def test_errors_are_told_from_words_by_share(spark):
    last = [a + b + "ndelkor" for a in "bdfgklmprt" for b in ("a", "e", "i", "o", "u", "ya", "ye", "yi", "yo", "yu")]
    rows = [("artist", f"Noemie {x}", 9) for x in last] + [("artist", f"Nozmie {x}", 1) for x in last[::13]]
    rows += [("album", f"{w} {x}", 3) for x in last[::30] for w in ("Island", "Islands")]
    got = {(r.field, r.name): r.entity for r in names.link_spellings(spark.createDataFrame(rows, "field string, name string, n bigint")).collect()}
    for x in last[::13]:  # an error that recurs is still one
        assert got["artist", f"Noemie {x}"] == got["artist", f"Nozmie {x}"], x
    for x in last[::30]:  # words of a like number of names are two words, however few the names
        assert got["album", f"Island {x}"] != got["album", f"Islands {x}"], x
    assert len({got["artist", f"Noemie {x}"] for x in last}) == len(last)


def test_cosine_pairs_are_exact(spark):
    rng = random.Random(12)
    # n-gram k stands in about a share of 1 / k of the names, so every vector has a long tail of common ones
    vecs = [{g for g in range(1, 120) if rng.random() < 1.5 / g} | {200 + rng.randrange(60), 200 + rng.randrange(60)} for _ in range(150)]
    df = {g: sum(g in v for v in vecs) for v in vecs for g in v}
    w = {g: np.log(1 + len(vecs) / n) for g, n in df.items()}
    size = [np.sqrt(sum(w[g] ** 2 for g in v)) for v in vecs]
    cos = {(i, j): sum(w[g] ** 2 for g in vecs[i] & vecs[j]) / size[i] / size[j] for i, j in itertools.combinations(range(len(vecs)), 2)}
    grams = spark.createDataFrame([("f", i, g) for i, v in enumerate(vecs) for g in v], "field string, node bigint, gram bigint")
    vectors = names.weighted_vectors(grams, {"f": len(vecs)})
    for least in (0.02, 0.14, 0.5):
        got = {(r.a, r.b): r.cosine for r in names.cosine_pairs(vectors, cosine=least).collect()}
        want = {p: c for p, c in cos.items() if c >= least}
        assert got.keys() == want.keys() and all(abs(got[p] - c) < 1e-6 for p, c in want.items())
    best = {(r.a, r.b) for r in names.cosine_pairs(vectors, cosine=0.1, top_n=2).collect()}
    want = set()
    for i in range(len(vecs)):
        near = sorted(((-c, b if a == i else a) for (a, b), c in cos.items() if i in (a, b) and c >= 0.1))[:2]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    assert best == want


def test_alternates_are_learned(spark):
    """A familiar form stands beside the full name again and again; relatives' names do so by chance."""
    rng = random.Random(8)
    last = ["".join(rng.choice("bdfgklmprstvz") + rng.choice("aeiou") + rng.choice(("", "n", "l", "r", "s")) for _ in range(4)) for _ in range(74)]
    last, bands = last[:54], last[54:]
    given = ["Margaret", "Ignacio", "Oleg", "Tomasz", "Beatriz", "Nikolai"]
    rows = [(f"{given[i % 6]} {x}", 5) for i, x in enumerate(last)]
    rows += [(f"Peggy {x}", 1) for x in last[::6][:5]]
    rows += [(f"{given[(i + 1) % 6]} {x}", 3) for i, x in enumerate(last) if i in (0, 7)]
    rows += [(f"The {x.title()} Kettles", 4) for x in bands] + [(f"{x.title()} Kettles", 1) for x in bands[::3]]
    df = spark.createDataFrame([("artist", n, k) for n, k in rows], "field string, name string, n bigint")
    got = {r.name: r.entity for r in names.link_spellings(df).collect()}
    for x in last[::6][:5]:
        assert got[f"Peggy {x}"] == got[f"Margaret {x}"]
    for i in (0, 7):
        assert got[f"{given[i % 6]} {last[i]}"] != got[f"{given[(i + 1) % 6]} {last[i]}"]
    for x in bands[::3]:
        assert got[f"{x.title()} Kettles"] == got[f"The {x.title()} Kettles"]


def test_local_and_distributed_linkage_agree(spark, tmp_path):
    rng = random.Random(5)
    rows, n = [], 0
    for size in [2, 3, 5, 8, 13, 21, 34] * 3:
        w = [rng.choice((1.0, 2.0, 5.0, 40.0)) for _ in range(size)]
        for i in range(1, size):
            for j in {rng.randrange(i), *(k for k in range(i) if rng.random() < 0.3)}:
                rows.append((n + j, n + i, rng.uniform(0.2, 1.0), w[j], w[i], n))
        n += size
    edges = spark.createDataFrame(rows, "a bigint, b bigint, s double, wa double, wb double, label bigint")
    one = edges.groupBy("label").applyInPandas(names._local(0.3), "node long, cluster long")
    other = names._rounds(spark, Cuts(spark), edges.drop("label"), 0.3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_cosine_pairs_are_all_pairs_also_where_an_ngram_is_split(spark, monkeypatch):
    """Products by hand; n-grams of more vectors than one group takes meet part by part, in several batches."""
    rng = random.Random(3)
    weight = {g: rng.choice((1.0, 4.0, 9.0)) + rng.random() for g in range(40)}
    vectors = []
    for i in range(260):
        grams = sorted(rng.sample(range(40), rng.randrange(1, 9)), key=lambda g: -weight[g])
        length = sum(weight[g] ** 2 for g in grams) ** 0.5 * rng.choice((1.0, 1.2))
        vectors.append(("artist" if i % 3 else "album", i * 7 - 900, grams, [weight[g] / length for g in grams]))
    v = spark.createDataFrame(vectors, "field string, node long, grams array<int>, ws array<float>").repartition(3)
    flat = {(f, n): dict(zip(g, w)) for f, n, g, w in vectors}
    dots = {(f, a, b): sum(w * y[g] for g, w in x.items() if g in y) for (f, a), x in flat.items() for (e, b), y in flat.items() if f == e and a < b}
    assert not any(abs(c - 0.5) < 1e-5 for c in dots.values())
    want = sorted(k for k, c in dots.items() if c >= 0.5)
    assert len(want) > 400
    for most in (20_000, 30, 7):
        monkeypatch.setattr(names, "HOT_GRAM", most)
        got = names.cosine_pairs(v, cosine=0.5).collect()
        assert sorted((r.field, r.a, r.b) for r in got) == want
        assert all(abs(r.cosine - dots[r.field, r.a, r.b]) < 1e-5 for r in got)
