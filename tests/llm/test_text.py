"""Text operators against brute force and exact round trips."""

import itertools
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import encoding, leakage, mixture, plain_form, subjects


def test_plain_forms(spark):
    cases = [
        ("Ｆｕｌｌ　Ｗｉｄｔｈ", "Full Width"), ("ﾌﾟﾗﾝ", "プラン"), ("ﬁn ﬂy ⅱ Ⅻ", "fin fly ii XII"), ("été", "été"), ("ガ", "ガ"), ("a​b­c﻿", "abc"), ("a b c", "a b c"),
        ("Hаlf fօr", "Half for"), ("пoгoдa", "погода"), ("ακóμα", "ακόμα"), ("Nº ½ “x” – …", "Nº ½ “x” – …"), ("Ωmega Привет", None), ("Привет мир Ελλάδα", "Привет мир Ελλάδα"), ("", ""), (None, None), ("x" * 200_000 + " ", "x" * 200_000 + " "),
    ]
    df = spark.createDataFrame([(i, t, "extra") for i, (t, _) in enumerate(cases)], "id bigint, f0 string, value string")
    got = {r.id: r.plain for r in plain_form.plain_forms(df, "id", ["f0"]).collect()}
    for i, (_, want) in enumerate(cases):
        if cases[i][0] != "Ωmega Привет":
            assert got[i] == want, cases[i]
    assert plain_form.plain_forms(df.limit(0), "id", ["f0"]).count() == 0


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252")])
def test_garbled_forms_hold_the_chain(chain):
    word = "Größe"
    assert word.encode(chain[0]).decode(chain[1], "replace") in {t for t, _ in encoding.garbled_forms(word)}


def test_restoring(spark):
    clean = ["Größe der Welt", "Señor Peña", "Погода", "Été à la mer", "CORAÇÃO DE", "O’Neil – live"] * 3
    bad = {"GrÃ¶ÃŸe der Welt": "Größe der Welt", "SeÃƒÂ±or PeÃ±a": "Señor Peña", "Ïîãîäà": "Погода", "Se�or": "Señor", "Gr�¶ÃŸe": "Größe", "├ñffnen Kl├╢ster": "äffnen Klöster"}
    rows = [(i, t, None) for i, t in enumerate(clean + list(bad) + [None, "", "plain"])]
    df = spark.createDataFrame(rows, "id bigint, title string, artist string")
    got = {r.value: r.restored for r in encoding.garbled_cells(df, "id", ["title", "artist"]).collect()}
    assert got == bad
    assert encoding.garbled_cells(df.limit(0), "id", ["title"]).count() == 0


def _words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())


def test_leakage_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(12)] + [(90, None), (91, ""), (92, "short text")]
    docs = []
    for i in range(60):
        ws = rng.choices(vocab, k=30)
        if i % 3 == 0:
            p = items[rng.randrange(12)][1].split()
            n, at = rng.randrange(9, 16), rng.randrange(20)
            part = p[at : at + n]
            if i % 2:
                part[len(part) // 2] = "changed"
            ws[5:5] = part
        docs.append((i, " ".join(ws).title() + "!"))
    docs += [(100, None), (101, ""), (102, "w1 " * 50_000)]
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    want = set()
    for d, t in docs:
        w = _words(t)
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, p in items if (q := _words(p)) and any(tuple(q[k : k + 12]) in runs for k in range(len(q) - 11))}
    for exact in (None, 12):
        got = leakage.leaked_passages(D, I, exact=exact).filter("exact_words >= 12")
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert want
    # every stretch of 12 words or more with up to two replaced ones, equal at both ends
    loose = set()
    for d, t in docs:
        for i, p in items:
            w, q = _words(t)[:200], _words(p)
            for s in range(-len(q), len(w)):
                same = [k for k in range(max(0, s), min(len(w), len(q) + s)) if w[k] == q[k - s]]
                if any(b - a >= 11 and b - a - (y - x) <= 2 for x, a in enumerate(same) for y, b in enumerate(same) if b > a):
                    loose.add((d, i))
    got = leakage.leaked_passages(D, I).filter("overlap_words >= 12")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == loose and loose > want
    assert leakage.leaked_passages(D.limit(0), I).count() == 0


def test_masks_tolerate_one_replaced_word():
    for at in range(12):
        assert any(m[k] == "0" if 0 <= (k := at - s) < len(m) else True for m in leakage.MASKS for s in range(12 - len(m) + 1)), at


def test_masks_tolerate_two_replaced_words():
    for pair in itertools.combinations(range(1, 11), 2):  # an overlap begins and ends with equal words
        assert any(all(m[k] == "0" for at in pair if 0 <= (k := at - s) < len(m)) for m in leakage.MASKS for s in range(12 - len(m) + 1)), pair


def test_sainte_lague():
    assert mixture.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    rng = random.Random(2)
    for _ in range(50):
        w = {i: rng.uniform(0.1, 9) for i in range(rng.randrange(1, 9))}
        n = rng.randrange(0, 300)
        got, want = mixture.sainte_lague(w, n), {k: 0 for k in w}
        for _ in range(n):
            k = max(w, key=lambda k: (w[k] / (2 * want[k] + 1), -k))
            want[k] += 1
        assert got == want
    assert sum(mixture.sainte_lague({"a": 1, "b": 1}, 10, {"a": 2, "b": 3}).values()) == 5


def test_mix_reaches_the_shares(spark):
    rng = random.Random(4)
    docs = [(i, "abcd"[0 if i % 3 else rng.randrange(1, 4)], " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(5, 60)))) for i in range(3000)] + [(9000, "a", None), (9001, "zz", "text"), (None, "a", "x")]
    D = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    T = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("d", 0.1, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    T4 = T.filter("source <> 'none'")
    drawn = mixture.mix(D, T4, block_tokens=200, shard_tokens=5000)
    assert drawn.groupBy("doc_id").count().filter("count > 1").count() == 0
    for r in mixture.shares(drawn, T4).collect():
        assert abs(r.actual_share - r.target_share) < 0.02 and r.most_copies <= r.max_repeats
    again = mixture.mix(D.repartition(5), T4, block_tokens=200, shard_tokens=5000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    assert mixture.mix(D.limit(0), T4).count() == 0


def test_subjects_of_planted_documents(spark):
    rng = random.Random(8)
    terms = {a: [f"term{a}x{k}" for k in range(8)] for a in (1, 2, 3)}
    line = lambda a: f"We spoke about {rng.choice(terms[a])} and then about {rng.choice(terms[a])} at length."
    docs, truth, labels = [], set(), []
    for i in range(600):
        areas = rng.sample([1, 2, 3], rng.choice([1, 1, 2]))
        parts = [line(a) for a in areas for _ in range(4)] + ["Nothing more to say.", "See you next week."]
        if i % 10 == 0:
            parts.append(line(next(a for a in (1, 2, 3) if a not in areas)))
        docs.append((i, " ".join(parts)))
        truth |= {(i, a) for a in areas}
        if i % 4 == 0:
            labels.append((i, rng.choice(areas) if rng.random() > 0.1 else rng.choice([1, 2, 3]), "x"))
    docs += [(900, None), (901, "")]
    D, L = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1, "x"), (5000, 2, "y"), labels[0]], "doc_id bigint, subject_id int, annotator string")
    got = {(r.doc_id, r.subject_id) for r in subjects.subjects_of_documents(D, L).collect()}
    assert len(got & truth) / len(truth) > 0.98 and len(got & truth) / len(got) > 0.98
    assert subjects.subjects_of_documents(D, L.limit(0)).count() == 0
    key = lambda r: (r.doc_id, r.at, r.subject_id, round(r.score, 9))
    sent, joined = (sorted(map(key, subjects.label_sentences(D, L, sent_links=n).collect())) for n in (subjects.SENT_LINKS, 0))
    assert sent == joined


def test_words_of_documents_of_several_areas_still_link(spark):
    rng = random.Random(9)
    rare = lambda a: f"term{a}x{rng.randrange(12)}"
    docs, labels = [], []
    for i in range(300):  # one area each, without the hub words
        a = i % 3 + 1
        docs.append((i, " ".join(f"We spoke of {rare(a)} and {rare(a)} at length." for _ in range(4))))
        labels.append((i, a, "x"))
    for i in range(300, 360):  # two areas each: a hub word falls on both labels and cannot verify in the seeds
        two = rng.sample([1, 2, 3], 2)
        docs.append((i, " ".join(f"Then {rare(a)} met hub{a} again." for a in two for _ in range(4))))
        labels += [(i, a, "x") for a in two]
    alone = {(1000 + i, i % 3 + 1) for i in range(30)}  # only hub words, no label
    docs += [(d, f"Mostly plain{d} hub{a} here. Also other{d} hub{a} there.") for d, a in alone]
    D, L = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject_id int, annotator string")
    got = {(r.doc_id, r.subject_id) for r in subjects.subjects_of_documents(D, L).collect()}
    assert {g for g in got if g[0] >= 1000} == alone


def test_mix_of_documents_longer_than_a_block(spark):
    docs = [(i, "a", "alpha beta gamma " * 500) for i in range(200)] + [(1000 + i, "b", "alpha beta gamma " * 20) for i in range(3000)]
    D = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    T = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 1)], "source string, target_share double, max_repeats int")
    for r in mixture.shares(mixture.mix(D, T, block_tokens=200, shard_tokens=100_000), T).collect():
        assert abs(r.actual_share - r.target_share) < 0.02 and r.most_copies <= r.max_repeats


def test_further_forms_are_plain(spark):
    cases = {"ﾡￂ": "가", "Ĳssel ĳ": "IJssel ij", "ﬓﬗ": "մնմխ", "ﷺ x": "صلى الله عليه وسلم x", "aᅟb": "ab", "aㅤb": "ab", "☆️": "☆", "a\U000e0041b": "ab", "ǆ": "dž", "ﻻ": "لا"}
    stay = ["œuvre æ", "½ № ™ ª", "“x” – y", "한글", "שלום"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, *stay])], "id bigint, t string")
    got = {r.value: r.plain for r in plain_form.plain_forms(df, "id", ["t"]).collect()}
    assert got == cases | {t: t for t in stay}


def test_a_guess_counts_as_lost(spark):
    words = ["Größe", "Grüße", "Müller"]
    garbled = "Größe".encode("utf-8").decode("cp1252")
    half = garbled[:2] + "�" * 2 + garbled[4:]
    rows = [(w,) for w in words for _ in range(5)] + [(garbled,), ("Müller".encode().decode("cp1252"),), (half,)]
    got = {r.value: (r.restored, r.lost) for r in encoding.restore_values(spark.createDataFrame(rows, "t string"), ["t"]).collect()}
    assert got[garbled] == ("Größe", False) and got["Müller".encode().decode("cp1252")] == ("Müller", False)
    assert got[half][1]


def test_a_small_mix_meets_its_targets(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaaabbc"), "alpha beta gamma delta " * rng.randrange(10, 60)) for i in range(600)]
    D = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    T = spark.createDataFrame([("a", 0.5, 2), ("b", 0.42, 3), ("c", 0.08, 3)], "source string, target_share double, max_repeats int")
    for r in mixture.shares(mixture.mix(D, T), T).collect():
        assert abs(r.actual_share - r.target_share) < 0.01
    with pytest.warns(UserWarning, match="permit"):
        mixture.mix(D, T, total_tokens=10**9)


def test_labels_come_from_all_similar_documents(spark, monkeypatch):
    """Every labelled document that is similar enough counts, also beyond the eighth, in one part or many."""
    from spindrift.llm._shared import Cuts

    rng = random.Random(2)
    sets = {i: sorted(rng.sample(range(24), rng.randrange(1, 7))) for i in range(140)}
    label = {i: {rng.choice((3, 7)): 1.0} for i in range(100)}
    df = spark.createDataFrame(list(sets.items()), "doc_id long, features array<long>").repartition(3)
    now = spark.createDataFrame([(i, a, w) for i, x in label.items() for a, w in x.items()], "doc_id long, subject_id int, weight double")
    want, most = {}, 0
    for i, x in sets.items():
        near = {j: s for j in label if j != i and (s := len({*x} & {*sets[j]}) / len({*x} | {*sets[j]})) >= subjects.SIMILAR}
        most = max(most, len(near))
        for j, s in near.items():
            for a, w in label[j].items():
                want[i, a] = want.get((i, a), 0) + s * w
    assert most > 40
    for sent in (4_000_000, 50):
        monkeypatch.setattr(subjects, "SENT_FEATURES", sent)
        got = {(r.doc_id, r.subject_id): r.w for r in subjects._labels_near(df, df, now).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _phrase_sets(rng, docs, phrases, each, width=8):
    """Sets of some whole phrases of ``width`` features each, and a few single features; every eleventh repeats the one before."""
    out = {}
    for i in range(docs):
        f = {p * width + k for p in rng.sample(range(phrases), each) for k in range(width)} | {1000 + rng.randrange(60) for _ in range(3)}
        out[i] = out[i - 1] if i % 11 == 10 else sorted(f)
    return out


def _run_labels_near(spark, sets, label, to):
    """The rows of ``_labels_near`` in this process, and its seconds in them."""
    import pyarrow as pa

    class Here:
        runs = ()

        def mapInArrow(self, run, _):  # noqa: N802
            here = Here()
            here.runs = (run,)
            return here

        def unionByName(self, other):  # noqa: N802
            self.runs += other.runs
            return self

        def groupBy(self, *_):  # noqa: N802
            return self

        def agg(self, *_):
            return self

    df = spark.createDataFrame(list(sets.items()), "doc_id long, features array<long>")
    now = spark.createDataFrame([(i, a, w) for i, x in label.items() for a, w in x.items()], "doc_id long, subject_id int, weight double")
    runs = subjects._labels_near(df, Here(), now).runs
    batch = pa.record_batch([pa.array(list(to)), pa.array([sets[i] for i in to], pa.list_(pa.int64()))], names=["doc_id", "features"])
    start, got = time.perf_counter(), {}
    for run in runs:
        for rows in run(iter([batch])):
            for d, a, w in zip(*(c.to_pylist() for c in rows.columns)):
                got[d, a] = got.get((d, a), 0) + w
    return got, time.perf_counter() - start


def test_sets_are_compared_whole_in_tiles_and_halves(spark, monkeypatch):
    rng = random.Random(4)
    sets = _phrase_sets(rng, 260, 12, 3) | {300: [5], 301: [5], 302: [99_999], 303: list(range(400))}
    label = {i: {rng.choice((3, 7, 9)): 0.3 + rng.random()} for i in sets if i % 3 != 1}
    want = {}
    for i, x in sets.items():
        for j in label:
            both = len({*x} & {*sets[j]})
            if j != i and both / (len(x) + len(sets[j]) - both) >= subjects.SIMILAR:
                for a, w in label[j].items():
                    want[i, a] = want.get((i, a), 0) + both / (len(x) + len(sets[j]) - both) * w
    for tile, together, rows, sent in ((2048, 64, 32_768, 4_000_000), (16, 4, 32_768, 4_000_000), (16, 4, 60, 4_000_000), (2048, 64, 32_768, 900)):
        for name, value in (("TILE", tile), ("TOGETHER", together), ("TABLE_ROWS", rows), ("SENT_FEATURES", sent)):
            monkeypatch.setattr(subjects, name, value, raising=False)
        got, _ = _run_labels_near(spark, sets, label, list(sets))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_comparing_sets_costs_less_than_one_by_one(spark):
    """Against looking up each feature of each document, the seconds on sets of phrases fall by a third at least (before, they rose by a fifth)."""
    rng = random.Random(6)
    sets = _phrase_sets(rng, 12_000, 60, 6)
    label = {i: {i % 11: 1.0} for i in sets}
    to = list(range(0, 12_000, 10))
    number, size = np.concatenate([sets[i] for i in sets]), np.array([len(x) for x in sets.values()])
    order, starts = np.argsort(number, kind="stable"), np.append(0, np.cumsum(np.bincount(number)))
    holders, labels, plain = np.repeat(np.arange(len(sets)), size)[order], np.eye(11)[np.arange(len(sets)) % 11], {}
    start = time.perf_counter()
    for d in to:
        common = np.bincount(np.concatenate([holders[starts[f] : starts[f + 1]] for f in sets[d]]), minlength=len(sets))
        alike = common / (size + size[d] - common)
        near = np.flatnonzero((alike >= subjects.SIMILAR) & (np.arange(len(sets)) != d))
        plain |= {(d, a): w for a, w in enumerate(alike[near] @ labels[near]) if w}
    seconds = time.perf_counter() - start
    got, spent = min((_run_labels_near(spark, sets, label, to) for _ in range(2)), key=lambda r: r[1])
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in plain)
    assert spent < 0.7 * seconds, (spent, seconds)
