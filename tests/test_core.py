"""Golden values of single operators."""

import hashlib
import json
import random
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.config import DetectionConfig, from_settings
from spindrift.functions import columns as fc
from spindrift.functions import kernels
from spindrift.operators import cache, evaluation, grouping, journal, library, matching
from spindrift.schema import TRACK, conform, missing_columns
from spindrift.sources import audio, files
from spindrift.streaming import incremental


def tracks(spark, *rows):
    return conform(spark.createDataFrame([{"id": i, "filepath": f"/m/{i}.mp3", "duration": 200.0, "filesize": 100, "sha256": "", "audio_hash": "", **r} for i, r in enumerate(rows)], TRACK))


def test_config_rules():
    assert DetectionConfig().acoustic_threshold == 95
    for bad in ({"acoustic_threshold": 80}, {"review_threshold": -1}, {"max_workers": 0}, {"max_workers": True}, {"min_duration": -1}, {"possible_threshold": "80"}):
        with pytest.raises(ValueError):
            DetectionConfig(**bad)
    assert DetectionConfig.from_dict({"unknown": 1, "review_threshold": 30}).review_threshold == 30
    assert DetectionConfig.load("/no/such/file") == DetectionConfig()
    assert from_settings(0.9, 0.95).acoustic_threshold == 100


def test_alignment_goldens():
    a = np.arange(1000, 2000, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(2**32)
    assert kernels.align(a, a) == (1.0, 0)
    assert kernels.align(a, np.concatenate([a[250:], np.zeros(250, np.uint64)])) == (1.0, -250)
    assert kernels.align(np.full(40, 0xAAAAAAAA, np.uint64), np.full(40, 0x55555555, np.uint64))[0] < 0.2
    for n in (0, 1, 3, 4):
        assert kernels.align(a[:n], a) == (0.0, 0)


def _slow_align(a, b):
    best = None
    need = max(5, min(40, min(len(a), len(b)) // 2 + 1))
    for o in range(-min(600, len(a) - need), min(600, len(b) - need) + 1):
        x, y = (a, b[o:]) if o >= 0 else (a[-o:], b)
        n = min(len(x), len(y))
        if n >= need:
            rate = sum((p ^ q).bit_count() for p, q in zip(x, y)) / (32 * n)
            if best is None or (rate, abs(o), o) < best:
                best = (rate, abs(o), o)
    if best is None or best[0] >= 1 or min(len(a), len(b)) < 5:
        return 0.0, 0
    return (1 - best[0] / 0.5 if best[0] <= 0.5 else 0.0), best[2]


def test_alignment_three_ways(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(25):
        a = [rng.getrandbits(32) for _ in range(rng.choice([0, 3, 5, 8, 30, 60]))]
        b = [x ^ rng.choice([0, 0, 1 << rng.randrange(32)]) for x in a[rng.randrange(3) :]] + [rng.getrandbits(32) for _ in range(rng.randrange(9))]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = df.select(matching.native_alignment(F.col("a"), F.col("b")).alias("n"), kernels.ber_align("a", "b").alias("k"), "a", "b").collect()
    for r in got:
        want = _slow_align(r.a, r.b)
        assert tuple(r.k) == pytest.approx(want) and tuple(r.n) == pytest.approx(want)


def test_tokens_keep_prefix_zero_and_candidates_need_three(spark):
    t = tracks(spark, {"fingerprint": [7, 0, 32, 33]}, {"fingerprint": [7, 32, 33]}, {"fingerprint": [7]}, {"fingerprint": []}, {"fingerprint": None})
    tok = matching.tokens(t)
    assert {r.token for r in tok.filter("id = 0").collect()} == {7, 0, 32, 33}
    assert [tuple(r) for r in matching.candidate_pairs(tok).collect()] == [(0, 1, 4)]


def _scenario(spark, name, n):
    rows, pairs = files.scenario(name, n)
    df = spark.createDataFrame([(i, p, z, d, fp) for i, (p, z, d, fp) in enumerate(rows)], "id bigint, filepath string, filesize bigint, duration double, fingerprint array<bigint>")
    return df, pairs


def test_adversarial_scenario_counts(spark):
    t, pairs = _scenario(spark, "D", 1000)
    tok = matching.tokens(t)
    assert matching.candidate_pairs(tok).count() == 124_750 and not pairs
    c = matching.coverage(tok).first()
    assert (c.oversized_buckets, c.pairs_generated, c.pairs_dropped, c.is_approximate) == (11, 1_372_266, 4_122_250, True)


def test_realistic_scenario_counts(spark):
    t, pairs = _scenario(spark, "B", 1000)
    tok = matching.tokens(t)
    found = matching.candidate_pairs(tok)
    named = found.join(t.select(F.col("id").alias("id_a"), F.col("filepath").alias("a")), "id_a").join(t.select(F.col("id").alias("id_b"), F.col("filepath").alias("b")), "id_b")
    r = evaluation.pair_recall(named, spark.createDataFrame(pairs, "a string, b string")).first()
    assert (r.true_positives, r.missed, r.extra, r.recall, r.precision) == (556, 0, 0, 1.0, 1.0)
    assert not matching.coverage(tok).first().is_approximate


def test_other_scenarios(spark):
    t, pairs = _scenario(spark, "A", 200)
    assert t.count() == 200 and not pairs and matching.candidate_pairs(matching.tokens(t)).count() == 0
    t, pairs = _scenario(spark, "C", 60)
    assert matching.candidate_pairs(matching.tokens(t)).count() == len(pairs) > 250


@pytest.mark.parametrize("sim, gap, want", [(0.95, 2.0, "ACOUSTIC_DUPLICATE"), (0.9499, 2.0, "POSSIBLE_DUPLICATE"), (0.80, 2.0, "POSSIBLE_DUPLICATE"), (0.7999, 2.0, "LOW_CONFIDENCE_REVIEW"), (0.40, 2.0, "LOW_CONFIDENCE_REVIEW"), (0.3999, 2.0, "NO_MATCH")])
def test_thresholds_at_offset_15(spark, sim, gap, want):
    c = spark.range(1).select(matching.confidence(F.lit(sim), F.lit(15), F.lit(gap), F.lit(0.0), F.lit(0.0)).alias("c")).first().c
    name = next(n for n, t in (("ACOUSTIC_DUPLICATE", 95), ("POSSIBLE_DUPLICATE", 80), ("LOW_CONFIDENCE_REVIEW", 40), ("NO_MATCH", 0)) if c >= t)
    assert name == want


def test_evidence_tiers(spark):
    fp = [(i * 2654435761) % 2**32 for i in range(1, 60)]
    t = tracks(spark, {"fingerprint": fp}, {"fingerprint": fp}, {"fingerprint": fp, "duration": 320.0}, {"fingerprint": []}, {"sha256": "x"}, {"sha256": "x"}, {"fingerprint": fp, "duration": 260.0})
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (4, 5), (0, 6)], "id_a bigint, id_b bigint")
    for native in (False, True):
        got = {(r.id_a, r.id_b): (r.classification, r.requires_manual_review) for r in matching.evidence(pairs, t, native=native).collect()}
        assert got == {(0, 1): ("ACOUSTIC_DUPLICATE", False), (0, 2): ("NO_MATCH", False), (0, 3): ("UNCERTAIN", False), (4, 5): ("EXACT_HASH", False), (0, 6): ("POSSIBLE_DUPLICATE", True)}


def test_groups_weakest_edge_and_ties(spark):
    t = tracks(spark, {"quality_score": 50.0}, {"quality_score": 80.0}, {"quality_score": 80.0}, {})
    e = spark.createDataFrame([(0, 1, "EXACT_HASH", 100.0, False), (1, 2, "POSSIBLE_DUPLICATE", 85.0, True), (2, 3, "NO_MATCH", 0.0, False)], "id_a bigint, id_b bigint, classification string, confidence double, requires_manual_review boolean")
    g, m = grouping.groups(e, t)
    r = g.first()
    assert (r.primary_type, r.members, r.best_track_path, r.average_similarity, r.space_saving_bytes) == ("POSSIBLE_DUPLICATE", 3, "/m/1.mp3", 100.0, 0)
    assert {x.action for x in m.collect()} == {"UNSET"}
    assert grouping.numbered(g, m).first().group_id == "group_001"


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {n: find(n) for n in {n for e in edges if e[0] != e[1] for n in e}}
    got = grouping.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.label for r in got} == want
    assert grouping.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_quality_goldens(spark):
    rows = [("FLAC", 900, 44100, 16, True, 0.0), ("MP3", 320, 44100, 16, False, 0.0), ("FLAC", 850, 44100, 16, True, 85.0)]
    df = spark.createDataFrame(rows, "format string, bitrate int, samplerate int, bit_depth int, is_lossless boolean, fake_lossless_confidence double").withColumn("spectral_assessment", F.lit("unknown"))
    a, b, c = [r.s for r in df.select(kernels.round_exact_1(library.quality_score()).alias("s")).collect()]
    assert a == 84.0 and a > b > c


def test_paths_and_text(spark):
    df = spark.createDataFrame([("C:/Music/a.mp3",), ("c:\\music\\b.MP3",), ("C:/Music2/c.mp3",), ("C:/Hits_100%/d",)], "filepath string")
    assert library.in_folder(df, "C:\\Music").count() == 2 and library.in_folder(df, "C:/Hits_100%/").count() == 1 and library.in_folder(df, "").count() == 4
    assert fc.prefix_pattern("a_b%") == "a^_b^%/%"
    r = spark.range(1).select(fc.duration_text(F.lit(61.9)).alias("d"), fc.size_text(F.lit(1048576)).alias("s"), fc.eta_text(F.lit(3700)).alias("e")).first()
    assert (r.d, r.s, r.e) == ("1:01", "1.0 MB", "~1h 1m")


def test_spectrum():
    rng = np.random.default_rng(777)
    noise = rng.normal(0, 0.1, 44100 * 4)
    assert kernels.spectral_assessment(noise, 44100, 1, 4.0)[0] == "no_lossy_evidence"
    assert kernels.spectral_assessment(np.zeros(44100 * 4), 44100, 1, 4.0)[1] == "insufficient_signal_energy"
    assert kernels.spectral_assessment(noise[:4000], 44100, 1, 0.1)[1] == "insufficient_duration"
    assert kernels.spectral_assessment(noise, 32000, 1, 4.0)[1] == "insufficient_frequency_bandwidth"
    noise[5] = np.nan
    assert kernels.spectral_assessment(noise, 44100, 1, 4.0)[1] == "nan_or_invalid_spectrum"
    t = np.arange(44100 * 4) / 44100
    tones = sum(np.sin(2 * np.pi * f * t) for f in (2000, 5000, 9000, 12000, 15500)) * 0.1
    got = kernels.spectral_assessment(tones, 44100, 1, 4.0)
    assert got[0] == "suspected_transcode" and got[2] < 17000


def test_files_cache_and_wav(spark, tmp_path):
    for n, size in (("a.mp3", 10), ("b.FLAC", 20000), ("c.txt", 5), ("d.wav", 0)):
        (tmp_path / n).write_bytes(b"x" * size)
    with wave.open(str(tmp_path / "e.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes((np.sin(np.arange(44100 * 4) / 9) * 9000).astype("<i2").tobytes())
    found = files.discover(spark, str(tmp_path))
    assert {r.filepath.rsplit("/", 1)[1] for r in found.collect()} == {"a.mp3", "b.FLAC", "e.wav"}
    stats = files.stat_files(found)
    old = stats.select(F.lit(1).cast("bigint").alias("id"), "filepath", F.col("new_size").alias("filesize"), F.col("new_mtime_ns").alias("mtime_ns"), F.col("new_signature").alias("quick_signature")).filter("filepath NOT LIKE '%a.mp3'")
    assert cache.misses(stats, old).select("filepath").first().filepath.endswith("a.mp3")
    wav = found.filter("filepath LIKE '%.wav'").select("filepath").mapInPandas(kernels.read_wav, "filepath string, samples array<float>, rate int, channels int, seconds double").first()
    assert wav.rate == 44100 and len(wav.samples) == 44100 * 4
    assert kernels.file_signature("/no/such") == ""


def test_upsert_keeps_ids_and_schema_conforms(spark):
    c = tracks(spark, {"quality_score": 1.0}, {"quality_score": 2.0})
    n = c.filter("id = 1").withColumns({"id": F.lit(9).cast("bigint"), "quality_score": F.lit(5.0)})
    assert sorted((r.id, r.quality_score) for r in cache.upsert(c, n).collect()) == [(0, 1.0), (1, 5.0)]
    legacy = spark.createDataFrame([(1, "/a", 1)], "id bigint, filepath string, is_fake_lossless int")
    assert conform(legacy).first().fake_lossless_confidence == 1.0 and not missing_columns(conform(legacy))


def test_evaluation_golden(spark):
    counts = {("EXACT_HASH", "EXACT_HASH"): 10, ("EXACT_HASH", "POSSIBLE_DUPLICATE"): 2, ("POSSIBLE_DUPLICATE", "EXACT_HASH"): 1, ("POSSIBLE_DUPLICATE", "POSSIBLE_DUPLICATE"): 5, ("POSSIBLE_DUPLICATE", "NO_MATCH"): 2, ("NO_MATCH", "POSSIBLE_DUPLICATE"): 1, ("NO_MATCH", "NO_MATCH"): 20}
    df = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "expected string, predicted string")
    m = {r["class"]: r for r in evaluation.class_metrics(df).collect()}
    assert round(m["EXACT_HASH"].precision, 4) == 0.9091 and round(m["EXACT_HASH"].recall, 4) == 0.8333
    assert df.filter(evaluation.error_severity() == "CRITICAL").count() == 1


def test_journal_and_plan(spark, tmp_path):
    j = spark.createDataFrame([("1", "/a", "BACKUP", "/b", s, "t0", u) for s, u in (("PENDING", "t1"), ("FS_DONE", "t2"))] + [("2", "/c", "DELETE", None, "PENDING", "t0", "t1")], "op_id string, filepath string, action string, target_path string, state string, created_at string, updated_at string")
    there = spark.createDataFrame([("/b",), ("/c",)], "filepath string")
    assert {r.op_id: r.outcome for r in journal.reconcile(j, there).collect()} == {"1": "COMPLETED", "2": "ABORTED"}
    src = tmp_path / "x.mp3"
    src.write_text("x")
    out = journal.execute([(str(src), str(tmp_path / "to" / "x.mp3")), ("/no/such", str(tmp_path / "y"))], journal.Journal(str(tmp_path / "j.jsonl")))
    assert out["success"] == 1 and out["failed"] == 1 and (tmp_path / "to" / "x.mp3").exists()


def test_session_round_trip(spark, tmp_path):
    p = str(tmp_path / "s.json")
    g = spark.createDataFrame([("g1", "POSSIBLE_DUPLICATE", False, [("/a",), ("/b",)]), ("g2", "EXACT_HASH", False, [("/c",)])], "group_id string, primary_type string, requires_manual_review boolean, tracks array<struct<filepath:string>>")
    assert files.save_session(g, "/m", p)
    r = files.load_session(spark, p).collect()
    assert [x.group_id for x in r] == ["g1"] and r[0].requires_manual_review
    (tmp_path / "s.json").write_text("{broken")
    assert files.load_session(spark, p).count() == 0


def test_near_links_join_what_all_pairs_join(spark):
    rng = random.Random(4)
    t = tracks(spark, *[{"audio_hash": rng.choice("xyz"), "duration": round(rng.uniform(0, 12), 1)} for _ in range(80)], {"audio_hash": "x", "duration": None}, {"audio_hash": "", "duration": 1.0})
    comps = lambda e: {r.node: r.label for r in grouping.components(e, "id_a", "id_b").collect()}
    links = matching.near_links(t, "audio_hash")
    assert comps(links) == comps(matching.exact_pairs(t, "audio_hash", 0.5)) and links.count() < 160
    assert matching.near_links(t.limit(0), "audio_hash").count() == 0


def test_audio_hash_counts_only_where_the_sound_is_equal(spark):
    fp = [(i * 2654435761) % 2**32 for i in range(1, 60)]
    t = tracks(spark, *[{"audio_hash": "h", "fingerprint": fp} for _ in range(3)])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "id_a bigint, id_b bigint")
    sound = spark.createDataFrame([(0, "p"), (1, "p"), (2, "q")], "id bigint, pcm_hash string")
    got = {r.id_b: (r.classification, r.reasons) for r in matching.evidence(pairs, t, sound=sound).collect()}
    assert got[1][0] == "EXACT_AUDIO" and got[2][0] == "ACOUSTIC_DUPLICATE" and "audio_hash_not_verified" in got[2][1]


def test_group_numbers_are_dense_across_partitions(spark):
    g = spark.createDataFrame([(f"l{i:04d}",) for i in range(500)], "label string").repartition(16)
    m = g.select("label", F.concat(F.lit("/"), F.reverse("label")).alias("filepath"))
    got = {r.label: r.group_id for r in grouping.numbered(g, m).collect()}
    want = {r: f"group_{k:03d}" for k, r in enumerate(sorted(got, key=lambda x: x[::-1]), 1)}
    assert got == want


def test_large_groups_are_ranked_in_parts(spark):
    rng = random.Random(6)
    t = tracks(spark, *[{"quality_score": rng.choice([None, 1.0, 50.0]), "bitrate": rng.choice([128, 320]), "filesize": rng.randrange(5)} for _ in range(120)])
    links = [(0, i) for i in range(1, 90)] + [(90, i) for i in range(91, 94)]
    e = spark.createDataFrame([(a, b, "EXACT_HASH", 100.0, False) for a, b in links], "id_a bigint, id_b bigint, classification string, confidence double, requires_manual_review boolean")
    plain, split = ({(r.label, r.id): (r["rank"], r.action) for r in grouping.groups(e, t, hot=h)[1].collect()} for h in (1000, 10))
    assert plain == split and len(plain) == 94
    assert sorted(k for (lab, _), (k, _) in split.items() if lab == 0) == list(range(1, 91))


def test_coverage_report(spark):
    c = matching.coverage(spark.createDataFrame([(t, i) for t in (1, 2) for i in range(3)], "token bigint, id bigint"), 2)
    r = matching.coverage_report(c).first()
    assert r.is_approximate and not r.is_complete and r.scan_status == "SUCCESS"
    r = matching.coverage_report(matching.coverage(spark.createDataFrame([(1, 1)], "token bigint, id bigint")), cancelled=True).first()
    assert r.is_complete and r.scan_status == "CANCELLED"


def _wav(path, values, width=2, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        x = np.asarray(values)
        w.writeframes((x + 128).astype(np.uint8).tobytes() if width == 1 else x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())


def test_wav_of_every_width(tmp_path):
    for width, top in ((1, 127), (2, 32767), (3, 2**23 - 1), (4, 2**31 - 1)):
        values = [0, 1, -1, top, -top - 1]
        _wav(tmp_path / "x.wav", values, width)
        x, rate, bits = audio.samples(str(tmp_path / "x.wav"))
        assert x[:, 0].tolist() == values and (rate, bits) == (8000, width * 8)


def test_sound_and_file_hashes(spark, tmp_path):
    tone = (np.sin(np.arange(24000) / 7) * 9000).astype(int)
    _wav(tmp_path / "a.wav", tone), _wav(tmp_path / "b.wav", tone), _wav(tmp_path / "c.wav", np.append(tone[:-1], 0)), (tmp_path / "d.wav").write_bytes(b"RIFF")
    (tmp_path / "b.wav").write_bytes((tmp_path / "b.wav").read_bytes() + b"LIST\4\0\0\0INFO")
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.wav"),) for n in "abcd"], "filepath string")
    r = {x.filepath[-5]: x for x in audio.sound_hashes(paths).collect()}
    assert r["a"].pcm_hash == r["b"].pcm_hash != r["c"].pcm_hash and r["a"].frames == 24000
    assert r["a"].prefix_hash == r["b"].prefix_hash and r["d"].error and r["d"].pcm_hash is None
    h = {x.filepath[-5]: x.sha256 for x in audio.file_hashes(paths).collect()}
    assert h["a"] == hashlib.sha256((tmp_path / "a.wav").read_bytes()).hexdigest() != h["b"]
    seen = spark.createDataFrame([(str(tmp_path / "a.wav"), h["a"]), (str(tmp_path / "b.wav"), h["a"]), (str(tmp_path / "gone.wav"), "x")], "filepath string, sha256 string")
    assert {x.filepath[-5] for x in audio.changed_files(seen).collect()} == {"b", "e"}


def test_metadata_from_headers(spark, tmp_path):
    _wav(tmp_path / "a.wav", [0] * 16000, rate=16000)
    info = b"INFOIART\x08\0\0\0Singer\0\0INAM\x05\0\0\0Song\0\0"
    raw = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "a.wav").write_bytes(raw + b"LIST" + len(info).to_bytes(4, "little") + info)
    bits = (44100 << 44 | 1 << 41 | 23 << 36 | 441000).to_bytes(8, "big")
    comment = b"\0\0\0\0\2\0\0\0" + b"".join(len(c).to_bytes(4, "little") + c for c in (b"ARTIST=Band", "title=Lied é".encode()))
    (tmp_path / "b.flac").write_bytes(b"fLaC\0\0\0\x22" + b"\0" * 10 + bits + b"\0" * 16 + b"\x84" + len(comment).to_bytes(3, "big") + comment)
    tag = b"TIT2\0\0\0\x05\0\0\3Abcd" + b"TALB\0\0\0\x05\0\0\1" + b"\xff\xfeX\0"
    (tmp_path / "c.mp3").write_bytes(b"ID3\4\0\0\0\0\0" + bytes([len(tag)]) + tag + b"\xff\xfb\x90\x00" + b"\0" * 15996)
    (tmp_path / "d.ogg").write_bytes(b"nothing")
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.wav", "b.flac", "c.mp3", "d.ogg", "none.mp3")], "filepath string")
    r = {x.filepath.rsplit("/", 1)[1]: x for x in audio.metadata(df).collect()}
    assert (r["a.wav"].samplerate, r["a.wav"].channels, r["a.wav"].bit_depth, r["a.wav"].duration, r["a.wav"].artist, r["a.wav"].title) == (16000, 1, 16, 1.0, "Singer", "Song")
    assert (r["b.flac"].samplerate, r["b.flac"].channels, r["b.flac"].bit_depth, r["b.flac"].duration, r["b.flac"].artist, r["b.flac"].title) == (44100, 2, 24, 10.0, "Band", "Lied é")
    assert (r["c.mp3"].bitrate, r["c.mp3"].samplerate, r["c.mp3"].channels, r["c.mp3"].title, r["c.mp3"].album) == (128, 44100, 2, "Abcd", "X") and r["c.mp3"].duration == 1.0
    assert r["d.ogg"].error and r["none.mp3"].error
    ruled = files.metadata_rules(audio.metadata(df).withColumn("filesize", F.lit(1_000_000))).select("filepath", "format", "is_lossless").collect()
    assert {x.filepath.rsplit("/", 1)[1]: (x.format, x.is_lossless) for x in ruled}["c.mp3"] == ("MP3", False)


def test_probe_facts():
    text = '{"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "alac", "sample_rate": "48000", "channels": 2, "sample_fmt": "s32p", "bits_per_raw_sample": "24", "duration": "3.5"}], "format": {"bit_rate": "900000", "tags": {"TITLE": "T"}}}'
    d = audio.parse_probe(text)
    assert (d["codec"], d["samplerate"], d["layout"], d["bit_depth"], d["lossless"], d["bitrate"], d["duration"], d["tags"]) == ("alac", 48000, "stereo", 24, True, 900, 3.5, {"TITLE": "T"})
    assert audio.parse_probe("{}") == audio.parse_probe("no json") == {}


def test_missing_fingerprint_tool_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", "/nowhere")
    r = next(files._fingerprint(60, 5)(iter([pd.DataFrame({"filepath": ["/a.mp3"]})]))).iloc[0]
    assert r.fingerprint is None and "not installed" in r.error


def test_watched_folder_flows_into_the_table(spark, tmp_path):
    music, root = tmp_path / "music", str(tmp_path / "table")
    music.mkdir()
    (music / "a.mp3").write_bytes(b"x" * 10), (music / "b.txt").write_bytes(b"x")
    base = cache.fitted(spark.createDataFrame([(7, str(music / "a.mp3"), 5)], "id bigint, filepath string, filesize bigint"), TRACK)
    base.write.parquet(f"{root}/v00000000")
    read = lambda: spark.read.parquet(f"{root}/v00000000")
    run = lambda: incremental.upsert_stream(incremental.watch(spark, str(music)), root, read, str(tmp_path / "ck")).awaitTermination(120)
    run()
    (music / "c.flac").write_bytes(b"y" * 20)
    run()
    rows = {r.filepath.rsplit("/", 1)[1]: r for r in incremental.current(spark, read(), root, 5).collect()}
    assert rows.keys() == {"a.mp3", "c.flac"} and (rows["a.mp3"].id, rows["a.mp3"].filesize) == (7, 10) and rows["c.flac"].last_scanned is not None
    deltas = spark.read.parquet(f"{root}/delta-*").count()
    run()  # nothing new: nothing is added
    assert spark.read.parquet(f"{root}/delta-*").count() == deltas == 2
    path = incremental.compact(spark, read(), root, 5, 1)
    assert spark.read.parquet(path).count() == 2 and cache.stored_size(spark, path) > 0


def test_bounded_batches(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.mp3").write_bytes(b"x")
    seen = []
    q = incremental.watch(spark, str(tmp_path), max_files=2).writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(seen) == 5 and max(seen) <= 2
    done = incremental.batches_done(q)
    assert [b["batch"] for b in done if b["rows"]] == [0, 1, 2] and all(b["rows_per_second"] > 0 for b in done if b["rows"])


def test_trash_and_report(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "share"))
    for n in ("p", "q"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.mp3").write_text(n)
    steps = [(str(tmp_path / n / "x.mp3"), None) for n in ("p", "q")]
    assert journal.execute(steps, journal.Journal(str(tmp_path / "j.jsonl")), "TRASH")["success"] == 2
    assert sorted(f.name for f in (tmp_path / "share/Trash/files").iterdir()) == ["x.mp3", "x_1.mp3"]
    pairs = spark.createDataFrame([("/a", "/b", "EXACT_HASH", "EXACT_HASH", 100.0), ("/a", "/c", "NO_MATCH", "EXACT_HASH", 81.239)], "a string, b string, expected string, predicted string, confidence double")
    evaluation.write_report(spark, pairs, str(tmp_path / "eval"))
    doc = json.loads((tmp_path / "eval.json").read_text())
    assert doc["accuracy"] == 0.5 and doc["classes"]["EXACT_HASH"]["tp"] == 1
    assert {r.confidence for r in spark.read.option("header", True).csv(str(tmp_path / "eval_scores")).collect()} == {"100.00", "81.24"}


def test_manifest_and_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("track_a_path,track_b_path,expected_category,note\\n/a,/b,EXACT_HASH,x\\n , /c,NO_MATCH,\\n/d,/e,NO_MATCH,\\n".replace("\\n", "\n"))
    assert [r.track_a_path for r in files.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == ["/a", "/d"]
    assert files.read_manifest(spark, str(tmp_path / "m.csv"), limit=1).count() == 1
    g = spark.createDataFrame([("g", "EXACT_HASH", "/m/0.mp3", "best", False)], "group_id string, primary_type string, best_track_path string, best_track_reason string, requires_manual_review boolean")
    m = spark.createDataFrame([("g", "/m/0.mp3"), ("g", "/m/1.mp3"), ("g", "/none")], "group_id string, filepath string")
    files.write_csv(files.report_rows(g, m, tracks(spark, {}, {})), str(tmp_path / "report"), one_file=True)
    got = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert tuple(got.columns) == files.REPORT_HEADER and {(r["Ruta Archivo"], r["Acción Recomendada"]) for r in got.collect()} == {("/m/0.mp3", "CONSERVAR"), ("/m/1.mp3", "ELIMINAR")}


def test_eligibility_edges(spark):
    t = tracks(spark, {"duration": 4.9}, {"duration": 5.0, "is_lossless": True}, {"duration": 0.0}, {"duration": None})
    got = {r.id: (r.wants_fingerprint, r.keeps_fingerprint, r.wants_spectrum) for r in files.eligibility(t).collect()}
    assert got == {0: (False, False, False), 1: (True, True, True), 2: (True, False, False), 3: (True, False, False)}


def test_legacy_fingerprints_and_partial_hash(spark):
    df = spark.createDataFrame([([1, 2**32 - 1, 7],)], "f array<bigint>")
    packed = df.select("f", kernels.pack_fingerprint("f").alias("b"))
    assert packed.select(kernels.unpack_fingerprint("b").alias("f")).first().f == [1, 2**32 - 1, 7]
    body = bytes(range(256)) * 1024
    got = spark.createDataFrame([(bytearray(body),)], "c binary").select(kernels.partial_sha256("c").alias("h")).first().h
    assert got == hashlib.sha256(len(body).to_bytes(8, "little") + body[:65536] + body[-65536:]).hexdigest()


def test_texts(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [f(fc.total_text(F.lit(v))) for v in (5, 2048, 3 << 20, 5 << 30, 3 << 40)] == ["5 B", "2.0 KB", "3.0 MB", "5.00 GB", "3.00 TB"]
    assert f(fc.plain_path(F.lit("M:\\\\a//b/"))) == "M:/a/b" and f(fc.plain_path(F.lit("/"))) == "/"
    assert f(fc.first_tag(F.create_map(F.lit("TITLE"), F.lit(" x ")), "title", "TIT2")) == "x"


def test_uncut_candidates_of_frequent_tokens_equal_all_pairs(spark, monkeypatch):
    """Classes of frequent tokens, cold partners and both, in several parts, against counting by hand; no meeting of a frequent token is joined."""
    import random

    rng = random.Random(5)
    common = [[16 * k + rng.randrange(16) for k in range(1, 7)] for _ in range(5)]
    prints = [rng.sample(rng.choice(common), rng.randrange(0, 6)) + [rng.randrange(1000, 1400) for _ in range(rng.randrange(0, 9))] for _ in range(150)]
    rows = [(i, f"/{rng.randrange(10**6)}", x) for i, x in enumerate(prints)]
    t = spark.createDataFrame(rows, "id bigint, filepath string, fingerprint array<bigint>")
    sets = {i: {x for x in f if x} | {x & ~15 for x in f if x} for i, _, f in rows}
    path = {i: (p, i) for i, p, _ in rows}
    want = sorted((*sorted((a, b), key=path.get), n) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= 3)
    tok = matching.tokens(t, frames=None)
    for hot, sent in ((8, 5_000_000), (8, 100), (2, 300), (10_000, 5_000_000)):
        monkeypatch.setattr(matching, "HOT_TOKEN", hot)
        monkeypatch.setattr(matching, "SENT_ENTRIES", sent)
        assert sorted(tuple(r) for r in matching.candidate_pairs(tok, cap=None).collect()) == want


def test_uncut_candidates_shuffle_no_pairs_of_one_token(spark, monkeypatch):
    """300 tracks of the same three tokens: 44,850 pairs, and no more rows in any join than tracks."""
    monkeypatch.setattr(matching, "HOT_TOKEN", 20)
    t = spark.createDataFrame([(i, f"/{i:04}", [16, 32, 48]) for i in range(300)], "id bigint, filepath string, fingerprint array<bigint>")
    joined = []
    by_path = matching._by_path
    monkeypatch.setattr(matching, "_by_path", lambda met, paths: joined.append(met.count()) or by_path(met, paths))
    found = matching.candidate_pairs(matching.tokens(t, frames=None), cap=None)
    assert found.count() == 300 * 299 // 2 and found.filter("hits <> 3 OR id_a >= id_b").count() == 0
    assert joined == [0]
