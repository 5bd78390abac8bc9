"""The core queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import cache, evaluation, grouping, journal, library, matching
from ..schema import latest, with_load_defaults
from ..streaming import incremental
from ..tables import written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _library(spark: SparkSession, d: str) -> DataFrame:
    return latest(_t(spark, d, "tracks"))




def latest_scan(s, d):
    return _library(s, d).select("filepath", "id", "filesize", "quality_score")


def load_defaults(s, d):
    return with_load_defaults(_t(s, d, "tracks")).select("id", "samplerate", "channels", "bit_depth", "bitrate", "duration", "format", "sha256", "quality_score", "spectral_assessment")


def derived_columns(s, d):
    return _t(s, d, "tracks").select("id", fc.filename("filepath").alias("filename"), fc.extension("filepath").alias("extension"), fc.display_title().alias("display_title"), fc.duration_text("duration").alias("duration_text"))


def folder_prefix(s, d):
    return library.in_folder(_t(s, d, "tracks"), "m:\\archive0001\\").select("id", "filepath")


def library_search(s, d):
    return library.search(_t(s, d, "tracks"), "garden", "MP3").select("id", "title", "format")


def quality_tabs(s, d):
    t = _t(s, d, "tracks")
    out = None
    for name in ("fake", "lossless", "low", "hires"):
        part = library.quality_tab(t, name).select("id", F.lit(name).alias("tab"))
        out = part if out is None else out.unionByName(part)
    return out


def diagnoses(s, d):
    return _t(s, d, "tracks").select("id", library.diagnosis().alias("diagnosis"))


def format_stats(s, d):
    return library.format_stats(_t(s, d, "tracks"))


def top_formats(s, d):
    return library.top_formats(_t(s, d, "tracks"))


def quality_kpis(s, d):
    return library.quality_kpis(_t(s, d, "tracks")).withColumn("average_score", F.round("average_score", 6))


def library_page(s, d):
    return library.page(library.ordered(_t(s, d, "tracks").select("id", "filepath", "quality_score"), "score"), 1, 50)


def quality_scores(s, d):
    return _t(s, d, "tracks").select("id", library.quality_score().alias("score"))


def exact_hash_pairs(s, d):
    return matching.exact_pairs(_t(s, d, "tracks"), "sha256").select("id_a", "id_b")


def exact_audio_pairs(s, d):
    return matching.exact_pairs(_t(s, d, "tracks"), "audio_hash", matching.AUDIO_TOLERANCE).select("id_a", "id_b")


def exact_hash_links(s, d):
    return matching.exact_links(_t(s, d, "tracks"), "sha256")


def track_tokens(s, d):
    return matching.tokens(_t(s, d, "tracks")).groupBy("id").agg(F.count("*").alias("tokens"), F.min("token").alias("lowest"), F.max("token").alias("highest"), F.sum("token").alias("total"), F.bit_xor("token").alias("mixed"))


def candidates(s, d):
    return matching.candidate_pairs(matching.tokens(_t(s, d, "tracks")))


def candidates_capped(s, d):
    return matching.candidate_pairs(matching.tokens(_t(s, d, "tracks")), cap=4)


def candidate_coverage(s, d):
    return matching.coverage(matching.tokens(_t(s, d, "tracks")), cap=4)


def pair_evidence(s, d):
    t = written(_library(s, d))
    pairs = matching.candidate_pairs(matching.tokens(t))
    return matching.evidence(pairs, t).withColumn("reasons", F.array_join("reasons", ","))


def pipeline(s, d) -> tuple[DataFrame, DataFrame]:
    """Candidates outside exact groups, evidence, components, groups and ranked members of the whole library."""
    t = written(_library(s, d))
    link = lambda df, kind: df.select("id_a", "id_b", F.lit(kind).alias("classification"), F.lit(100.0).alias("confidence"), F.lit(False).alias("requires_manual_review"))
    exact = link(matching.exact_links(t, "sha256"), "EXACT_HASH").unionByName(link(matching.near_links(t, "audio_hash"), "EXACT_AUDIO")).checkpoint()
    label = grouping.components(exact, "id_a", "id_b")
    pairs = matching.candidate_pairs(matching.tokens(t))
    la, lb = (label.select(F.col("node").alias(f"id_{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
    open_pairs = pairs.join(la, "id_a", "left").join(lb, "id_b", "left").filter("la IS NULL OR lb IS NULL OR la <> lb").select("id_a", "id_b")
    scored = matching.duplicates_only(matching.evidence(open_pairs, t)).select(*exact.columns)
    return grouping.groups(exact.unionByName(scored).checkpoint(), t)


def group_pipeline(s, d):
    return pipeline(s, d)[0]


def group_members_ranked(s, d):
    return pipeline(s, d)[1]


def _reports(s, d):
    r = _t(s, d, "evidence_reports")
    return r.select("track_a_path", "track_b_path", "classification", "confidence", "requires_manual_review").filter("track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path")


def report_groups(s, d):
    return grouping.groups(_reports(s, d), _library(s, d), "track_a_path", "track_b_path", "filepath")[0]


def report_actions(s, d):
    _, m = grouping.groups(_reports(s, d), _library(s, d), "track_a_path", "track_b_path", "filepath")
    return m.select("label", "filepath", "rank", "action")


def report_summary(s, d):
    return grouping.summary(report_groups(s, d))


def session_prune(s, d):
    return grouping.prune(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _library(s, d))


def session_recommend(s, d):
    return grouping.recommend(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"))


def session_summary(s, d):
    return grouping.summary(_t(s, d, "duplicate_groups"))


def session_sorted(s, d):
    g = _t(s, d, "duplicate_groups").select("group_id", "primary_type", "space_saving_bytes")
    return library.page(grouping.tab(g, "acoustic").orderBy(F.desc_nulls_last("space_saving_bytes"), "group_id"), 0, 50)


def cache_partition(s, d):
    """Every file's newest scan against its oldest as the cache: what a rescan would skip."""
    t = _t(s, d, "tracks").filter("filepath IS NOT NULL")
    now = latest(t).select("filepath", F.col("filesize").alias("new_size"), F.col("mtime_ns").alias("new_mtime_ns"), F.col("quick_signature").alias("new_signature"))
    row = F.struct("filesize", "mtime_ns", "quick_signature")
    old = t.groupBy("filepath").agg(F.min_by(row, F.struct("last_scanned", "id")).alias("r")).select("filepath", "r.*")
    return cache.partition_by_cache(now, old).select("filepath", "cache_hit")


def cache_upsert(s, d):
    t = _t(s, d, "tracks").filter("filepath IS NOT NULL")
    first = t.groupBy("filepath").agg(F.min_by(F.struct(*t.columns), F.struct("last_scanned", "id")).alias("r")).select("r.*")
    return cache.upsert(first, t).select("filepath", "id", "filesize", "quality_score")


def _labelled(s, d):
    """The latest report of a pair as the label, the earliest as the prediction."""
    r = _t(s, d, "evidence_reports").filter("track_a_path IS NOT NULL AND track_b_path IS NOT NULL")
    when = F.struct("reported_at", "confidence", "classification")
    a, b = F.least("track_a_path", "track_b_path"), F.greatest("track_a_path", "track_b_path")
    return r.groupBy(a.alias("a"), b.alias("b")).agg(F.max_by("classification", when).alias("expected"), F.min_by("classification", when).alias("predicted"))


def evaluation_metrics(s, d):
    return evaluation.class_metrics(_labelled(s, d))


def evaluation_confusion(s, d):
    return evaluation.confusion(_labelled(s, d))


def evaluation_severity(s, d):
    return _labelled(s, d).groupBy(F.coalesce(evaluation.error_severity(), F.lit("NONE")).alias("severity")).agg(F.count("*").alias("pairs"))


def manifest_hydrated(s, d):
    r = _t(s, d, "evidence_reports").select("track_a_path", "track_b_path", F.col("classification").alias("expected_category"))
    return evaluation.hydrate(r, _library(s, d)).select("track_a_path", "track_b_path", "expected_category", "id_a", "id_b", "error")


def journal_states(s, d):
    return journal.last_states(_t(s, d, "operation_journal")).select("op_id", "state", "updated_at")


def journal_reconcile(s, d):
    return journal.reconcile(_t(s, d, "operation_journal"), _t(s, d, "tracks"))


def action_plan(s, d):
    return journal.plan(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _t(s, d, "tracks"), folder="/backup")


def action_status(s, d):
    p = action_plan(s, d)
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = p.groupBy("group_id").agg(n("planned").alias("success"), F.count_if(F.col("verdict").isin("last_copy", "missing")).alias("failed"), n("blocked").alias("blocked"), F.lit(0).alias("partial"))
    return g.select("group_id", journal.status().alias("status"))


def event_speed(s, d):
    """Values in hundredths, so that the moving sums are exact in any order."""
    e = _t(s, d, "events").select(F.col("user_id").alias("series"), "ts", F.col("event_id").alias("event"), F.round(F.col("value") * 100).alias("value"))
    return incremental.moving_speed(e).select("event", "average")


def sign_bits(s, d):
    """Differing signs between each embedding and its label's first vector, over all dimensions."""
    e = _t(s, d, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    wrong = F.aggregate(F.zip_with("embedding", "first", lambda x, y: ((x >= 0) != (y >= 0)).cast("int")), F.lit(0), lambda n, x: n + x)
    return e.join(first, "label").select("vec_id", wrong.alias("bit_errors"))


_NAMES = """latest_scan load_defaults derived_columns folder_prefix library_search quality_tabs diagnoses format_stats top_formats quality_kpis library_page quality_scores
exact_hash_pairs exact_audio_pairs exact_hash_links track_tokens candidates candidates_capped candidate_coverage pair_evidence group_pipeline group_members_ranked report_groups report_actions report_summary
session_prune session_recommend session_summary session_sorted cache_partition cache_upsert evaluation_metrics evaluation_confusion evaluation_severity manifest_hydrated
journal_states journal_reconcile action_plan action_status event_speed sign_bits""".split()
from . import more, sql  # noqa: E402

QUERIES = {n: globals()[n] for n in _NAMES} | more.QUERIES
SQL = sql.SQL | more.SQL
