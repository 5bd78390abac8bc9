"""Further core queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import cache, evaluation, grouping, journal, library, matching
from ..schema import latest
from ..sources import files
from . import sql

QUERIES, SQL = {}, {}
LIB, OLD, NAME, LABELLED = sql.LIB, sql.OLD, sql.NAME, sql.LABELLED
MEMBERS = "(SELECT DISTINCT group_id, filepath FROM group_members WHERE group_id IS NOT NULL AND filepath IS NOT NULL)"
SHOWN = f"lower(CASE WHEN title <> '' AND artist <> '' THEN artist || ' - ' || title WHEN title <> '' THEN title ELSE regexp_replace({NAME}, '(.)\\.[^.]*$', '\\1') END)"
WORD = "live"


def query(text: str | None):
    """Register a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _library(spark: SparkSession, d: str) -> DataFrame:
    return latest(_t(spark, d, "tracks"))


def _oldest(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "tracks").filter("filepath IS NOT NULL")
    return t.groupBy("filepath").agg(F.min_by(F.struct(*t.columns), F.struct("last_scanned", "id")).alias("r")).select("r.*")


def _now(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).select("filepath", F.col("filesize").alias("new_size"), F.col("mtime").alias("new_mtime"), F.col("mtime_ns").alias("new_mtime_ns"), F.col("quick_signature").alias("new_signature"))


def _contains(*cols: str) -> str:
    return " OR ".join(f"contains(lower(coalesce({c}, '')), '{WORD}')" for c in cols)


HIT = "coalesce(lib.filesize = old.filesize AND lib.mtime_ns = old.mtime_ns AND (coalesce(old.quick_signature, '') = '' OR lib.quick_signature = old.quick_signature), false)"


@query(f"WITH {LIB}, {OLD} SELECT filepath, coalesce(lib.filesize = old.filesize AND abs(lib.mtime - old.mtime) < 0.001, false) AS cache_hit FROM lib JOIN old USING (filepath)")
def cache_hits_by_time(s, d):
    old = _oldest(s, d).select("filepath", "filesize", "mtime")
    return _now(s, d).join(old, "filepath", "left").select("filepath", cache.is_hit_by_time().alias("cache_hit"))


@query(f"WITH {LIB}, {OLD} SELECT filepath FROM lib JOIN old USING (filepath) WHERE NOT {HIT}")
def cache_misses(s, d):
    return cache.misses(_now(s, d), _oldest(s, d)).select("filepath")


@query(f"WITH {LIB} SELECT filepath, id FROM lib WHERE filepath IN (SELECT filepath FROM group_members)")
def cache_lookup(s, d):
    return cache.lookup(_library(s, d), _t(s, d, "group_members")).select("filepath", "id")


@query("SELECT id, filepath FROM tracks WHERE filepath IS NULL OR filepath NOT IN (SELECT filepath FROM group_members WHERE filepath IS NOT NULL)")
def cache_removed(s, d):
    return cache.remove(_t(s, d, "tracks"), _t(s, d, "group_members")).select("id", "filepath")


@query("SELECT count(*) AS rows FROM tracks WHERE false")
def cache_cleared(s, d):
    return cache.cleared(_t(s, d, "tracks")).agg(F.count("*").alias("rows"))


@query(f"""WITH {LIB}, {OLD}, st AS (SELECT CASE WHEN {HIT} THEN 'hit' WHEN lib.duration IS NULL THEN 'failed' ELSE 'done' END AS status FROM lib JOIN old USING (filepath))
SELECT count(*) AS found, count(*) FILTER (status = 'hit') AS from_cache, count(*) FILTER (status IN ('hit', 'done')) AS scanned, count(*) FILTER (status = 'failed') AS failed FROM st""")
def scan_counters(s, d):
    """Files without a duration stand for those that could not be read."""
    marked = cache.partition_by_cache(_now(s, d), _oldest(s, d)).join(_library(s, d).select("filepath", "duration"), "filepath")
    return cache.scan_counters(marked.select(F.when(F.col("cache_hit"), "hit").when(F.col("duration").isNull(), "failed").otherwise("done").alias("status")))


@query("""WITH p AS (SELECT user_id, count(*)::DOUBLE AS f, (count(*) FILTER (event_type <> 'view'))::DOUBLE AS s, date_diff('second', min(ts), max(ts))::DOUBLE AS t FROM events GROUP BY 1),
q AS (SELECT *, CASE WHEN t > 0 AND s > 0 THEN s / t WHEN t > 0 AND f > 0 THEN f / t ELSE 0.0 END AS v FROM p)
SELECT user_id, CASE WHEN f > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, s / f * 100)) ELSE 0.0 END AS progress_percent, v AS files_per_second, CASE WHEN v > 0 AND f > s AND s > 0 THEN (f - s) / v ELSE 0.0 END AS eta_seconds FROM q""")
def scan_progress(s, d):
    """Each user's events as a scan: all are found, those that are no views are scanned."""
    e = _t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(F.col("event_type") != "view").alias("scanned"), F.expr("unix_seconds(cast(max(ts) AS timestamp)) - unix_seconds(cast(min(ts) AS timestamp))").alias("seconds"))
    return e.select("user_id", *cache.progress())


@query("""SELECT id, coalesce(duration, 0) <= 0 OR duration >= 5 AS wants_fingerprint, coalesce(duration, 0) >= 5 AS keeps_fingerprint, coalesce(is_lossless, false) AS wants_spectrum FROM tracks""")
def eligibility(s, d):
    return files.eligibility(_t(s, d, "tracks")).select("id", "wants_fingerprint", "keeps_fingerprint", "wants_spectrum")


@query(f"WITH {LIB} SELECT group_id FROM duplicate_groups WHERE group_id IN (SELECT group_id FROM group_members JOIN lib USING (filepath) WHERE {_contains(NAME, 'title', 'artist', 'album', 'format')})")
def group_search(s, d):
    return grouping.search(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _library(s, d), WORD).select("group_id")


def _pages(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {LIB}, f AS (SELECT group_id, arg_min({SHOWN}, m.filepath) AS first_title, sum(filesize) AS total_size FROM {MEMBERS} m JOIN lib USING (filepath) GROUP BY 1),
g AS (SELECT group_id, space_saving_bytes, average_similarity, first_title, total_size FROM duplicate_groups LEFT JOIN f USING (group_id))
(SELECT 'saving' AS mode, group_id FROM g ORDER BY space_saving_bytes DESC NULLS LAST, group_id LIMIT 50) UNION ALL (SELECT 'similarity', group_id FROM g ORDER BY average_similarity DESC NULLS LAST, group_id LIMIT 50)
UNION ALL (SELECT 'title', group_id FROM g ORDER BY first_title NULLS LAST, group_id LIMIT 50) UNION ALL (SELECT 'size', group_id FROM g ORDER BY total_size DESC NULLS LAST, group_id LIMIT 50)""")
def group_orders(s, d):
    """The first page of the groups in every order."""
    g, m, t = _t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _library(s, d)
    return _pages([library.page(grouping.ordered(g, m, t, mode), 0, 50).select(F.lit(mode).alias("mode"), "group_id") for mode in ("saving", "similarity", "title", "size")])


_ORDERS = {
    "title": "lower(title) NULLS FIRST", "artist_album": "lower(artist) NULLS FIRST, lower(album) NULLS FIRST", "score": "quality_score DESC NULLS LAST", "bitrate": "bitrate DESC NULLS LAST", "size": "filesize DESC NULLS LAST", "duration": "duration DESC NULLS LAST",
}


@query(" UNION ALL ".join(f"(SELECT '{m}' AS mode, id FROM tracks ORDER BY {o}, filepath NULLS FIRST, id LIMIT 100 OFFSET 100)" for m, o in _ORDERS.items()))
def library_orders(s, d):
    """The second page of the library in each of its six orders."""
    t = _t(s, d, "tracks").select("id", "filepath", "title", "artist", "album", "quality_score", "bitrate", "filesize", "duration")
    return _pages([library.page(library.ordered(t, mode), 1, 100).select(F.lit(mode).alias("mode"), "id") for mode in _ORDERS])


@query(f"""(SELECT 'fake' AS tab, id FROM tracks WHERE coalesce(fake_lossless_confidence, 0) > 50 ORDER BY fake_lossless_confidence DESC NULLS LAST, filepath NULLS FIRST, id LIMIT 100)
UNION ALL (SELECT 'low', id FROM tracks WHERE NOT {sql.LOSSLESS} AND NOT coalesce(bitrate, 0) >= 192 ORDER BY quality_score NULLS LAST, filepath NULLS FIRST, id LIMIT 100)""")
def quality_orders(s, d):
    t = _t(s, d, "tracks")
    return _pages([library.page(library.quality_ordered(library.quality_tab(t, tab), tab), 0, 100).select(F.lit(tab).alias("tab"), "id") for tab in ("fake", "low")])


@query(f"SELECT id FROM tracks WHERE {_contains(NAME, 'title', 'artist', 'format', 'quality_details')}")
def quality_search(s, d):
    return library.quality_search(_t(s, d, "tracks"), WORD).select("id")


@query("""SELECT (SELECT count(*) FROM duplicate_groups) AS groups, (SELECT count(*) FROM (SELECT DISTINCT group_id, filepath FROM group_members WHERE filepath IS NOT NULL AND group_id IN (SELECT group_id FROM duplicate_groups))) AS tracks,
(SELECT coalesce(sum(space_saving_bytes), 0)::BIGINT FROM duplicate_groups) AS saving""")
def session_totals(s, d):
    return grouping.totals(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"))


@query("SELECT group_id, filepath, action, CASE WHEN action = 'DELETE' THEN 'KEEP' ELSE 'DELETE' END AS toggled FROM group_members")
def group_toggle(s, d):
    return _t(s, d, "group_members").select("group_id", "filepath", "action", grouping.toggled().alias("toggled"))


@query(f"""WITH l AS (SELECT m.group_id, m.filepath, g.best_track_path AS was FROM {MEMBERS} m JOIN duplicate_groups g USING (group_id) WHERE filepath NOT IN (SELECT filepath FROM group_members WHERE action = 'DELETE' AND filepath IS NOT NULL))
SELECT group_id, CASE WHEN bool_or(coalesce(filepath = was, false)) THEN max(was) ELSE min(filepath) END AS best_track_path, NOT bool_or(coalesce(filepath = was, false)) AS best_changed, count(*) AS members FROM l GROUP BY 1""")
def group_best_after_removal(s, d):
    """Sessions once all marked files are gone."""
    m = _t(s, d, "group_members")
    return grouping.best_after_removal(_t(s, d, "duplicate_groups"), m, m.filter("action = 'DELETE' AND filepath IS NOT NULL"))


@query(sql.REPORT_GROUPS + ", f AS (SELECT label, min(filepath) AS first_path FROM acted GROUP BY 1) SELECT label, printf('group_%03d', row_number() OVER (ORDER BY first_path, label)) AS group_id FROM g JOIN f USING (label)")
def report_group_ids(s, d):
    r = _t(s, d, "evidence_reports").select("track_a_path", "track_b_path", "classification", "confidence", "requires_manual_review").filter("track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path")
    return grouping.numbered(*grouping.groups(r, _library(s, d), "track_a_path", "track_b_path", "filepath")).select("label", "group_id")


@query(f"""WITH {LIB} SELECT m.group_id AS "Grupo ID", primary_type AS "Tipo Duplicado", CASE WHEN coalesce(requires_manual_review, false) THEN 'REVISAR' WHEN coalesce(filepath = best_track_path, false) THEN 'CONSERVAR' ELSE 'ELIMINAR' END AS "Acción Recomendada",
filepath AS "Ruta Archivo", format AS "Formato", bitrate AS "Bitrate", duration AS "Duración", filesize AS "Tamaño bytes", quality_score AS "Puntaje Calidad", CASE WHEN coalesce(filepath = best_track_path, false) THEN best_track_reason ELSE '' END AS "Razón"
FROM {MEMBERS} m JOIN duplicate_groups g ON g.group_id = m.group_id JOIN lib USING (filepath)""")
def session_report(s, d):
    return files.report_rows(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _library(s, d))


@query("""SELECT DISTINCT updated_at AS "Timestamp", action AS "Operación", filepath AS "Archivo", state AS "Estado", CASE WHEN state = 'COMPLETED' THEN 'OK' WHEN state IN ('FAILED', 'ABORTED') THEN 'ERROR' ELSE '' END AS "Resultado",
coalesce(target_path, '') AS "Detalles", op_id, created_at FROM operation_journal WHERE op_id IS NOT NULL""".replace(", op_id, created_at FROM", " FROM").replace("SELECT DISTINCT", "SELECT").replace("FROM operation_journal", "FROM (SELECT DISTINCT * FROM operation_journal)"))
def deletion_log(s, d):
    return files.deletion_log(_t(s, d, "operation_journal"))


@query("""WITH r AS (SELECT DISTINCT filepath, replace(filepath[length('/music') + 2:], '//', '/') AS rel FROM tracks WHERE starts_with(lower(replace(filepath, '\\', '/')), '/music/'))
SELECT rel AS relative_path, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '(raíz)' END AS parent, regexp_extract(rel, '[^/]*$') AS name,
CASE WHEN position('.' IN regexp_extract(rel, '[^/]*$')[2:]) > 0 THEN lower(regexp_extract(regexp_extract(rel, '[^/]*$')[2:], '\\.[^.]+$')) ELSE '' END AS suffix FROM r""".replace("replace(filepath[length('/music') + 2:], '//', '/')", "filepath[length('/music') + 2:]"))
def library_inventory(s, d):
    return files.inventory(_t(s, d, "tracks").select("filepath").filter("filepath IS NOT NULL").distinct(), "/music")


@query(sql.SQL["action_plan"].replace("CASE WHEN coalesce(g.requires_manual_review, false) THEN 'blocked' WHEN NOT has_other", "CASE WHEN NOT has_other"))
def action_plan_bypassed(s, d):
    return journal.plan(_t(s, d, "duplicate_groups"), _t(s, d, "group_members"), _t(s, d, "tracks"), bypass_review=True, folder="/backup")


_METRICS = sql.SQL["evaluation_metrics"]


@query(f"""SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM ({_METRICS}) WHERE tp + fp + fn > 0""")
def evaluation_macro(s, d):
    from .queries import _labelled

    m = evaluation.macro(evaluation.class_metrics(_labelled(s, d)))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(f"""WITH {LABELLED}, n AS (SELECT count(*) AS pairs, count(*) FILTER (expected IS NOT NULL AND predicted IS NOT NULL) AS evaluated, count(*) FILTER (expected = predicted) AS right, count(*) FILTER (expected <> predicted) AS errors FROM x)
SELECT *, CASE WHEN evaluated = 0 THEN 0.0 ELSE "right" / evaluated END AS accuracy FROM n""".replace("AS right,", 'AS "right",'))
def evaluation_accuracy(s, d):
    from .queries import _labelled

    return evaluation.accuracy(_labelled(s, d))


@query("SELECT coalesce(classification, '') AS label, count(*) AS pairs FROM evidence_reports GROUP BY 1")
def label_distribution(s, d):
    return evaluation.label_distribution(_t(s, d, "evidence_reports"), "classification")


# pairs reported as duplicates against pairs of one saved group
_FOUND = "SELECT DISTINCT least(track_a_path, track_b_path) AS a, greatest(track_a_path, track_b_path) AS b FROM evidence_reports WHERE track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path AND classification NOT IN ('NO_MATCH', 'UNCERTAIN')"
_TRUE = f"SELECT DISTINCT p.filepath AS a, q.filepath AS b FROM {MEMBERS} p JOIN {MEMBERS} q ON p.group_id = q.group_id AND p.filepath < q.filepath"


def _pair_tables(s, d) -> tuple[DataFrame, DataFrame]:
    r = _t(s, d, "evidence_reports").filter("track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path AND classification NOT IN ('NO_MATCH', 'UNCERTAIN')")
    found = r.select(F.least("track_a_path", "track_b_path").alias("a"), F.greatest("track_a_path", "track_b_path").alias("b")).distinct()
    m = _t(s, d, "group_members").filter("group_id IS NOT NULL AND filepath IS NOT NULL").select("group_id", "filepath").distinct()
    return found, m.withColumnRenamed("filepath", "a").join(m.withColumnRenamed("filepath", "b"), "group_id").filter("a < b").select("a", "b").distinct()


@query(f"""WITH f AS ({_FOUND}), t AS ({_TRUE}), n AS (SELECT count(*) FILTER (f.a IS NOT NULL AND t.a IS NOT NULL) AS true_positives, count(*) FILTER (f.a IS NULL) AS missed, count(*) FILTER (t.a IS NULL) AS extra FROM f FULL JOIN t ON f.a = t.a AND f.b = t.b)
SELECT *, CASE WHEN true_positives + missed = 0 THEN 0.0 ELSE true_positives / (true_positives + missed) END AS recall, CASE WHEN true_positives + extra = 0 THEN 0.0 ELSE true_positives / (true_positives + extra) END AS precision FROM n""")
def pair_recall(s, d):
    return evaluation.pair_recall(*_pair_tables(s, d))


@query(f"WITH f AS ({_FOUND}), t AS ({_TRUE}) SELECT *, 'both' AS part FROM (FROM f INTERSECT FROM t) UNION ALL SELECT *, 'extra' FROM (FROM f EXCEPT FROM t) UNION ALL SELECT *, 'missed' FROM (FROM t EXCEPT FROM f)")
def pair_sets(s, d):
    return evaluation.pair_sets(*_pair_tables(s, d))


_PARENT = "CASE WHEN contains(filepath, '/') THEN regexp_replace(filepath, '/[^/]*$', '') ELSE '' END"


def _folders(s, d) -> DataFrame:
    return _t(s, d, "tracks").filter("filepath IS NOT NULL").select("filepath").distinct().select("filepath", fc.parent("filepath").alias("parent"))


@query(f"WITH f AS (SELECT filepath, {_PARENT} AS parent FROM (SELECT DISTINCT filepath FROM tracks WHERE filepath IS NOT NULL)) SELECT p.parent, p.filepath AS track_a_path, q.filepath AS track_b_path FROM f p JOIN f q ON p.parent = q.parent AND p.filepath < q.filepath")
def folder_pairs_all(s, d):
    return evaluation.same_folder_pairs(_folders(s, d))


@query(f"""WITH f AS (SELECT filepath, {_PARENT} AS parent FROM (SELECT DISTINCT filepath FROM tracks WHERE filepath IS NOT NULL)),
n AS (SELECT *, lead(filepath) OVER w AS other, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY parent ORDER BY md5('42/' || filepath), filepath))
SELECT parent, least(filepath, other) AS track_a_path, greatest(filepath, other) AS track_b_path FROM n WHERE other IS NOT NULL AND n <= 5""")
def folder_pairs_drawn(s, d):
    return evaluation.folder_pairs(_folders(s, d))


@query("""SELECT id, CASE WHEN coalesce(filesize, 0) < 1048576 THEN printf('%.1f KB', coalesce(filesize, 0) / 1024.0::DOUBLE) ELSE printf('%.1f MB', filesize / 1048576.0::DOUBLE) END AS size_text,
CASE WHEN coalesce(filesize, 0) < 1024 THEN printf('%.0f B', coalesce(filesize, 0)::DOUBLE) WHEN filesize < 1048576 THEN printf('%.1f KB', filesize / 1024.0::DOUBLE) WHEN filesize < 1073741824 THEN printf('%.1f MB', filesize / 1048576.0::DOUBLE) ELSE printf('%.2f GB', filesize / 1073741824.0::DOUBLE) END AS total_text,
concat_ws(' / ', CASE WHEN samplerate > 0 THEN printf('%.1f kHz', samplerate / 1000.0::DOUBLE) END, CASE WHEN bit_depth > 0 THEN printf('%d bit', bit_depth) END, CASE WHEN channels > 0 THEN printf('%d ch', channels) END) AS specs FROM tracks""")
def text_columns(s, d):
    return _t(s, d, "tracks").select("id", fc.size_text("filesize").alias("size_text"), fc.total_text("filesize").alias("total_text"), fc.specs_text().alias("specs"))


@query("SELECT id, regexp_replace(regexp_replace(replace(filepath, '\\', '/'), '/+', '/', 'g'), '(.)/$', '\\1') AS plain_path FROM tracks")
def plain_paths(s, d):
    return _t(s, d, "tracks").select("id", fc.plain_path("filepath").alias("plain_path"))


@query("""WITH x AS (SELECT id, filepath, audio_hash, format, samplerate, channels, bit_depth, coalesce(is_lossless, false) AS lossless FROM tracks WHERE audio_hash <> '')
SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.channels > 0 AND a.channels = b.channels AND a.samplerate > 0 AND a.samplerate = b.samplerate AND a.lossless = b.lossless AND a.bit_depth > 0 AND a.bit_depth = b.bit_depth AND (a.lossless OR a.format = b.format)
  THEN CASE a.bit_depth WHEN 16 THEN 's16le' WHEN 24 THEN 's24le' WHEN 32 THEN 's32le' END END AS pcm FROM x a JOIN x b ON a.audio_hash = b.audio_hash AND (a.filepath < b.filepath OR (a.filepath = b.filepath AND a.id < b.id))""")
def comparable_sound(s, d):
    """The raw format in which rows of one audio hash may be compared bit by bit."""
    t = _t(s, d, "tracks")
    depth = F.col("bit_depth").cast("string")
    fmt = F.struct(F.col("format").alias("codec"), "samplerate", "channels", F.lit("").alias("layout"), F.concat(F.lit("s"), depth, F.lit("p")).alias("sample_fmt"), "bit_depth", F.coalesce("is_lossless", F.lit(False)).alias("lossless"))
    pairs = matching.exact_pairs(t, "audio_hash").select("id_a", "id_b")
    side = lambda x: t.select(F.col("id").alias(f"id_{x}"), fmt.alias(x))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", matching.canonical_pcm().alias("pcm"))


@query(f"""WITH f AS (SELECT id, filepath, unnest(list_filter(fingerprint, lambda x: x <> 0)) AS v FROM tracks),
tok AS (SELECT DISTINCT id, filepath, token FROM (SELECT id, filepath, v AS token FROM f UNION ALL SELECT id, filepath, v & 4294967280 FROM f)), {sql._pairs(1 << 40)} SELECT * FROM pairs""")
def candidates_uncut(s, d):
    """Candidates over all frames and without the cap on frequent tokens."""
    return matching.candidate_pairs(matching.tokens(_t(s, d, "tracks"), frames=None), cap=None)


@query(f"""WITH {sql._tokens('tracks')}, n AS (SELECT count(*) AS n FROM tok GROUP BY token)
SELECT coalesce(sum(least(n, 500) * (least(n, 500) - 1) // 2), 0)::BIGINT AS pairs_generated, coalesce(sum(n * (n - 1) // 2 - least(n, 500) * (least(n, 500) - 1) // 2), 0)::BIGINT AS pairs_dropped, count(*) FILTER (n > 500) AS oversized_buckets, count(*) FILTER (n > 500) > 0 AS is_approximate FROM n""")
def candidate_coverage_500(s, d):
    """What the cap that the pipeline uses leaves out."""
    return matching.coverage(matching.tokens(_t(s, d, "tracks")))


@query(f"""SELECT id, CASE spectral_assessment WHEN 'suspected_transcode' THEN coalesce(nullif(spectral_cutoff, 0), 16000) WHEN 'no_lossy_evidence' THEN coalesce(samplerate, 0) / 2 ELSE 0 END::DOUBLE AS cutoff_hz,
CASE WHEN spectral_assessment = 'suspected_transcode' THEN {sql.CONF} ELSE 0 END::DOUBLE AS confidence FROM tracks""")
def cutoff_and_confidence(s, d):
    return _t(s, d, "tracks").select("id", library.cutoff_and_confidence().alias("c")).select("id", "c.cutoff_hz", "c.confidence")


@query("""WITH m AS (SELECT event_id, user_id, avg(round(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS speed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT event_id AS event, speed, CASE WHEN speed > 0 THEN trunc((n - done) * 3600 / speed)::BIGINT ELSE 0 END AS eta FROM m)
SELECT event, speed, CASE WHEN eta < 60 THEN printf('~%ds', eta) WHEN eta < 3600 THEN printf('~%dm', eta // 60) ELSE printf('~%dh %dm', eta // 3600, eta % 3600 // 60) END AS eta_text FROM e""")
def event_eta(s, d):
    """Average of the last 15 values as the hourly speed of a scan, and the time that the user's remaining events would take."""
    from pyspark.sql.window import Window

    from ..streaming import incremental

    own = Window.partitionBy("user_id")
    e = _t(s, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).alias("value"), F.row_number().over(own.orderBy("ts", "event_id")).alias("done"), F.count("*").over(own).alias("n"))
    m = incremental.moving_speed(e.withColumnsRenamed({"user_id": "series", "event_id": "event"}), last=15)
    left = F.when(F.col("average") > 0, ((F.col("n") - F.col("done")) * 3600 / F.col("average")).cast("bigint")).otherwise(F.lit(0))
    return m.select("event", F.col("average").alias("speed"), fc.eta_text(left).alias("eta_text"))
