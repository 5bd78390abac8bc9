"""The same queries as DuckDB SQL over the same tables."""

LIB = "lib AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY last_scanned DESC NULLS LAST, id DESC) AS rn FROM tracks WHERE filepath IS NOT NULL) WHERE rn = 1)"
OLD = "old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY last_scanned NULLS FIRST, id) AS rn FROM tracks WHERE filepath IS NOT NULL) WHERE rn = 1)"
NAME = "regexp_extract(filepath, '[^/]*$')"
CONF = "coalesce(fake_lossless_confidence, 0.0)"
LOSSLESS = "coalesce(is_lossless, false)"


def _tokens(source: str) -> str:
    return f"""f AS (SELECT id, filepath, unnest(list_filter(fingerprint[1:300], lambda x: x <> 0)) AS v FROM {source}),
tok AS (SELECT DISTINCT id, filepath, token FROM (SELECT id, filepath, v AS token FROM f UNION ALL SELECT id, filepath, v & 4294967280 FROM f))"""


def _pairs(cap: int) -> str:
    return f"""c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY filepath, id) AS rn FROM tok) WHERE rn <= {cap}),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS hits FROM c a JOIN c b ON a.token = b.token AND (a.filepath < b.filepath OR (a.filepath = b.filepath AND a.id < b.id)) GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _exact(key: str, more: str = "") -> str:
    return f"SELECT a.id AS id_a, b.id AS id_b FROM tracks a JOIN tracks b ON a.{key} = b.{key} AND a.{key} <> '' AND (a.filepath < b.filepath OR (a.filepath = b.filepath AND a.id < b.id)) {more}"


SEVERITY = "CASE classification WHEN 'EXACT_HASH' THEN 0 WHEN 'EXACT_AUDIO' THEN 1 WHEN 'ACOUSTIC_DUPLICATE' THEN 2 WHEN 'POSSIBLE_DUPLICATE' THEN 3 WHEN 'LOW_CONFIDENCE_REVIEW' THEN 4 END"
def _groups(key: str) -> str:
    """Groups of the links l(a, b, classification, confidence, requires_manual_review, sev) between values of ``key``."""
    return f"""e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
lab AS (SELECT node, min(reached) AS label FROM r GROUP BY node),
listed AS (SELECT label, filepath, filesize, quality_score, bitrate, id FROM lab JOIN lib ON node = {key}),
sizes AS (SELECT label, count(*) AS members FROM listed GROUP BY label HAVING count(*) >= 2),
typed AS (SELECT label, max(sev) AS worst, bool_or(coalesce(requires_manual_review, false) OR sev >= 3) AS requires_manual_review, max(confidence) AS average_similarity FROM l JOIN lab ON l.a = lab.node GROUP BY label),
m AS (SELECT label, id, filepath, filesize, quality_score, row_number() OVER (PARTITION BY label ORDER BY quality_score DESC NULLS LAST, bitrate DESC NULLS LAST, filesize DESC NULLS LAST, filepath, id) AS rank, requires_manual_review
  FROM listed JOIN sizes USING (label) JOIN typed USING (label)),
acted AS (SELECT *, CASE WHEN requires_manual_review THEN 'UNSET' WHEN rank = 1 THEN 'KEEP' ELSE 'DELETE' END AS action FROM m),
totals AS (SELECT label, max(CASE WHEN rank = 1 THEN filepath END) AS best_track_path, max(CASE WHEN rank = 1 THEN quality_score END) AS best_score, coalesce(sum(CASE WHEN action = 'DELETE' THEN filesize END), 0)::BIGINT AS space_saving_bytes FROM acted GROUP BY label),
g AS (SELECT label, requires_manual_review, average_similarity, members, ['EXACT_HASH', 'EXACT_AUDIO', 'ACOUSTIC_DUPLICATE', 'POSSIBLE_DUPLICATE', 'LOW_CONFIDENCE_REVIEW'][worst + 1] AS primary_type, best_track_path, space_saving_bytes, printf('best_quality %.0f', round_even(coalesce(best_score, 0), 0)) AS best_track_reason
  FROM typed JOIN sizes USING (label) JOIN totals USING (label))"""


REPORT_GROUPS = f"""WITH RECURSIVE {LIB},
l AS (SELECT track_a_path AS a, track_b_path AS b, classification, confidence, requires_manual_review, {SEVERITY} AS sev FROM evidence_reports
  WHERE track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path AND classification NOT IN ('NO_MATCH', 'UNCERTAIN')),
{_groups("filepath")}
"""


def _summary(source: str) -> str:
    return f"""SELECT count(*) AS total_groups, count(*) FILTER (primary_type IN ('EXACT_HASH', 'EXACT_AUDIO')) AS exact_groups, count(*) FILTER (primary_type = 'ACOUSTIC_DUPLICATE') AS acoustic_groups,
count(*) FILTER (primary_type = 'POSSIBLE_DUPLICATE') AS possible_groups, coalesce(sum(space_saving_bytes), 0)::BIGINT AS total_saving FROM {source}"""


LABELLED = """p AS (SELECT least(track_a_path, track_b_path) AS a, greatest(track_a_path, track_b_path) AS b, *,
  row_number() OVER (PARTITION BY least(track_a_path, track_b_path), greatest(track_a_path, track_b_path) ORDER BY reported_at DESC NULLS LAST, confidence DESC NULLS LAST, classification DESC NULLS LAST) AS late,
  row_number() OVER (PARTITION BY least(track_a_path, track_b_path), greatest(track_a_path, track_b_path) ORDER BY reported_at NULLS FIRST, confidence NULLS FIRST, classification NULLS FIRST) AS early
  FROM evidence_reports WHERE track_a_path IS NOT NULL AND track_b_path IS NOT NULL),
x AS (SELECT a, b, max(CASE WHEN late = 1 THEN classification END) AS expected, max(CASE WHEN early = 1 THEN classification END) AS predicted FROM p GROUP BY a, b)"""
CLASSES = "(VALUES ('EXACT_HASH'), ('EXACT_AUDIO'), ('ACOUSTIC_DUPLICATE'), ('POSSIBLE_DUPLICATE'), ('LOW_CONFIDENCE_REVIEW'), ('NO_MATCH'), ('UNCERTAIN')) AS k(class)"
_CLASS_LIST = ("EXACT_HASH", "EXACT_AUDIO", "ACOUSTIC_DUPLICATE", "POSSIBLE_DUPLICATE", "LOW_CONFIDENCE_REVIEW", "NO_MATCH", "UNCERTAIN")

def _evidence(pairs: str) -> str:
    return f"""j AS (SELECT id_a, id_b, a.fingerprint AS fa, b.fingerprint AS fb, abs(coalesce(a.duration, 0.0) - coalesce(b.duration, 0.0)) AS gap, a.spectral_cutoff AS ca, b.spectral_cutoff AS cb, coalesce(a.audio_hash <> '' AND a.audio_hash = b.audio_hash, false) AS same_audio,
  (a.format IS NOT DISTINCT FROM b.format AND a.samplerate IS NOT DISTINCT FROM b.samplerate AND a.channels IS NOT DISTINCT FROM b.channels AND a.bitrate IS NOT DISTINCT FROM b.bitrate) AS metadata_match,
  CASE WHEN a.sha256 <> '' AND a.sha256 = b.sha256 THEN 'EXACT_HASH' WHEN a.audio_hash <> '' AND a.audio_hash = b.audio_hash AND abs(coalesce(a.duration, 0.0) - coalesce(b.duration, 0.0)) <= 0.5 THEN 'EXACT_AUDIO'
    WHEN abs(coalesce(a.duration, 0.0) - coalesce(b.duration, 0.0)) > 90 THEN 'NO_MATCH' WHEN coalesce(len(a.fingerprint), 0) = 0 OR coalesce(len(b.fingerprint), 0) = 0 THEN 'UNCERTAIN' END AS tier
  FROM {pairs} JOIN lib a ON a.id = id_a JOIN lib b ON b.id = id_b),
n AS (SELECT id_a, id_b, fa, fb, len(fa) AS la, len(fb) AS lb, greatest(5, least(40, least(len(fa), len(fb)) // 2 + 1)) AS need FROM j WHERE tier IS NULL),
o AS (SELECT *, unnest(generate_series(-least(600, la - need), least(600, lb - need))) AS o FROM n WHERE la >= need AND lb >= need),
w AS (SELECT id_a, id_b, o, CASE WHEN o >= 0 THEN least(la, lb - o) ELSE least(la + o, lb) END AS n, need, fa, fb FROM o),
s AS (SELECT id_a, id_b, o, list_sum(list_transform(generate_series(1, n), lambda i: bit_count(xor(fa[i + greatest(-o, 0)], fb[i + greatest(o, 0)])))) / (n * 32.0::DOUBLE) AS rate FROM w WHERE n >= need),
best AS (SELECT id_a, id_b, arg_min(struct_pack(rate := rate, o := o), struct_pack(rate := rate, far := abs(o), o := o)) AS b FROM s GROUP BY id_a, id_b),
sim AS (SELECT j.*, CASE WHEN tier IS NULL AND b.rate <= 0.5 THEN 1.0::DOUBLE - b.rate / 0.5::DOUBLE ELSE 0.0 END AS similarity, CASE WHEN tier IS NULL AND b.rate < 1.0 THEN b.o ELSE 0 END AS offset_frames FROM j LEFT JOIN best USING (id_a, id_b)),
con AS (SELECT *, CASE WHEN tier IN ('EXACT_HASH', 'EXACT_AUDIO') THEN 100.0 WHEN tier IS NOT NULL THEN 0.0 ELSE least(99.9::DOUBLE, greatest(0.0, similarity * 100.0::DOUBLE + CASE WHEN similarity * 100.0::DOUBLE < 40.0 THEN 0.0 ELSE
  greatest(0.0, (1.0::DOUBLE - abs(offset_frames) / 15.0::DOUBLE) * 3.0::DOUBLE) + greatest(0.0, (1.0::DOUBLE - gap / 2.0::DOUBLE) * 2.0::DOUBLE) + CASE WHEN gap >= 10 THEN greatest(-10.0, (gap - 10.0::DOUBLE) * -10.0::DOUBLE / 20.0::DOUBLE) ELSE 0.0 END
  + CASE WHEN ca > 0 AND cb > 0 THEN greatest(0.0, 1.0::DOUBLE - abs(ca - cb) / 1000.0::DOUBLE) ELSE 0.0 END END)) END AS confidence FROM sim),
cl AS (SELECT *, coalesce(tier, CASE WHEN confidence >= 95 THEN CASE WHEN gap > 2 THEN 'POSSIBLE_DUPLICATE' ELSE 'ACOUSTIC_DUPLICATE' END WHEN confidence >= 80 THEN 'POSSIBLE_DUPLICATE' WHEN confidence >= 40 THEN 'LOW_CONFIDENCE_REVIEW' ELSE 'NO_MATCH' END) AS classification FROM con)"""


REASONS = """concat_ws(',', lower(tier), CASE WHEN same_audio AND gap > 0.5 THEN 'audio_hash_duration_differs' END, CASE WHEN tier IS NULL AND confidence >= 95 AND gap > 2 THEN 'duration_firewall' END,
  CASE WHEN tier IS NULL AND gap >= 10 THEN 'duration_penalty' END, CASE WHEN metadata_match THEN 'metadata_match' END)"""
EVIDENCE = f"""WITH {LIB}, {_tokens("lib")}, {_pairs(500)},
{_evidence("pairs")}
SELECT id_a, id_b, classification, confidence::DOUBLE AS confidence, similarity::DOUBLE AS similarity, offset_frames::INTEGER AS offset_frames, gap AS duration_diff, metadata_match, tier IS NULL AND classification IN ('POSSIBLE_DUPLICATE', 'LOW_CONFIDENCE_REVIEW') AS requires_manual_review, {REASONS} AS reasons FROM cl"""

LIBRARY_GROUPS = f"""WITH RECURSIVE {LIB},
ex AS (SELECT a.id AS a, b.id AS b, 'EXACT_HASH' AS classification, 0 AS sev FROM lib a JOIN lib b ON a.sha256 = b.sha256 AND a.sha256 <> '' AND a.id < b.id
  UNION ALL SELECT a.id, b.id, 'EXACT_AUDIO', 1 FROM lib a JOIN lib b ON a.audio_hash = b.audio_hash AND a.audio_hash <> '' AND a.id < b.id AND abs(a.duration - b.duration) <= 0.5),
xe AS (SELECT a, b FROM ex UNION SELECT b, a FROM ex),
xr AS (SELECT a AS node, a AS reached FROM xe UNION SELECT xr.node, xe.b FROM xr JOIN xe ON xe.a = xr.reached),
xl AS (SELECT node, min(reached) AS label FROM xr GROUP BY node),
{_tokens("lib")}, {_pairs(500)},
op AS (SELECT id_a, id_b FROM pairs LEFT JOIN xl p ON p.node = id_a LEFT JOIN xl q ON q.node = id_b WHERE p.label IS NULL OR q.label IS NULL OR p.label <> q.label),
{_evidence("op")},
l AS (SELECT a, b, classification, 100.0::DOUBLE AS confidence, false AS requires_manual_review, sev FROM ex UNION ALL SELECT id_a, id_b, classification, confidence::DOUBLE, tier IS NULL AND classification IN ('POSSIBLE_DUPLICATE', 'LOW_CONFIDENCE_REVIEW'), {SEVERITY}
  FROM cl WHERE classification NOT IN ('NO_MATCH', 'UNCERTAIN')),
{_groups("id")}
"""

PLAN = """m AS (SELECT group_id, filepath, max(action) AS action FROM group_members WHERE group_id IS NOT NULL AND filepath IS NOT NULL GROUP BY 1, 2),
safe AS (SELECT group_id, bool_or(coalesce(action <> 'DELETE', true)) AS has_other FROM m GROUP BY 1),
v AS (SELECT m.group_id, m.filepath, CASE WHEN coalesce(g.requires_manual_review, false) THEN 'blocked' WHEN NOT has_other THEN 'last_copy' WHEN f.filepath IS NULL THEN 'missing' ELSE 'planned' END AS verdict, regexp_extract(m.filepath, '[^/]*$') AS name
  FROM m JOIN safe USING (group_id) LEFT JOIN duplicate_groups g USING (group_id) LEFT JOIN (SELECT DISTINCT filepath FROM tracks) f ON f.filepath = m.filepath WHERE action = 'DELETE'),
pl AS (SELECT *, row_number() OVER (PARTITION BY verdict, name ORDER BY filepath, group_id) - 1 AS n FROM v)"""

SQL = {
    "latest_scan": f"WITH {LIB} SELECT filepath, id, filesize, quality_score FROM lib",
    "load_defaults": """SELECT id, coalesce(nullif(samplerate, 0), 44100) AS samplerate, coalesce(nullif(channels, 0), 2) AS channels, coalesce(nullif(bit_depth, 0), 16) AS bit_depth, coalesce(bitrate, 0) AS bitrate, coalesce(duration, 0.0) AS duration,
        coalesce(format, '') AS format, coalesce(sha256, '') AS sha256, coalesce(quality_score, 0.0) AS quality_score,
        CASE WHEN spectral_assessment IN ('no_lossy_evidence', 'suspected_transcode', 'unknown', 'not_analyzed') THEN spectral_assessment ELSE 'unknown' END AS spectral_assessment FROM tracks""",
    "derived_columns": f"""SELECT id, {NAME} AS filename, CASE WHEN position('.' IN {NAME}[2:]) > 0 THEN lower(regexp_extract({NAME}[2:], '\\.[^.]+$')) ELSE '' END AS extension,
        CASE WHEN title <> '' AND artist <> '' THEN artist || ' - ' || title WHEN title <> '' THEN title ELSE regexp_replace({NAME}, '(.)\\.[^.]*$', '\\1') END AS display_title,
        printf('%d:%02d', trunc(coalesce(duration, 0))::BIGINT // 60, trunc(coalesce(duration, 0))::BIGINT % 60) AS duration_text FROM tracks""",
    "folder_prefix": "SELECT id, filepath FROM tracks WHERE replace(filepath, '\\', '/') ILIKE 'm:/archive0001/%' ESCAPE '^'",
    "library_search": f"SELECT id, title, format FROM tracks WHERE upper(format) = 'MP3' AND (contains(lower({NAME}), 'garden') OR contains(lower(coalesce(title, '')), 'garden') OR contains(lower(coalesce(artist, '')), 'garden') OR contains(lower(coalesce(album, '')), 'garden'))",
    "quality_tabs": f"""SELECT id, 'fake' AS tab FROM tracks WHERE {CONF} > 50 UNION ALL SELECT id, 'lossless' FROM tracks WHERE {LOSSLESS} AND {CONF} <= 50
        UNION ALL SELECT id, 'low' FROM tracks WHERE NOT {LOSSLESS} AND NOT coalesce(bitrate, 0) >= 192 UNION ALL SELECT id, 'hires' FROM tracks WHERE NOT (coalesce(samplerate, 0) < 48000 AND coalesce(bit_depth, 0) <= 16)""",
    "diagnoses": f"""SELECT id, CASE WHEN {LOSSLESS} AND {CONF} > 50 THEN 'fake_lossless' WHEN {LOSSLESS} AND (coalesce(samplerate, 0) >= 88200 OR coalesce(bit_depth, 0) > 16) THEN 'hi_res' WHEN {LOSSLESS} THEN 'lossless'
        WHEN coalesce(bitrate, 0) >= 256 THEN 'high_bitrate' WHEN coalesce(bitrate, 0) >= 192 THEN 'medium_bitrate' ELSE 'low_bitrate' END AS diagnosis FROM tracks""",
    "format_stats": "SELECT upper(coalesce(nullif(format, ''), 'UNKNOWN')) AS format, count(*) AS files, coalesce(sum(filesize), 0)::BIGINT AS bytes FROM tracks GROUP BY 1",
    "top_formats": "SELECT upper(coalesce(nullif(format, ''), 'UNKNOWN')) AS format, count(*) AS files, coalesce(sum(filesize), 0)::BIGINT AS bytes FROM tracks GROUP BY 1 ORDER BY files DESC, 1 LIMIT 5",
    "quality_kpis": f"""SELECT count(*) AS tracks, round(avg(quality_score) FILTER (quality_score > 0), 6) AS average_score, coalesce(sum(filesize), 0)::BIGINT AS bytes, count(*) FILTER ({LOSSLESS} AND {CONF} <= 50) AS true_lossless, count(*) FILTER ({CONF} > 50) AS fake_lossless,
        count(*) FILTER (NOT {LOSSLESS} AND bitrate > 0 AND bitrate < 192) AS low_bitrate FROM tracks""",
    "library_page": "SELECT id, filepath, quality_score FROM tracks ORDER BY quality_score DESC NULLS LAST, filepath NULLS FIRST, id LIMIT 50 OFFSET 50",
    "quality_scores": f"""WITH q AS (SELECT id, {LOSSLESS} AS l, {CONF} AS conf, coalesce(spectral_assessment, 'unknown') = 'suspected_transcode' OR {CONF} > 50 AS fake, upper(coalesce(format, '')) AS f, coalesce(bitrate, 0) AS r, coalesce(bit_depth, 0) AS d, coalesce(samplerate, 0) AS hz FROM tracks)
        SELECT id, least(100.0::DOUBLE, greatest(5.0::DOUBLE,
          CASE WHEN l AND fake THEN greatest(10.0::DOUBLE, 45.0::DOUBLE - conf / 100.0::DOUBLE * 35.0::DOUBLE) WHEN l THEN 45.0::DOUBLE WHEN f IN ('AAC', 'M4A', 'OGG', 'OPUS') THEN 32.0::DOUBLE WHEN f = 'MP3' THEN 28.0::DOUBLE ELSE 20.0::DOUBLE END
          + CASE WHEN l AND fake THEN greatest(5.0::DOUBLE, 30.0::DOUBLE - conf / 100.0::DOUBLE * 18.8::DOUBLE) WHEN l THEN 30.0::DOUBLE ELSE CASE WHEN r > 0 THEN least(320, r) ELSE 128 END / 320.0::DOUBLE * 28.0::DOUBLE END
          + CASE WHEN d >= 24 THEN 8.0::DOUBLE WHEN d = 16 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN hz >= 96000 THEN 7.0::DOUBLE WHEN hz >= 48000 THEN 5.0::DOUBLE WHEN hz >= 44100 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM q""",
    "exact_hash_pairs": _exact("sha256"),
    "exact_audio_pairs": _exact("audio_hash", "AND abs(a.duration - b.duration) <= 0.5"),
    "exact_hash_links": "SELECT f.id AS id_a, t.id AS id_b FROM (SELECT *, first_value(id) OVER (PARTITION BY sha256 ORDER BY filepath NULLS FIRST, id) AS first_id FROM tracks WHERE sha256 <> '') t JOIN tracks f ON f.id = t.first_id WHERE t.id <> f.id",
    "track_tokens": f"WITH {_tokens('tracks')} SELECT id, count(*) AS tokens, min(token) AS lowest, max(token) AS highest, sum(token)::BIGINT AS total, bit_xor(token) AS mixed FROM tok GROUP BY id",
    "candidates": f"WITH {_tokens('tracks')}, {_pairs(500)} SELECT * FROM pairs",
    "candidates_capped": f"WITH {_tokens('tracks')}, {_pairs(4)} SELECT * FROM pairs",
    "candidate_coverage": f"""WITH {_tokens('tracks')}, n AS (SELECT count(*) AS n FROM tok GROUP BY token)
        SELECT coalesce(sum(least(n, 4) * (least(n, 4) - 1) // 2), 0)::BIGINT AS pairs_generated, coalesce(sum(n * (n - 1) // 2 - least(n, 4) * (least(n, 4) - 1) // 2), 0)::BIGINT AS pairs_dropped, count(*) FILTER (n > 4) AS oversized_buckets, count(*) FILTER (n > 4) > 0 AS is_approximate FROM n""",
    "pair_evidence": EVIDENCE,
    "group_pipeline": LIBRARY_GROUPS + "SELECT * FROM g",
    "group_members_ranked": LIBRARY_GROUPS + "SELECT label, id, filepath, filesize, rank::INTEGER AS rank, action FROM acted",
    "report_groups": REPORT_GROUPS + "SELECT * FROM g",
    "report_actions": REPORT_GROUPS + "SELECT label, filepath, rank::INTEGER AS rank, action FROM acted",
    "report_summary": REPORT_GROUPS + _summary("g"),
    "session_prune": f"""WITH {LIB}, m AS (SELECT group_id, filepath, max(action) AS action FROM group_members WHERE group_id IS NOT NULL AND filepath IS NOT NULL GROUP BY 1, 2),
        j AS (SELECT m.group_id, m.filepath, m.action, lib.filesize, g.primary_type, g.best_track_path AS was, coalesce(g.requires_manual_review, false) OR coalesce(g.primary_type IN ('POSSIBLE_DUPLICATE', 'LOW_CONFIDENCE_REVIEW'), false) AS review,
          row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(quality_score, '-infinity'::DOUBLE) DESC, coalesce(bitrate, -1) DESC, coalesce(lib.filesize, -1) DESC, m.filepath) AS rn FROM m JOIN lib USING (filepath) JOIN duplicate_groups g USING (group_id)),
        a AS (SELECT group_id, count(*) AS members, any_value(primary_type) AS primary_type, any_value(review) AS review, bool_or(coalesce(filepath = was, false)) AS kept, CASE WHEN bool_or(coalesce(filepath = was, false)) THEN any_value(was) ELSE max(CASE WHEN rn = 1 THEN filepath END) END AS best FROM j GROUP BY group_id HAVING count(*) >= 2)
        SELECT a.group_id, a.primary_type, members, best AS best_track_path, NOT kept AS best_changed, a.review AS requires_manual_review,
          coalesce(sum(CASE WHEN CASE WHEN a.review AND action = 'DELETE' THEN 'UNSET' WHEN NOT a.review AND filepath = best THEN 'KEEP' ELSE action END = 'DELETE' THEN filesize END), 0)::BIGINT AS space_saving_bytes FROM a JOIN j USING (group_id) GROUP BY ALL""",
    "session_recommend": """SELECT DISTINCT m.group_id, filepath, action, CASE WHEN filepath = best_track_path THEN 'KEEP' ELSE 'DELETE' END AS new_action FROM group_members m JOIN duplicate_groups g ON m.group_id = g.group_id
        WHERE filepath IS NOT NULL AND NOT coalesce(g.requires_manual_review, false) AND coalesce(best_track_path, '') <> ''""",
    "session_summary": _summary("duplicate_groups"),
    "session_sorted": "SELECT group_id, primary_type, space_saving_bytes FROM duplicate_groups WHERE primary_type = 'ACOUSTIC_DUPLICATE' ORDER BY space_saving_bytes DESC NULLS LAST, group_id LIMIT 50",
    "cache_partition": f"WITH {LIB}, {OLD} SELECT filepath, coalesce(lib.filesize = old.filesize AND lib.mtime_ns = old.mtime_ns AND (coalesce(old.quick_signature, '') = '' OR lib.quick_signature = old.quick_signature), false) AS cache_hit FROM lib JOIN old USING (filepath)",
    "cache_upsert": f"WITH {LIB}, {OLD} SELECT filepath, old.id, lib.filesize, lib.quality_score FROM lib JOIN old USING (filepath)",
    "evaluation_metrics": f"""WITH {LABELLED}, c AS (SELECT class, count(*) FILTER (expected = class AND predicted = class) AS tp, count(*) FILTER (expected <> class AND predicted = class) AS fp, count(*) FILTER (expected = class AND predicted <> class) AS fn, count(*) FILTER (expected <> class AND predicted <> class) AS tn FROM x, {CLASSES} GROUP BY class),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr, CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn / (fn + tp) END AS fnr FROM c)
        SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""",
    "evaluation_confusion": f"WITH {LABELLED} SELECT class AS expected, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in _CLASS_LIST) + f" FROM {CLASSES} LEFT JOIN x ON x.expected = class GROUP BY class",
    "evaluation_severity": f"""WITH {LABELLED} SELECT CASE WHEN expected = predicted THEN 'NONE' WHEN expected = 'NO_MATCH' AND predicted IN ('EXACT_HASH', 'EXACT_AUDIO', 'ACOUSTIC_DUPLICATE', 'POSSIBLE_DUPLICATE') THEN 'CRITICAL'
        WHEN (expected IN ('EXACT_HASH', 'EXACT_AUDIO', 'ACOUSTIC_DUPLICATE') AND predicted IN ('POSSIBLE_DUPLICATE', 'NO_MATCH', 'UNCERTAIN')) OR (expected = 'POSSIBLE_DUPLICATE' AND predicted IN ('EXACT_HASH', 'EXACT_AUDIO', 'ACOUSTIC_DUPLICATE')) THEN 'MODERATE' ELSE 'LOW' END AS severity, count(*) AS pairs FROM x GROUP BY 1""",
    "manifest_hydrated": f"""WITH {LIB} SELECT track_a_path, track_b_path, classification AS expected_category, a.id AS id_a, b.id AS id_b, CASE WHEN classification IS NULL OR classification NOT IN {_CLASS_LIST} THEN 'label'
        WHEN a.id IS NULL THEN 'track_a' WHEN b.id IS NULL THEN 'track_b' END AS error FROM evidence_reports r LEFT JOIN lib a ON a.filepath = track_a_path LEFT JOIN lib b ON b.filepath = track_b_path
        WHERE trim(track_a_path) <> '' AND trim(track_b_path) <> ''""",
    "journal_states": "SELECT op_id, state, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY updated_at DESC NULLS LAST, CASE state WHEN 'PENDING' THEN 0 WHEN 'FS_DONE' THEN 1 WHEN 'COMPLETED' THEN 2 WHEN 'FAILED' THEN 2 WHEN 'ABORTED' THEN 2 ELSE -1 END DESC, state DESC NULLS LAST) AS rn FROM operation_journal WHERE op_id IS NOT NULL) WHERE rn = 1",
    "journal_reconcile": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY updated_at DESC NULLS LAST, CASE state WHEN 'PENDING' THEN 0 WHEN 'FS_DONE' THEN 1 WHEN 'COMPLETED' THEN 2 WHEN 'FAILED' THEN 2 WHEN 'ABORTED' THEN 2 ELSE -1 END DESC, state DESC NULLS LAST) AS rn FROM operation_journal WHERE op_id IS NOT NULL) WHERE rn = 1 AND state IN ('PENDING', 'FS_DONE')),
        f AS (SELECT DISTINCT filepath FROM tracks), o AS (SELECT op_id, p.filepath, CASE WHEN s.filepath IS NOT NULL THEN 'ABORTED' WHEN upper(action) IN ('BACKUP', 'MOVE') AND t.filepath IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS outcome FROM p LEFT JOIN f s ON s.filepath = p.filepath LEFT JOIN f t ON t.filepath = p.target_path)
        SELECT *, outcome = 'COMPLETED' AS purge FROM o""",
    "action_plan": f"""WITH {PLAN} SELECT group_id, filepath, verdict, CASE WHEN verdict = 'planned' THEN '/backup/' || regexp_replace(name, '(.)\\.[^.]*$', '\\1') || CASE WHEN n > 0 THEN '_' || n ELSE '' END || regexp_extract(name[2:], '\\.[^.]*$') END AS target_path FROM pl""",
    "action_status": f"""WITH {PLAN}, c AS (SELECT group_id, count(*) FILTER (verdict = 'planned') AS s, count(*) FILTER (verdict IN ('last_copy', 'missing')) AS f, count(*) FILTER (verdict = 'blocked') AS b FROM pl GROUP BY 1)
        SELECT group_id, CASE WHEN s > 0 AND f > 0 THEN 'PARTIAL_FAILURE' WHEN s > 0 AND b > 0 THEN 'PARTIAL_SUCCESS' WHEN f > 0 THEN 'FAILED' WHEN b > 0 THEN 'BLOCKED' ELSE 'SUCCESS' END AS status FROM c""",
    "event_speed": "SELECT event_id AS event, avg(round(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS average FROM events",
    "sign_bits": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)
        SELECT vec_id, list_sum(list_transform(generate_series(1, len(embedding)), lambda i: ((embedding[i] >= 0) <> (first[i] >= 0))::INTEGER))::INTEGER AS bit_errors FROM embeddings JOIN f USING (label)""",
}
