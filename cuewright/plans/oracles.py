"""SQL that gives the results of the core queries."""

from __future__ import annotations

from cuewright.functions.text import JUNK_PATTERNS
from cuewright.sources.assets import EXCLUDED_DIRS

CLEAN = "nullif(trim({0}, ' \"''`' || chr(9) || chr(10) || chr(13)), '')"
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6)"
DIST = f"round(list_distance(embedding::DOUBLE[], {Q0}), 6)"
WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"

#: The speaker number in SQL: from the label, else from a name that opens the text.
SPEAKER_SQL = r"""
  SELECT voice_id, trim(media_path, ' "''`' || chr(9) || chr(10) || chr(13)) AS media_path, start_time, end_time, speaker_label, transcribed_text,
    regexp_extract(regexp_replace(translate(lower(speaker_label), '０１２３４５６７８９', '0123456789'), '\(cont[^)]*\)', ''),
      '^[\s\[]*(?:(?:speaker|spk|sprecher|locuteur)[\s_#-]*|s)([0-9o]+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen)[\s\]:]*$', 1) AS in_label,
    regexp_extract(lower(transcribed_text),
      '^\s*(?:>>\s*)?[\[(]?(?:(?:speaker|spk)[\s_]?|s)([0-9]+)(?:[\])>:]| - )', 1) AS in_text
  FROM speaker_segments
"""
NUMBER_SQL = """coalesce(try_cast(translate(t, 'o', '0') AS INT), list_position(['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen'], t)::INT - 1)"""
NAMED_SQL = f"SELECT *, CASE WHEN coalesce(in_label, '') <> '' THEN in_label ELSE nullif(in_text, '') END AS t FROM ({SPEAKER_SQL})"

STEM = r"regexp_replace(regexp_extract(p, '([^/\\]*)$', 1), '([^.])\.[^.]*$', '\1')"
_TITLE = """regexp_replace(regexp_replace(raw, '\\[.*?\\]', ' ', 'g'), '\\(.*?\\)', ' ', 'g')"""
for _junk in JUNK_PATTERNS:
    _TITLE = f"regexp_replace({_TITLE}, '{_junk}', ' ', 'gi')"
TITLES = rf"""
  SELECT file_id, stem, p, media_type, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'), ' -_.') AS title, year FROM (
    SELECT *, CASE WHEN bracketed THEN regexp_extract(name, '^(.*?)\((\d{{4}})\)', 1) WHEN year IS NOT NULL THEN regexp_extract(name, '^(.*?)\b(19\d{{2}}|20\d{{2}})\b', 1) ELSE name END AS raw FROM (
      SELECT *, try_cast(CASE WHEN bracketed THEN regexp_extract(name, '^(.*?)\((\d{{4}})\)', 2) ELSE regexp_extract(name, '^(.*?)\b(19\d{{2}}|20\d{{2}})\b', 2) END AS INT) AS year FROM (
        SELECT *, regexp_matches(name, '\(\d{{4}}\)') AS bracketed FROM (
          SELECT *, replace(replace(stem, '.', ' '), '_', ' ') AS name FROM (
            SELECT *, {STEM} AS stem FROM (SELECT file_id, media_type, {CLEAN.format("path")} AS p FROM media_files))))))
"""
EXT = r"lower(regexp_extract(regexp_extract(p, '([^/\\]*)$', 1), '[^.]\.([^.]+)$', 1))"
HINT = "CASE WHEN media_type IN ('video','audio','image','movie','tv','personal','unknown') THEN media_type ELSE 'unknown' END"
GUESS = rf"""CASE WHEN regexp_matches(regexp_extract(p, '([^/\\]*)$', 1), '[sS]\d{{2}}[eE]\d{{2}}') THEN 'tv' WHEN title <> '' AND year IS NOT NULL THEN 'movie'
  WHEN {EXT} IN ('mp4','mkv','avi','mov','wmv','flv','webm') THEN 'video' WHEN {EXT} IN ('mp3','aac','flac','wav','ogg','m4a') THEN 'audio'
  WHEN {EXT} IN ('jpg','jpeg','png','webp','bmp','tiff') THEN 'image' ELSE 'personal' END"""
KIND = f"CASE WHEN {HINT} <> 'unknown' THEN {HINT} ELSE {GUESS} END"
PREPARED = f"""SELECT segment_id, trim(seg_text, {WHITE}) AS text, start_s AS start, coalesce(end_s, start_s + 2.0) AS "end", 'dialogue' AS type
  FROM media_segments WHERE trim(seg_text, {WHITE}) <> '' AND start_s IS NOT NULL AND NOT isnan(start_s)"""
UUID5 = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12)"
SHA = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({0}))"
FACADE = f"""
WITH p AS (SELECT vec_id, label, {COS} AS score FROM embeddings),
v AS (SELECT * FROM p WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 10), s AS (SELECT * FROM p WHERE label >= 5 ORDER BY score DESC, vec_id LIMIT 10)
SELECT 'visual' AS modality, printf('%.2f', score) AS score, printf('%.2fs', vec_id / 4.0) AS time, '/v/' || label || '.mkv' AS file, 'Visual scene' AS content FROM v
UNION ALL SELECT 'dialogue', printf('%.2f', score), printf('%.2fs', vec_id / 4.0), '/v/' || label || '.mkv', 'line ' || vec_id FROM s"""
MS = "CAST(round_even({0} * 1000, 0) AS BIGINT)"
STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"

NAMED = f"""SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, vec_id, label, {COS} AS cos, {DIST} AS dist, '/v/' || label || '.mkv' AS video_path, vec_id / 4.0 AS t0,
  CASE WHEN vec_id % 3 > 0 THEN 'dialogue' END AS type FROM embeddings"""
EXCLUDED = "|".join(x.replace(".", r"\.").replace("+", r"\+") for x in EXCLUDED_DIRS)
CUED = f"""SELECT coalesce({CLEAN.format("video_path")}, '-') AS path, trim(seg_text, {WHITE}) AS text, start_s AS s,
  coalesce(CASE WHEN isnan(end_s) THEN NULL ELSE end_s END, start_s + 2.0) AS e FROM media_segments WHERE NOT isnan(start_s)"""

ORACLES = {
    "hit_segments": f"""
SELECT cos AS score, 'line ' || vec_id AS text, t0 AS start, t0 + 2 AS "end", video_path, type FROM ({NAMED}) WHERE label = 3 AND type = 'dialogue' ORDER BY cos DESC, id LIMIT 7""",
    "hit_frames": f"""
SELECT cos AS score, 'scene ' || vec_id AS action, t0 AS timestamp, video_path, coalesce(type, 'visual') AS type FROM ({NAMED}) WHERE cos >= 0.05 ORDER BY cos DESC, id LIMIT 50""",
    "hit_faces": f"SELECT dist AS score, id, NULL::VARCHAR AS name, label AS cluster_id FROM ({NAMED}) ORDER BY dist, id LIMIT 5",
    "path_hits": f"SELECT vec_id, cos AS score FROM ({NAMED}) WHERE label = 5 ORDER BY cos DESC, id LIMIT 10",
    "store_upsert": f"""
WITH p AS (SELECT segment_id, ingested_at, video_path, trim(seg_text, {WHITE}) AS text, start_s AS start, coalesce(CASE WHEN isnan(end_s) THEN NULL ELSE end_s END, start_s + 2.0) AS "end"
  FROM media_segments WHERE trim(seg_text, {WHITE}) <> '' AND start_s IS NOT NULL AND NOT isnan(start_s) AND video_path IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_path, start ORDER BY ingested_at DESC NULLS LAST, segment_id DESC) AS r, {SHA.format("video_path || '_' || (start::VARCHAR)")} AS h FROM p)
SELECT {UUID5} AS id, video_path, start, "end", sha1(CASE WHEN "end" - start > 3 THEN 'again: ' ELSE '' END || text) AS text_hash, 'dialogue' AS type, 384 AS dim FROM r WHERE r = 1""",
    "store_append": f"""
SELECT {CLEAN.format("video_path")} AS video_path, 2 * count(*) AS faces, 2 * count(*) AS ids FROM detected_faces
WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1""",
    "store_frames": rf"""
WITH f AS (SELECT video_path, action_text, row_number() OVER (PARTITION BY video_path, frame_ts ORDER BY frame_id DESC) AS r FROM media_frames
  WHERE video_path IS NOT NULL AND isfinite(frame_ts) AND frame_ts >= 0 AND trim(coalesce(action_text, ''), {WHITE}) <> '')
SELECT video_path, CASE WHEN regexp_matches(lower(action_text), '^\s*\[?(error|failed)\b') THEN 'failed' ELSE 'stored' END AS state, count(*) AS frames FROM f WHERE r = 1 GROUP BY 1, 2""",
    "voice_vectors": """
SELECT vec_id, least(1.0 + label, 31.0) AS "end", round(sqrt(list_sum(list_transform(e, lambda x: (x / (n + 1e-9)) * (x / (n + 1e-9))))), 6) AS length, round(e[1] / (n + 1e-9), 6) AS "first"
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) WHERE label >= 0.8 AND label <> 4""",
    "written_cues": f"SELECT path, count(*) AS cues FROM ({CUED}) WHERE text <> '' AND e - s >= 0.2 GROUP BY path",
    "frame_counts": f"""
SELECT {CLEAN.format("media_path")} AS video_path, sum(ceil(duration_s / 15.0))::BIGINT AS frames, max((ceil(duration_s / 15.0) - 1) * 15.0) AS "last" FROM transcriptions
WHERE duration_s > 0 AND NOT isnan(duration_s) GROUP BY 1""",
    "message_texts": f"""
SELECT doc_id, substr(text, 1, 30) AS preview, 'org_' || coalesce(replace(source, '/', '_'), 'none') AS folder,
  trim(array_to_string(list_filter([' ', lang, source], lambda x: x IS NOT NULL), chr(10)), {WHITE}) AS parts FROM documents""",
    "cache_keys": """
SELECT face_id, sha1(video_path || concat_ws(',', bbox.box_top, bbox.box_right, bbox.box_bottom, bbox.box_left) || 'v1') AS key FROM detected_faces WHERE bbox IS NOT NULL AND video_path IS NOT NULL""",
    "probe_answers": "SELECT transcription_id, round(coalesce(duration_s, 0), 3) AS seconds FROM transcriptions",
    "scanned_defaults": rf"""
SELECT file_id, CASE WHEN e IN ('mp4','mkv','mov','avi','webm','m4v') THEN 'video' WHEN e IN ('mp3','wav','aac','flac','m4a','ogg') THEN 'audio' ELSE 'image' END AS media_type
FROM (SELECT file_id, p, {EXT} AS e FROM (SELECT *, {CLEAN.format("path")} AS p FROM media_files))
WHERE e IN ('mp4','mkv','mov','avi','webm','m4v','mp3','wav','aac','flac','m4a','ogg','jpg','jpeg','png','webp','bmp','tiff')
  AND NOT regexp_matches(p, '(^|[/\\])({EXCLUDED}|\.[^/\\]*)[/\\]') AND NOT regexp_matches(p, '(^|[/\\])\.[^/\\]*$')""",
    "sentence_fold": rf"""
WITH RECURSIVE s AS (SELECT transcription_id, (i - 1)::INT AS segment_no, coalesce(x.seg_text, '') AS text, x.start_s AS a, coalesce(x.end_s, x.start_s + 2.0) AS b FROM (
  SELECT transcription_id, unnest(segments) AS x, generate_subscripts(segments, 1) AS i FROM transcriptions) WHERE x.start_s IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ 	

]+'), lambda x: x <> '') AS ws FROM s),
f AS (SELECT transcription_id, segment_no, a, (b - a) / len(ws) AS step, ws, 1 AS k, a AS start, '' AS acc, 0 AS no, NULL::VARCHAR AS done, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e FROM w WHERE len(ws) > 0
  UNION ALL SELECT transcription_id, segment_no, a, step, ws, k + 1, CASE WHEN flush THEN stop ELSE start END, CASE WHEN flush THEN '' ELSE full_text END,
    CASE WHEN flush THEN no + 1 ELSE no END, CASE WHEN flush OR k = len(ws) THEN full_text END, start, stop FROM (
    SELECT *, acc || ' ' || ws[k] AS full_text, a + step * k AS stop, (a + step * k - start) > 6 OR regexp_matches(ws[k], '[?.!]$') AS flush FROM f WHERE k <= len(ws)))
SELECT transcription_id, segment_no, (row_number() OVER (PARTITION BY transcription_id, segment_no ORDER BY k) - 1)::INT AS sentence_no, trim(done, {WHITE}) AS text, round(s + 1e-7, 4) AS start, round(e + 1e-7, 4) AS "end"
FROM f WHERE done IS NOT NULL
UNION ALL SELECT transcription_id, segment_no, 0, trim(text, {WHITE}), round(a + 1e-7, 4), round(b + 1e-7, 4) FROM w WHERE len(ws) = 0""",
    "topk_cosine": f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
    "topk_cosine_filtered": f"SELECT vec_id, label, {COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10",
    "topk_threshold": f"SELECT vec_id, {COS} AS score FROM embeddings WHERE {COS} >= 0.15 ORDER BY score DESC, vec_id LIMIT 50",
    "topk_euclid": f"SELECT vec_id, {DIST} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10",
    "topk_batched": """
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0)) WHERE rank <= 5""",
    "topk_faces": """
WITH f AS (SELECT face_id, embedding::DOUBLE[] AS e FROM detected_faces WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT face_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-9)) AS e FROM f WHERE list_inner_product(e, e) > 0)
SELECT query_id, face_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, face_id) AS rank FROM (
  SELECT q.face_id AS query_id, p.face_id, round(list_distance(q.e, p.e), 6) AS score FROM u q, u p WHERE q.face_id % 50 = 0)) WHERE rank <= 3 AND score <= 0.5""",
    "search_facade": FACADE,
    "hit_counts": f"SELECT modality, count(*) AS hits FROM ({FACADE}) GROUP BY modality",
    "hit_format": """
SELECT frame_id, printf('%.2f', frame_ts / 7) AS score, printf('%.2fs', frame_ts) AS time, video_path AS file, coalesce(nullif(action_text, ''), 'Visual scene') AS content
FROM media_frames WHERE isfinite(frame_ts) AND frame_ts >= 0""",
    "hit_lines": r"""
SELECT segment_id, coalesce(nullif(regexp_extract(video_path, '([^/\\]*)$', 1), ''), 'Unknown') || ': ' || substr(seg_text, 1, 80) || '...' AS line
FROM media_segments WHERE seg_text IS NOT NULL""",
    "vector_norms": """
SELECT vec_id, round(n, 6) AS length, round(sqrt(list_sum(list_transform(e, lambda x: (x / (n + 1e-9)) * (x / (n + 1e-9))))), 6) AS unit_length
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "vector_pairs": f"SELECT vec_id, {COS} AS cos, {DIST} AS dist FROM embeddings",
    "face_validity": """
SELECT coalesce(len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS valid, count(*) AS faces FROM detected_faces GROUP BY 1""",
    "face_boxes": """
SELECT face_id, trunc(bbox.box_top + 0.25)::INT AS top, trunc(bbox.box_left + 0.75 + bbox.box_right - bbox.box_left)::INT AS "right",
  trunc(bbox.box_top + 0.25 + bbox.box_bottom - bbox.box_top)::INT AS bottom, trunc(bbox.box_left + 0.75)::INT AS "left" FROM detected_faces WHERE bbox IS NOT NULL""",
    "prepare_segments": PREPARED,
    "segments_within": f'SELECT segment_id, start, "end" FROM ({PREPARED}) WHERE start >= 60 AND "end" <= 120',
    "voice_clamp": """
SELECT voice_id, round(s, 6) AS start, round(least(e, s + 30), 6) AS "end" FROM (SELECT voice_id, start_time AS s, start_time + (end_time - start_time) * 5 AS e FROM speaker_segments
  WHERE NOT isnan(start_time) AND NOT isnan(end_time)) WHERE e - s >= 0.8""",
    "voice_profile": f"""
SELECT label, round(sum(end_time - start_time), 3) AS total_duration, count(*) AS segments FROM (SELECT *, {NUMBER_SQL} AS label FROM ({NAMED_SQL}))
WHERE NOT isnan(start_time) AND NOT isnan(end_time) AND end_time > start_time GROUP BY label""",
    "face_cluster_counts": """
SELECT (cluster_id % 17)::INT AS cluster_id, count(*) AS occurrence_count, min(nullif(trim(sample_image_path), '')) AS sample_image_path FROM unresolved_faces GROUP BY 1""",
    "mean_vector": """
SELECT label, round(max(m) FILTER (i = 1), 6) AS "first", round(sqrt(sum(m * m)), 6) AS length FROM (
  SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label""",
    "media_types": f"SELECT file_id, {HINT} AS hint, {KIND} AS kind, {GUESS} AS guessed FROM ({TITLES})",
    "titles": f"SELECT file_id, title, year, coalesce(nullif(title, ''), stem) AS shown FROM ({TITLES})",
    "scanned_assets": rf"""
SELECT file_id, CASE WHEN e IN ('mp4','mkv','mov','avi','webm','m4v') THEN 'video' WHEN e IN ('mp3','wav','aac','flac','m4a','ogg') THEN 'audio' ELSE 'image' END AS media_type, file_size_bytes
FROM (SELECT file_id, size_bytes AS file_size_bytes, p, {EXT} AS e FROM (SELECT *, {CLEAN.format("path")} AS p FROM media_files))
WHERE e IN ('mp4','mkv','mov','avi','webm','m4v','mp3','wav','aac','flac','m4a','ogg','jpg','jpeg','png','webp','bmp','tiff')
  AND NOT regexp_matches(p, '(^|[/\\])(backup|inbox|cam00|\.[^/\\]*)[/\\]') AND NOT regexp_matches(p, '(^|[/\\])\.[^/\\]*$')""",
    "asset_table": f"""
SELECT file_id, {KIND} AS kind, title, year, coalesce(duration, 0.0) AS duration FROM ({TITLES})
LEFT JOIN (SELECT {CLEAN.format("media_path")} AS q, max(duration_s) AS duration FROM transcriptions GROUP BY 1) ON p = q""",
    "metadata_lookup": f"""
WITH t AS ({TITLES}), known AS (SELECT title, year, min(file_id) AS i FROM t WHERE year IS NOT NULL AND title <> '' GROUP BY 1, 2),
w AS (SELECT file_id, title, year, {KIND} AS kind FROM t)
SELECT file_id, CASE WHEN a THEN 'plot ' || i WHEN b THEN 'other ' || i END AS plot_summary, CASE WHEN a THEN 'A' || i || '|B|C|D' WHEN b THEN 'X|Y' END AS "cast", a OR b AS is_processed
FROM (SELECT w.file_id, i, coalesce(kind IN ('movie', 'tv') AND i % 3 = 0, false) AS a, coalesce(kind IN ('movie', 'tv') AND i % 4 = 0, false) AS b
  FROM w LEFT JOIN known k ON w.title = k.title AND w.year = k.year)""",
    "actor_lists": f"""
SELECT doc_id, len(a)::INT AS actors, array_to_string(a, '|') AS names FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, {WHITE})), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)""",
    "model_answers": "SELECT event_id, props AS part, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "prompts": r"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' {} ' || p_type ELSE p_name || chr(10) || chr(10) || '## JSON Output Schema' || chr(10) || '{}' END AS prompt FROM part""",
    "point_ids": f"""
SELECT segment_id, id, id = point_id AS as_stored FROM (SELECT segment_id, point_id, {UUID5} AS id FROM (
  SELECT *, {SHA.format("video_path || '_' || (start_s::VARCHAR)")} AS h FROM media_segments WHERE video_path IS NOT NULL AND NOT isnan(start_s)))""",
    "frame_ids": f"""
SELECT frame_id, {UUID5} AS id FROM (SELECT frame_id, {SHA.format("video_path || '_' || printf('%.3f', frame_ts)")} AS h FROM media_frames
  WHERE video_path IS NOT NULL AND isfinite(frame_ts) AND frame_ts >= 0)""",
    "upsert_latest": """
SELECT point_id, segment_id, sha1(coalesce(seg_text, '')) AS text_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC NULLS LAST, segment_id DESC) AS r FROM media_segments) WHERE r = 1""",
    "cache_misses": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM doc_labels l WHERE l.doc_id = d.doc_id)",
    "frames_of_videos": """
SELECT video_path, i::INT AS frame_idx, i * 15.0 AS timestamp, 'frame_' || lpad((i + 1)::VARCHAR, 4, '0') || '.jpg' AS name FROM (
  SELECT 't' || transcription_id AS video_path, unnest(range(ceil(duration_s / 15.0)::INT)) AS i FROM transcriptions WHERE duration_s > 0 AND NOT isnan(duration_s))""",
    "srt_cues": f"""
SELECT path, row_number() OVER (PARTITION BY path ORDER BY s, e, text) AS cue_no, {STAMP.format("ms")} AS from_ts, {STAMP.format("me")} AS to_ts, text FROM (
  SELECT *, {MS.format("s")} AS ms, {MS.format("e")} AS me FROM (SELECT coalesce({CLEAN.format("video_path")}, '-') AS path, trim(seg_text, {WHITE}) AS text, start_s AS s,
    coalesce(CASE WHEN isnan(end_s) THEN NULL ELSE end_s END, start_s + 2.0) AS e FROM media_segments WHERE NOT isnan(start_s)) WHERE text <> '' AND e - s >= 0.2)""",
    "srt_round_trip": rf"""
SELECT segment_id, {MS.format("s")} / 1000.0 AS start, {MS.format("e")} / 1000.0 AS "end", text FROM (
  SELECT segment_id, trim(regexp_replace(seg_text, '\s+', ' ', 'g'), {WHITE}) AS text, start_s AS s, coalesce(CASE WHEN isnan(end_s) THEN NULL ELSE end_s END, start_s + 2.0) AS e
  FROM media_segments WHERE NOT isnan(start_s)) WHERE text <> '' AND e - s >= 0.2""",
    "srt_times": f"SELECT event_id, {STAMP.format('m')} AS shown, m / 1000.0 AS seconds FROM (SELECT event_id, {MS.format('value * 37')} AS m FROM events)",
    "subtitle_choice": f"""
SELECT video_path, b.kind AS kind, b.path AS path FROM (SELECT video_path, min({{'o': o, 'kind': kind, 'path': path}}) AS b FROM (
  SELECT {CLEAN.format("video_path")} AS video_path, ['sidecar', 'user', 'embedded', 'sidecar_language', 'other'][segment_id % 5 + 1] AS kind, '/subs/' || lpad((segment_id % 97)::VARCHAR, 2, '0') || '.srt' AS path,
    [3, 1, 4, 2, 0][segment_id % 5 + 1] AS o FROM media_segments WHERE video_path IS NOT NULL)
  WHERE o > 0 AND NOT (kind LIKE 'sidecar%' AND path = '/subs/05.srt') AND video_path IS NOT NULL GROUP BY video_path)""",
    "long_chunks": rf"""
WITH s AS (SELECT transcription_id, (i - 1)::INT AS segment_no, trim(regexp_replace(x.seg_text, '[\s]+', ' ', 'g')) AS text, x.start_s AS s, x.end_s AS e FROM (
  SELECT transcription_id, unnest(segments) AS x, generate_subscripts(segments, 1) AS i FROM transcriptions)),
n AS (SELECT *, string_split(text, ' ') AS w, CASE WHEN e - s > 8 THEN (floor((e - s + 8.0 - 1e-9) / 8.0) + 1)::INT ELSE 1 END AS n FROM s WHERE text <> '' AND s IS NOT NULL),
p AS (SELECT *, greatest(len(w) // n, 1) AS per FROM n), l AS (SELECT *, (least(n, ceil(len(w)::DOUBLE / per)) - 1)::INT AS last FROM p),
b AS (SELECT *, unnest(range(last + 1)) AS k FROM l)
SELECT transcription_id, segment_no, k::INT AS piece_no, array_to_string(w[k * per + 1 : CASE WHEN k = last THEN len(w) ELSE (k + 1) * per END], ' ') AS text,
  round(CASE WHEN n > 1 THEN s + k * ((e - s) / n) ELSE s END, 4) AS start, round(CASE WHEN n > 1 THEN s + (k + 1) * ((e - s) / n) ELSE e END, 4) AS "end" FROM b""",
    "clusters": """
WITH RECURSIVE n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.13),
core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 3),
reach(id, r) AS (SELECT id, id FROM core UNION SELECT n.b, reach.r FROM reach JOIN n ON n.a = reach.id JOIN core ON core.id = n.b),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM root)),
lab AS (SELECT id, c FROM root JOIN num USING (root)),
border AS (SELECT n.a AS id, min(c) AS c FROM n JOIN lab ON lab.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT vec_id, coalesce(lab.c, border.c, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN lab ON lab.id = vec_id LEFT JOIN border ON border.id = vec_id""",
    "p5_found": rf"""
WITH named AS ({NAMED_SQL}),
iv AS (SELECT voice_id, media_path, {NUMBER_SQL} AS speaker_no, round(start_time * 1000)::BIGINT AS s, round(end_time * 1000)::BIGINT AS e
  FROM named WHERE t IS NOT NULL AND isfinite(start_time) AND isfinite(end_time) AND end_time > start_time),
m AS (SELECT *, max(e) OVER (PARTITION BY media_path, speaker_no ORDER BY s, e, voice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY media_path, speaker_no ORDER BY s, e, voice_id ROWS UNBOUNDED PRECEDING) AS i FROM m),
p AS (SELECT media_path, speaker_no, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY media_path, speaker_no, i),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY media_path, speaker_no ORDER BY start_ms) AS next_ms FROM p)
SELECT media_path, speaker_no, 'period' AS kind, start_ms, end_ms FROM n
UNION ALL SELECT media_path, speaker_no, 'gap', end_ms, next_ms FROM n WHERE next_ms IS NOT NULL
""",
}
