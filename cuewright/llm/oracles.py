"""SQL that gives the results of the queries it can express."""

from __future__ import annotations

PATH = "trim(video_path, ' \"''`' || chr(9) || chr(10) || chr(13))"

#: Hesitation sounds as whole words, and what else does not count as a spoken word.
SOUND = "(?:u+h+|u+h+-h+u+h+|u+m+|e+r+m*|e+u+h+|a+h+|ä+h+|h+m+|m+h+m+|m+-h+m+)"
NOTE = r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|\{[^}]*\}|【[^】]*】|\*[^*]*\*|[♪♫]+|[0-9]+:[0-9:.,]+"
OPENER = r"^\s*(?:>>\s*)?[\[(]?(?:(?:speaker|spk)[\s_]?|s)[0-9]+(?:[\])>:]| - )"
LABEL = r"^[\s\[]*(?:(?:speaker|spk|sprecher|locuteur)[\s_#-]*|s)([0-9o]+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen)[\s\]:]*$"
WORDS = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen']"

UNITS = """SELECT '{0}' AS origin, {1} AS id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT {1}, {2}::DOUBLE[] AS e FROM {0}
  WHERE len({2}) = 128 AND len(list_filter({2}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) WHERE list_inner_product(e, e) > 0"""
LINKED = """, reach(id, r) AS (SELECT a, a FROM (SELECT a FROM {0} UNION SELECT b FROM {0}) UNION SELECT n.b, reach.r FROM reach JOIN (SELECT a, b FROM {0} UNION SELECT b, a FROM {0}) n ON n.a = reach.id),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id)"""
EPISODES = r"(?:s([0-9]{1,2})[ ._-]?e([0-9]{1,3})|(?:^|[^0-9])([0-9]{1,2})x([0-9]{2,3})(?:[^0-9]|$)|season[ ._]*([0-9]+)[ ._-]*episode[ ._]*([0-9]+))"
YEARS = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9px]|$)"

ORACLES = {
    "p2_found": rf"""
WITH RECURSIVE f AS (SELECT file_id, trim(path, ' "''`' || chr(9) || chr(10) || chr(13)) AS p, regexp_replace(lower(trim(regexp_replace(content_hash, '\s+', ' ', 'g'))), '^sha1:', '') AS h FROM media_files),
n AS (SELECT *, regexp_replace(lower(strip_accents(regexp_replace(regexp_extract(p, '([^/\\]*)$', 1), '\.[^.]*$', ''))), '^\[[^\]]*\]\s*', '') AS name,
  regexp_matches(lower(p), '\.(mp4|mkv|avi|mov|webm|m4v)$') AS video FROM f),
g AS (SELECT *, regexp_extract(name, '{EPISODES}', 1) || regexp_extract(name, '{EPISODES}', 3) || regexp_extract(name, '{EPISODES}', 5) AS season,
  regexp_extract(name, '{EPISODES}', 2) || regexp_extract(name, '{EPISODES}', 4) || regexp_extract(name, '{EPISODES}', 6) AS episode,
  regexp_extract(name, '^.*{YEARS}', 1) AS year FROM n),
t AS (SELECT *, CASE WHEN episode <> '' THEN regexp_replace(name, '{EPISODES}.*$', '') ELSE regexp_extract(name, '^(.*){YEARS}', 1) END AS raw,
  CASE WHEN episode <> '' THEN 's' || season::INT || 'e' || episode::INT
    ELSE 'y' || year || 'd' || coalesce(nullif(regexp_extract(name, '{YEARS}(?:.*[^a-z])?(?:cd|disc|disk|dvd|part|pt)[ ._-]?([0-9])', 2), ''), '0') END AS ky
  FROM g WHERE video AND (episode <> '' OR year <> '') AND NOT regexp_matches(name, '^(img|vid)[^a-z]')),
w AS (SELECT file_id, ky || CASE WHEN regexp_matches(x, ' (ii|2)$') AND episode = '' THEN 'n2' ELSE '' END AS ky, CASE WHEN episode = '' THEN regexp_replace(x, ' (ii|2)$', '') ELSE x END AS x FROM (
  SELECT *, regexp_replace(trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')), '^the | the$', '', 'g') AS x FROM t)),
k AS (SELECT file_id, 'p' || p AS k FROM f WHERE p <> '' UNION ALL SELECT file_id, 'h' || h FROM f WHERE regexp_matches(h, '^[0-9a-f]{{16,}}$') AND NOT regexp_matches(h, '^0+$')
  UNION ALL SELECT file_id, 'w' || ky || x FROM w),
v AS (SELECT ky, x, min(file_id) AS file_id FROM w GROUP BY ky, x),
e AS (SELECT k.file_id AS a, m.m AS b FROM k JOIN (SELECT k, min(file_id) AS m FROM k GROUP BY k) m USING (k)
  UNION SELECT a.file_id, b.file_id FROM v a JOIN v b ON a.ky = b.ky AND a.x < b.x AND abs(length(a.x) - length(b.x)) <= 2 AND damerau_levenshtein(a.x, b.x) <= 2){LINKED.format("e")}
SELECT root AS first_file_id, id AS file_id FROM root WHERE root <> id
""",
    "p7_found": f"""
WITH RECURSIVE u AS ({UNITS.format("detected_faces", "face_id", "embedding")} UNION ALL {UNITS.format("unresolved_faces", "cluster_id", "face_encoding")}),
e AS (SELECT {{'o': x.origin, 'i': x.id}} AS a, {{'o': y.origin, 'i': y.id}} AS b FROM u x JOIN u y ON x.origin = y.origin AND x.id < y.id AND list_distance(x.u, y.u) < 0.5){LINKED.format("e")},
c AS (SELECT root FROM root GROUP BY root HAVING count(*) >= 3)
SELECT id.o AS origin, root.i AS first_id, id.i AS member_id FROM root WHERE root IN (SELECT root FROM c) AND id <> root
""",
    "p3_found": f"""
WITH r AS (SELECT min(voice_id) AS voice_id, media_path, start_time, speaker_label, transcribed_text AS t FROM speaker_segments
  WHERE isfinite(start_time) AND isfinite(end_time) AND end_time > start_time GROUP BY media_path, start_time, end_time, speaker_label, transcribed_text),
n AS (SELECT *, regexp_extract(regexp_replace(translate(lower(speaker_label), '０１２３４５６７８９', '0123456789'), '\\(cont[^)]*\\)', ''), '{LABEL}', 1) AS l,
  regexp_extract(lower(t), '{OPENER.replace("[0-9]+(?:[", "([0-9]+)(?:[")}', 1) AS o,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(t), '{OPENER}', ' '), '{NOTE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}''-]+'),
    lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_full_match(x, '{SOUND}')) AS words FROM r),
k AS (SELECT *, CASE WHEN coalesce(l, '') <> '' THEN l ELSE nullif(o, '') END AS key FROM n WHERE len(words) > 0),
s AS (SELECT *, coalesce(try_cast(translate(key, 'o', '0') AS INT), list_position({WORDS}, key) - 1) AS spk FROM k WHERE key IS NOT NULL),
c AS (SELECT *, CASE WHEN spk IS DISTINCT FROM lag(spk) OVER (PARTITION BY media_path ORDER BY start_time, voice_id) THEN voice_id END AS opens FROM s)
SELECT last_value(opens IGNORE NULLS) OVER (PARTITION BY media_path ORDER BY start_time, voice_id ROWS UNBOUNDED PRECEDING) AS turn_voice_id, voice_id FROM c
""",
    "p1_found": f"""
WITH s AS (SELECT segment_id, {PATH} AS p, round(start_s * 1000)::BIGINT AS t FROM media_segments
  WHERE isfinite(start_s) AND start_s >= 0),
f AS (SELECT {PATH} AS p, round(frame_ts * 1000)::BIGINT AS t, min(frame_id) AS frame_id FROM media_frames
  WHERE isfinite(frame_ts) AND frame_ts >= 0 GROUP BY 1, 2)
SELECT segment_id, arg_min(frame_id, abs(s.t - f.t)) AS frame_id FROM s JOIN f ON s.p = f.p AND f.t BETWEEN s.t - 2000 AND s.t + 2000 GROUP BY segment_id
""",
    "p4_found": r"""
SELECT 'media_segments' AS origin, segment_id AS item_id, 0 AS item_no FROM media_segments
WHERE length(regexp_replace(seg_text, '^\s+|\s+$', '', 'g')) > 600
UNION ALL
SELECT 'transcriptions', transcription_id, (i - 1)::INT FROM
  (SELECT transcription_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM transcriptions)
WHERE length(regexp_replace(s.seg_text, '^\s+|\s+$', '', 'g')) > 600
""",
}


_MEDIA = "trim(media_path, ' \"''`' || chr(9) || chr(10) || chr(13))"
_TURNS = ORACLES["p3_found"].strip()
_OPENED = _TURNS[: _TURNS.rindex("SELECT last_value")]
SOURCE = r"coalesce(nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), ''), 'unknown')"
STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SIZES = ORACLES["p7_found"].strip()
ORACLES |= {
    "p3_times": f"""{_OPENED.rstrip()},
t AS (SELECT last_value(opens IGNORE NULLS) OVER (PARTITION BY media_path ORDER BY start_time, voice_id ROWS UNBOUNDED PRECEDING) AS turn_voice_id, voice_id, spk FROM c)
SELECT turn_voice_id, min({_MEDIA}) AS media_path, min(spk)::INT AS speaker_no, min(round(start_time * 1000)::BIGINT) AS start_ms, max(round(end_time * 1000)::BIGINT) AS end_ms, count(*) AS n_rows
FROM t JOIN speaker_segments USING (voice_id) GROUP BY turn_voice_id""",
    "p4_checks": f"""
SELECT 'media_segments' AS origin, segment_id AS item_id, 0 AS item_no, sha1({STRIPPED.format("seg_text")}) AS text_hash, 0 AS too_long, 0 AS not_repeated FROM media_segments
WHERE length({STRIPPED.format("seg_text")}) > 600
UNION ALL
SELECT 'transcriptions', transcription_id, (i - 1)::INT, sha1({STRIPPED.format("s.seg_text")}), 0, 0 FROM
  (SELECT transcription_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM transcriptions)
WHERE length({STRIPPED.format("s.seg_text")}) > 600""",
    "p7_sizes": _SIZES[: _SIZES.rindex("c AS (SELECT root")].rstrip().rstrip(",")
    + """,
n AS (SELECT 'unresolved_faces' AS o, cluster_id AS i, sum(greatest(coalesce(occurrence_count, 1), 1)) AS n FROM unresolved_faces GROUP BY cluster_id)
SELECT root.o AS origin, root.i AS first_id, count(*) AS faces, sum(coalesce(n.n, 1))::BIGINT AS occurrences FROM root LEFT JOIN n ON n.o = id.o AND n.i = id.i GROUP BY 1, 2""",
    "p8_checks": """
SELECT spec_name, count(*) AS documents, 0 AS cut_wrongly, 0 AS not_whole, 0 AS too_full FROM documents, container_specs WHERE text <> '' GROUP BY spec_name""",
    "p9_checks": "SELECT source_name AS source, target_share, max_repeats, true AS met, 0 AS strange, 0 AS over_used FROM source_targets",
    "p10_checks": f"SELECT {SOURCE} AS source, count(*) AS documents, 0 AS no_chances FROM documents GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
