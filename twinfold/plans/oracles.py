"""DuckDB SQL of the registered queries: same columns, same rows."""

from __future__ import annotations

from twinfold.functions.media import EXTENSIONS, SCREENS

FILES = r"""f AS (SELECT *, regexp_extract(full_path, '([^/]*)$', 1) AS file_name, regexp_extract(full_path, '^(.*)/[^/]*$', 1) AS directory_name, lower(regexp_extract(full_path, '(\.[^./]+)$', 1)) AS extension
FROM (SELECT doc_id AS file_id, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/item ' || (doc_id // 5)::VARCHAR || CASE WHEN doc_id % 35 = 34 THEN '.mp4' ELSE ['.txt', ' (1).txt', ' - Copy.txt', ' final.PDF', '.jpg'][doc_id % 5 + 1] END AS full_path,
strlen(coalesce(text, ''))::BIGINT AS length, doc_id % 97 AS day, coalesce(text, '') AS content FROM documents))"""

IMAGES = r"""i AS (SELECT *, CASE WHEN vec_id % 13 = 0 THEN 'Screenshot ' ELSE 'IMG_' END || vec_id::VARCHAR || extension AS file_name FROM (SELECT vec_id AS file_id, vec_id, embedding, CASE WHEN vec_id % 11 = 0 THEN '.png' ELSE '.jpg' END AS extension, label::BIGINT * 1000 + vec_id % 7 AS length, (400 + vec_id % 5 * 400)::INT AS width, (300 + vec_id % 3 * 390)::INT AS height,
list_sum(list_transform(range(0, 64), lambda k: CASE WHEN embedding[k + 1] < embedding[(k + 1) % 64 + 1] THEN (1::HUGEINT << k::INT) ELSE 0::HUGEINT END))::UBIGINT AS h FROM embeddings WHERE embedding IS NOT NULL))"""

VIDEOS = r"""v AS (SELECT vec_id AS file_id, vec_id % 50 * 1000 AS length, list_transform(range(0, 2 + vec_id % 3), lambda k: list_sum(list_transform(range(0, 16), lambda j: CASE WHEN embedding[16 * k + j + 1] < embedding[(16 * k + j + 1) % 64 + 1] THEN (1::BIGINT << j::INT) ELSE 0::BIGINT END))::BIGINT) AS frames FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT x.file_id AS a, y.file_id AS b, len(list_filter(x.frames, lambda g: len(list_filter(y.frames, lambda q: bit_count(xor(g, q)) <= 2)) > 0)) / least(len(x.frames), len(y.frames)) AS share FROM v x, v y WHERE x.file_id < y.file_id),
ok AS (SELECT * FROM p WHERE share >= 0.6)"""


def normalized(c: str) -> str:
    """Normalisation of a name without extension."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '(?i)[\(\[\{{]?\s*(copy|\d+)\s*[\)\]\}}]?$', ''), '(?i)\b(copy|copie|kopie|kopya|duplicate|final|new|edit|edited)\b', '', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def reach(edges: str, n: str = "") -> str:
    """Components of an edge list (a, b): node and least node reached, as ``cc``."""
    return f"""s{n} AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), reach{n}(node, r) AS (SELECT DISTINCT a, a FROM s{n} UNION SELECT s{n}.b, reach{n}.r FROM reach{n} JOIN s{n} ON s{n}.a = reach{n}.node), cc{n} AS (SELECT node, min(r) AS component FROM reach{n} GROUP BY node)"""


PARTS = rf"""pn AS (SELECT p_partkey AS file_id, p_name AS file_name, {normalized(r"regexp_replace(p_name, '\.[^.]*$', '')")} AS name FROM part WHERE p_name IS NOT NULL),
dn AS (SELECT name, min(file_id) AS id FROM pn WHERE name <> '' GROUP BY name),
np AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 1 - levenshtein(x.name, y.name)::DOUBLE / greatest(length(x.name), length(y.name)) AS ratio FROM dn x JOIN dn y ON x.name[1] = y.name[1] AND x.id < y.id),
ne AS (SELECT * FROM np WHERE ratio >= 0.6)"""

NUMBERED = r"^(.*) \(([1-9]\d{0,8})\)((?:\.[^.]*)?)$"
#: A pair of videos whose smaller id's frames are counted, with their negative keys in that order.
SHARES = "SELECT x.file_id AS a, y.file_id AS b, len(list_filter(x.frames, lambda g: len(list_filter(y.frames, lambda q: bit_count(xor(g, q)) <= 2)) > 0)) / least(len(x.frames), len(y.frames)) AS share FROM v x, v y WHERE x.file_id > y.file_id"
TREE = r"""t AS (SELECT *, folder || '/' || file_name AS path FROM (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS length, coalesce(text, '') AS content, 's' || (doc_id % 5)::VARCHAR || CASE WHEN doc_id % 7 = 0 THEN '/.hid' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '/deep/er' ELSE '' END AS folder,
CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'f' || doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.md' END AS file_name FROM documents WHERE doc_id IS NOT NULL))"""

SIZED = "sg AS (SELECT length::VARCHAR AS group_key, row_number() OVER (PARTITION BY length ORDER BY day, file_id) - 1 AS pos, * FROM f WHERE length IN (SELECT length FROM f GROUP BY length HAVING count(*) > 1))"

MERGED = rf"""{FILES}, {SIZED},
e AS (SELECT length::VARCHAR || ':' || sha256(content) AS k, * FROM f),
m AS (SELECT 0 AS o, 'ExactContent' AS method, 1 AS bit, 1.0::DOUBLE AS similarity, k AS gk, row_number() OVER (PARTITION BY k ORDER BY day, file_id) - 1 AS pos, file_id, length, full_path, file_name, directory_name FROM e WHERE k IN (SELECT k FROM e GROUP BY k HAVING count(*) > 1)
UNION ALL SELECT 1, 'NameSimilarity', 2, 0.9::DOUBLE, group_key, pos, file_id, length, full_path, file_name, directory_name FROM sg),
sets AS (SELECT o, method, bit, similarity, gk, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS sk FROM m GROUP BY ALL),
kept AS (SELECT sk, min(o) AS o, bit_or(bit) AS methods, max(similarity) AS similarity FROM sets GROUP BY sk),
km AS (SELECT kept.sk, kept.methods, kept.similarity AS best, sets.gk AS signature, m.* EXCLUDE (similarity) FROM kept JOIN sets ON kept.sk = sets.sk AND kept.o = sets.o JOIN m ON m.gk = sets.gk AND m.o = sets.o),
g AS (SELECT sk, min(file_id) AS group_id, any_value(method) AS method, any_value(methods)::INT AS methods, any_value(best) AS similarity, any_value(signature) AS signature, count(*) AS n_files, sum(CASE WHEN pos > 0 THEN length ELSE 0 END)::BIGINT AS reclaimable_bytes, sum(length)::BIGINT AS total_bytes FROM km GROUP BY sk),
rk AS (SELECT row_number() OVER (ORDER BY reclaimable_bytes DESC, n_files DESC, group_id) AS ordinal, * FROM g)"""
COLUMNS = "group_id, method, methods, similarity, signature, n_files, reclaimable_bytes, total_bytes"

_SCREENS = ", ".join(sorted({f"'{a}x{b}'" for w, h in SCREENS for a, b in ((w, h), (h, w))}))
SHOT = f"(lower(file_name) LIKE '%screenshot%' OR lower(file_name) LIKE '%screen shot%' OR lower(file_name) LIKE '%screen\\_%' ESCAPE '\\' OR lower(file_name) LIKE '%capture%' OR lower(file_name) LIKE 'scr\\_%' ESCAPE '\\' OR (extension = '.png' AND (width::VARCHAR || 'x' || height::VARCHAR) IN ({_SCREENS})))"

PHOTOS = rf"""{IMAGES}, gr AS (SELECT *, list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 0.5) * 255)))::BIGINT) AS g FROM i),
lp AS (SELECT *, list_transform(list_filter(range(0, 64), lambda k: k // 8 BETWEEN 1 AND 6 AND k % 8 BETWEEN 1 AND 6), lambda k: 4 * g[k + 1] - g[k] - g[k + 2] - g[k - 7] - g[k + 9]) AS l FROM gr),
ms AS (SELECT *, list_sum(g)::BIGINT / 64 AS brightness, list_sum(l)::BIGINT / 36 AS mean, list_sum(list_transform(l, lambda x: x * x))::BIGINT / 36 AS sq FROM lp),
sh AS (SELECT *, greatest(0.0::DOUBLE, sq - mean * mean) AS sharpness FROM ms),
fl AS (SELECT *, list_filter([CASE WHEN sharpness < 15000 THEN 'Blurry' END, CASE WHEN brightness < 42 THEN 'Dark' END, CASE WHEN brightness > 238 THEN 'Overexposed' END, CASE WHEN greatest(width, height) < 500 THEN 'LowResolution' END, CASE WHEN {SHOT} THEN 'Screenshot' END], lambda x: x IS NOT NULL) AS flags FROM sh),
ph AS (SELECT *, floor(greatest(0, least(100, greatest(0, least(60, sharpness / 8)) + (25 - least(25, abs(brightness - 128) / 5)) + greatest(0, least(15, width::DOUBLE * height / 1000000 * 3)) - CASE WHEN list_contains(flags, 'Blurry') THEN 20 ELSE 0 END)))::INT AS score FROM fl)"""


def keep(order: str) -> str:
    return f"WITH {FILES}, {SIZED} SELECT group_key, file_id FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {order} pos) AS rn FROM sg) WHERE rn = 1"


MARKS = r"((CASE WHEN lower(file_name) LIKE '%copy%' OR lower(file_name) LIKE '%copie%' OR lower(file_name) LIKE '%kopya%' THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(file_name, '\(\d+\)') THEN 1 ELSE 0 END) + (CASE WHEN file_name LIKE '% - %' THEN 1 ELSE 0 END))"
CLASS = "CASE WHEN extension IN ({}) THEN 'Images' WHEN extension IN ({}) THEN 'Videos' ELSE 'Other' END".format(*(", ".join(f"'{e}'" for e in EXTENSIONS[k]) for k in ("Images", "Videos")))
PRESET = ", ".join(f"'{e}'" for e in sorted({*EXTENSIONS["Documents"], *EXTENSIONS["Videos"], ".jpg", ".xyz"}))
TYPES = f"ty AS (SELECT c.category, coalesce(n, 0)::BIGINT AS n_files, coalesce(b, 0)::BIGINT AS bytes FROM (VALUES ('Images'), ('Videos'), ('Other')) c(category) LEFT JOIN (SELECT {CLASS} AS category, count(*) AS n, sum(length) AS b FROM f GROUP BY 1) x USING (category))"
REASONS = "rs AS (SELECT g.group_id, g.n_files, sets.method, sets.similarity, sets.gk, g.sk FROM g JOIN sets USING (sk))"
POSITIONS = "SELECT file_id, k::INT AS k, d * 0.08::DOUBLE + greatest(d * (1 - 0.08::DOUBLE - 0.05::DOUBLE), 0.5::DOUBLE) / 12 * (k + 0.5::DOUBLE) AS second FROM (SELECT vec_id AS file_id, (vec_id % 50 * 1000)::DOUBLE / 1000 AS d, unnest(range(0, 12)) AS k FROM embeddings WHERE embedding IS NOT NULL)"
STEM = r"regexp_replace(file_name, '\.[^.]*$', '')"
NAMED = rf"nm AS (SELECT {normalized(STEM)} AS name, * FROM f)"

ORACLES: dict[str, str] = {
    "scan_filter_size": f"WITH {FILES} SELECT file_id, length FROM f WHERE length BETWEEN 500 AND 5000",
    "scan_filter_ext_include_exclude": f"WITH {FILES} SELECT file_id, extension FROM f WHERE extension = '.txt'",
    "scan_exclude_folder": f"WITH {FILES} SELECT file_id, directory_name FROM f WHERE NOT (directory_name = '/src1' OR directory_name LIKE '/src1/%' OR directory_name = '/src2/en' OR directory_name LIKE '/src2/en/%')",
    "scan_root_distinct": f"WITH {FILES} SELECT directory_name, count(*) AS n_files FROM f GROUP BY 1",
    "file_projection": rf"WITH {FILES} SELECT file_id, file_name, directory_name, extension, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM f",
    "media_classes": f"WITH {FILES} SELECT {CLASS} AS category, count(*) AS n_files FROM f GROUP BY 1",
    "category_presets": f"WITH {FILES} SELECT extension, count(*) AS n_files FROM f WHERE extension IN ({PRESET}) GROUP BY 1",
    "size_buckets": f"WITH {FILES} SELECT length, count(*) AS n_files FROM f GROUP BY 1 HAVING count(*) > 1",
    "quick_hash_candidates": f"WITH {FILES}, q AS (SELECT file_id, length, sha256(content[1:64] || CASE WHEN length(content) > 128 THEN content[-64:] ELSE '' END) AS quick FROM f) SELECT * FROM q WHERE (length, quick) IN (SELECT length, quick FROM q GROUP BY ALL HAVING count(*) > 1)",
    "content_signature": f"WITH {FILES} SELECT file_id, length::VARCHAR || ':' || sha256(content) AS signature FROM f WHERE length IN (SELECT length FROM f GROUP BY 1 HAVING count(*) > 1)",
    "exact_groups": f"WITH {FILES}, k AS (SELECT length::VARCHAR || ':' || sha256(content) AS signature, * FROM f) SELECT min(file_id) AS group_id, signature, count(*) AS n_files, sum(length)::BIGINT AS total_bytes, (sum(length) - any_value(length))::BIGINT AS reclaimable_bytes FROM k GROUP BY signature HAVING count(*) > 1",
    "exact_members": f"WITH {FILES}, k AS (SELECT length::VARCHAR || ':' || sha256(content) AS signature, * FROM f) SELECT signature, (row_number() OVER (PARTITION BY signature ORDER BY day, file_id) - 1)::INT AS pos, file_id FROM k WHERE signature IN (SELECT signature FROM k GROUP BY 1 HAVING count(*) > 1)",
    "name_normalize": f"WITH {FILES}, {NAMED}, {PARTS} SELECT file_id, name AS normalized_name FROM nm UNION ALL SELECT -file_id, name FROM pn",
    "name_pairs": f"WITH {PARTS} SELECT a, b, floor(ratio * 1000000 + 0.5)::BIGINT AS ratio_millionths FROM ne",
    "name_clusters": f"WITH RECURSIVE {PARTS}, {reach('ne')} SELECT node AS name_id, component AS cluster_id FROM cc",
    "name_group_similarity": f"""WITH RECURSIVE {PARTS}, {reach('ne')}, c AS (SELECT pn.*, coalesce(component, id) AS root FROM pn JOIN dn USING (name) LEFT JOIN cc ON node = id),
t AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY file_name, file_id) AS rn, count(*) OVER (PARTITION BY root) AS n, first_value(name) OVER (PARTITION BY root ORDER BY file_name, file_id) AS rep FROM c)
SELECT min(file_id) AS group_id, count(*) AS n_files, any_value(rep) AS signature, round(avg(CASE WHEN rn > 1 THEN 1 - levenshtein(name, rep)::DOUBLE / greatest(length(name), length(rep)) END), 6) AS similarity FROM t WHERE n > 1 GROUP BY root""",
    "dhash_embedding": f"WITH {IMAGES} SELECT file_id, lpad(lower(to_hex(h)), 16, '0') AS hash FROM i",
    "hamming_pairs": f"WITH {IMAGES} SELECT a.file_id AS a, b.file_id AS b, bit_count(xor(a.h, b.h))::INT AS bits FROM i a JOIN i b ON a.file_id < b.file_id WHERE bit_count(xor(a.h, b.h)) <= 17",
    "image_clusters": f"WITH RECURSIVE {IMAGES}, pe AS (SELECT a.file_id AS a, b.file_id AS b FROM i a JOIN i b ON a.file_id < b.file_id WHERE bit_count(xor(a.h, b.h)) <= 17), {reach('pe')} SELECT component AS group_id, node AS file_id FROM cc",
    "image_group_similarity": f"""WITH RECURSIVE {IMAGES}, pe AS (SELECT a.file_id AS a, b.file_id AS b FROM i a JOIN i b ON a.file_id < b.file_id WHERE bit_count(xor(a.h, b.h)) <= 17), {reach('pe')},
t AS (SELECT component, file_id, h, first_value(h) OVER w AS rh, first_value(file_id) OVER w AS rf FROM cc JOIN i ON node = file_id WINDOW w AS (PARTITION BY component ORDER BY length DESC, file_id))
SELECT any_value(rf) AS first_file, count(*) AS n_files, lpad(lower(to_hex(any_value(rh))), 16, '0') AS signature, round(1 - avg(CASE WHEN file_id <> rf THEN bit_count(xor(h, rh)) END) / 64, 6) AS similarity FROM t GROUP BY component""",
    "video_pairs": f"WITH {VIDEOS} SELECT a, b, floor(share * 1000000 + 0.5)::BIGINT AS share_millionths FROM ok",
    "video_clusters": f"WITH RECURSIVE {VIDEOS}, {reach('ok')} SELECT (row_number() OVER (PARTITION BY component ORDER BY length DESC, file_id) - 1)::INT AS pos, file_id, 0.6::DOUBLE AS similarity, 'video:' || (count(*) OVER (PARTITION BY component))::VARCHAR AS signature FROM cc JOIN v ON node = file_id",
    "video_sample_positions": POSITIONS,
    "keep_newest": keep("day DESC,"),
    "keep_oldest": keep("day,"),
    "keep_largest": keep("length DESC,"),
    "keep_smallest": keep("length,"),
    "keep_shortest_path": keep("length(full_path),"),
    "keep_cleanest_name": keep(f"{MARKS}, length(file_name),"),
    "keep_first": keep(""),
    "redundant_files": f"WITH {FILES}, {SIZED} SELECT group_key, file_id FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {MARKS}, length(file_name), pos) AS rn FROM sg) WHERE rn > 1",
    "copy_marker_scores": f"WITH {FILES} SELECT file_id, {MARKS}::INT AS score FROM f",
    "merge_by_file_set": f"WITH {MERGED} SELECT {COLUMNS} FROM g",
    "group_methods_bitmask": f"WITH {MERGED} SELECT methods, count(*) AS n_groups, count(*) FILTER (methods & 2 = 2) AS with_name FROM g GROUP BY 1",
    "groups_ranked": f"WITH {MERGED} SELECT ordinal, {COLUMNS} FROM rk",
    "group_ordinals": f"WITH {MERGED} SELECT ordinal, group_id, CASE WHEN similarity >= 0.999 THEN '100%' ELSE round(similarity * 100)::INT::VARCHAR || '%' END AS similarity_text FROM rk",
    "filter_min_count": f"WITH {MERGED} SELECT group_id, n_files FROM g WHERE n_files >= 3",
    "filter_text": f"WITH {MERGED} SELECT group_id, n_files FROM g WHERE sk IN (SELECT sk FROM km WHERE lower(file_name) LIKE '%src1%' OR lower(directory_name) LIKE '%src1%')",
    "filter_reasons_any": f"WITH {MERGED} SELECT group_id, n_files FROM g WHERE methods & 1 = 1",
    "filter_reasons_all": f"WITH {MERGED} SELECT group_id, n_files FROM g WHERE methods & 3 = 3",
    "filter_similarity_floor": f"WITH {MERGED} SELECT group_id, n_files FROM g WHERE similarity >= 0.95",
    "group_reasons": f"WITH {MERGED}, {REASONS} SELECT group_id, n_files, method, similarity AS reason_similarity, gk AS reason_signature FROM rs",
    "scan_summary": f"WITH {MERGED} SELECT (SELECT count(*) FROM f) AS files_scanned, (SELECT sum(length) FROM f)::BIGINT AS bytes_scanned, count(*) AS duplicate_groups, sum(n_files)::BIGINT AS duplicate_files, sum(n_files - 1)::BIGINT AS redundant_files, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes FROM g",
    "file_type_stats": f"WITH {FILES}, {TYPES} SELECT * FROM ty",
    "file_type_bars": f"WITH {FILES}, {TYPES} SELECT *, bytes::DOUBLE / greatest(1, max(bytes) OVER ()) AS fraction FROM ty WHERE n_files > 0",
    "method_stats": f"WITH {MERGED}, x AS (SELECT method, count(*) AS n_groups, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes FROM g GROUP BY 1) SELECT *, reclaimable_bytes::DOUBLE / greatest(1, max(reclaimable_bytes) OVER ()) AS fraction FROM x",
    "top5_groups": f"WITH {MERGED} SELECT group_id, reclaimable_bytes FROM g WHERE method = 'ExactContent' ORDER BY reclaimable_bytes DESC, group_id LIMIT 5",
    "import_totals": f"WITH {MERGED} SELECT sum(n_files)::BIGINT AS files_scanned, sum(n_files - 1)::BIGINT AS redundant_files, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes FROM g",
    "photo_quality": f"WITH {PHOTOS} SELECT file_id, sharpness, brightness, score, array_to_string(flags, ',') AS flags FROM ph",
    "photo_flags_histogram": f"WITH {PHOTOS}, x AS (SELECT flag, count(*) AS n FROM (SELECT unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['Good'] END) AS flag FROM ph) GROUP BY 1) SELECT flag, n, n::DOUBLE / greatest(1, max(n) OVER ()) AS fraction FROM x",
    "photo_flagged_only": f"WITH {PHOTOS} SELECT file_id, score, width::VARCHAR || '×' || height::VARCHAR AS resolution FROM ph WHERE len(flags) > 0",
    "screenshot_rule": f"WITH {IMAGES} SELECT file_id, {SHOT} AS screenshot FROM i",
    "parse_extensions": r"WITH s AS (SELECT p_partkey, lower(regexp_replace(upper(p_brand[1:3]) || ';.' || p_type[1:3] || ', ' || p_name[1:2], '[^A-Za-z;., ]', '', 'g')) AS t FROM part), x AS (SELECT p_partkey, list_transform(list_filter(regexp_split_to_array(t, '[,; ]+'), lambda p: p <> ''), lambda p: CASE WHEN starts_with(p, '.') THEN p ELSE '.' || p END) AS l FROM s) SELECT p_partkey, array_to_string(list_filter(l, lambda p, k: list_position(l, p) = k), '|') AS extensions FROM x",
    "humanize_bytes": r"WITH k AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders), h AS (SELECT *, (n * 100 + 512) // 1024 AS c FROM k) SELECT o_orderkey, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n::VARCHAR || ' KB' ELSE regexp_replace(regexp_replace((c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0'), '0+$', ''), '\.$', '') || ' MB' END AS size_text FROM h",
    "report_json_rows": f"""WITH {MERGED}, fs AS (SELECT sk, list({{'path': full_path, 'sizeBytes': length, 'lastModifiedUtc': strftime(TIMESTAMP '2024-01-01' + to_days((file_id % 97)::INT), '%Y-%m-%dT%H:%M:%S.000000') || '0Z', 'contentHash': NULL::VARCHAR}} ORDER BY pos) AS files FROM km GROUP BY sk)
SELECT ordinal, to_json({{'id': ordinal, 'method': method, 'similarity': similarity, 'signature': signature, 'reclaimableBytes': reclaimable_bytes, 'files': files}})::VARCHAR AS json FROM rk JOIN fs USING (sk)""",
    "report_csv_rows": f"WITH {MERGED} SELECT rk.ordinal AS group_number, km.pos::INT AS pos, rk.method, CASE WHEN rk.similarity >= 1 THEN '1' ELSE '0.9' END AS similarity_text, km.full_path AS file_path, km.length AS size_bytes, rk.reclaimable_bytes FROM rk JOIN km USING (sk)",
    "session_roundtrip": f"WITH {MERGED} SELECT count(*)::INT AS n_files, any_value(CASE WHEN km.methods = 3 THEN 2 ELSE 1 END)::INT AS n_reasons, min_by(full_path, pos) AS first_path, sum(length)::BIGINT AS total_bytes FROM km GROUP BY sk",
    "session_import_defaults": f"WITH {FILES} SELECT length, count(*)::INT AS n_files, 'ExactContent' AS method, 1.0::DOUBLE AS similarity FROM f GROUP BY length HAVING count(*) > 1",
    "action_plan_move": rf"""WITH {FILES}, {SIZED}, x AS (SELECT full_path, length, 'item ' || (file_id % 20)::VARCHAR || CASE WHEN file_id % 3 = 0 THEN ' (' || (file_id % 4)::VARCHAR || ')' ELSE '' END || regexp_replace(file_name, '^item \d+', '') AS name FROM sg WHERE pos > 0),
own AS (SELECT DISTINCT lower(name) AS n FROM x UNION SELECT unnest(['item 3.txt', 'item 7 (2).txt'])),
tk AS (SELECT regexp_extract(n, '{NUMBERED}', 1) || '/' || regexp_extract(n, '{NUMBERED}', 3) AS base, list(regexp_extract(n, '{NUMBERED}', 2)::BIGINT) AS ks FROM own WHERE regexp_matches(n, '{NUMBERED}') GROUP BY 1),
y AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '(\.[^.]*)$', 1) AS ext, row_number() OVER (PARTITION BY lower(name) ORDER BY full_path) - CASE WHEN lower(name) IN ('item 3.txt', 'item 7 (2).txt') THEN 0 ELSE 1 END AS nth FROM x)
SELECT 'move' AS action, full_path AS path, length AS bytes, '/trash/' || CASE WHEN nth = 0 THEN name ELSE stem || ' (' || (list_filter(range(1, nth + coalesce(len(ks), 0) + 1), lambda k: NOT list_contains(coalesce(ks, []), k))[nth])::VARCHAR || ')' || ext END AS destination FROM y LEFT JOIN tk ON base = lower(stem || '/' || ext)""",
    "action_plan_delete": f"WITH {FILES}, {SIZED} SELECT 'delete' AS action, full_path AS path, length AS bytes FROM sg WHERE pos > 0",
    "action_errors": f"WITH {FILES} SELECT full_path AS path, full_path || ': denied' AS message FROM f WHERE file_id % 100 = 0",
    "photos_by_score": f"WITH {PHOTOS} SELECT row_number() OVER (ORDER BY score, file_id) AS ordinal, file_id, score FROM ph",
    "reasons_by_similarity": f"WITH {MERGED}, {REASONS} SELECT group_id, n_files, (row_number() OVER (PARTITION BY sk ORDER BY similarity DESC, CASE method WHEN 'ExactContent' THEN 0 ELSE 1 END, gk) - 1)::INT AS place, method, similarity FROM rs",
    "groups_by_column": f"WITH {MERGED} SELECT row_number() OVER (ORDER BY total_bytes DESC, group_id) AS ordinal, total_bytes FROM g",
    "files_by_name": f"WITH {FILES} SELECT row_number() OVER (ORDER BY file_name, file_id) AS ordinal, file_id, file_name FROM f",
    "photo_texts": f"WITH {IMAGES} SELECT file_id, width::VARCHAR || '×' || height::VARCHAR AS resolution, ((width::BIGINT * height + 50000) // 100000 // 10)::VARCHAR || '.' || ((width::BIGINT * height + 50000) // 100000 % 10)::VARCHAR AS megapixels FROM i",
    "photo_counts": f"WITH {PHOTOS} SELECT count(*) AS n_photos, count(*) FILTER (len(flags) > 0) AS n_flagged FROM ph",
    "selection_totals": f"WITH {FILES}, {SIZED} SELECT count(*) AS n_selected, coalesce(sum(length), 0)::BIGINT AS bytes_selected FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY day DESC, pos) AS rn FROM sg) WHERE rn > 1",
    "candidate_bytes": f"WITH {FILES}, q AS (SELECT length, count(*) AS n, count(*) * length AS b FROM f GROUP BY length HAVING count(*) > 1), h AS (SELECT length, content[1:65536] || CASE WHEN length > 131072 THEN content[-65536:] ELSE '' END AS part FROM f), r AS (SELECT length, count(*) AS n, count(*) * length AS b FROM h GROUP BY length, part HAVING count(*) > 1) SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM q) AS n_quick, (SELECT coalesce(sum(b), 0)::BIGINT FROM q) AS bytes_quick, (SELECT coalesce(sum(n), 0)::BIGINT FROM r) AS n_full, (SELECT coalesce(sum(b), 0)::BIGINT FROM r) AS bytes_full",
    "visible_groups": f"WITH {MERGED} SELECT count(*) AS n_groups, count(*) FILTER (n_files >= 3) AS n_visible FROM g",
    "after_action_groups": f"WITH {FILES}, {SIZED} SELECT group_key, count(*) AS n_files FROM sg WHERE file_id % 3 <> 0 GROUP BY 1 HAVING count(*) > 1",
    "action_report": f"WITH {FILES} SELECT count(*) FILTER (file_id % 100 <> 0) AS succeeded, (sum(length) FILTER (file_id % 100 <> 0))::BIGINT AS bytes_freed, (count(*) FILTER (file_id % 100 = 0))::INT AS n_errors FROM f",
    "engine_scan": rf"""WITH RECURSIVE {FILES}, {IMAGES}, {VIDEOS}, al AS (SELECT file_id, file_name, length FROM f UNION ALL SELECT -(2 * vec_id + 1), file_name, length FROM i UNION ALL SELECT -(2 * file_id + 2), file_id::VARCHAR || '.mp4', length FROM v),
nm AS (SELECT {normalized(STEM)} AS name, * FROM al), dn AS (SELECT name, min(file_id) AS id FROM nm WHERE name <> '' GROUP BY name),
ne AS (SELECT x.id AS a, y.id AS b FROM dn x JOIN dn y ON x.name[1] = y.name[1] AND x.id < y.id WHERE 1 - levenshtein(x.name, y.name)::DOUBLE / greatest(length(x.name), length(y.name)) >= 0.85),
i24 AS (SELECT -(2 * vec_id + 1) AS file_id, length, h & 16777215 AS h FROM i), pe AS (SELECT a.file_id AS a, b.file_id AS b FROM i24 a JOIN i24 b ON a.file_id < b.file_id WHERE bit_count(xor(a.h, b.h)) <= 2),
ok2 AS (SELECT -(2 * a + 2) AS a, -(2 * b + 2) AS b FROM (SELECT * FROM ({SHARES}) WHERE share >= 0.6)), {reach("ne", "1")}, {reach("pe", "2")}, {reach("ok2", "3")}, e AS (SELECT length::VARCHAR || ':' || sha256(content) AS k, * FROM f),
m AS (SELECT 0 AS o, 'ExactContent' AS method, k AS gk, row_number() OVER (PARTITION BY k ORDER BY day, file_id) AS rn, file_id, length, count(*) OVER (PARTITION BY k) AS c FROM e
UNION ALL SELECT 1, 'NameSimilarity', root::VARCHAR, row_number() OVER (PARTITION BY root ORDER BY file_name, file_id), file_id, length, count(*) OVER (PARTITION BY root) FROM (SELECT nm.*, coalesce(component, id) AS root FROM nm JOIN dn USING (name) LEFT JOIN cc1 ON node = id)
UNION ALL SELECT 2, 'PerceptualImage', component::VARCHAR, row_number() OVER (PARTITION BY component ORDER BY length DESC, file_id), file_id, length, count(*) OVER (PARTITION BY component) FROM cc2 JOIN i24 ON node = file_id
UNION ALL SELECT 3, 'PerceptualVideo', component::VARCHAR, row_number() OVER (PARTITION BY component ORDER BY length DESC, node), node, length, count(*) OVER (PARTITION BY component) FROM cc3 JOIN v ON node = -(2 * file_id + 2)),
s AS (SELECT o, method, gk, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS sk, min(file_id) AS group_id, count(*) AS n_files, sum(CASE WHEN rn > 1 THEN length ELSE 0 END)::BIGINT AS reclaimable_bytes, sum(length)::BIGINT AS total_bytes FROM m WHERE c > 1 GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY o) AS q FROM s)
SELECT row_number() OVER (ORDER BY reclaimable_bytes DESC, n_files DESC, group_id) AS ordinal, group_id, method, n_files, reclaimable_bytes, total_bytes FROM d WHERE q = 1""",
    "tree_walk": f"WITH {TREE} SELECT path, file_name, regexp_extract(lower(file_name), '(\\.[^.]+)$', 1) AS extension, length FROM t WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 1",
    "tree_walk_hidden": f"WITH {TREE} SELECT path, length FROM t",
    "tree_walk_flat": f"WITH {TREE} SELECT file_name, length FROM t WHERE folder = 's2' AND doc_id % 11 <> 0",
    "tree_warnings": "SELECT '/missing: No such file or directory' AS warning",
    "action_apply": f"WITH {TREE}, r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY path) AS k FROM t) SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'delete' ELSE 'move' END AS action, NULL::VARCHAR AS error, false AS there, doc_id % 2 = 1 AS arrived FROM r WHERE k > 1 UNION ALL SELECT path || '.gone', 'delete', 'No such file or directory', false, false FROM t WHERE doc_id % 50 = 0",
    "action_apply_report": f"WITH {TREE}, r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY path) AS k FROM t) SELECT count(*) AS succeeded, coalesce(sum(length), 0)::BIGINT AS bytes_freed, (SELECT count(*) FROM t WHERE doc_id % 50 = 0)::INT AS n_errors FROM r WHERE k > 1",
    "tree_video_durations": "SELECT 'v' || (doc_id % 5)::VARCHAR || '/f' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 2 THEN '.mkv' ELSE '.mp4' END AS path, CASE WHEN doc_id % 3 <> 2 THEN (strlen(coalesce(text, '')) + 1)::DOUBLE / 1000 END AS duration FROM documents WHERE doc_id IS NOT NULL",
    "tree_exact_groups": f"WITH {TREE} SELECT length::VARCHAR || ':' || sha256(content) AS group_key, count(*) AS n_files FROM t GROUP BY 1 HAVING count(*) > 1",
}
