"""Registered queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfold.common import cut, remove, scratch, ship, table
from twinfold.llm import bpe, chat, decontam, embeddings, langid, licences, lines, quality, runs, simhash, toxicity, trie, warc
from twinfold.llm.sampling import remainder


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.report(table(spark, sf_dir, "documents"))
    return found.withColumn("families", F.array_join("families", ","))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept", "audited_recall")


OP3_SQL = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM t WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, r) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.node),
c AS (SELECT node, min(vec_id) AS component FROM reach JOIN v ON v.n = r GROUP BY node), k AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, CASE WHEN node IS NULL THEN vec_id ELSE component END AS component_id,
vec_id IS NOT DISTINCT FROM CASE WHEN node IS NULL THEN vec_id ELSE component END AS kept, 1.0::DOUBLE AS audited_recall FROM t LEFT JOIN k ON k.a = t.n LEFT JOIN c ON c.node = t.n
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 5) == 0)
    return langid.predict(docs.drop("lang"), langid.fit(docs.filter(~F.col("held_out")))).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT r, item_id, p, m FROM dw JOIN bw USING (m, s)),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hit) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(warc.plan(table(spark, sf_dir, "pages")), path)
    page = F.nullif(F.regexp_extract(F.get("metadata", 0)["text"], r"page: (-?\d+)", 1), F.lit("")).cast("long")
    found = cut(warc.assemble(warc.read(spark, path), payload=False).select("record_id", page.alias("page_id"), "warc_type", "payload_bytes", "payload_digest", "named_digest", "refers_to"))
    remove(spark, path)
    first = found.filter("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"))
    revisit = F.col("warc_type") == "revisit"
    return found.join(first, "refers_to", "left").select(
        "page_id", F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("named_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.when(revisit, F.col("to_page")).alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS nth FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (k // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to FROM p
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format(table(spark, sf_dir, "conversations"))


def _pointer(x: str) -> str:
    return f"'/' || replace(replace({x}, '~', '~0'), '/', '~1')"


def _members(j: str, *known: str) -> str:
    """SQL for the members of an object that are not known, each with its JSON."""
    json = f"CASE WHEN json_type({j}, {_pointer('x')}) = 'VARCHAR' THEN to_json(json_extract_string({j}, {_pointer('x')}))::VARCHAR ELSE coalesce(json_extract({j}, {_pointer('x')})::VARCHAR, 'null') END"
    some = f"list_filter(json_keys({j}), lambda x: x NOT IN ({', '.join(repr(k) for k in known)}))" if known else f"json_keys({j})"
    return f"list_transform({some}, lambda x: {{'key': x, 'json': {json}}})"


def _line_of(members: str) -> str:
    """SQL for an object of members in the order of their keys."""
    return f"'{{' || array_to_string(list_transform(list_sort({members}), lambda e: to_json(e.key)::VARCHAR || ':' || e.json), ',') || '}}'"


def _maybe(key: str, json: str) -> str:
    return f"CASE WHEN {json} IS NULL THEN [] ELSE [{{'key': '{key}', 'json': {json}}}] END"


OP7_SQL = f"""
WITH m AS (SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, CASE WHEN role IN ('assistant', 'tool', 'system') AND ltrim(text) LIKE '{{%' THEN CASE WHEN json_valid(text) THEN CASE WHEN coalesce(text::JSON ->> '$.role', role) = role AND len(json_keys(text)) = len(list_distinct(json_keys(text))) THEN text::JSON END END END AS v FROM m),
j AS (SELECT *, CASE WHEN role = 'assistant' AND json_type(v, '$.tool_calls') = 'ARRAY' THEN CASE WHEN len(list_filter(json_extract(v, '$.tool_calls[*]'), lambda c: json_type(c) <> 'OBJECT')) = 0 THEN v END END AS a, CASE WHEN role = 'tool' THEN v END AS b FROM o),
tl AS (SELECT conv_id, coalesce(t ->> '$.name', t ->> '$.function.name') AS name, coalesce(json_extract(t, '$.parameters'), json_extract(t, '$.function.parameters')) AS p FROM (SELECT conv_id, unnest(json_extract(v, '$.tools[*]')) AS t FROM j WHERE role = 'system' AND json_type(v, '$.tools') = 'ARRAY')),
pa AS (SELECT DISTINCT conv_id, name, x AS parameter, json_extract_string(p, '/properties' || {_pointer('x')} || '/type') AS type, coalesce(list_contains(json_extract_string(p, '$.required[*]'), x), false) AS required FROM (SELECT *, unnest(json_keys(p, '$.properties')) AS x FROM tl)),
k AS (SELECT n, conv_id, turn, unnest(json_extract(a, '$.tool_calls[*]')) AS c, unnest(range(len(json_extract(a, '$.tool_calls[*]')))) AS slot FROM j WHERE a IS NOT NULL),
f AS (SELECT *, (c ->> '$.name') IS NULL AND (c ->> '$.arguments') IS NULL AND coalesce(json_type(c, '$.function'), '') = 'OBJECT' AS nested, json_extract(c, '$.function') AS fn FROM k),
h AS (SELECT *, CASE WHEN nested THEN {_members("fn", "name", "arguments")} ELSE [] END AS rest FROM f),
c AS (SELECT n, conv_id, turn, slot, c ->> '$.id' AS id, CASE WHEN nested THEN fn ->> '$.name' ELSE c ->> '$.name' END AS name, CASE WHEN nested THEN fn ->> '$.arguments' ELSE c ->> '$.arguments' END AS given,
  CASE WHEN nested THEN {_members("c", "id", "name", "arguments", "function")} || CASE WHEN len(rest) > 0 THEN [{{'key': 'function', 'json': {_line_of("rest")}}}] ELSE [] END ELSE {_members("c", "id", "name", "arguments")} END AS more FROM h),
d AS (SELECT *, coalesce(given, '{{}}') AS raw FROM c WHERE coalesce(id, name, given) IS NOT NULL OR len(more) > 0),
e AS (SELECT *, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN raw::JSON END END AS args FROM d),
ar AS (SELECT n, slot, conv_id, name, args, unnest(json_keys(args)) AS x FROM e WHERE args IS NOT NULL),
ok AS (SELECT DISTINCT n, slot, x FROM ar JOIN pa ON ar.conv_id IS NOT DISTINCT FROM pa.conv_id AND ar.name = pa.name AND x = parameter AND CASE type WHEN 'string' THEN json_type(args, {_pointer('x')}) = 'VARCHAR'
  WHEN 'integer' THEN json_type(args, {_pointer('x')}) IN ('BIGINT', 'UBIGINT') WHEN 'number' THEN json_type(args, {_pointer('x')}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') WHEN 'boolean' THEN json_type(args, {_pointer('x')}) = 'BOOLEAN'
  WHEN 'array' THEN json_type(args, {_pointer('x')}) = 'ARRAY' WHEN 'object' THEN json_type(args, {_pointer('x')}) = 'OBJECT' WHEN 'null' THEN json_type(args, {_pointer('x')}) = 'NULL' ELSE true END),
bad AS (SELECT n, slot FROM ar ANTI JOIN ok USING (n, slot, x) UNION SELECT e.n, e.slot FROM e JOIN pa ON e.conv_id IS NOT DISTINCT FROM pa.conv_id AND e.name = pa.name WHERE required AND NOT coalesce(list_contains(json_keys(args), parameter), false)
  UNION SELECT n, slot FROM e WHERE args IS NULL UNION SELECT n, slot FROM e WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.conv_id IS NOT DISTINCT FROM e.conv_id AND tl.name = e.name)),
fi AS (SELECT conv_id, id, min(turn) AS called FROM e WHERE id IS NOT NULL GROUP BY conv_id, id),
r AS (SELECT j.*, b ->> '$.tool_call_id' AS answers, fi.id IS NOT NULL AS linked, called FROM j LEFT JOIN fi ON j.conv_id IS NOT DISTINCT FROM fi.conv_id AND fi.id = b ->> '$.tool_call_id'),
an AS (SELECT DISTINCT conv_id, answers, called FROM r WHERE linked),
g AS (SELECT e.n, count(*) AS n_calls, sum((an.answers IS NOT NULL)::INT) AS n_linked, sum((bad.n IS NOT NULL)::INT) AS n_invalid,
  string_agg({_line_of(f"[{{'key': 'arguments', 'json': to_json(CASE WHEN args IS NULL THEN raw ELSE {_line_of(_members('args'))} END)::VARCHAR}}] || {_maybe('id', 'to_json(e.id)::VARCHAR')} || {_maybe('name', 'to_json(e.name)::VARCHAR')} || more")}, ',' ORDER BY e.slot) AS calls
  FROM e LEFT JOIN an ON e.conv_id IS NOT DISTINCT FROM an.conv_id AND e.id = an.answers AND e.turn IS NOT DISTINCT FROM an.called LEFT JOIN bad ON bad.n = e.n AND bad.slot = e.slot GROUP BY e.n),
z AS (SELECT r.*, coalesce(n_calls, 0)::INT AS n_calls, CASE WHEN answers IS NOT NULL THEN linked::INT ELSE coalesce(n_linked, 0)::INT END AS n_linked, coalesce(n_invalid, 0)::INT AS n_invalid, calls, n_calls IS NOT NULL OR answers IS NOT NULL AS parsed FROM r LEFT JOIN g USING (n))
SELECT conv_id, turn, greatest(turn, called) AS place, (answers IS NOT NULL)::INT AS rank, role, n_calls, n_linked, n_invalid,
{_line_of(f"[{{'key': 'content', 'json': CASE WHEN NOT parsed THEN to_json(text)::VARCHAR WHEN coalesce(json_type(v, '$.content'), 'NULL') = 'NULL' THEN to_json('')::VARCHAR WHEN json_type(v, '$.content') = 'VARCHAR' THEN to_json(v ->> '$.content')::VARCHAR ELSE json_extract(v, '$.content')::VARCHAR END}}, {{'key': 'role', 'json': to_json(role)::VARCHAR}}] || {_maybe('tool_call_id', 'to_json(answers)::VARCHAR')} || {_maybe('tool_calls', "'[' || calls || ']'")} || CASE WHEN NOT parsed THEN [] WHEN role = 'tool' THEN {_members('v', 'role', 'content', 'tool_call_id')} ELSE {_members('v', 'role', 'content', 'tool_calls')} END")} AS message
FROM z
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, decoded="decoded", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT r, doc_id, line, k.k, m.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN m USING (key)) GROUP BY r, doc_id
"""

#: CRC-32 of the decimal text of a whole number {0}.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: [ord(substr({0}::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by the CRC-32 of its key repeats itself from some word on; a null key's never does."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({CRC32_SQL.format("doc_id")}, 1) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS q FROM g),
w AS (SELECT r, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % q ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.r, y.i - x.i AS p, x.i AS t FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, p, min(t) AS s, count(*) + p AS len FROM (SELECT *, t - row_number() OVER (PARTITION BY r, p ORDER BY t) AS island FROM e) GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
o AS (SELECT r, s, len, min(p) AS p FROM s GROUP BY r, s, len),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + len)) AS i FROM o),
c AS (SELECT w.r, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY w.r),
best AS (SELECT r, s, len, p FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len / p DESC, s, p) AS k FROM o) WHERE k = 1),
al AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS txt FROM o GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, p::BIGINT AS period, (1000 * len // p)::BIGINT AS exponent_milli, sha256(coalesce(txt, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN al USING (r) LEFT JOIN c USING (r)
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    rows, sizes = trie.spliced(trie.turns(table(spark, sf_dir, "conversations")), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    return trie.prefix_trie(rows, sizes).drop("node")


OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS donor, count(*) AS own, {CRC32_SQL.format("c")} % 9 AS h FROM t GROUP BY c),
f AS (SELECT k.*, least(k.h, coalesce(o.own, 0)) AS head FROM k LEFT JOIN k o ON o.c = k.donor),
r AS (SELECT f.c, pos + 1 AS d, role, text FROM f JOIN t ON t.c = donor AND pos < head UNION ALL SELECT f.c, pos - h + head + 1, role, text FROM f JOIN t USING (c) WHERE pos >= h),
n AS (SELECT f.c, coalesce(max(d), 0) AS n FROM f LEFT JOIN r USING (c) GROUP BY f.c),
l AS (SELECT c, list(sha256(strlen(role) || ':' || role || text) ORDER BY d) AS x, list(strlen(text) ORDER BY d) AS b FROM r GROUP BY c),
path AS (SELECT c, d, n, sha256(array_to_string(x[1 : d], ',')) AS node, sha256(array_to_string(x[1 : d - 1], ',')) AS up, coalesce(b[d], 0) AS b FROM (SELECT n.c, n, coalesce(x, []) AS x, coalesce(b, []) AS b, unnest(range(n + 1)) AS d FROM n LEFT JOIN l USING (c))),
nodes AS (SELECT node, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS conv, count(*) AS m, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM path GROUP BY node, d),
ch AS (SELECT up AS node, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN ch USING (node)),
sums AS (SELECT path.node, sum((v.k = 0)::INT)::BIGINT AS leaves, sum((v.m - 1) * v.b)::BIGINT AS saved FROM v JOIN path ON path.c = v.conv AND path.d <= v.d GROUP BY path.node)
SELECT v.conv AS conv_id, v.d::BIGINT AS depth, o.conv AS parent_conv_id, v.m AS n_convs, v.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN sums USING (node) LEFT JOIN v o ON o.node = v.up
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licences": op2_licences,
    "op3_embeddings": op3_embeddings,
    "op4_langid": op4_langid,
    "op5_decontam": op5_decontam,
    "op6_warc": op6_warc,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_lines": op11_lines,
    "op12_runs": op12_runs,
    "op13_trie": op13_trie,
}

ORACLES: dict[str, str] = {
    "op3_embeddings": OP3_SQL,
    "op5_decontam": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_chat": OP7_SQL,
    "op11_lines": OP11_SQL,
    "op12_runs": OP12_SQL,
    "op13_trie": OP13_SQL,
}
