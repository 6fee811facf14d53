"""Each operator against a brute-force version, round trips, and its edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinfold.llm import bpe, chat, decontam, embeddings, langid, licences, queries, quality, simhash, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k, "en"), None, None) for k, t in enumerate(texts)], DOC)


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [None, "", " ", "a  b", "a   b\n \nc ", "don't I'll 123 4 x<|endoftext|> y <|endoftext|>", "日本語 😀 é́ \x00", "z" * 3000, "-" * 500 + "ab" * 200, LONG]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2100), rng.randrange(0x1F300, 0x1F700)])) for _ in range(300)) for _ in range(20)]
    df = docs(spark, texts).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    for k, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert list(rows[k].ids) == want and rows[k].decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.filter("false"), path).count() == 0
    again = bpe.encode(df.unionByName(df), path, decoded="decoded", keep_text=False)
    assert "text" not in again.columns and sorted((r.doc_id, r.ids, r.decoded) for r in again.collect()) == sorted(2 * [(k, r.ids, r.decoded) for k, r in rows.items()])


def test_bpe_cuts_where_the_library_does(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_WORDS", 500)
    path = queries.tokenizer_file()
    lib, v, rng = Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(5)
    texts = ["\n", "a\n\n\nb", "\r\nx\r\n y\t z", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "a.b,c' d's'sx 'tt x'.y 1'2 a\x1cb \x85c\xa0 d  e", "\x01a \x01", ""]
    texts += ["".join(rng.choice(" \n\t\r'.a1éB \x1c\x85 !-st") for _ in range(60)) for _ in range(400)]
    for at in range(0, len(texts), 50):
        ids, ends = v.encode(texts[at : at + 50])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts[at : at + 50]]


def test_bpe_vectorised_merges_equal_the_heap():
    v = bpe.vocabulary(queries.tokenizer_file())
    rng = random.Random(2)
    words = [bytes(rng.choice(b"theringaoutnd ") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for w, got in zip(words, v.exact(words), strict=True):
        assert got.tolist() == v._heap([v.single[b] for b in w])


# SimHash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "two Words", "three words here", "Ä ß É x y z", "a b c a b c a b c", LONG[:5000]):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_links(values, close):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a + 1, len(values)):
            if close(values[a], values[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("leaf,tile", [(1024, 16_384), (8, 20)])
def test_all_links_of_fingerprints(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(120)]
    for base in fps[:8]:
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(12)]
    fps = list(dict.fromkeys(fps))
    want = brute_links(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from twinfold.common import cut
    from twinfold.operators.components import components

    points = cut(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"))
    got = {r.node: r.component for r in components(simhash.links(points)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == want


def test_near_duplicates_edge_cases(spark):
    base = prose(random.Random(4), ["an", "the", "or", "ing"], 400)
    texts = [base, base, base + " tail", None, "", "  ", "a b", LONG, "Other Words entirely here now"]
    df = docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k][0] % (1 << 64) for k in range(len(texts))] == fps
    assert [got[k][1] for k in range(len(texts))] == brute_links(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert simhash.near_duplicates(df.filter("false")).count() == 0
    odd = df.unionByName(df.filter("doc_id in (0, 7)")).unionByName(df.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    kept = [r.doc_id for r in simhash.deduplicate(odd).collect()]
    assert sorted(kept, key=str) == sorted(set(brute_links(fps, lambda a, b: (a ^ b).bit_count() <= 3)), key=str)


@pytest.mark.parametrize("most", [500_000, 0])
def test_deduplication_decides_by_row(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST", most)
    rng = random.Random(17)
    a, b, c, d = (prose(rng, ["an", "the", "or", "ing", "ble", "st"], 60) for _ in range(4))
    rows = [(2, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a), (9, d), (None, d), (3, None), (None, "")]
    kept = simhash.deduplicate(spark.createDataFrame([(k, t, "en", None, None) for k, t in rows], DOC)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("2", a), ("5", b), ("None", c), ("9", d)]) and [r.doc_id for r in kept if not r.text] == [3]


# Embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:20] + 0.05 * rng.normal(size=(20, 16)), np.repeat(x[:1], 40, 0) + 0.02 * rng.normal(size=(40, 16)), x[:3]]).astype(np.float32)
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    n = len(rows)
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [0.0] * 16, [1.0, 2.0]]
    rows += [(n + k, b, None) for k, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(1))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_links(list(range(n)), lambda a, b: near[a, b])
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert [got[k].component_id for k in range(n)] == want and [got[k].n_links for k in range(n)] == (near.sum(1) - 1).tolist()
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k for k in range(len(bad))) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_graph_search_meets_what_is_in_range(monkeypatch):
    rng = np.random.default_rng(6)
    x = embeddings.unit(np.concatenate([rng.normal(size=(900, 32)), rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(300, 32))]))
    truth = x @ x.T >= 0.95
    edges = embeddings.build(x)
    found = sum(len(h) for _, h in embeddings.search(x, edges, np.arange(len(x))))
    assert found >= 0.99 * truth.sum()


def run_sql(sql, **tables):
    """Rows of DuckDB SQL over tables given as (columns with types, rows)."""
    import duckdb

    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted((dict(zip(names, r, strict=True)) for r in out.fetchall()), key=repr)


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


@pytest.mark.parametrize("overlap_most,sample", [(32, 16_384), (1, 16_384), (32, 40)])
def test_embeddings_of_several_lengths_equal_the_sql(spark, tmp_path, monkeypatch, overlap_most, sample):
    monkeypatch.setattr(embeddings, "OVERLAP_MOST", overlap_most)
    monkeypatch.setattr(embeddings, "SHARD", 64)
    monkeypatch.setattr(embeddings, "SAMPLE", sample)
    rng = np.random.default_rng(10)
    rows = [(k, [float(v) for v in c + 0.02 * rng.normal(size=n)]) for k, (n, c) in enumerate((n, c) for n in (2, 3, 8) for c in rng.normal(size=(40, n)) for _ in range(3))]
    rows += [(500, [1e-200, 1.0]), (501, [0.0, 1.0]), (502, []), (503, None), (504, [1e150, 1.01e150]), (505, rows[9][1]), (9, rows[30][1]), (9, rows[9][1]), (None, rows[60][1]), (None, [1.0] * 5), (None, [1.0] * 5), (None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = as_dicts(queries.op3_embeddings(spark, str(tmp_path)))
    assert got == run_sql(queries.OP3_SQL, embeddings=("vec_id BIGINT, embedding DOUBLE[]", rows))
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 1.1e-300]), (2, [-1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(huge).collect()) == [(0, 2, 0), (1, 2, 0), (2, 0, 2), (2, 2, 0)]


def test_hot_shards_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 100)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(250, 8))).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df).collect()
    assert all(r.n_links == 249 and r.component_id == 0 for r in got)


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=(1, 32)) + 0.01 * rng.normal(size=(150, 32))
    pairs = np.repeat(rng.normal(size=(100, 32)), 2, 0) + 0.01 * rng.normal(size=(200, 32))
    rows = [(k, 1, [float(v) for v in r]) for k, r in enumerate(np.concatenate([hot, pairs]))]
    points = spark.createDataFrame(rows, "rep long, n long, vector array<float>")
    found = spark.createDataFrame([(k, 149 if k < 150 else 0) for k in range(len(rows))], "u long, n_links long")
    assert embeddings._audit(points, found, len(rows), 0.95) == 0
    assert embeddings._audit(points, found.withColumn("n_links", F.greatest("n_links", F.lit(1))), len(rows), 0.95) == 1


def test_all_pairs_are_compared_where_overlap_falls_short(spark, monkeypatch):
    whole = embeddings._linked

    def lossy(*given, **more):
        out = whole(*given, **more)
        return out if more.get("exact") else out.filter("v is null").withColumn("n", F.lit(0).cast("long"))

    monkeypatch.setattr(embeddings, "_linked", lossy)
    monkeypatch.setattr(embeddings, "TILE", 100)
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.normal(size=(60, 16)), 3, 0) + 0.01 * rng.normal(size=(180, 16))).astype(np.float32)
    got = embeddings.near_duplicates(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert len(got) == 180 and all(r.n_links == 2 and r.component_id == r.vec_id // 3 * 3 for r in got)


# Language, quality, toxicity


def test_language_identification(spark):
    rng = random.Random(8)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["ör", "sch", "ung"]}
    train = [(k, prose(rng, s, 40), lang, None, None) for k, (lang, s) in enumerate(x for x in kinds.items() for _ in range(30))]
    model = langid.fit(spark.createDataFrame([*train, (900, None, "aa", None, None), (901, "x", None, None, None)], DOC))
    texts = ["kalomi loka unseenkalo", "ungör schungör", None, "", "123 !!", LONG, "ung"]
    df = docs(spark, texts).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 3, 4, 6)] == ["aa", "bb", "und", "und", "und", "bb"] and got[5].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0
    held = spark.createDataFrame([(k, prose(rng, s, 30), lang, None, None) for k, (lang, s) in enumerate(x for x in kinds.items() for _ in range(20))], DOC)
    assert langid.predict(held, model).filter("lang = lang_pred").count() == 40
    none = langid.fit(held.filter("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.filter("false"), model).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    good = [prose(rng, ["an", "the", "or", "ing"], 120) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, ["an", "the", "or", "ing"], 120).split()) for _ in range(120)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, 1 - k % 2, None) for k in range(len(texts))] + [(5000, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels.filter("doc_id < 180"))
    s = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((s[k] >= 0.5) == (k % 2 == 0) for k in range(180, 240))
    odd = docs(spark, [None, "", LONG, texts[0], texts[0]]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert got[0] == got[1] and got[3] == got[4] and all(0 <= x <= 1 for x in got.values())
    assert {r.score for r in quality.score(odd, quality.fit(df, labels.filter("false"))).collect()} == {0.5}


def test_language_scores_equal_brute_force(spark):
    import math

    rng = random.Random(18)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["ör", "sch", "ung"], "cc": ["ka", "ör", "x"]}
    model = langid.fit(spark.createDataFrame([(k, prose(rng, s, 40), lang, None, None) for k, (lang, s) in enumerate(x for x in kinds.items() for _ in range(20))], DOC))
    texts = [prose(rng, rng.choice([*kinds.values(), ["zz", "ka"]]), rng.randrange(1, 30)) for _ in range(60)] + ["Ka LO2mi", "²³", "q", "ka_lo", "the same", "the same"]
    df = spark.createDataFrame([(k // 2, t, "aa", None, None) for k, t in enumerate(texts)], DOC)
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(df, model).collect())

    def score(text):
        words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
        if not any(ch.isalpha() for w in words for ch in w):
            return "und", 0.0
        total = [0.0] * len(model.langs)
        for w in words:
            rows = [model.words[w]] if w in model.words else []
            if not rows:
                padded = f" {w} "
                for i in range(len(padded)):
                    known = [padded[i : i + n] for n in (4, 3, 2, 1) if i + n <= len(padded) and padded[i : i + n] in model.grams]
                    rows += [model.grams[known[0]]] if known else []
                rows = rows or [0]
            for c in range(len(total)):
                total[c] += sum(model.table[r][c] for r in rows) / len(rows)
        e = [math.exp(langid.SHARPNESS * (t - max(total)) / len(words)) for t in total]
        best = max(range(len(e)), key=lambda c: e[c])
        return model.langs[best], e[best] / sum(e)

    assert got == sorted((k // 2, (s := score(t))[0], round(s[1], 9)) for k, t in enumerate(texts))


def test_quality_scores_equal_brute_force(spark):
    import math

    import zstandard

    rng = random.Random(19)
    texts = [prose(rng, ["an", "the", "or", "ing"], rng.randrange(1, 200)) if k % 2 else " ".join(w.upper() + "!!" for w in prose(rng, ["an", "the"], rng.randrange(1, 200)).split()) for k in range(120)] + [None, "", LONG, "same", "same"]
    df = spark.createDataFrame([(k // 2, t, None, None, None) for k, t in enumerate(texts)], DOC)
    model = quality.fit(docs(spark, texts[:100]), spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int"))

    def size(text, words):
        data, n = (text or "").encode(), 0
        for at in range(0, max(1, len(data)), quality.BLOCK):
            fresh = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
            n += len(fresh.compress(data[at : at + quality.BLOCK]))
        return n

    def score(text):
        good, bad = size(text, model.good), size(text, model.bad)
        return 1 / (1 + math.exp(-(model.slope * (bad - good) / (bad + good) + model.offset)))

    got = sorted((r.doc_id, round(r.score, 9)) for r in quality.score(df, model).collect())
    assert model.slope and got == sorted((k // 2, round(score(t), 9)) for k, t in enumerate(texts))
    assert quality.score(df.filter("false"), model).count() == 0


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(20)
    terms = [("idiot", False, 0.9), ("scum", False, 0.8), ("grumblewort", False, 0.95), ("lowei", True, 0.99), ("bomente", True, 0.7)]
    lexicon = toxicity.Lexicon(terms, ["scam", "idiom"], 0.03, ["lowei"])

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row

    def weight(w):
        exact = [toxicity.PLAIN * p for t, stem, p in terms if w == t and not stem] or [toxicity.PLAIN * p for t, stem, p in terms if stem and w.startswith(t)]
        if exact or w in lexicon.clean:
            return exact[0] if exact else 0.0
        near = [(t, stem, p) for t, stem, p in terms if (min(lev(t, w)) if stem else lev(t, w)[-1]) == 1]
        return max(((toxicity.MISSPELT if t in lexicon.lone or toxicity.misspelt(t, w, stem) else toxicity.FAINT) * p for t, stem, p in near), default=0.0)

    def score(text):
        low = (text or "").lower()
        at = [(m.start(), m.end(), weight(m[0])) for m in re.finditer(r"\w(?:[\w@$*]*\w)?", low)]
        for start, end, w in toxicity.with_signs(low):
            inside = [p for p in at if p[0] < end and p[1] > start]
            if weight(w) > max((p[2] for p in inside), default=0):
                at = [p for p in at if p not in inside] + [(start, end, weight(w))]
        left, weak, pairs = 1.0, 0.0, toxicity.quotations(low)
        for start, end, x in at:
            if not x:
                continue
            quoted = any(a < start and end <= b and a >= start - toxicity.WINDOW and b < end + toxicity.WINDOW for a, b in pairs) or toxicity.REPORTING.search(low[max(0, start - toxicity.WINDOW) : start])
            if quoted:
                weak = max(weak, toxicity.QUOTED * x)
            elif x <= toxicity.FAINT:
                weak = max(weak, x)
            else:
                left *= 1 - x
        return max(lexicon.base, 1 - left * (1 - weak))

    pool = ["idiot", "idiott", "idot", "1diot", "id!ot", "scum", "scam", "skum", "scums", "idiom", "loweiana", "lowxian", "bomentear", "bomxntear", "bmenteción", "grumblewrt", "grumbelwort", '"an', 'idiot"', "“scum”", "said", "the", "nice", "word", "\n", "$cum", "an", "or", "grumble", "wort"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + [None, "", "same idiot", "same idiot", "x" * 50_000]
    df = spark.createDataFrame([(k // 2, t, None, None, None) for k, t in enumerate(texts)], DOC)
    got = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(df, lexicon).collect())
    assert got == sorted((k // 2, round(score(t), 9)) for k, t in enumerate(texts))
    assert toxicity.score(df.filter("false"), lexicon).count() == 0
    assert toxicity.fit(df.filter("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).score("you idiot") >= 0.5


def test_toxicity(spark):
    rng = random.Random(10)
    syllables = ["an", "the", "or", "ing"]
    rows, labels = [], []
    for k in range(200):
        t = prose(rng, syllables, 60).split()
        if k % 4 == 0:
            t.insert(rng.randrange(60), rng.choice(["grumblewort", "lowei" + rng.choice(syllables) + rng.choice(["x", "y", "z"])]))
        rows.append(" ".join(t))
        labels.append((k, None, int(k % 4 == 0)))
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(df, lab.filter("doc_id < 160"))
    terms = {t: stem for t, stem, _ in lexicon.terms}
    assert terms["grumblewort"] is False and terms["lowei"] is True
    texts = ["you grumblewort", "you grumblewrt", "you gr*mblewort", "what loweibana", None, "", 'he was "a grumblewort" they claimed', "an or the ing", "you 1diot", "a laser closer", LONG, "IDIOT!!"]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts).withColumn("score", F.lit("clash")), lexicon).collect()}
    assert [got[k] >= 0.5 for k in range(len(texts))] == [True, True, True, True, False, False, False, False, True, False, False, True]
    assert got[6] > got[7]
    bare = toxicity.fit(df, lab.filter("false"))
    assert bare.score("you idiot") >= 0.5 and bare.score("the or an") == 0


def test_misspelt_short_terms_and_stems():
    terms = [*((w, False, 0.8) for w in toxicity.KNOWN), ("bomente", True, 0.99), ("lowei", True, 0.99), ("vequa", True, 0.99)]
    lexicon = toxicity.Lexicon(terms, ["looser"], 0.0, ["lowei"])
    toxic = ["idiott", "losr", "morron", "clwn", "id!ot", "$hit", "@sshole", "you!idiot", "bomxntear", "bmenteción", "lowxian", "veqquaan"]
    assert [w for w in toxic if lexicon.score(f"what a {w}!") < 0.5] == []
    clean = ["looser", "laser", "lose", "moon", "where", "wow!", "co$t", "vexuaan", "bomentar laser where moon"]
    assert [w for w in clean if lexicon.score(f"what a {w}!") >= 0.5] == []


def test_abuse_between_quotations_is_not_quoted():
    lexicon = toxicity.Lexicon([("idiot", False, 1.0)], [], 0.0)
    long = "nice " * 30
    plain = ["“nice” you idiot “bye”", "«nice» you idiot «bye»", "« nice » you idiot « bye »", "„nice“ you idiot „bye“", "»nice« you idiot »bye«", "‘nice’ you idiot ‘bye’", f'"{long}" you idiot "bye"', f'"{long}" you idiot and "bye" you idiot', 'a 5" pipe, you idiot, "bye"', 'the end" you idiot "bye"', 'open "\nyou idiot "bye"']
    assert [t for t in plain if lexicon.score(t) < 0.5] == []
    quoted = ["“you idiot”", "«an idiot»", "« an idiot »", "„an idiot“", "»an idiot«", "‘don’t, idiot’", '"nice" and "you idiot"', f'"{long}" and "you idiot" again', '("an idiot")', '«the "so" idiot»', "«the “so” idiot»"]
    assert [t for t in quoted if lexicon.score(t) >= 0.5] == []


def test_levenshtein_walk_is_exact():
    rng = random.Random(11)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) for _ in range(20)]
    trie = toxicity.Trie([(t, False) for t in terms])

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(100):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        assert set(trie.within(w)) == {(k, lev(t, w)) for k, t in enumerate(terms) if lev(t, w) <= 1}


# Decontamination


def brute_decontam(text, items):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    w, hit, found = words(text), set(), set()
    for key, t in items:
        v = words(t)
        m = min(10, len(v))
        windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
        for k in range(len(w) - m + 1 if m else 0):
            if tuple(w[k : k + m]) in windows:
                hit.update(range(k, k + m))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    pool = ["aa", "bb", "cc", "Äé"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.randrange(10, 40))) for k in range(6)] + [(90, "only four words, HERE"), (91, ""), (92, None), (93, "one"), (94, text(9)), (None, text(20)), (9, "x y " * 15)]
    texts = [None, "", "one", "two", LONG, "x y " * 30] + [text(rng.randrange(1, 60)) for _ in range(25)]
    texts += [text(20) + " \n " + items[k % 6][1].upper().replace(" ", "; ") + " " + text(15) for k in range(10)] + ["so only four words, here too"]
    df = docs(spark, texts).withColumn("items", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in decontam.report(df, bench).collect()}
    want = {k: brute_decontam(t, items) for k, t in enumerate(texts)}
    assert got == {k: (n, h, len(found), sorted(x for x in found if x != "None")) for k, (n, h, found) in want.items()}
    kept = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert kept == {k for k, v in want.items() if not v[1]}
    assert decontam.report(df, bench.filter("false")).filter("contaminated").count() == 0 and decontam.report(df.filter("false"), bench).count() == 0


def test_decontamination_of_repeated_and_null_keys_equals_its_sql(spark, tmp_path):
    rng = random.Random(16)
    item = prose(rng, ["an", "the", "or", "ing"], 30)
    words = item.split()
    rows = [(7, "clean words only"), (7, item), (7, " ".join(words[3:15]) + " x"), (None, item.upper()), (None, "clean"), (None, None), (8, item), (8, item), (9, None), (10, "four short words here")]
    items = [(1, item), (1, item), (2, " ".join(words[:20])), (None, " ".join(words[10:])), (None, "short words"), (3, "Short words"), (4, None), (5, "")]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = as_dicts(queries.op5_decontam(spark, str(tmp_path)))
    assert got == run_sql(queries.OP5_SQL, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert sorted((str(r.doc_id), str(r.text)) for r in decontam.decontaminate(df, bench).collect()) == [("7", "clean words only"), ("9", "None"), ("None", "None"), ("None", "clean")]


def test_decontamination_of_long_texts_that_repeat_themselves(spark, monkeypatch):
    rows = [(0, "x y " * 100_000, None, None, None), (1, "x y " * 7, None, None, None), (2, "y x " * 50 + "z", None, None, None)]
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, "x y " * 15)], "item_id long, text string")
    want = [(0, 200_000, 200_000, ["1"]), (1, 14, 14, ["1"]), (2, 101, 100, ["1"])]
    for most in (500_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST", most)
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.report(df, bench).collect()) == want
        assert decontam.decontaminate(df, bench).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<a>\r\n\r\nWARC/1.0\r\n</a>", "<a>\r\n\r\nWARC/1.0\r\n</a>", None, "", "é\n", "é\n", "é\n", "x" * 200_000, "\n\n\n", "HTTP/1.1\r\n\r\n\r\n"]
    pages = spark.createDataFrame([(k, f"http://h.example/{k} ü\n" if k else None, h, "x") for k, h in enumerate(htmls)], "page_id long, url string, html string, digest string")
    at = str(tmp_path / "w")
    warc.write(warc.plan(pages), at)
    rows = warc.assemble(warc.read(spark, at)).collect()
    assert len(rows) == len(htmls)
    bodies = {int(re.search(r"page: (\d+)", r.metadata[0].text)[1]): r for r in rows}
    for k, h in enumerate(htmls):
        data = (h or "").encode()
        last = max(j for j, o in enumerate(htmls) if (o or "") == (h or ""))
        assert bodies[k].warc_type == ("response" if k == last else "revisit") and bodies[k].request[0].text.startswith("GET ")
        if k == last:
            import base64

            assert bytes(bodies[k].payload) == data and bodies[k].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    warc.write(warc.plan(pages, least=10), str(tmp_path / "v"))
    kinds = [r.warc_type for r in warc.assemble(warc.read(spark, str(tmp_path / "v"))).collect()]
    assert kinds.count("revisit") == 1
    empty = str(tmp_path / "e")
    warc.write(warc.plan(pages.filter("false")), empty)
    assert warc.plan(pages.filter("false")).count() == 0


def test_warc_of_repeated_and_null_keys_equals_its_sql(spark, tmp_path):
    rows = [(5, "u", "AAA"), (5, "u", "AAA"), (3, "v", "AAA"), (None, None, "AAA"), (None, None, "BBB"), (None, "w", "BBB"), (6, "x", None), (6, "x", ""), (7, "y", "CCC"), (7, "z", "DDD"), (8, "z", "DDD")]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    assert as_dicts(queries.op6_warc(spark, str(tmp_path))) == run_sql(queries.OP6_SQL, pages=("page_id BIGINT, url VARCHAR, html VARCHAR", rows))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert queries.op6_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_links_in_either_direction_and_repeated_headers(spark, tmp_path):
    import gzip

    def record(kind, ident, names, block=b"x"):
        named = "".join(f"WARC-Concurrent-To: {n}\r\n" for n in names)
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n{named}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(record("request", "q1", []) + record("response", "r1", ["q1", "m1"]) + record("metadata", "m1", []))
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write(record("response", "r2", []) + record("request", "q2", ["r2", "m9"]) + record("metadata", "m2", ["q2"]) + record("metadata", "m3", ["r2"]) + record("metadata", "m4", ["gone"]) + record("response", "r3", []) + record("warcinfo", "i", []))
    got = {r.record_id: ([x.id for x in r.request], [x.id for x in r.metadata]) for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2", "m3"]), "r3": ([], [])}


def test_warc_parser_rejects_cut_files():
    for text in (b"WARC/1.0\r\nContent-Length: 100\r\n\r\nshort", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(("f", x) for x in text.split(b"\n")))


# Licenses and chat


def brute_licences(texts, model):
    """(text's number, place, family, probability) of every paragraph scored in full."""
    import math

    import regex

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = []
    for k, t in enumerate(texts):
        for place, p in enumerate(regex.split(r"(?<=[^\p{L}\p{N}\s,(\-])[ \t]*\r?\n|\r?\n(?=[ \t]*\r?\n)", t) if t is not None else []):
            w = regex.findall(r"[\p{L}\p{N}]+", p.lower())
            one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
            g = {signed(h) for h in one} | {signed(xxhash.xxh64_intdigest(b.encode(), a)) for a, b in zip(one, w[1:], strict=False)}
            if not g:
                continue
            z = [o + sum(model.weights[x][c] for x in g if x in model.weights) / math.sqrt(len(g)) for c, o in enumerate(model.offsets)]
            e = [math.exp(v - max(z)) for v in z]
            best = max(range(len(z)), key=lambda c: z[c])
            if model.names[best] != licences.UNKNOWN and max(e) / sum(e) >= licences.LEAST:
                out.append((k, place, model.names[best], round(max(e) / sum(e), 6)))
    return out


def licence_corpus():
    rng = random.Random(13)
    body = ["\n".join(prose(rng, ["an", "the", "or", "ing", "ble"], 12).capitalize() + rng.choice([".", ".", "!", ".***"]) for _ in range(8)) for _ in range(60)]
    wrapped = "Copyright (c) 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    notices = {
        "MIT": ["Released under the MIT License.", "Licensed under the MIT license", wrapped], "Apache-2.0": ["Licensed under the Apache License, Version 2.0."], "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
        "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."], "GPL-2.0": ["Released under the GNU General Public License, version 2."], "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."], "CC-BY-ND-4.0": ["Released under CC BY-ND 4.0."], "CC-BY-4.0": ["This work is licensed under CC BY 4.0."],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."], "ISC": ["Released under the ISC License."], "EPL-2.0": ["Licensed under the Eclipse Public License 2.0."], "CC0-1.0": ["Released under CC0 1.0."], "Unlicense": ["This is free and unencumbered software released into the public domain."],
        "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    }
    none = ["He lost his fishing license in the lake.", "The MIT campus was licensed to serve beer under a new law.", "Licensed under terms that nobody has read so far.", "All rights reserved by the author of this work.", "See the license of the software for more."]
    texts, want = [], []
    for family, ts in [*notices.items(), (None, none)]:
        for t in ts:
            texts.append(f"{body[len(texts)]}\n{t}\n\n{body[len(texts) + 9]}")
            want.append(family)
    return [*texts, *body[40:], None, "", LONG + "\n\nreleased under the MIT license\n", "Licensed under the MIT license.\nLicensed under the MIT license."], [*want, *[None] * 22, "MIT", "MIT"]


def test_licence_scan_equals_brute_force(spark):
    texts, want = licence_corpus()
    df = docs(spark, texts).select("*", *(F.lit("clash").alias(c) for c in ("family", "place", "paragraph", "probability", "_row", "gram")))
    model = licences.fit(spark, df)
    rows = licences.scan(df, model=model).collect()
    assert sorted((r.doc_id, r.place, r.family, round(r.probability, 6)) for r in rows) == brute_licences(texts, model)
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.family, r.confirmed))
    assert {k: {f for f, _ in v} for k, v in got.items()} == {k: {f} for k, f in enumerate(want) if f}
    assert all(c for v in got.values() for _, c in v)
    assert licences.scan(df.filter("false")).count() == 0 and licences.report(df.filter("false")).count() == 0


def test_licences_of_repeated_and_null_keys(spark, tmp_path):
    texts, _ = licence_corpus()
    mit = "Released under the MIT License."
    rows = [*enumerate(texts), (0, "nothing here"), (0, mit), (None, mit), (None, None), (500, mit), (500, mit), (501, f"{mit}\n{mit}\nReleased under the ISC License.")]
    spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_licences(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    of = lambda k: sorted((r.n_paragraphs, r.families, r.confirmed) for r in got if r.doc_id == k)
    assert of(0) == [(0, "", False), (1, "MIT", True), (1, "MIT", True)] and of(None) == [(0, "", False), (1, "MIT", True)]
    assert of(500) == [(1, "MIT", True)] * 2 and of(501) == [(3, "ISC,MIT", True)]


def test_a_licence_in_other_words_is_not_confirmed(spark):
    texts, _ = licence_corpus()
    model = licences.fit(spark, docs(spark, texts))
    odd = docs(spark, ["Licensed under CC BY-XX 4.0 with many changes of our own.", "Licensed under the MIT license and the moon and the stars and the sea and every song that was sung there before the war."])
    assert not any(r.confirmed for r in licences.scan(odd, model=model).collect())


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name, args: f'{{"content":"c","tool_calls":[{{"id":"{i}","name":"{name}","arguments":{args}}}]}}'
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", call("a", "find", '{"n": 3, "q": "x"}')), (1, 0, "tool", '{"tool_call_id":"a","content":"r"}'),
        (1, 3, "assistant", call("b", "find", '{"q": 5}')), (1, 4, "tool", '{"tool_call_id":"zz","content":"lost"}'), (1, 5, "assistant", "{not json"), (2, 0, None, None),
        (2, 1, "assistant", call("a", "other", "{}")), (None, None, "user", "x"), (2, 2, "assistant", call("d", "find", '{"n": 1, "q": "y", "more": 1}')),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    tools = spark.createDataFrame([("find", "q", "string", True), ("find", "n", "integer", False)], chat.TOOLS)
    got = chat.format(df, tools).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn, r.role): r for r in got}
    assert at[1, 0, "user"].message == '{"content":"say \\"hi\\"\\n","role":"user"}'
    a = at[1, 1, "assistant"]
    assert (a.n_calls, a.n_linked, a.n_invalid) == (1, 1, 0)
    assert a.message == '{"content":"c","role":"assistant","tool_calls":[{"arguments":"{\\"n\\":3,\\"q\\":\\"x\\"}","id":"a","name":"find"}]}'
    assert (at[1, 0, "tool"].place, at[1, 0, "tool"].rank, at[1, 0, "tool"].n_linked) == (1, 1, 1) and at[1, 4, "tool"].n_linked == 0
    assert at[1, 3, "assistant"].n_invalid == 1 and at[2, 1, "assistant"].n_invalid == 1 and at[2, 2, "assistant"].n_invalid == 1
    assert at[1, 5, "assistant"].message == '{"content":"{not json","role":"assistant"}' and at[2, 0, ""].message == '{"content":"","role":""}'
    assert chat.format(df.filter("false")).count() == 0


def test_chat_keeps_calls_of_null_and_repeated_rows(spark):
    call = '{"content":"c","tool_calls":[{"id":"a","name":"f","arguments":{}},{"name":"g","arguments":{}}]}'
    answer = '{"tool_call_id":"a","content":"r"}'
    rows = [(None, 1, "assistant", call), (None, 0, "tool", answer), (3, None, "assistant", call), (3, 4, "tool", answer), (4, 1, "assistant", call), (4, 1, "assistant", call), (5, 1, "assistant", '{"tool_calls":[{"name":"g"}]}'), (5, 2, "tool", answer)]
    got = chat.format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    asked = sorted(((str(r.conv_id), str(r.turn), r.n_calls, r.n_linked, r.n_invalid) for r in got if r.role == "assistant"))
    assert asked == [("3", "None", 2, 1, 2), ("4", "1", 2, 0, 2), ("4", "1", 2, 0, 2), ("5", "1", 1, 0, 1), ("None", "1", 2, 1, 2)]
    assert all(r.message == '{"content":"c","role":"assistant","tool_calls":[{"arguments":"{}","id":"a","name":"f"},{"arguments":"{}","name":"g"}]}' for r in got if r.n_calls == 2)
    assert sorted((str(r.conv_id), r.place, r.rank, r.n_linked) for r in got if r.role == "tool") == [("3", 4, 1, 1), ("5", 2, 1, 0), ("None", 1, 1, 1)]


CONV = "conv_id long, turn long, role string, text string"


def planted_conversations(rng, n=60):
    """Chains of calls and results, some late, repeated, unanswered, malformed or without keys."""
    import json

    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.randrange(1, 6)):
            ids = [rng.choice(["a", "b", "c", "d", None, 7]) for _ in range(rng.randrange(0, 4))]
            calls = [{"id": i, "name": rng.choice(["find", "stop", None]), "arguments": rng.choice([{"q": "x é \"", "n": rng.randrange(9)}, {"z/~": [1, {"a": None}], "b": True}, {}, "plain", '{"n":1}', None])} for i in ids]
            calls = [{k: v for k, v in c.items() if v is not None or rng.random() < 0.5} for c in calls]
            rows.append((conv, turn, "user", rng.choice(["hi", "", None, "{", '{"tool_call_id":"a"}'])))
            rows.append((conv, turn + 1, "assistant", json.dumps({"content": rng.choice(["ok\n", None, ""]), "tool_calls": calls}, ensure_ascii=rng.random() < 0.5)))
            for i in ids:
                if i is not None and rng.random() < 0.8:
                    rows.append((conv, rng.choice([turn + 2, turn, 0, None]), "tool", json.dumps({"tool_call_id": i, "content": "r"})))
            turn += 3
        if rng.random() < 0.3:
            rows += rows[-2:]
    return rows


def brute_chat(rows):
    import json

    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    parsed = []
    for conv, turn, role, text in rows:
        role, text, calls, answers, content = role or "", text or "", [], None, text or ""
        try:
            o = json.loads(text) if text.lstrip().startswith("{") else None
        except ValueError:
            o = None
        if o and role == "assistant":
            for c in o.get("tool_calls") or []:
                given = c.get("arguments")
                raw = given if isinstance(given, str) else dump(given) if given is not None else None
                one = {"id": None if c.get("id") is None else str(c["id"]), "name": c.get("name"), "arguments": raw}
                if any(v is not None for v in one.values()):
                    one["arguments"] = "{}" if raw is None else raw
                    try:
                        back = json.loads(one["arguments"])
                        one["arguments"] = dump(back) if isinstance(back, dict) else one["arguments"]
                    except ValueError:
                        pass
                    calls.append(one)
            content = (o.get("content") or "") if calls else content
        if o and role == "tool" and o.get("tool_call_id") is not None:
            answers, content = str(o["tool_call_id"]), o.get("content") or ""
        parsed.append((conv, turn, role, content, calls, answers))
    first = {}
    for conv, turn, _, _, calls, _ in parsed:
        for c in calls:
            if c["id"] is not None:
                old = first.get((conv, c["id"]))
                first[conv, c["id"]] = turn if old is None else old if turn is None else min(old, turn)
    answered = {(conv, a, first[conv, a]) for conv, _, _, _, _, a in parsed if a is not None and (conv, a) in first}
    out = []
    for conv, turn, role, content, calls, answers in parsed:
        called = first.get((conv, answers)) if answers is not None else None
        place = max((x for x in (turn, called) if x is not None), default=None)
        linked = int((conv, answers) in first) if answers is not None else sum((conv, c["id"], turn) in answered for c in calls)
        message = {"content": content, "role": role} | ({"tool_call_id": answers} if answers is not None else {}) | ({"tool_calls": [{k: v for k, v in c.items() if v is not None} for c in calls]} if calls else {})
        out.append({"conv_id": conv, "turn": turn, "place": place, "rank": int(answers is not None), "role": role, "n_calls": len(calls), "n_linked": linked, "n_invalid": len(calls), "message": dump(message)})
    return sorted(out, key=repr)


def test_chat_equals_brute_force_and_its_sql(spark, tmp_path):
    rows = planted_conversations(random.Random(15))
    assert sum("tool_calls" in (r[3] or "") for r in rows) > 100
    spark.createDataFrame(rows, CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    got = as_dicts(queries.op7_chat(spark, str(tmp_path)))
    assert got == brute_chat(rows)
    assert got == run_sql(queries.OP7_SQL, conversations=("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", rows))


# The pipeline and the registered queries


def test_language_stage_keeps_texts_where_no_language_is_known(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(["some words", "123 !!", "ung", None, "x"])], DOC)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()) == [0, 2, 4]


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(14)
    syllables = ["an", "the", "or", "ing", "ble"]
    texts = [prose(rng, syllables, 80) for _ in range(60)]
    item = prose(rng, syllables, 20)
    texts[3] = texts[10]
    texts[5] += " you idiot"
    texts[7] += " " + item
    texts[8] = None
    texts[9] = "12 34"
    df = docs(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k == 5)) for k in range(0, 60, 2)] + [(5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run")).collect()}
    # A run that failed after a stage goes on with the next; what came before is gone.
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if p.is_dir()) == ["4"]
    again = [(name, (lambda *_: 1 / 0) if k < 4 else stage) for k, (name, stage) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", again)
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run")).collect()} == got
    left = [k for k in range(60) if k not in (5, 8, 9)]
    roots = brute_links([brute_fingerprint(texts[k]) for k in left], lambda a, b: (a ^ b).bit_count() <= 3)
    want = [k for i, k in enumerate(left) if roots[i] == i and not brute_decontam(texts[k], [(0, item)])[1]]
    assert sorted(got) == want
    lib = Tokenizer.from_file(queries.tokenizer_file())
    for k in want:
        ids = lib.encode(texts[k], add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[k].decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    df = docs(spark, ["an the or"] * 3 + [None, ""]).withColumn("score", F.lit(1)).withColumn("fp", F.lit(2))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (df, df.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == df.columns


def test_stages_of_null_and_repeated_keys(spark, tmp_path):
    """A benchmark passage goes whatever its key, a clean text of the same key stays; one row of a group stays."""
    import corpus_pipeline

    rng = random.Random(23)
    a, b, c = (prose(rng, ["an", "the", "or", "ing", "ble", "st"], 60) for _ in range(3))
    spark.createDataFrame([(0, c)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, c), (None, a), (7, b), (7, c), (7, a), (8, a)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in df.collect()) == sorted([(7, a), (7, b)])


def test_remainder(spark):
    from twinfold.llm.sampling import remainder

    rows = spark.createDataFrame([(k,) for k in (0, 7, 123456)] + [(None,)], "doc_id long").select("doc_id", remainder("doc_id", 5).alias("m")).collect()
    assert all(r.m == (zlib.crc32(str(r.doc_id).encode()) % 5 if r.doc_id is not None else 0) for r in rows)
