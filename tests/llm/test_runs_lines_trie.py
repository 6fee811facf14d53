"""Line dedup, periodic runs and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinfold.llm import lines, queries, runs, trie

DOC = "doc_id long, text string, lang string, n long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def docs(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(k, t, "en", 1) for k, t in rows], DOC)
    return df.withColumns({c: F.lit("clash") for c in ("mark", "h1", "last", "__gone", "runs", "collapsed", "n_lines", "kept")})


# Periodic runs


def brute_runs(w, least=6, periods=4):
    out = {}
    for p in range(1, len(w) // periods + 1):
        t = 0
        while t + p < len(w):
            s = t
            while t + p < len(w) and w[t] == w[t + p]:
                t += 1
            if t > s and t - s + p >= max(least, periods * p):
                out.setdefault((s, t - s + p), p)
            t += 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
        base = [rng.randrange(k) for _ in range(rng.randrange(1, 8))]
        w = [base[i % len(base)] if rng.random() < 0.97 else rng.randrange(k) for i in range(n)] if rng.random() < 0.5 else [rng.randrange(k) for _ in range(n)]
        w = [b"%d" % x for x in w]
        least, periods = rng.choice([2, 6]), rng.choice([2, 3, 4])
        assert runs.find_runs(w, least, periods) == brute_runs(w, least, periods)


def test_runs_of_long_texts_take_time_in_proportion():
    import time

    for make in (lambda i: b"a", lambda i: b"%d" % (i % 7), lambda i: b"%d" % (i * i % 997)):
        began = time.time()
        found = runs.find_runs([make(i) for i in range(150_000)])
        assert len(found) == 1 and found[0][:2] == (0, 150_000) and time.time() - began < 20
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 2_000:
        a, b = b, b + a
    assert runs.find_runs(b, 2, 3) == brute_runs(b, 2, 3)


def test_runs_do_not_trust_hashes(monkeypatch):
    """With hashes that all agree, every answer is still that of the words themselves."""
    rng = random.Random(2)
    monkeypatch.setattr(runs.Words, "_equal", lambda self, i, j, n: True)
    for _ in range(300):
        base = [rng.randrange(3) for _ in range(rng.randrange(9, 14))]
        w = [b"%d" % base[i % len(base)] for i in range(90)]
        w[rng.randrange(90)] = b"x"
        assert runs.find_runs(w, 2, 2) == brute_runs(w, 2, 2)


def test_strongest_run_is_exact():
    assert runs.strongest([]) is None
    assert runs.strongest([(5, 12, 3), (2, 8, 2), (1, 8, 2)]) == (5, 12, 3)
    big = 10**17
    assert runs.strongest([(0, 4 * big + 1, big), (9, 4 * (big + 1) + 1, big + 1)]) == (0, 4 * big + 1, big)


def test_run_needs_two_periods():
    with pytest.raises(ValueError):
        runs.find_runs([b"a"] * 9, 2, 1)


def test_periodic_runs_of_a_table(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "a b c", "x " * 40, "a\x0bb\x0ca\x0bb a b a b a b", "é é é é é é é é", "a b " * 20_000] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x " * 40), (3, "a b c"), (4, "y " * 9)]
    got = defaultdict(list)
    for r in runs.periodic_runs(docs(spark, rows)).collect():
        got[r.doc_id].append(([tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed))
    want = defaultdict(list)
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(w) if len(w) < 1000 else [(0, len(w), 2)]
        want[k].append((found, runs.strongest(found), brute_collapsed(w, found)))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert runs.periodic_runs(docs(spark, rows).filter("false")).count() == 0


def test_planted_texts_follow_the_contract():
    rng, seen = random.Random(4), 0
    for key in range(400):
        w = [b"%d" % rng.randrange(1000) for _ in range(rng.randrange(0, 50))]
        h, n = zlib.crc32(str(key).encode()), len(w)
        want = list(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            seen += 1
        assert queries.planted(key, w) == want
    assert seen > 20 and queries.planted(None, [b"a", b"b"]) == [b"a", b"b"]


# Line dedup


def brute_lines(rows, least=40, often=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for r, (k, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(r)
    last = {x: max((rows[r][0] for r in who if rows[r][0] is not None), default=None) for x, who in held.items() if len(who) >= often}
    out = []
    for k, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if key(x) not in last or k == last[key(x)]]
        out.append((k, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(rng, n=120):
    common = [f"{c} common line that many documents hold, number {c} of all" for c in range(12)] + ["é" * 40, "É" * 40, "é" * 39, "short"]
    rows = []
    for k in range(n):
        some = [rng.choice([f"line {rng.random()} of its own, forty letters at least", f"{rng.choice(['', ' ', chr(9)])}{rng.choice(common)}{rng.choice(['', chr(13), ' '])}", rng.choice(common).upper(), ""]) for _ in range(rng.randrange(9))]
        rows.append((k if rng.random() < 0.9 else rng.choice([k - 1, None]), "\n".join(some)))
    return rows + [(None, None), (500, ""), (501, "\n"), (7, rows[7][1]), (502, common[0] + "\n" + common[0])]


def collected(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rows = line_rows(random.Random(5))
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 50
    assert collected(lines.drop_repeated(docs(spark, rows))) == want
    monkeypatch.setattr(lines, "BROADCAST", -1)
    assert collected(lines.drop_repeated(docs(spark, rows), batches=7, fanout=2)) == want
    assert lines.drop_repeated(docs(spark, rows).filter("false")).count() == 0


def test_lines_of_only_null_keys_and_of_one_key(spark):
    x = "a line that everyone has and that is long enough to count"
    for keys in ([None] * 6, [3] * 6, [None, 1, 1, 1, 1, None]):
        rows = [(k, f"{x}\nown {n}") for n, k in enumerate(keys)]
        assert collected(lines.drop_repeated(docs(spark, rows))) == brute_lines(rows)


def test_very_long_line_texts(spark):
    rows = [(k, "\n".join(f"line number {i % 300} of a very long text, over and over" for i in range(20_000)) + f"\n{k}") for k in range(5)]
    assert collected(lines.drop_repeated(docs(spark, rows))) == brute_lines(rows)


def test_runs_of_lines_are_levelled(spark):
    """No hash stands in two runs, counts are those of all batches, and there are few runs."""
    rng = random.Random(6)
    store, count, first = lines.Runs(spark, fanout=2, buckets=3), defaultdict(int), {}
    for b in range(7):
        hashes = [rng.randrange(60) for _ in range(40)]
        fresh = store.add(spark.createDataFrame([(100 - b, h, -h) for h in hashes], "doc_id long, h1 long, h2 long"), "doc_id")
        if b == 6:
            assert {r.h1 for r in fresh.collect()} == set(hashes) - set(count)
        for h in hashes:
            count[h] += 1
            first.setdefault(h, 100 - b)
    assert [len(x) for x in store.levels] == [1, 1, 1]
    assert sum(r.count() for r in store.runs()) == len(count)
    assert {(r.h1, r.last) for r in store.held_often(5).collect()} == {(h, first[h]) for h, n in count.items() if n >= 5}
    names = [n for level in store.levels for n, _ in level]
    store.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
    with pytest.raises(ValueError):
        store.held_often(5)


def test_merges_with_runs_do_not_shuffle_them(spark):
    store = lines.Runs(spark, buckets=3)
    make = lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "id AS h1", "id AS h2")
    store.add(make(0, 50), "doc_id")
    run = spark.table(store.levels[0][0][0])
    plan = run.join(run.hint("merge"), lines.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.close()


# Prefix trie


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            leaf = sha(f"{len((r or '').encode())}:{r or ''}{x or ''}")[:32]
            convs[c].append(((t is not None, t or 0, r or "", leaf), (r or "", x or "")))
    convs = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(donor, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    kids = defaultdict(int)
    for t in nodes:
        if t:
            kids[t[:-1]] += 1
    for t, who in nodes.items():
        for d in range(len(t) + 1):
            below[t[:d]][0] += kids[t] == 0
            below[t[:d]][1] += (len(who) - 1) * len(t[-1][1].encode()) if t else 0
    return sorted(((min(who), len(t), min(nodes[t[:-1]]) if t else None, len(who), kids[t], *below[t], sha(",".join(map(str, sorted(c for c in who if len(convs[c]) == len(t)))))) for t, who in nodes.items()), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def by_contract(df):
    conv = F.col("conv")
    return trie.prefix_trie(*trie.spliced(trie.turns(df), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("pos", "leaf", "node", "n", "__group", "up")})


def chats(rng, n=60):
    rows = []
    for c in range(-8, n):
        if rng.random() < 0.15:
            continue
        length = rng.choice([1, 2, 3, 8, 12, 30])
        rows += [(c, k if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hello", "hello", "é", None, f"own {c}"])) for k in range(length)]
    return rows + rows[:4] + [(None, 1, "user", "left out")]


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 4), ("MEMBERS", 3), ("BROADCAST", -1)):
            monkeypatch.setattr(trie, name, value)
    rows = chats(random.Random(7))
    rng = random.Random(8)
    rng.shuffle(rows)
    assert trie_rows(by_contract(conversations(spark, rows))) == brute_trie(rebuilt(rows))


def test_trie_of_few_or_no_conversations(spark):
    assert trie_rows(by_contract(conversations(spark, [(None, 1, "user", "x")]))) == []
    # Without its donor, whose turns it would begin with, a conversation may be left without any.
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie_rows(by_contract(conversations(spark, [(c, 0, "user", "x")]))) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_deep_conversation_takes_few_rounds(spark, monkeypatch):
    written, made = trie.written, []
    monkeypatch.setattr(trie, "written", lambda *a: made.append(1) or written(*a))
    monkeypatch.setattr(trie, "SHARED", 0)
    rows = [(c, k, "user", str(k)) for c in (0, 5, 10) for k in range(700 if c else 300)]
    leaf = trie.turns(conversations(spark, rows))
    sizes = leaf.groupBy("conv").agg(F.count("*").alias("n"))
    assert trie_rows(trie.prefix_trie(leaf, sizes)) == brute_trie({c: [("user", str(k)) for k in range(700 if c else 300)] for c in (0, 5, 10)})
    assert len(made) < 60


def test_rollup_sums_what_is_below(spark):
    """A forest given by parents alone, with a hub and a chain."""
    edges = {f"c{k}": f"c{k - 1}" for k in range(1, 40)} | {f"h{k}": "c3" for k in range(50)} | {"c0": None, "alone": None}
    nodes = spark.createDataFrame([(k, p, len(k)) for k, p in edges.items()], "node string, parent string, x long")
    want = defaultdict(int)
    for k in edges:
        at = k
        while at is not None:
            want[at] += len(k)
            at = edges[at]
    assert {r.node: r.x for r in trie.rolled_up(nodes, ["x"], 40).collect()} == want
