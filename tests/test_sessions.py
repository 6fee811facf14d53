"""One-file reports and sessions: the same bytes as written row by row, and read in ranges of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from twinfold.sources import jsonsplit, session


def groups(spark, n):
    return spark.createDataFrame([(k + 1, json.dumps({"Reasons": [], "Files": [{"Path": f'/é "{k}"\\{"x" * (k % 9)}[{{', "Length": k}] * 2}, ensure_ascii=False)) for k in range(n)], "ordinal long, json string").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 37])
def test_a_session_is_the_same_bytes(spark, tmp_path, n):
    at = tmp_path / "s.json"
    session.save(str(at), groups(spark, n))
    rows = [r.json for r in groups(spark, n).orderBy("ordinal").collect()]
    head, _, rest = at.read_text().partition('"Groups":[')
    assert rest == "".join("," * bool(k) + "\n" + r for k, r in enumerate(rows)) + "]}" and json.loads(at.read_text())["Version"] == 1
    back = session.load(spark, str(at)).orderBy("group_key").collect()
    assert [r.files[0].Path for r in back] == [json.loads(r)["Files"][0]["Path"] for r in rows] and all(r.reasons[0].Method == "ExactContent" for r in back)
    assert [p.name for p in tmp_path.iterdir()] == ["s.json"]


def test_reports_are_the_same_bytes(spark, tmp_path):
    session.write_json(f"file:{tmp_path}/r.json", {"a": 1}, ["é"], groups(spark, 12))
    rows = [r.json for r in groups(spark, 12).orderBy("ordinal").collect()]
    assert (tmp_path / "r.json").read_text() == '{"summary":{"a": 1},"warnings":["é"],"groups":[' + ",".join(rows) + "]}"
    table = spark.createDataFrame([(k % 3, "m", "1", f'é,"{k}\n', k, "k", None, 5, k) for k in range(20)], "GroupId long, Method string, Similarity string, FilePath string, SizeBytes long, SizeHuman string, LastModifiedUtc string, ReclaimableBytes long, _pos long")
    session.write_csv(table, str(tmp_path / "r.csv"))
    line = F.concat_ws(",", *(session.csv_escape(F.col(c).cast("string")) for c in session.COLUMNS))
    want = "﻿" + ",".join(session.COLUMNS) + "\n" + "".join(r.line + "\n" for r in table.orderBy("GroupId", "_pos").select(line.alias("line")).collect())
    assert (tmp_path / "r.csv").read_bytes() == want.encode()


def document(rng):
    """A document with strings that look like structure, escapes before the ends of ranges, and other arrays."""
    nasty = ['"', "\\", '\\"', "[{", "}]", "é", "\\\\", "a" * 30, '"Groups":[', ""]
    text = lambda: "".join(rng.choice(nasty) for _ in range(rng.randrange(6)))
    items = [{"k": k, text(): text(), "Files": [{"Path": text()}, [[{"x": {}}]], text()]} for k in range(rng.randrange(30))]
    root = {text() + "a": [{"k": "other"}], "Version": 1, "o": {"Groups": [{"k": "inner"}]}, "Groups": items, "after": [{"k": "late"}], "z" + text(): text()}
    return json.dumps(root, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), items


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_elements_of_a_document_in_ranges(spark, tmp_path, size):
    """By plain functions for small ranges: each range told, then cut out, as the tasks do it."""
    for seed in range(12 if size < 100 else 2):
        text, items = document(random.Random(seed))
        at = tmp_path / f"{seed}.json"
        at.write_text(text)
        if size == 100_000:
            got = [json.loads(r.json) for r in jsonsplit.elements(spark, str(at), "Groups", 512).orderBy("at").collect()]
            assert got == items and jsonsplit.elements(spark, str(at), "none").count() == 0
            continue
        path, data, begins, inside, depth, start, stop = str(at), text.encode(), [], False, 0, None, None
        for k in range(0, len(data), size):
            begins.append((k, inside, depth))
            ends, more, places, depths = jsonsplit._told(data[k : k + size], jsonsplit._slashes_before(path, k))[int(inside)]
            start, stop = jsonsplit._bounds(path, [(k + p, depth + d) for p, d in zip(places, depths)], "Groups", start, stop)
            inside, depth = ends, depth + more
        assert not inside and depth == 0
        got = [json.loads(x) for k, i, d in begins if start is not None and k + size > start and k < stop for _, x in jsonsplit._elements(path, k, min(len(data), k + size), jsonsplit._slashes_before(path, k), i, d, start, len(data))]
        assert got == items
