"""Registered queries, and some of them against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "exact_groups", "exact_members", "quick_hash_candidates", "name_pairs", "name_group_similarity", "hamming_pairs", "image_group_similarity", "video_clusters", "keep_cleanest_name",
    "merge_by_file_set", "groups_ranked", "filter_reasons_all", "scan_summary", "photo_quality", "parse_extensions", "report_csv_rows", "session_roundtrip", "action_plan_move", "engine_scan",
    "action_plan_delete", "action_errors", "photos_by_score", "reasons_by_similarity", "groups_by_column", "files_by_name", "photo_counts", "selection_totals", "candidate_bytes", "visible_groups",
    "tree_walk", "tree_walk_hidden", "tree_walk_flat", "tree_warnings", "tree_exact_groups", "action_apply", "action_apply_report",
]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and sum(r.n_files for r in rows) == 21


def test_only_an_absent_subpackage_is_passed_over(monkeypatch):
    import builtins

    plain = builtins.__import__

    def without(missing):
        def imported(name, *rest, **more):
            if name.startswith("twinfold.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return plain(name, *rest, **more)

        return imported

    monkeypatch.setattr(builtins, "__import__", without("twinfold.llm"))
    assert "exact_groups" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
    monkeypatch.setattr(builtins, "__import__", without("zstandard"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def _plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, float) else v if isinstance(v, (bool, str)) else float(v)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(_plain(r[k]) for k in order) for r in want.fetchall()), key=key)
