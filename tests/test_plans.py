"""Plans: what is read, and what is not there."""

import os
import re

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name,columns", [("size_buckets", {"text"}), ("exact_groups", {"text", "doc_id"}), ("dhash_embedding", {"vec_id", "embedding"}), ("media_classes", {"doc_id", "source", "lang"})])
def test_scans_read_what_is_used(spark, name, columns):
    p = plan(__spark_entry__.queries()[name](spark, DATA))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>(?=\s|$)", p) for c in s.split(",")}
    assert read <= columns


@pytest.mark.parametrize("name", ["exact_groups", "exact_members", "quick_hash_candidates", "photo_quality", "keep_cleanest_name", "video_sample_positions"])
def test_no_python_and_no_cross_join(spark, name):
    p = plan(__spark_entry__.queries()[name](spark, DATA))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", p)
