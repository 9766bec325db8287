"""The stages of the pipeline against their operators and brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import data  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    queries = entry.queries()
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        before, left = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(left) <= set(before) and left
        if name.startswith("quality"):
            want = {r.doc_id for r in queries["op10_quality_bytes"](spark, SF).filter("predicted = 1").collect()}
            assert set(left) == want
        if name.startswith("substring"):
            windows = set()
            for k in sorted(left):
                words = left[k].text.split()
                own = {tuple(words[i:i + 50]) for i in range(len(words) - 49)}
                # What joins up over a gap may repeat; whole texts that stayed as they were may not.
                if left[k].text == before[k].text:
                    assert not own & windows
                    windows |= own
        docs = spark.createDataFrame(list(left.values()), docs.schema)
    assert stage is not None and pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_run(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_awkward(spark, tmp_path, empty):
    data.write_all(tmp_path, empty=empty)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
    assert bool(docs.take(1)) != empty
    assert bool(pipeline.run(spark, str(tmp_path)).count()) != empty or not empty
