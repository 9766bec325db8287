"""Vector search in a grid of groups, against brute force."""

import math
import random

import pytest

from stepfield.llm import vector_search as V


@pytest.mark.parametrize("group", [1 << 10, 64 << 20])
def test_grid_of_groups(spark, monkeypatch, group):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8 if i % 9 else 4)]) for i in range(300)] + [(7, [0.5] * 8), (11, [0.5] * 8)]
    monkeypatch.setattr(V, "GROUP", group)
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "QUERIES", 4)
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = V.search(vectors, vectors.filter("vec_id % 25 = 0"), 5)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    whole = [(i, [math.floor(256 * x) for x in r.embedding]) for i, r in ((r.vec_id, r) for r in vectors.collect())]
    want = []
    for q, v in whole:
        if q % 25 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole if c != q and len(w) == len(v))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
