"""Vector top-k by a broadcast matrix and by cells of queries and rows, against plain products."""

import random

import numpy as np
import pytest

from granary.operators import retrieval


def tables(spark, n_queries, n_rows, seed=1):
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(size=(n_rows, 6)), 1)
    base[3] = 0
    base[5:9] = base[5]  # ties
    asked = np.vstack([base[: n_queries // 2], np.round(rng.normal(size=(n_queries - n_queries // 2, 6)), 1)])
    ids = list(range(n_queries))
    random.Random(seed).shuffle(ids)
    queries = spark.createDataFrame([(i, asked[i].tolist()) for i in ids] + [(10**6, None)], "query_id long, q_embedding array<double>")
    kb = spark.createDataFrame([(i, base[i].tolist()) for i in range(n_rows)] + [(10**6 + 1, None)], "pos long, embedding array<float>")
    return asked, base.astype(np.float32).astype(np.float64), queries, kb


@pytest.mark.parametrize(("block", "cosine", "exclude"), [(4096, True, True), (8, True, True), (8, False, False), (4096, False, True)])
def test_both_ways_give_the_nearest_of_all_rows(spark, monkeypatch, block, cosine, exclude):
    for name, value in (("QUERY_BLOCK", block), ("CELL_QUERIES", 20), ("CELL_ROWS", 30), ("SCORES", 500)):
        monkeypatch.setattr(retrieval, name, value)
    asked, base, queries, kb = tables(spark, 70, 200)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) if cosine else x
    scores = np.round(unit(asked) @ unit(base).T, 6) + 0.0
    want = {(q, p, r + 1): scores[q, p] for q in range(70) for r, p in enumerate(sorted((p for p in range(200) if not (exclude and p == q)), key=lambda p: (-scores[q, p], p))[:5])}
    got = {(r.query_id, r.pos, r.hit_rank): r.vector_score for r in retrieval.vector_topk(queries, kb, 5, exclude, cosine).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert retrieval.vector_topk(queries.limit(0), kb, 5).collect() == [] and retrieval.vector_topk(queries, kb.limit(0), 5).collect() == []


def test_many_queries_don_t_pass_through_the_driver(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    queries = spark.range(30_000).selectExpr("id AS query_id", "array(cast(id % 7 AS double), cast(id % 11 AS double), 1D) AS q_embedding")
    kb = spark.range(500).selectExpr("id AS pos", "array(cast(id % 5 AS float), cast(id % 3 AS float), 1F) AS embedding")
    got = retrieval.vector_topk(queries, kb, 3)
    assert got.count() == 90_000 and not sent
    assert got.groupBy("query_id").count().filter("count <> 3").isEmpty()


def test_a_cell_holds_few_scores_at_once():
    """What a worker holds beside its vectors doesn't grow with the number of queries that meet in its cell."""
    import tracemalloc

    rng = np.random.default_rng(4)
    rows, queries = rng.standard_normal((1 << 14, 8)), rng.standard_normal((600, 8))
    tracemalloc.start()
    ids, pos, scores = retrieval._nearest(np.arange(600), queries, np.arange(1 << 14), rows, 3, False, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    want = np.round(queries[:5] @ rows.T, 6)
    for k in range(5):
        assert pos[ids == k].tolist() == np.lexsort((np.arange(1 << 14), -want[k]))[:3].tolist()
