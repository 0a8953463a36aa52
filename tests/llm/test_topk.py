"""Exact search against all products."""

import numpy as np

from tidemark.llm import topk
from tidemark.llm.topk import exact_top_k, quantized, search


def test_search_equals_all_products_and_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 300
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(400, 16)))
    ids = np.arange(400) * 3
    q, own = x[::20], ids[::20]
    scores, found, scored = search(x, ids, q, own, 5, block=50)
    for i, row in enumerate(q @ x.T):
        row = row.copy()
        row[i * 20] = -np.inf
        order = np.lexsort((ids, -row))[:5]
        assert (found[i] == ids[order]).all() and (scores[i] == row[order]).all()
    assert scored < len(q) * 8


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.1 * (i % 7), -0.3, 0.2 * (i % 3)]) for i in range(130)]
    rows += [(200, None), (250, [None, 1.0, 1.0]), (300, [nan, 1.0, 1.0]), (350, [inf, 1.0, 1.0]), (400, [1.0]), (450, []), (None, [1.0, 1.0, 1.0]), (0, [0.5, 0.5, 0.5]), (100, [0.1 * (100 % 7), -0.3, 0.2 * (100 % 3)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.select(df.vec_id.alias("id"), quantized(df.embedding).alias("vector"))
    got = [(r.query_id, r["rank"], r.id, r.score) for r in exact_top_k(v, v.where("id % 50 = 0")).collect()]
    fine = [(i, [np.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    want = []
    for n, (i, a) in enumerate(fine):
        if i % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(a, b, strict=False)), k) for m, (k, b) in enumerate(fine) if m != n)
            want += [(i, r + 1, k, int(-s)) for r, (s, k) in enumerate(scored[:5])]
    assert sorted(got) == sorted(want) and sum(x[0] == 0 for x in got) == 10
    assert exact_top_k(v.limit(0), v).collect() == [] and exact_top_k(v, v.limit(0)).collect() == []


def test_empty_vectors_and_clashing_names(spark):
    df = spark.createDataFrame([(50, [], 1, "x"), (51, [], 2, "y"), (100, [], 3, "z")], "id long, vector array<double>, score long, rank string")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in exact_top_k(df, df.where("id % 50 = 0")).collect())
    assert got == [(50, 1, 51, 0), (50, 2, 100, 0), (100, 1, 50, 0), (100, 2, 51, 0)]


def test_scores_of_the_first_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 20)
    monkeypatch.setattr(topk, "FIRST", 4)
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(700, 6)) * 40)
    x[300:320] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in exact_top_k(df, df.where("id % 50 = 0")).collect())
    want = []
    for i in range(0, 700, 50):
        s = sorted((-int(x[i] @ x[j]), j) for j in range(700) if j != i)[:5]
        want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    assert got == sorted(want)


def test_copied_queries_are_not_broadcast(spark, monkeypatch):
    """However small their file is; and there are as many copies as cores ask for, not as there are shards."""
    for name, n in (("SHARD", 4), ("CHUNK", 8), ("TURNS", 1)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (200, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = exact_top_k(df, df.where("id % 10 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "SortMergeJoin [bucket" in plan and f"sequence(0, {spark.sparkContext.defaultParallelism - 1}" in found._jdf.queryExecution().analyzed().toString().replace("cast(0 as bigint)", "0").replace(f"cast({spark.sparkContext.defaultParallelism - 1} as bigint)", str(spark.sparkContext.defaultParallelism - 1))
    got = {(r.query_id, r.rank): (r.id, r.score) for r in found.collect()}
    for q in range(0, 200, 10):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(200) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
