"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from tessera.llm import ann


def brute(rows, ids, k):
    keys = sorted(rows)
    m = np.array([rows[i] for i in keys])
    out = {}
    for q in ids:
        scores = ann.exact_cosine(np.array(rows[q]), m)
        order = sorted((-s, i) for s, i in zip(scores.tolist(), keys) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


@pytest.mark.parametrize("dims", [64, 7])
def test_recall(spark, dims, monkeypatch):
    rng = np.random.RandomState(1)
    centres = rng.randn(20, dims)
    rows = {i: (centres[i % 20] + rng.randn(dims) * 0.7).tolist() for i in range(3000)}
    rows[200] = rows[100] = rows[50]
    for i in range(1500, 2000):
        rows[i] = rows[1500]
    monkeypatch.setattr(ann, "CODES_PER_BLOCK", 40)
    monkeypatch.setattr(ann, "CODES_PER_GROUP", 700)
    monkeypatch.setattr(ann, "QUERIES_PER_GROUP", (20, 20))
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows.items()], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(frame, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, range(0, 3000, 50), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert got[50][:2] == [100, 200]
    assert got[1600] == want[1600] == [1500, 1501, 1502, 1503, 1504]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 2.0]), (8, [-1.0, 0.0]), (9, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(frame, lambda i: i == 0).orderBy("rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 9), (0, 4, 8)]
    assert ann.search(frame.limit(0), lambda i: i == 0).collect() == []
    assert ann.search(frame, lambda i: i == 77).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 3)) for r in ann.search(frame, lambda i: i == 0, k=2).collect())
    assert got == [(1, 1, 0.995), (1, 1, 0.995), (2, 1, 0.1), (2, 1, 0.1)]


def test_recall_of_the_supplied_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    want = brute(rows, [i for i in rows if i % 50 == 0], 5)
    got = ann.search(frame, lambda i: i % 50 == 0).collect()
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("kind", ["tight clusters", "one cone", "far from the sample"])
def test_none_of_the_nearest_is_missed_where_codes_tell_little(spark, kind, monkeypatch):
    rng = np.random.RandomState(5)
    dims, n = 32, 4000
    if kind == "tight clusters":  # members lie closer than codes can tell
        made = rng.randn(8, dims)[np.arange(n) % 8] + rng.randn(n, dims) * 1e-3
    elif kind == "one cone":
        made = np.full(dims, 5.0) + rng.randn(n, dims) * 0.02
    else:  # the codebook knows nothing of most rows
        monkeypatch.setattr(ann, "SAMPLE", 20)
        made = np.where(np.arange(n)[:, None] % 50 == 1, rng.randn(n, dims), rng.randn(4, dims)[np.arange(n) % 4] * 1e200 + rng.randn(n, dims) * 1e198)
    rows = {i: v.tolist() for i, v in enumerate(made)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, range(0, n, 50), 5)
