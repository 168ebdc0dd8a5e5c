import math

import numpy as np
import pytest

from skyledger.llm import neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, vec string, dim int, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1, 2) for i, v in rows], VECTORS)


def brute(rows, every=100, k=10):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vec = tuple(float(np.float32(x)) for x in v)
            held[i] = min(vec, held.get(i, vec))
    out = {}
    for q in held:
        if q % every == 0:
            near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(held[q], v))), i) for i, v in held.items() if i != q and len(v) == len(held[q])]
            out[q] = sorted(near)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 24))
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


def test_recall_order_and_scores(spark, rows):
    got, want = found(neighbours.nearest(frame(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    recall = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(recall) >= 0.9
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near)
        for score, i in near:
            assert math.isclose(score, float(np.sqrt(((vec[q] - vec[i]) ** 2).sum())), rel_tol=1e-12)


def test_several_shards_and_query_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 400)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    got, want = found(neighbours.nearest(frame(spark, rows[:2000]), every=50)), brute(rows[:2000], 50)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_whole_share_is_exact_with_ties_and_bad_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-2, 3, 3).tolist()) for i in range(150)] + [(i, [1, 2, 1]) for i in range(200, 260)]
    rows += [(300, None), (400, [0, 0, 0]), (500, [1, None, 2]), (600, [1, math.nan, 2]), (700, [math.inf, 1, 2]), (None, [1, 1, 1]), (800, [])]
    rows += [(900, [1, 2]), (901, [2, 2]), (10, [9, 9, 9]), (10, [9, 9, 9])]
    want = brute(rows, 10)
    got = found(neighbours.nearest(frame(spark, rows), every=10, share=1.0))
    assert got.keys() == {q for q in want if want[q]}
    for q, near in got.items():
        assert [i for _, i in near] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in near], [s for s, _ in want[q]])


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)]
    got = found(neighbours.nearest(frame(spark, rows)))
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[100] == [(0.0, i) for i in range(10)]


def test_few_rows_and_empty_table(spark):
    assert found(neighbours.nearest(frame(spark, [(0, [1, 0]), (5, [0, 1])]))) == {0: [(math.sqrt(2), 5)]}
    assert neighbours.nearest(frame(spark, [(0, [1, 0])])).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1, 0])]).limit(0)).collect() == []
