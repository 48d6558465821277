import math

import numpy as np
import pyarrow as pa

from tessera.llm import additive_ann


def test_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in additive_ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, near in got.items():
        exact = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(3000), -exact)) if i != q][:20]
        hits += len(set(want) & {v for v, _ in near.values()})
        assert sorted(near) == list(range(1, 21)) and all(math.isclose(s, exact[v], rel_tol=1e-12) for v, s in near.values())
        scores = [near[k][1] for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
    assert hits / (20 * len(got)) >= 0.9


def test_recall_of_a_short_list(spark):
    """50,000 rows, of which a query's list is less than a hundredth."""
    n, rng = 50_000, np.random.default_rng(11)
    x = rng.normal(size=(n, 48)).astype(np.float32)
    x[n // 2 :] = x[: n // 2] * 0.7 + rng.normal(size=(n // 2, 48)).astype(np.float32) * 0.7
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    got = additive_ann.nearest(df, every=500, shortlist=400).toPandas()
    wide, hits = x.astype(np.float64), 0
    for q, near in got.groupby("query_id"):
        score = wide @ wide[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(near["vec_id"]))
    assert len(got) == 20 * n // 500 and hits / len(got) >= 0.9


def test_blocks_and_distances(spark):
    x = np.random.default_rng(7).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = additive_ann.usable(df).cache()
    asked = rows.where("id % 20 = 0")
    one = {(r.query_id, r.rank): r.vec_id for r in additive_ann.search(rows, asked, 5, measure="l2").collect()}
    many = {(r.query_id, r.rank): r.vec_id for r in additive_ann.search(rows, asked, 5, query_block=7, row_block=50, measure="l2").collect()}
    assert one == many
    far = ((x - x[20]) ** 2).sum(1)
    assert one[20, 1] == [i for i in np.argsort(far) if i != 20][0]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [None, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 2.0, 3.0]), (40, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in additive_ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 1.0), (0, 4, None, 1.0), (20, 1, 0, 1.0), (20, 2, 8, 1.0), (20, 3, 9, 1.0), (20, 4, None, 1.0), (40, 1, 7, 1.0)]
    assert additive_ann.nearest(df.where("1 = 0")).count() == 0


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in additive_ann.nearest(df).collect())
    one = [(20, 1, 20, 1.0), (20, 2, 1, 0.5), (20, 3, 20, 0.0)]
    assert got == sorted([*one, *one, (20, 1, 1, 0.5), (20, 2, 20, 0.0), (20, 3, 20, 0.0)])


def test_decoded_norms():
    x = np.random.default_rng(8).normal(size=(50, 6)).astype(np.float32)
    books = additive_ann.Codebooks(np.random.default_rng(9).normal(size=(3, 16, 6)).astype(np.float32))
    codes, norms = additive_ann.encode(books, x)
    decoded = sum(books.words[m][codes[:, m]] for m in range(3))
    assert np.allclose((decoded**2).sum(1), norms, atol=1e-4)


def test_copies_give_their_smallest_ids_and_leave_room_for_others(spark):
    rng = np.random.default_rng(10)
    hot, x = rng.normal(size=16), rng.normal(size=(600, 16))
    x[:25] = hot * np.linspace(0.9, 1.1, 25)[:, None]
    vectors = {i: hot for i in range(10_000, 12_500)} | {20 * i: v for i, v in enumerate(x)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in additive_ann.nearest(df, shortlist=300).where("query_id >= 10000 or query_id = 480").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    ids = np.array(sorted(vectors))
    every = np.array([vectors[i] for i in ids])
    for q, near in got.items():
        exact = (every * vectors[q]).sum(1)
        want = [int(ids[i]) for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
        assert [near[k] for k in range(1, 21)] == want
    assert len(got) > 100
