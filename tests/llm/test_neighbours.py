import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import neighbours


def brute(ids, x, key, k):
    score = x @ x[ids == key][0]
    score[ids == key] = -np.inf
    order = np.lexsort((ids, -score))[: min(k, (ids != key).sum())]
    return ids[order], score[order]


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    ids = rng.permutation(3000)
    out = neighbours.nearest(table(spark, ids, x), F.col("vec_id") % 20 == 0, shard_rows=800).toPandas()
    assert (out.groupby("query_id").size() == 20).all() and out.query_id.nunique() == 150
    hits, x = [], x.astype(np.float64)
    for key, group in out.groupby("query_id"):
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21)) and (np.diff(group.score) <= 0).all()
        expected, _ = brute(ids, x, key, 20)
        hits.append(len(set(expected) & set(group.vec_id)) / 20)
        own = x[ids == key][0]
        assert np.allclose([x[ids == v][0] @ own for v in group.vec_id], group.score, rtol=1e-12)
    assert np.mean(hits) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 4)).astype(np.float32)
    x = np.concatenate([base, np.repeat(base[:1], 60, axis=0)])
    df = table(spark, range(90), x)
    odd = [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 1.0, 1.0]), (1060, [float("nan")] * 4), (1080, [float("inf"), 0.0, 0.0, 0.0]),
           (1100, []), (None, [1.0] * 4), (1120, [5.0, 5.0]), (1140, [1.0, 2.0]), (1121, [1.0, 0.0])]
    df = df.union(spark.createDataFrame(odd, df.schema)).withColumns({"rank": F.lit(1), "id": F.lit("x"), "shard": F.lit(0)})
    out = {}
    for r in neighbours.report(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(out) == {0, 20, 40, 60, 80, 1120, 1140}
    ids, x = np.arange(90), x.astype(np.float64)
    for key in (0, 20, 40, 60, 80):
        expected, score = brute(ids, x, key, 20)
        assert [v for v, _ in out[key]] == expected.tolist() and np.allclose([s for _, s in out[key]], score)
    assert out[1120] == [(1140, 15.0), (1121, 5.0)] and out[1140] == [(1120, 15.0), (1121, 1.0)]


def test_few_rows(spark):
    assert neighbours.report(table(spark, [], np.zeros((0, 3)))).count() == 0
    assert neighbours.report(table(spark, [20], np.ones((1, 3)))).count() == 0
    assert neighbours.report(table(spark, [20, 21], np.ones((2, 3)))).collect()[0].asDict() == {"query_id": 20, "rank": 1, "vec_id": 21, "score": 3.0}
    assert neighbours.report(table(spark, [20, 20], np.ones((2, 3)))).count() == 0


def test_clusters_stay_reachable():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] * 5 + rng.normal(0, 0.1, (2000, 16))
    graph = neighbours.build(x)
    found = neighbours.search(graph, x[::20])
    exact = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, found)]) > 0.95
