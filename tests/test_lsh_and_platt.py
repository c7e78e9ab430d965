"""Recall of the locality-sensitive join; Platt scaling on inner folds."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import lsh, models
from tests.test_pruned import as_rows, brute, clustered, table


def test_collision_probability_by_simulation():
    rng = np.random.default_rng(0)
    for distance, width in ((0.5, 1.0), (1.0, 0.4), (0.2, 3.0)):
        x = rng.normal(size=(200_000,)) * distance
        start = rng.uniform(0, width, 200_000)
        same = np.floor((start + x) / width) == 0
        assert abs(same.mean() - lsh.collision(distance, width)) < 0.01
    assert lsh.collision(0, 1) == 1 and lsh.bucket_width(0.5, 0.95) > lsh.bucket_width(0.1, 0.95)


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_of_the_three_nearest(spark, kind):
    refs, rng, c = clustered(5)
    q = c[rng.integers(0, len(c), 250)] + 0.1 * rng.normal(size=(250, 24))
    if kind == "noise":
        q, refs = rng.normal(size=(250, 10)), rng.normal(size=(1500, 10))
    got = as_rows(lsh.approx_topk(table(spark, q), table(spark, refs)))
    want = brute(q, refs, 3, 12)
    assert set(got) == set(want)
    hit = {}
    for (i, _), (j, _) in got.items():
        hit.setdefault(i, set()).add(j)
    assert sum(j in hit[i] for (i, _), (j, _) in want.items()) / len(want) >= 0.95
    assert all(abs(v - np.dot(q[i], refs[j]) / np.linalg.norm(q[i]) / np.linalg.norm(refs[j])) < 1e-6 for (i, _), (j, v) in got.items())


def test_copies_zero_vectors_and_nulls(spark):
    refs, rng, c = clustered(6, groups=8, each=30)
    refs = np.vstack([refs, np.repeat(refs[:1], 120, axis=0), np.zeros((2, 24))])
    q = np.vstack([refs[:1], refs[:1] * 2, refs[30:50], np.zeros((1, 24))])
    odd = spark.createDataFrame([(None, [1.0] * 24), (900, None)], "record_id long, embedding array<double>")
    got = as_rows(lsh.approx_topk(table(spark, q).unionByName(odd), table(spark, refs).unionByName(odd)))
    assert {i for i, _ in got} == set(range(len(q))) and len(got) == 3 * len(q)
    assert [got[0, n][0] for n in (1, 2, 3)] == [got[1, n][0] for n in (1, 2, 3)] == [0, 240, 241]
    assert [got[len(q) - 1, n] for n in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert lsh.approx_topk(table(spark, q).limit(0), table(spark, refs)).collect() == []
    assert lsh.approx_topk(table(spark, q), table(spark, refs).limit(0)).collect() == []


def mean_direction(rows):
    """A quick linear scorer: difference of the class means."""
    mu = {r.y: np.array(r.m) for r in rows.groupBy("y").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(20)]).alias("m")).collect()}
    return mu.get(1, 0) - mu.get(0, 0)


def scored(u, rows):
    return rows.select("record_id", "y", sum((F.col("embedding")[i] * float(v) for i, v in enumerate(u)), F.lit(0.0)).alias("p"))


def test_inner_margins_come_from_models_that_did_not_see_the_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(0.25 * (i % 2), 1, 20)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, embedding array<double>, y int")
    seen = []

    def fit(part):
        own = {r.record_id for r in part.collect()}
        seen.append(own)
        return mean_direction(part), own

    def score(model, part):
        assert not model[1] & {r.record_id for r in part.collect()}
        return scored(model[0], part)

    inner = models.inner_margins(df, fit, score)
    assert sorted(r.record_id for r in inner.collect()) == list(range(60)) and len(seen) == 5 and all(len(s) == 48 for s in seen)
    # margins of the training rows flatter the fit: the inner ones give a better curve for new rows
    fresh = spark.createDataFrame([(i, [float(v) for v in rng.normal(0.25 * (i % 2), 1, 20)], i % 2) for i in range(2000)], "record_id long, embedding array<double>, y int")
    u = mean_direction(df)

    def loss(cal):
        q = cal(F.col("p"))
        return scored(u, fresh).agg(F.avg(-F.log(F.when(F.col("y") == 1, q).otherwise(1 - q)))).first()[0]

    assert loss(models.platt(inner)) < loss(models.platt(scored(u, df)))


def test_inner_margins_with_few_rows_of_a_class(spark):
    rows = [(i, [float(i)] * 20, int(i == 0)) for i in range(7)]
    df = spark.createDataFrame(rows, "record_id long, embedding array<double>, y int")
    assert models.inner_margins(df, mean_direction, scored).count() == 7
    two = spark.createDataFrame([(i, [float(i)] * 20, int(i < 2)) for i in range(7)], "record_id long, embedding array<double>, y int")
    assert models.inner_margins(two, mean_direction, scored).count() == 7


def test_a_bucket_in_cells_gives_the_best_of_all_its_pairs(spark, monkeypatch):
    """One bucket holds everything; its cells are small, and only the best of each go on."""
    rng = np.random.default_rng(8)
    q, refs = rng.normal(size=(60, 6)), rng.normal(size=(300, 6))
    q, refs = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, refs))
    rows = lambda x: [(i, [float(a) for a in v], [i + 1000 * j for j in range(1 + i % 2)]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows(q), "id long, v array<double>, ids array<long>").withColumn("key", F.col("id") + 7)

    class OneBucket:
        def transform(self, d):
            from pyspark.ml.functions import array_to_vector
            return d.withColumn("h", F.array(*[array_to_vector(F.array(F.lit(3.0))) for _ in range(2)]))

    monkeypatch.setattr(lsh, "SIDE", 50)
    r = spark.createDataFrame(rows(refs), "id long, v array<double>, ids array<long>").withColumn("key", F.col("id") + 7)
    got = lsh.bucket_join(frame.select("id", "v", F.lit(0).alias("f")), r.withColumn("f", F.lit(0)), OneBucket(), 3, 1.0).collect()
    assert len(got) <= 2 * 6 * 60 * 3  # two tables, six cells along the references
    want = {(i, int(j)) for i, row in enumerate(q @ refs.T) for j in np.argsort(-row)[:3] if row[j] > 0.5}
    best = {}
    for x in got:
        assert x["ids"][0] == x["key"] - 7 and x["cosine"] == pytest.approx(float(q[x["head"]] @ refs[x["key"] - 7]), abs=1e-12)
        best.setdefault(x["head"], {})[x["key"] - 7] = x["cosine"]
    assert {(i, j) for i, own in best.items() for j in sorted(own, key=own.get)[-3:]} == want
