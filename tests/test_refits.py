"""Refits by moments, calibration fits of all repeats together."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import calibrate, moments, resample
from sieve.operators.split import repeated_kfold


def vectors(spark, n=90, dim=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(i % 3 == 0, 1, dim)], int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, embedding array<double>, y int").repartition(3), rows


def direction(rows, weight):
    """The scorer of one weighting, row by row."""
    c = []
    for k in (1, 0):
        own = [(weight.get(i, 0), np.array(x)) for i, x, y in rows if y == k]
        c.append(sum(w * x for w, x in own) / sum(w for w, _ in own))
    return moments.SCORE_SCALE * (c[0] / np.linalg.norm(c[0]) - c[1] / np.linalg.norm(c[1]))


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_replicate_scorers_equal_fits_one_by_one(spark, mode):
    df, rows = vectors(spark)
    n = 12
    gen = resample.bootstrap if mode == "exact" else resample.bootstrap_poisson
    draws = {}
    for r in gen(df.select("record_id", "y"), n).collect():
        draws.setdefault(r.replicate, {})[r.record_id] = r.draws
    got = {r.group: r.u for r in moments.bootstrap_scorers(df, n, mode).collect()}
    assert sorted(got) == list(range(n))
    for g, u in got.items():
        assert np.allclose(u, direction(rows, draws[g]), atol=1e-12)


def test_fold_scorers_leave_their_fold_out(spark):
    df, rows = vectors(spark)
    folds = repeated_kfold(df.select("record_id", "y"), k=4, repeats=3)
    member = {(r.repeat, r.record_id): r.fold for r in folds.collect()}
    got = {r.group: r.u for r in moments.fold_scorers(df, folds, 3, 4, "repeat").collect()}
    assert sorted(got) == list(range(12))
    for g, u in got.items():
        assert np.allclose(u, direction(rows, {i: float(member[g // 4, i] != g % 4) for i, _, _ in rows}), atol=1e-10)


def test_scorers_without_a_class_and_with_null_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (3, None, 1), (4, [1.0, 1.0], None), (5, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "record_id long, embedding array<double>, y int")
    weights = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 2, 1.0), (2, 5, 1.0), (2, 2, 1.0), (0, 3, 5.0), (0, 4, 5.0)], "group int, record_id long, weight double")
    own = df.join(moments.weight_lists(weights), "record_id")
    got = {r.group: r.u for r in moments.models(moments.class_sums(own, 3)).collect()}
    s = moments.SCORE_SCALE
    assert got == {0: [s, -s], 1: None, 2: [0.0, -s]}
    scores = moments.refit_scores(moments.models(moments.class_sums(own, 3)), spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 0.0]), (0, [0.0, 0.0])], "group int, embedding array<double>"), 3)
    assert sorted((r.group, r.p) for r in scores.collect() if r.group == 0) == [(0, 0.5), (0, round(1 / (1 + np.exp(-s)), 9))]
    assert [r.p for r in scores.collect() if r.group == 1] == [None]


def test_class_sums_spread_over_tasks(spark):
    """The same sums from any number of partitions, and no row copied per weighting."""
    df, _ = vectors(spark, 300, 3)
    lists = moments.poisson_lists(df, 40)
    one, many = ({(r.group, r.y): (r.n, tuple(np.round(r.s, 9))) for r in moments.class_sums(lists.repartition(k), 40).collect()} for k in (1, 7))
    assert one == many and len(one) == 80
    assert "Generate" not in lists._jdf.queryExecution().executedPlan().toString()


def test_calibration_equals_newton_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(p), int(rng.random() < p ** (1 + k / 3))) for k in range(4) for p in rng.uniform(0.02, 0.98, 200)]
    rows += [(9, 0.3, 1), (9, 0.6, 1), (0, None, 1), (0, 0.4, None)]
    rows += [(7, 0.2, 0), (7, 0.3, 0), (7, 0.7, 1), (7, 0.8, 1)]  # separable: the penalty alone holds the slope
    df = spark.createDataFrame(rows, "repeat int, p double, y int")
    got = {r["repeat"]: r for r in calibrate.calibration_fit(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 7, 9] and got[9].cal_slope is None and not got[9].converged
    for k in range(4):
        p, y = (np.array([r[i] for r in rows if r[0] == k and None not in r], float) for i in (1, 2))
        x = np.log(p / (1 - p))
        q = 1 / (1 + np.exp(-(got[k].cal_slope * x + got[k].cal_intercept)))
        assert got[k].converged and abs(np.sum((q - y) * x) + got[k].cal_slope / calibrate.CAL_C) < 1e-6 and abs(np.sum(q - y)) < 1e-6
    assert calibrate.calibration_fit(df, max_steps=1).filter("converged").count() == 0
    assert calibrate.calibration_fit(df.limit(0)).collect() == []


def test_calibration_fit_is_the_same_however_rows_lie(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("repeat"), ((F.col("id") * 37 % 97 + 1) / 99).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a, b = (sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in calibrate.calibration_fit(df.repartition(k)).collect()) for k in (1, 9))
    assert a == b


def test_rows_without_a_label_are_in_no_split_and_no_fold(spark):
    from sieve.operators.split import stratified_holdout, stratified_kfold

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "record_id long, y int")
    labelled = df.filter("y is not null")
    for split in (stratified_holdout, stratified_kfold):
        assert sorted(split(df).collect()) == sorted(split(labelled).collect())
        assert split(df).filter("y is null").isEmpty() and split(df.filter("y is null")).isEmpty()


def test_listed_scores_equal_the_join_and_copy_no_vector(spark):
    """score_listed: the pairs and scores of the join; vectors aren't copied for each model."""
    from sieve.operators.models import score_linear, score_listed

    models = spark.createDataFrame([(0, [1.0, 2.0], 0.5), (2, [0.0, -1.0], 0.0), (3, None, 0.0)], "slot int, u array<double>, b double")
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0, 1, 2, 3]), (2, [0.5, None], [2]), (3, None, [0, 9]), (4, [3.0, 1.0], [2, 2]), (4, [3.0, 1.0], [0]), (5, [0.0, 0.0], []), (6, [1.0, 1.0], None)],
                                 "record_id long, embedding array<double>, slots array<int>")
    joined = score_linear(models, rows.selectExpr("record_id", "embedding", "explode(slots) slot"), ["slot"], max_models=4)
    listed = score_listed(models, rows, 4)
    key_ = lambda xs: sorted(xs, key=str)
    got = [(r["record_id"], r["slot"], None if r["p"] is None else round(r["p"], 12)) for r in listed.collect()]
    want = [(r["record_id"], r["slot"], None if r["p"] is None else round(r["p"], 12)) for r in joined.collect()]
    assert key_(got) == key_(want) and len(want) == 8
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()


def test_drawn_rows_are_the_hash_of_seed_replicate_and_draw(spark):
    from pyspark.sql import functions as F

    from sieve.functions.numeric import hash_index
    from sieve.operators.resample import drawn_rows

    numbers = spark.range(0, 70, numPartitions=3)
    plan = numbers.mapInArrow(drawn_rows(7, 42, 5), "replicate long, row_idx long")
    want = numbers.select((F.floor(F.col("id") / 7) + 5).alias("replicate"), (F.col("id") % 7).alias("draw"))
    want = want.select("replicate", (hash_index(F.lit(42), F.col("replicate"), F.col("draw")) % 7).alias("row_idx"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, want.collect()))
    assert spark.range(0).mapInArrow(drawn_rows(7, 42, 5), "replicate long, row_idx long").count() == 0
