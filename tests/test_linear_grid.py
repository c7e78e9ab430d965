"""Closed-form model selection: settings fitted by class moments."""
import json

import numpy as np

from sieve.operators import linear_grid as lg
from sieve.operators.selection import grid_rows
from sieve.operators.split import stratified_kfold


def data(spark, n=60, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal((i % 3 == 0) * 0.8, 1, dim).tolist(), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, embedding array<double>, y int").repartition(3), rows


def encoded(x, encoder):
    x = np.array(x)
    x = {"domain": x, "general": np.sign(x), "half": np.where(np.arange(len(x)) < len(x) / 2, x, 0)}[encoder]
    return x / np.linalg.norm(x) if np.linalg.norm(x) else x


def brute(train, family, params):
    x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train])
    c1, c0, m = x[y == 1].mean(0), x[y == 0].mean(0), x.mean(0)
    scale, prior = params["scale"], params.get("prior", 0) * np.log((y == 1).sum() / (y == 0).sum())
    if family == "Centroid cosine":
        h = params["shrink"]
        e1, e0 = (1 - h) * c1 + h * m, (1 - h) * c0 + h * m
        return scale * (e1 / np.linalg.norm(e1) - e0 / np.linalg.norm(e0)), 0.0
    w = np.ones(x.shape[1])
    if family == "Diagonal discriminant":
        v = np.where(y[:, None] == 1, (x - c1) ** 2, (x - c0) ** 2).mean(0)
        d = v + params["reg"] * v.mean()
        w = np.divide(1, d, out=np.zeros_like(d), where=d > 1e-15)
    return scale * (c1 - c0) * w, prior - scale * 0.5 * ((c1**2 - c0**2) * w).sum()


def test_every_setting_equals_its_own_fit(spark):
    df, rows = data(spark)
    got = {(r.encoder, r.family, r.seed, r.grid_pos, r.record_id): r.p for r in lg.sweep_scores(df, seeds=(1, 2), k=3).collect()}
    folds = {(r.seed, r.record_id): r.fold for r in stratified_kfold(df.select("record_id", "y"), k=3, seeds=(1, 2)).collect()}
    assert len(got) == len(lg.ENCODINGS) * len(grid_rows(lg.LINEAR_GRIDS)) * 2 * len(rows)
    for encoder in lg.ENCODINGS:
        for seed in (1, 2):
            for fold in range(3):
                train = [(encoded(x, encoder), y) for i, x, y in rows if folds[seed, i] != fold]
                for family, pos, js in grid_rows(lg.LINEAR_GRIDS):
                    u, b = brute(train, family, json.loads(js))
                    for i, x, _ in rows:
                        if folds[seed, i] == fold:
                            want = 1 / (1 + np.exp(-(encoded(x, encoder) @ u + b)))
                            assert abs(got[encoder, family, seed, pos, i] - want) < 1e-8


def test_null_rows_zero_vectors_one_class_and_no_rows(spark):
    schema = "record_id long, embedding array<double>, y int"
    rows = [(i, [float(i + 1), 1.0 + i % 2], i % 2) for i in range(8)] + [(20, None, 1), (21, [1.0, 2.0], None), (22, [0.0, 0.0], 0)]
    got = lg.sweep_scores(spark.createDataFrame(rows, schema), seeds=(1,), k=2).collect()
    assert {r.record_id for r in got if r.p is not None} == {*range(8), 22}
    assert all(0 <= r.p <= 1 for r in got if r.p is not None)
    one = [(i, [1.0, float(i)], 1) for i in range(6)]
    assert lg.sweep_scores(spark.createDataFrame(one, schema), seeds=(1,), k=2).count() == 0
    assert lg.sweep_scores(spark.createDataFrame([], schema), seeds=(1,), k=2).count() == 0


def test_chosen_setting_is_refitted_on_all_rows(spark):
    df, rows = data(spark)
    family, pos, js = [g for g in grid_rows(lg.LINEAR_GRIDS) if g[0] == "Diagonal discriminant"][3]
    chosen = spark.createDataFrame([("general", family, pos, 0.4)], "encoder string, family string, grid_pos int, threshold double")
    u, b = brute([(encoded(x, "general"), y) for _, x, y in rows], family, json.loads(js))
    got = {r.record_id: r for r in lg.refit_chosen(df, df, chosen).collect()}
    assert len(got) == len(rows)
    for i, x, y in rows:
        assert abs(got[i].p - 1 / (1 + np.exp(-(encoded(x, "general") @ u + b)))) < 1e-8 and got[i].threshold == 0.4 and got[i].y == y
