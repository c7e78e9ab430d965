"""Real-fit model-selection sweep: all five families, leak-free hoisted features,
scores read back from the written table and reduced by the selection chain."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import models as md
from sieve.operators import selection as sel
from sieve.operators.split import stratified_kfold
from sieve.operators import sweep
from sieve.operators.sweep import model_sweep, sweep_status

GRID = [
    ("Logistic Regression", 0, json.dumps({"C": 0.1, "penalty": "l2"})),
    ("Logistic Regression", 6, json.dumps({"C": 1, "penalty": "l2"})),
    ("Random Forest", 0, json.dumps({"n_estimators": 10, "max_depth": 3, "min_samples_split": 2,
                                     "min_samples_leaf": 1})),
    ("SVM-RBF", 5, json.dumps({"C": 1, "gamma": "scale"})),
    ("XGBoost", 0, json.dumps({"n_estimators": 5, "max_depth": 2, "learning_rate": 0.3, "subsample": 1.0,
                               "colsample_bytree": 1.0})),
]


def test_sweep_all_families(spark):
    rng = np.random.default_rng(11)
    n, d = 90, 6
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.7 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "record_id long, embedding array<double>, y int")
    scores = model_sweep(df, GRID, seeds=(42,), k=3, parallelism=6)
    rows = scores.collect()
    assert len(rows) == len(GRID) * n                       # every record validated once per setting
    assert {r["family"] for r in rows} == {f for f, _, _ in GRID}
    assert all(0.0 <= r["p"] <= 1.0 for r in rows)

    # leak-free: LR (C=1) on fold 0 equals a numpy fit on that fold's training rows only
    folds = {r["record_id"]: r["fold"] for r in stratified_kfold(df, seeds=(42,), k=3).collect()}
    tr = np.array([folds[i] != 0 for i in range(n)])
    u, b, _ = md.linear_pipeline_fit(x[tr], y[tr].astype(float), np.ones(tr.sum()), 1.0)
    want = 1 / (1 + np.exp(-(x @ u + b)))
    got = {r["record_id"]: r["p"] for r in rows
           if r["family"] == "Logistic Regression" and r["grid_pos"] == 6 and r["fold"] == 0}
    assert set(got) == {i for i in range(n) if not tr[i]}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4

    best = sel.best_settings(sel.setting_means(sel.fold_thresholds(scores), k=3),
                             spark.createDataFrame(GRID, "family string, grid_pos int, params string"))
    assert best.count() == 4                                # one best setting per family and seed
    win = sel.winner(sel.summary(best), best).collect()
    assert len(win) == 1 and win[0]["cv_f1_mean"] > 0.7     # separable data


def test_sweep_status_and_errors(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), float(-i % 7)], int(i > 9)) for i in range(20)],
                               "record_id long, embedding array<double>, y int")
    bad = ("Logistic Regression", 1, json.dumps({"C": -1, "penalty": "l2"}))
    scores = model_sweep(df, [GRID[0], bad], seeds=(42,), k=2, out_dir=str(tmp_path / "a"))
    assert {r["grid_pos"] for r in scores.collect()} == {0}
    status = {(r["grid_pos"], r["fold"]): r for r in sweep_status(spark, str(tmp_path / "a")).collect()}
    assert set(status) == {(p, f) for p in (0, 1) for f in (0, 1)}
    assert all(r["fitted"] == (p == 0) and bool(r["message"]) == (p == 1) for (p, _), r in status.items())
    assert model_sweep(df, [bad], seeds=(42,), k=2, out_dir=str(tmp_path / "b")).count() == 0

    def lost(*_):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(sweep, "_fit_scores", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        model_sweep(df, [GRID[0]], seeds=(42,), k=2, out_dir=str(tmp_path / "c"))


def test_restarted_sweep_goes_on(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), float(-i % 7)], int(i > 9)) for i in range(20)],
                               "record_id long, embedding array<double>, y int")
    grid, out, made = [GRID[0], GRID[1]], str(tmp_path / "s"), []
    fit = sweep._fit_scores

    def counted(family, params, *rest):
        made.append(params["C"])
        if len(made) == 3 and params["C"] == 1:
            raise RuntimeError("driver lost")
        return fit(family, params, *rest)
    monkeypatch.setattr(sweep, "_fit_scores", counted)
    with pytest.raises(RuntimeError, match="driver lost"):
        model_sweep(df, [GRID[1], GRID[1], GRID[1]], seeds=(42,), k=2, out_dir=out, parallelism=1)
    before = len(made)
    scores = model_sweep(df, grid, seeds=(42,), k=2, out_dir=out, parallelism=1)
    assert len(made) > before and scores.count() == 2 * 20
    again = len(made)
    same = model_sweep(df, grid, seeds=(42,), k=2, out_dir=out)
    assert len(made) == again                               # a second run fits nothing
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, scores.collect()))
    assert model_sweep(df, [GRID[0]], seeds=(42,), k=2, out_dir=out).count() == 20 and len(made) == again
    with pytest.raises(ValueError, match="other rows"):
        model_sweep(df.filter("record_id > 0"), grid, seeds=(42,), k=2, out_dir=out)


def test_forest_split_size_folds_into_the_leaves(spark):
    def leaf(split, leaf):
        est = md.classifier("Random Forest", {"n_estimators": 5, "max_depth": None, "min_samples_split": split,
                                              "min_samples_leaf": leaf}, 100)
        return est.getMinInstancesPerNode()
    assert [leaf(s, m) for s in (2, 5, 10) for m in (1, 2, 4)] == [1, 2, 4, 3, 3, 4, 5, 5, 5]
