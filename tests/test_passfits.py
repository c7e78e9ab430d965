"""Fits by passes over listed rows equal one fit of each model's own rows."""
import numpy as np

from sieve.operators import models as md
from sieve.operators import passfits as pf
from sieve.operators import split as sp


def rows_of(rng, n=160, d=6):
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 50
    x[:, 2] = 0.5                                  # a constant column
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 50).astype(int)
    return x, y


def test_listed_fits_equal_single_fits(spark, monkeypatch):
    """Weights, a C grid, several tasks and slices, rows without label or vector, a model without rows."""
    monkeypatch.setattr(pf, "SLICE_NUMBERS", 600)
    monkeypatch.setattr(pf, "TASK_FLOPS", 20_000)
    rng = np.random.default_rng(4)
    x, y = rows_of(rng)
    w = rng.integers(0, 3, size=(len(x), 3))
    data = [(v.tolist(), int(t), [0, 1, 2], [float(q) for q in row]) for v, t, row in zip(x, y, w, strict=True)]
    data += [(None, 1, [0], [1.0]), (x[0].tolist(), None, [1], [1.0]), ([None] * 6, 0, [2], [1.0])]
    df = spark.createDataFrame(data, "embedding array<double>, y int, slots array<int>, ws array<double>")
    grid = [(3, 0.01), (7, 0.5)]
    got = {(r["slot"], r["grid_pos"]): r for r in pf.fit_listed(df, 4, weights="ws", c_grid=grid).collect()}
    assert set(got) == {(s, pos) for s in range(3) for pos, _ in grid}
    for (s, pos), r in got.items():
        own = w[:, s] > 0
        u, b, k = md.linear_pipeline_fit(x[own], y[own].astype(float), w[own, s].astype(float), dict(grid)[pos])
        assert (r["k"], r["n"]) == (k, w[:, s].sum())
        assert np.allclose(x @ np.array(r["u"]) + r["b"], x @ u + b, atol=1e-7)


def test_out_of_fold_rows_travel_once(spark, monkeypatch):
    """oof_fit and lr_sweep fit without a group that holds a model's rows, and without a copy of a row for each model."""
    from sieve.plans import catalog as cat
    monkeypatch.setattr(md, "fit_linear_many", lambda *a, **k: (_ for _ in ()).throw(AssertionError("rows copied for each model")))
    rng = np.random.default_rng(5)
    x, y = rows_of(rng, 90)
    ids = [None, 7, 7, *range(100, 187)]           # ids may repeat or be null
    v = spark.createDataFrame([(i, a.tolist(), int(b)) for i, a, b in zip(ids, x, y, strict=True)], "record_id long, embedding array<double>, y int")
    monkeypatch.setattr(cat.ad, "vectors", lambda spark, sf_dir: v)
    lists = sp.fold_lists(v, sp.repeated_kfold, "repeat").collect()
    assert len(lists) == 90 and all(sorted(f["repeat"] for f in r["folds"]) == list(range(10)) for r in lists)
    got = {r["record_id"]: r for r in cat.oof_fit(spark, "-").collect()}
    assert set(got) == set(ids)
    a = sp.repeated_kfold(v).filter("record_id > 7").select("repeat", "fold", "record_id").toPandas()
    unique = {i: (p, q) for i, p, q in zip(ids, x, y, strict=True) if i is not None and i > 7}
    one = next(iter(unique))
    # a record's scores come from the fits of the folds it isn't in
    folds = a[a.record_id == one].set_index("repeat")["fold"]
    assert len(folds) == 10
    ps = []
    for r in range(10):
        train = [(row["embedding"], row["y"]) for row in lists if next(f["fold"] for f in row["folds"] if f["repeat"] == r) != folds[r]]
        u, b, _ = md.linear_pipeline_fit(np.array([t[0] for t in train]), np.array([t[1] for t in train], float), np.ones(len(train)), md.BEST_C)
        ps.append(1 / (1 + np.exp(-(unique[one][0] @ u + b))))
    assert abs(got[one]["p_oof_mean"] - np.mean(ps)) < 1e-7 and abs(got[one]["p_oof_sd"] - np.std(ps)) < 1e-7
