"""Properties of the metric operators: edge cases, and the same answer whatever
the row order, the shuffle partition count, or the execution path (plain
windows for small groups, bucketed running sums for large ones)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import metrics as mt
from sieve.operators import prefix as px
from sieve.operators import thresholds as th


def test_metric_edge_cases(spark):
    rows = [(1, 0.2, 0), (1, 0.7, 0),            # one class only
            (2, 0.5, 1), (2, 0.5, 0),            # all scores tied
            (3, 0.0, 1), (3, 1.0, 0),            # p in {0, 1}, inverted
            (4, 0.3, 1)]                         # a single positive
    df = spark.createDataFrame(rows, "g int, p double, y int")
    rk = {r["g"]: (r["auc"], r["ap"]) for r in mt.rank_metrics(df, ["g"]).collect()}
    assert rk[1] == (None, None) and rk[4] == (None, 1.0)
    assert rk[2] == (0.5, 0.5) and rk[3] == (0.0, 0.5)
    pm = {r["g"]: r for r in mt.prob_metrics(df, ["g"]).collect()}
    assert all(math.isfinite(r["log_loss"]) for r in pm.values())      # clipped, never infinite
    bt = {r["g"]: (r["threshold"], r["f1"]) for r in th.best_threshold(df, ["g"]).collect()}
    assert bt[1] == (0.5, 0.0) and bt[3] == (0.5, 0.0)                  # no F1 > 0 -> default
    assert bt[4][1] == 1.0


def _table(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(3):
        n = 150 + 60 * g
        p = np.round(rng.random(n), 2)                                 # many ties
        y = (rng.random(n) < 0.2 + 0.6 * p).astype(int)
        rows += [(g, i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "g int, i int, p double, y int")


def _all_metrics(df):
    g = ["g"]
    out = {}
    for r in mt.rank_metrics(df, g).collect():
        out[("rank", r["g"])] = (r["auc"], r["ap"])
    for r in mt.prob_metrics(df, g, f1_at=[(0.39, "f1_t")]).collect():
        out[("prob", r["g"])] = (r["brier"], r["log_loss"], r["f1_t"])
    for r in mt.ece(df, g).collect():
        out[("ece", r["g"])] = (r["ece"],)
    for r in th.best_threshold(df, g).collect():
        out[("thr", r["g"])] = (r["threshold"], r["f1"])
    for r in px.exact_quantiles(df, g, "p", [0.025, 0.5, 0.975]).collect():
        out[("q", r["g"], r["q_idx"])] = (r["value"],)
    return out


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-12, (k, x, y)


@pytest.mark.parametrize("bucketed", [False, True])
def test_metrics_invariant_to_order_and_partitions(spark, monkeypatch, bucketed):
    if bucketed:                                   # every group takes the bucketed path
        monkeypatch.setattr(px, "SMALL_GROUP_ROWS", 0)
    df = _table(spark)
    base = _all_metrics(df)
    shuffled = _all_metrics(df.repartition(7, F.rand(seed=3)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        few = _all_metrics(df)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = _all_metrics(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for other in (shuffled, few, many):
        _close(base, other)


def test_fast_and_bucketed_paths_agree(spark, monkeypatch):
    df = _table(spark, seed=9)
    fast = _all_metrics(df)
    monkeypatch.setattr(px, "SMALL_GROUP_ROWS", 0)
    _close(fast, _all_metrics(df))
