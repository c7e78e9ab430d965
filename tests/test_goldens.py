"""Closed-form goldens (FIXTURES.md section 3) and cleaning cases (section 4)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.functions import text as tx
from sieve.functions.numeric import count_le, round_half_even
from sieve.operators import metrics as mt
from sieve.operators import selection as sel
from sieve.operators import split as sp
from sieve.operators import thresholds as th


def test_threshold_grid_is_linspace():
    assert np.array_equal(np.array(th.threshold_grid()), np.linspace(0.05, 0.95, 91))


def test_holdout_quotas_g4():
    assert sp.quota_table(183, {0: 101, 1: 82}) == {0: 20, 1: 17}


def test_holdout_and_folds_on_183_rows(spark):
    rows = [(i, 1 if i < 82 else 0) for i in range(183)]
    df = spark.createDataFrame(rows, "record_id long, y int")
    h = sp.stratified_holdout(df).groupBy("split", "y").count().collect()
    got = {(r["split"], r["y"]): r["count"] for r in h}
    assert got[("test", 1)] == 17 and got[("test", 0)] == 20
    f = sp.stratified_kfold(df, k=3, seeds=[42])
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [61, 61, 61]
    per = f.groupBy("fold", "y").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in per if r["y"] == y]
        assert max(c) - min(c) <= 1
    # each record in exactly one fold per seed
    assert f.groupBy("seed", "record_id").count().filter("count != 1").count() == 0


def test_auc_ap_g6(spark):
    p = [.9, .8, .8, .7, .6, .6, .5, .4, .3, .2]
    y = [1, 1, 0, 1, 0, 1, 0, 0, 1, 0]
    df = spark.createDataFrame(list(zip(p, y)), "p double, y int").withColumn("g", F.lit(1))
    auc = mt.roc_auc(df, ["g"]).first()["auc"]
    ap = mt.average_precision(df, ["g"]).first()["ap"]
    assert abs(auc - 0.72) < 1e-12
    assert abs(ap - 0.727778) < 1e-6


def test_prior_brier_g5(spark):
    df = spark.createDataFrame([(1 if i < 82 else 0, 0.5) for i in range(183)], "y int, p double")
    r = mt.prob_metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert abs(r["brier_prior"] - 0.24730508525) < 1e-10


def test_half_even_g7(spark):
    vals = [(.0005, 0.0), (.0015, .002), (.0025, .002), (.1235, .124), (.2675, .268), (1.0005, 1.0)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 3)).collect()]
    assert got == [e for _, e in vals]


G1_M = [.406, .394, .352, .414, .538, .409, .345, .458, .588, .387, .215]
G1_V = [.765, .687, .376, .437]


def test_threshold_sensitivity_g1(spark):
    df = spark.createDataFrame([(f"m{i+1}", p) for i, p in enumerate(G1_M)], "name string, p double")
    calls = {round(r["threshold"], 2): (r["n_calls"], r["n_flips"]) for r in th.flips(df).collect()}
    want = {.30: (10, 3), .35: (9, 2), .36: (8, 1), .39: (7, 0), .40: (6, 1), .41: (4, 3), .42: (3, 4), .46: (2, 5)}
    for t, v in want.items():
        assert calls[t] == v, (t, calls[t], v)
    both = spark.createDataFrame([(f"v{i+1}", p) for i, p in enumerate(G1_V)] +
                                 [(f"m{i+1}", p) for i, p in enumerate(G1_M)], "name string, p double")
    stable = sorted(r["name"] for r in th.stable_calls(both).collect())
    assert stable == sorted(["v1", "v2", "m5", "m8", "m9", "m11"])


def test_selection_summary_g2(spark):
    f1 = [.7805128205, .7961578442, .7908589440, .7879365079, .7802914261]
    t = [.38, .39, .44, .30, .43]
    rows = [("e", "Logistic Regression", s, f, tt, "A" if i != 3 else "B")
            for i, (s, f, tt) in enumerate(zip(sp.CV_SEEDS, f1, t))]
    best = spark.createDataFrame(rows, "encoder string, family string, seed int, cv_f1 double, "
                                       "opt_threshold double, params string")
    s = sel.summary(best).first()
    assert abs(s["cv_f1_mean"] - .7871515086) < 1e-9
    assert abs(s["cv_f1_std"] - .0068302323) < 1e-9
    assert abs(s["opt_threshold_mean"] - .388) < 1e-12
    assert sel.winner(sel.summary(best), best).first()["modal_params"] == "A"


def test_confusion_g3(spark):
    rows = [(1, .9)] * 13 + [(0, .9)] * 5 + [(1, .1)] * 4 + [(0, .1)] * 15
    df = spark.createDataFrame(rows, "y int, p double").withColumn("g", F.lit(1))
    r = mt.confusion(df, ["g"], 0.39).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (13, 5, 4, 15)
    assert abs(r["accuracy"] - 28 / 37) < 1e-12 and abs(r["f1"] - 26 / 35) < 1e-12
    assert abs(r["precision"] - 13 / 18) < 1e-12 and abs(r["recall"] - 13 / 17) < 1e-12


def test_best_threshold_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        n = int(rng.integers(5, 40))
        p = np.round(rng.random(n), 2)            # many scores exactly on grid points
        y = (rng.random(n) < (0.3 if g % 7 else 0.0)).astype(int)     # some all-negative groups
        rows += [(g, float(a), int(b)) for a, b in zip(p, y)]
    df = spark.createDataFrame(rows, "g int, p double, y int")
    got = {r["g"]: (r["threshold"], r["f1"]) for r in th.best_threshold(df, ["g"]).collect()}
    grid = np.linspace(0.05, 0.95, 91)
    for g in range(30):
        p = np.array([a for gg, a, _ in rows if gg == g])
        y = np.array([b for gg, _, b in rows if gg == g])
        best_f, best_t = 0, 0.5
        for t in grid:
            pr = (p >= t).astype(int)
            tp, fp, fn = int((pr & y).sum()), int((pr & (1 - y)).sum()), int(((1 - pr) & y).sum())
            f = 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
            if f > best_f:
                best_f, best_t = f, t
        assert got[g][0] == pytest.approx(best_t, abs=0) and got[g][1] == pytest.approx(best_f, abs=1e-12)


CLEAN = [
    ("  Foo (bar) baz 12 ", "name", "Foo baz"),
    (" A  b٣\n", "name", "A b"),
    ("(a)(b", "name", "(b"),
    ("IC50: 3 CLASSE 2)", "tag", "IC50: 3"),
]


@pytest.mark.parametrize("raw,rule,want", CLEAN)
def test_cleaning_cases(spark, raw, rule, want):
    df = spark.createDataFrame([(raw,)], "c string")
    fn = tx.clean_name if rule == "name" else tx.clean_tag
    assert df.select(fn("c")).first()[0] == want


def test_missing_tokens(spark):
    df = spark.createDataFrame([(None,), ("ND",), ("",), ("nd",), (" ND",), ("  ",), ("ND (classe 3)",)], "c string")
    got = [r[0] for r in df.select(tx.normalize_missing("c")).collect()]
    assert got == ["Unknown", "Unknown", "Unknown", "nd", " ND", "  ", "ND (classe 3)"]
    # missing rule first, then tag stripping: the literal 'ND' survives
    assert df.select(tx.clean_tag(tx.normalize_missing("c"))).collect()[-1][0] == "ND"


def test_count_le(spark):
    edges = [0.1, 0.2, 0.2, 0.5]
    df = spark.createDataFrame([(v,) for v in [0.0, 0.1, 0.2, 0.3, 0.5, 0.9]], "v double")
    got = [r[0] for r in df.select(count_le(edges, "v")).collect()]
    assert got == [0, 1, 3, 3, 4, 4]
    assert math.isclose(sum(got), 15)


def test_labels_from_sheet_text(spark):
    """Label cells read as text ('1.0', '0') become 1 / 0; unlabelled rows go."""
    from sieve.operators import clean as cl
    df = spark.createDataFrame([("a", "1.0"), ("b", "0"), ("c", None)], "name string, target string")
    assert [tuple(r) for r in cl.labelled(df).orderBy("name").collect()] == [("a", 1), ("b", 0)]
