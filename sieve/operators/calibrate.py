"""Out-of-fold calibration: per-record summaries, per-repeat metric tables,
calibration slope / intercept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logit
from ..functions.vectors import with_one_row
from . import metrics as mt

# --- fixed values -----------------------------------------------------------
CAL_C = 1e6              # near-unpenalised logistic fit of y on logit(p)
CAL_STEPS = 50
CAL_TOL = 1e-9
# ---------------------------------------------------------------------------


def oof_summary(oof: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Per record: mean and population sd of its out-of-fold score over repeats."""
    return oof.groupBy(id_col).agg(F.first("y").alias("y"), F.avg("p").alias("p_oof_mean"),
                                   F.stddev_pop("p").alias("p_oof_sd"))


def repeat_metrics(oof: DataFrame, t: float) -> DataFrame:
    """One row per repeat: AUC, AP, Brier, log loss, ECE, calibration slope and
    intercept, score range and mean, F1 at ``t`` and at 0.5."""
    g = ["repeat"]
    # three passes over the scores: plain aggregates (with both F1s), running
    # counts over distinct scores (AUC and AP), quantile bins (ECE)
    pm = mt.prob_metrics(oof, g, f1_at=[(t, "f1_t"), (0.5, "f1_05")]) \
        .select("repeat", "brier", "log_loss", "p_min", "p_max", "p_mean", "f1_t", "f1_05")
    slopes = calibration_fit(oof).drop("converged")         # one row per repeat
    return mt.rank_metrics(oof, g).join(pm, g).join(mt.ece(oof, g), g).join(F.broadcast(slopes), g)


METRICS = ["auc", "ap", "brier", "log_loss", "ece", "cal_slope", "cal_intercept", "p_min", "p_max", "p_mean", "f1_t", "f1_05"]


def metric_table(per_repeat: DataFrame, labels: DataFrame, metrics=METRICS) -> DataFrame:
    """Metrics as rows: mean and sample sd over repeats, plus the Brier score of
    the constant class-prior predictor."""
    long = per_repeat.unpivot(["repeat"], list(metrics), "metric", "value")
    s = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    prior = labels.agg((F.avg(F.col("y").cast("double")) * (1 - F.avg(F.col("y").cast("double"))))
                       .alias("brier_class_prior"))
    return with_one_row(s, prior)


def calibration_fit(oof: DataFrame, c: float = CAL_C, max_steps: int = CAL_STEPS, tol: float = CAL_TOL) -> DataFrame:
    """(repeat, cal_slope, cal_intercept, converged): a near-unpenalised logistic fit of
    y on logit(p) for each repeat.

    All repeats advance together: a Newton step needs five sums of each (the gradient's
    two, the curvature's three), which are one grouped aggregation over all scores,
    whatever the number of rows.  The state is two numbers a repeat.  A repeat of one
    class has no fit (null, not converged); one that still moves after ``max_steps``
    is returned with converged = false.  Rows without p or y take no part.
    """
    spark = oof.sparkSession
    rows = oof.filter(F.col("p").isNotNull() & F.col("y").isNotNull()).select("repeat", logit("p").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = rows.groupBy("repeat").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()   # one row a repeat
    state = {r["repeat"]: (0.0, 0.0) for r in sizes if r["lo"] != r["hi"]}
    kind = dict(rows.dtypes)["repeat"]
    moving, steps = set(state), 0
    while moving and steps < max_steps:
        now = spark.createDataFrame([(k, *state[k]) for k in sorted(moving)], f"repeat {kind}, a double, b double")
        at = rows.join(F.broadcast(now), "repeat")          # two numbers for each repeat that still moves
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        at = at.select("repeat", "x", (q - F.col("y")).alias("r"), (q * (F.lit(1.0) - q)).alias("w"))
        sums = at.groupBy("repeat").agg(F.sum(F.col("r") * F.col("x")).alias("ga"), F.sum("r").alias("gb"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("haa"),
                                        F.sum(F.col("w") * F.col("x")).alias("hab"), F.sum("w").alias("hbb"))
        for m in sums.collect():
            a, b = state[m["repeat"]]
            ga, gb = c * m["ga"] + a, c * m["gb"]
            haa, hab, hbb = c * m["haa"] + 1.0, c * m["hab"], c * m["hbb"]
            det = haa * hbb - hab * hab
            if not det > 0:          # flat: p has reached 0 or 1 everywhere
                moving.discard(m["repeat"])
                state[m["repeat"]] = (a, b, False)
                continue
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            state[m["repeat"]] = (a - da, b - db)
            if max(abs(da), abs(db)) < tol:
                moving.discard(m["repeat"])
        steps += 1
    out = [(r["repeat"], *(state[r["repeat"]][:2] if r["repeat"] in state else (None, None)),
            r["repeat"] in state and r["repeat"] not in moving and len(state[r["repeat"]]) == 2) for r in sizes]
    return spark.createDataFrame(out, f"repeat {kind}, cal_slope double, cal_intercept double, converged boolean")
