"""Model selection over a long table of validation scores.

Input shape: ``(encoder, family, seed, grid_pos, fold, record_id, p, y)`` — one
row per validation record per fitted setting.  Everything after the fits is a
chain of aggregations:

threshold search per fit -> fold means per setting (only settings with all
folds) -> best setting per (encoder, family, seed) -> summary per (encoder,
family) -> winner with modal setting.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .thresholds import best_threshold

# --- fixed values -----------------------------------------------------------
# Hyper-parameter grids of the five classifier families, in the reference's
# loop order (first key outermost).  A family may have several sub-grids.
GRIDS = {
    "Logistic Regression": [
        {"C": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10, 50, 100], "penalty": ["l2"]},
        {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1"], "solver": ["saga"], "max_iter": [2000]},
    ],
    "Random Forest": [
        {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7, None],
         "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    ],
    "SVM-RBF": [
        {"C": [0.1, 1, 10, 100], "gamma": ["scale", "auto", 0.001, 0.01, 0.1]},
    ],
    "SVM-Linear": [
        {"C": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10, 50, 100]},
    ],
    "XGBoost": [
        {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.3],
         "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    ],
}
ENCODERS = ["domain", "general"]
CV_FOLDS = 3
# Fold means are compared after rounding to this many decimals, so that sums
# taken in a different order cannot reorder settings with equal means.
COMPARE_DIGITS = 12
# ---------------------------------------------------------------------------


def json_value(v) -> str:
    """Render a parameter value as JSON text."""
    return json.dumps(v)


def grid_frame(spark: SparkSession, grids: dict = GRIDS) -> DataFrame:
    """(family, grid_pos, params) — grid expanded by crossing the value lists with
    ``posexplode``; ``grid_pos`` follows the nested-loop order."""
    frames = []
    for family, subgrids in grids.items():
        offset = 0
        for sub in subgrids:
            keys = list(sub)
            df = spark.range(1).select(F.lit(family).alias("family"))
            for k in keys:
                df = df.select("*", F.posexplode(F.array(*[F.lit(json_value(v)) for v in sub[k]]))
                               .alias(f"_i_{k}", f"_v_{k}"))
            pos = F.lit(0)
            for k in keys:
                pos = pos * F.lit(len(sub[k])) + F.col(f"_i_{k}")
            body = F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), F.col(f"_v_{k}")) for k in keys])
            frames.append(df.select("family", (F.lit(offset) + pos).cast("int").alias("grid_pos"),
                                    F.concat(F.lit("{"), body, F.lit("}")).alias("params")))
            n = 1
            for k in keys:
                n *= len(sub[k])
            offset += n
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def grid_rows(grids: dict = GRIDS) -> list[tuple[str, int, str]]:
    """The same grid, driver-side (for fitting loops and tests)."""
    import itertools
    rows = []
    for family, subgrids in grids.items():
        pos = 0
        for sub in subgrids:
            keys = list(sub)
            for combo in itertools.product(*[sub[k] for k in keys]):
                body = ",".join(f"{json.dumps(k)}:{json_value(v)}" for k, v in zip(keys, combo))
                rows.append((family, pos, "{" + body + "}"))
                pos += 1
    return rows


FIT_KEYS = ["encoder", "family", "seed", "grid_pos", "fold"]
SETTING_KEYS = ["encoder", "family", "seed", "grid_pos"]
SEED_KEYS = ["encoder", "family", "seed"]


def fold_thresholds(scores: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Best threshold and its F1 for every fitted (setting, fold)."""
    return best_threshold(scores, FIT_KEYS, p, y)


def setting_means(fold_best: DataFrame, k: int = CV_FOLDS) -> DataFrame:
    """Mean F1 / threshold over folds; a setting missing a fold is dropped."""
    return (fold_best.groupBy(*SETTING_KEYS)
                     .agg(F.avg("f1").alias("cv_f1"), F.avg("threshold").alias("mean_t"),
                          F.count(F.lit(1)).alias("_nf"))
                     .filter(F.col("_nf") == k).drop("_nf"))


def best_settings(means: DataFrame, grid: DataFrame) -> DataFrame:
    """Per (encoder, family, seed): highest mean F1, first in grid order on ties."""
    w = Window.partitionBy(*SEED_KEYS).orderBy(F.desc(F.round("cv_f1", COMPARE_DIGITS)), F.asc("grid_pos"))
    top = means.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return (top.join(F.broadcast(grid), ["family", "grid_pos"], "left")        # grid: fixed few hundred rows
               .select("encoder", "family", "seed", "grid_pos", "cv_f1",
                       F.bround("mean_t", 2).alias("opt_threshold"), "params"))


def summary(best: DataFrame) -> DataFrame:
    """Per (encoder, family): mean and sample sd of the seeds' best F1, mean threshold."""
    return best.groupBy("encoder", "family").agg(
        F.avg("cv_f1").alias("cv_f1_mean"), F.stddev_samp("cv_f1").alias("cv_f1_std"),
        F.avg("opt_threshold").alias("opt_threshold_mean"), F.count(F.lit(1)).alias("n_seeds"))


def winner(summ: DataFrame, best: DataFrame) -> DataFrame:
    """Top (encoder, family) by mean F1 and its modal setting (smallest text on ties)."""
    # first row of the ordered summary: a top-1 (partial top-k per partition, then merged)
    top = summ.orderBy(F.desc(F.round("cv_f1_mean", COMPARE_DIGITS)), "encoder", "family").limit(1)
    modal = (best.groupBy("encoder", "family", "params").agg(F.count(F.lit(1)).alias("_c"))
                 .withColumn("_r", F.row_number().over(
                     Window.partitionBy("encoder", "family").orderBy(F.desc("_c"), "params")))
                 .filter(F.col("_r") == 1).select("encoder", "family", F.col("params").alias("modal_params")))
    return top.join(modal, ["encoder", "family"], "left")


def chart_series(summ: DataFrame) -> DataFrame:
    """Mean +- sd per (family, encoder); families stand in the order of the first
    encoder's mean F1, highest first.  One row per encoder and family: bounded."""
    first = F.min("encoder").over(Window.partitionBy())
    best = summ.withColumn("_first", first).filter(F.col("encoder") == F.col("_first"))
    order = best.select("family", F.row_number().over(Window.orderBy(F.desc(F.round("cv_f1_mean", COMPARE_DIGITS)), "family")).alias("order_pos"))
    sd = F.coalesce("cv_f1_std", F.lit(0.0))
    return summ.join(order, "family", "left").select("encoder", "family", F.col("order_pos").cast("int"), F.col("cv_f1_mean").alias("m"), sd.alias("s"),
                                                     (F.col("cv_f1_mean") - sd).alias("m_minus_s"), (F.col("cv_f1_mean") + sd).alias("m_plus_s"))
