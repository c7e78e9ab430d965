"""Classification metrics over long score tables ``(group..., p, y)``.

Every metric is a grouped aggregation.  Rank-based metrics (ROC AUC, average
precision) first collapse rows to distinct scores per group and then need
running sums over the score order; those use :func:`prefix_sums`, which never
sorts a whole group inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import LOG_EPS, clip, count_le
from ..functions.vectors import with_one_row
from .prefix import exact_quantiles, prefix_sums


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def _confusion_aggs(t: float, p: str, y: str, suffix: str = "") -> list:
    call = F.col(p) >= F.lit(float(t))
    pos = F.col(y) == 1
    return [F.sum((call & pos).cast("long")).alias(f"tp{suffix}"), F.sum((call & ~pos).cast("long")).alias(f"fp{suffix}"),
            F.sum((~call & pos).cast("long")).alias(f"fn{suffix}"), F.sum((~call & ~pos).cast("long")).alias(f"tn{suffix}")]


def f1_from_counts(suffix: str = ""):
    tp, fp, fn = F.col(f"tp{suffix}"), F.col(f"fp{suffix}"), F.col(f"fn{suffix}")
    return _ratio(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, group_cols: Sequence[str], t: float, p: str = "p", y: str = "y") -> DataFrame:
    """tp fp fn tn and accuracy / precision / recall / F1 at threshold ``t``
    (inclusive), zero division -> 0."""
    c = df.groupBy(*group_cols).agg(*_confusion_aggs(t, p, y))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(*group_cols, "tp", "fp", "fn", "tn",
                    _ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
                    _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    f1_from_counts().alias("f1"))


def score_counts(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Distinct scores per group with positive / negative counts."""
    return df.groupBy(*group_cols, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("npos"),
                                          F.sum((F.col(y) != 1).cast("long")).alias("nneg"))


def rank_metrics(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """ROC AUC (Mann-Whitney, ties counted half) and step-wise average precision
    from one pass of running counts over the distinct scores of each group:
    (group..., auc, ap).

    With ``below_*`` the counts of strictly lower scores and P, N the group
    totals: AUC = sum npos (below_nneg + nneg / 2) / (P N); AP = sum over scores,
    high to low, of the recall step npos / P times the precision at that score,
    (P - below_npos) / (P + N - below_npos - below_nneg).
    """
    g = list(group_cols)
    sc = prefix_sums(score_counts(df, g, p, y), g, F.col(p), ["npos", "nneg"], out_prefix="below_", totals=True)
    P, N = F.col("_total_npos"), F.col("_total_nneg")
    ge_pos = P - F.col("below_npos")
    prec = ge_pos / (ge_pos + N - F.col("below_nneg"))
    agg = sc.groupBy(*g).agg(
        F.sum(F.col("npos") * (F.col("below_nneg") + 0.5 * F.col("nneg"))).alias("_u"),
        F.sum(F.col("npos") * prec).alias("_ap"), F.max(P).alias("_P"), F.max(N).alias("_N"))
    return agg.select(*g, F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(None).cast("double"))
                      .otherwise(F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auc"),
                      F.when(F.col("_P") == 0, F.lit(None).cast("double"))      # no positives: undefined
                       .otherwise(F.col("_ap") / F.col("_P")).alias("ap"))


def roc_auc(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Mann-Whitney AUC with ties counted half: (group..., auc)."""
    return rank_metrics(df, group_cols, p, y).select(*group_cols, "auc")


def average_precision(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Step-wise average precision: sum over distinct thresholds (high to low) of
    recall increase x precision at that threshold."""
    return rank_metrics(df, group_cols, p, y).select(*group_cols, "ap")


def _prob_aggs(p: str, y: str, eps: float) -> list:
    q = clip(F.col(p), eps, 1.0 - eps)
    yy = F.col(y).cast("double")
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"),
            F.avg(F.pow(F.col(p) - yy, 2)).alias("brier"),
            (F.avg(yy) * (1 - F.avg(yy))).alias("brier_prior"),
            (-F.avg(yy * F.log(q) + (1 - yy) * F.log(1 - q))).alias("log_loss"),
            F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.avg(p).alias("p_mean")]


def prob_metrics(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y",
                 eps: float = LOG_EPS, f1_at: Sequence[tuple[float, str]] = ()) -> DataFrame:
    """n, positives, Brier, prior Brier, log loss, min / max / mean score; and,
    in the same aggregation, F1 at each ``(threshold, column name)`` of ``f1_at``."""
    aggs = _prob_aggs(p, y, eps)
    for i, (t, _) in enumerate(f1_at):
        aggs += _confusion_aggs(t, p, y, f"_{i}")
    out = df.groupBy(*group_cols).agg(*aggs)
    if f1_at:
        out = out.select(*group_cols, "n", "n_pos", "brier", "brier_prior", "log_loss", "p_min", "p_max", "p_mean",
                         *[f1_from_counts(f"_{i}").alias(name) for i, (_, name) in enumerate(f1_at)])
    return out


def class_balance(df: DataFrame, group_cols: Sequence[str], y: str = "y") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                       F.sum((F.col(y) == 1).cast("long")).alias("n_pos"),
                                       F.sum((F.col(y) != 1).cast("long")).alias("n_neg"),
                                       F.avg(F.col(y).cast("double")).alias("pos_rate"))


def quantile_bins(df: DataFrame, group_cols: Sequence[str], p: str = "p", n_bins: int = 5) -> DataFrame:
    """Assign ``bin`` in [0, n_bins): edges are exact quantiles of ``p`` per group,
    the last edge nudged up by 1e-9; a value equal to an inner edge goes up."""
    g = list(group_cols)
    probs = [i / n_bins for i in range(n_bins + 1)]
    qs = exact_quantiles(df, g, p, probs)
    inner = (qs.filter((F.col("q_idx") > 0) & (F.col("q_idx") < n_bins))
               .groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("q_idx", "value"))).alias("_e"))
               .select(*g, F.transform("_e", lambda s: s["value"]).alias("_edges")))    # n_bins - 1 values
    j = df.join(inner, g, "left") if g else with_one_row(df, inner)
    b = count_le(F.col("_edges"), F.col(p))
    return j.withColumn("bin", F.least(F.greatest(b, F.lit(0)), F.lit(n_bins - 1)).cast("int")).drop("_edges")


def ece(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y", n_bins: int = 5) -> DataFrame:
    """Expected calibration error over quantile bins: sum |mean p - mean y| * share."""
    g = list(group_cols)
    b = quantile_bins(df, g, p, n_bins)
    per = b.groupBy(*g, "bin").agg(F.avg(p).alias("_mp"), F.avg(F.col(y).cast("double")).alias("_my"),
                                   F.count(F.lit(1)).alias("_nb"))
    return (per.groupBy(*g)
               .agg(F.sum(F.abs(F.col("_mp") - F.col("_my")) * F.col("_nb")).alias("_s"),
                    F.sum("_nb").alias("_n"))
               .select(*g, (F.col("_s") / F.col("_n")).alias("ece")))


def reliability(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y", n_bins: int = 5) -> DataFrame:
    """Per quantile bin: 1-based bin, score range text, n, mean predicted, observed rate."""
    from ..functions.numeric import interval_text
    g = list(group_cols)
    b = quantile_bins(df, g, p, n_bins)
    return b.groupBy(*g, "bin").agg(
        F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate")) \
        .select(*g, (F.col("bin") + 1).alias("bin"), interval_text("_lo", "_hi").alias("p_range"), "n",
                "mean_predicted", "observed_rate")
