"""Decision thresholds: F1-optimal threshold search and threshold sensitivity.

The search evaluates all 91 grid thresholds of every group at once: each score
is bucketed by how many grid thresholds it reaches, counts per (group, bucket)
are summed from the top bucket down (a window over at most 92 rows per group),
and F1 follows from the counts.  That is O(rows), not O(rows x thresholds), and
it handles any number of groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_le

# --- fixed values -----------------------------------------------------------
GRID_START, GRID_STOP, GRID_POINTS = 0.05, 0.95, 91
DEFAULT_THRESHOLD = 0.5          # returned when no threshold gives F1 > 0
SENSITIVITY = [round(0.30 + 0.01 * i, 2) for i in range(21)]      # 0.30 ... 0.50
BASE_THRESHOLD = 0.39
CV_SEED_THRESHOLDS = {42: 0.38, 123: 0.39, 456: 0.44, 789: 0.30, 2024: 0.43}
BAND_EXTRA = (0.34, 0.44)
# ---------------------------------------------------------------------------


def threshold_grid(start: float = GRID_START, stop: float = GRID_STOP, num: int = GRID_POINTS) -> list[float]:
    """Bit-exact ``linspace``: start + k * ((stop - start) / (num - 1)); last point = stop."""
    step = (stop - start) / (num - 1)
    pts = [start + k * step for k in range(num)]
    pts[-1] = stop
    return pts


def f1_by_threshold(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y",
                    grid: Sequence[float] | None = None) -> DataFrame:
    """(group..., k, threshold, tp, fp, fn, f1) for every grid threshold."""
    g = list(group_cols)
    thr = list(grid or threshold_grid())
    m = len(thr)
    arr = F.array(*[F.lit(float(t)) for t in thr])
    b = df.withColumn("_j", count_le(thr, F.col(p)))     # p >= t_k  <=>  k < _j
    cnt = b.groupBy(*g, "_j").agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"),
                                  F.sum((F.col(y) != 1).cast("long")).alias("_neg"))
    # at most m + 1 (bucket, counts) entries per group: a bounded list
    per = cnt.groupBy(*g).agg(F.collect_list(F.struct("_j", "_pos", "_neg")).alias("_e"))
    zero = F.lit(0).cast("long")

    def above(k, field):
        return F.aggregate(F.filter("_e", lambda e: e["_j"] > k), zero, lambda a, e: a + e[field])

    curve = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.struct(
        k.alias("k"), above(k, "_pos").alias("tp"), above(k, "_neg").alias("fp")))
    s = (per.select(*g, F.aggregate("_e", zero, lambda a, e: a + e["_pos"]).alias("_P"),
                    F.explode(curve).alias("_c"))
            .select(*g, "_P", F.col("_c.k").cast("int").alias("k"), "_c.tp", "_c.fp")
            .withColumn("fn", F.col("_P") - F.col("tp")))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(den == 0, F.lit(0.0)).otherwise((2 * F.col("tp")).cast("double") / den.cast("double"))
    return s.select(*g, "k", arr[F.col("k")].alias("threshold"), "tp", "fp", "fn", f1.alias("f1"))


def best_threshold(df: DataFrame, group_cols: Sequence[str], p: str = "p", y: str = "y",
                   grid: Sequence[float] | None = None) -> DataFrame:
    """(group..., threshold, f1): highest F1, lowest threshold on ties; (0.5, 0)
    when no threshold reaches F1 > 0.

    Scores are bucketed by how many grid thresholds they reach (``_j``); counts
    per (group, bucket) are at most ``len(grid) + 1`` rows per group.  F1 only
    changes where an occupied bucket begins: for occupied buckets j1 < j2 < ...,
    every threshold index k in [j(i-1), j(i) - 1] calls exactly the rows of
    buckets >= j(i), and the lowest such k is the previous occupied bucket (0 for
    the first).  So the candidates are the occupied buckets, with running counts
    from the top bucket down; no per-threshold rows are made.
    """
    g = list(group_cols)
    thr = list(grid or threshold_grid())
    arr = F.array(*[F.lit(float(t)) for t in thr])
    b = df.withColumn("_j", count_le(thr, F.col(p)))     # p >= t_k  <=>  k < _j
    cnt = b.groupBy(*g, "_j").agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"),
                                  F.sum((F.col(y) != 1).cast("long")).alias("_neg"))
    wg = Window.partitionBy(*g)                                                  # <= len(grid) + 1 rows
    down = wg.orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = (cnt.withColumn("_tp", F.sum("_pos").over(down))
            .withColumn("_fp", F.sum("_neg").over(down))
            .withColumn("_P", F.sum("_pos").over(wg))
            .withColumn("_k", F.coalesce(F.lag("_j").over(wg.orderBy("_j")), F.lit(0))))
    den = 2 * F.col("_tp") + F.col("_fp") + (F.col("_P") - F.col("_tp"))
    f1 = (F.when(F.col("_j") == 0, F.lit(None).cast("double"))      # bucket 0 is never called
           .when(den == 0, F.lit(0.0))
           .otherwise((2 * F.col("_tp")).cast("double") / den.cast("double")))
    top = (c.withColumn("_f1", f1)
            .withColumn("_r", F.row_number().over(wg.orderBy(F.desc_nulls_last("_f1"), F.asc("_k"))))
            .filter(F.col("_r") == 1))
    ok = F.col("_f1") > 0
    return top.select(*g, F.when(ok, arr[F.col("_k")]).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
                      F.when(ok, F.col("_f1")).otherwise(F.lit(0.0)).alias("f1"))


def calls_wide(df: DataFrame, keep: Sequence[str], p: str = "p", thresholds: Sequence[float] = SENSITIVITY) -> DataFrame:
    """One 0/1 column per threshold, ``t_0_30`` ... : a narrow projection, no shuffle."""
    cols = [(F.col(p) >= F.lit(float(t))).cast("int").alias(f"t_{t:.2f}".replace(".", "_")) for t in thresholds]
    return df.select(*keep, *cols)


def calls_long(df: DataFrame, keep: Sequence[str], p: str = "p", thresholds: Sequence[float] = SENSITIVITY) -> DataFrame:
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    return (df.select(*keep, p, F.explode(arr).alias("threshold"))
              .withColumn("call", (F.col(p) >= F.col("threshold")).cast("int")))


def flips(df: DataFrame, p: str = "p", thresholds: Sequence[float] = SENSITIVITY,
          base: float = BASE_THRESHOLD) -> DataFrame:
    """Per threshold: number of positive calls and of calls that differ from the
    base threshold.  Partial aggregation keeps this one pass over the rows."""
    lg = calls_long(df, [], p, thresholds)
    flip = (F.col("call") != (F.col(p) >= F.lit(float(base))).cast("int")).cast("long")
    return lg.groupBy("threshold").agg(F.sum(F.col("call").cast("long")).alias("n_calls"),
                                       F.sum(flip).alias("n_flips"))


def flipped_records(df: DataFrame, id_col: str, p: str = "p", thresholds: Sequence[float] = (),
                    base: float = BASE_THRESHOLD) -> DataFrame:
    """Long form (threshold, id) of records whose call flips vs the base threshold."""
    lg = calls_long(df, [id_col], p, thresholds)
    return lg.filter(F.col("call") != (F.col(p) >= F.lit(float(base))).cast("int")).select("threshold", id_col)


def stability_band(extra: Sequence[float] = BAND_EXTRA, per_seed: dict | None = None) -> tuple[float, float]:
    vals = sorted(set(list(extra) + list((per_seed or CV_SEED_THRESHOLDS).values())))
    return vals[0], vals[-1]


def stable_calls(df: DataFrame, p: str = "p", band: tuple[float, float] | None = None) -> DataFrame:
    """Rows whose call is the same for every threshold in the band."""
    lo, hi = band or stability_band()
    return df.filter((F.col(p) >= F.lit(hi)) | (F.col(p) < F.lit(lo)))
