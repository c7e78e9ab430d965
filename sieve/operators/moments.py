"""Refits of the centroid scorer for many row weightings in one pass.

A centroid scorer needs, for each class, the weighted count and the weighted sum of the
rows: both add up, over partitions and over folds.  So the rows are read once, each
with the list of its weights (bootstrap draws, Poisson draws, or fold membership); a
task multiplies its weights by its rows (one matrix product per slice) and hands on one
sum vector for each (weighting, class); Spark adds those up.  No training row is copied
per model, and what a task holds is weightings x classes x dim numbers, fixed by
parameters.  Out-of-fold models are the totals minus a fold's own sums.

``models`` turns the sums into one direction for each weighting:
``u = scale * (c1 / |c1| - c0 / |c0|)`` with class centroids c, so that a unit row's
score is ``sigmoid(u . x)`` = sigmoid(scale * (cos(x, c1) - cos(x, c0))).  A centroid
of length zero has cosine 0 with everything; a weighting without rows of one class has
no model (u is null, so are its scores).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_le, hash_unit
from ..functions.vectors import dot, norm
from .resample import BOOT_SEED, N_BOOT, poisson1_cdf

# --- fixed values -----------------------------------------------------------
SCORE_SCALE = 8.0
SCORE_DIGITS = 6
REFIT_DIGITS = 9        # means and quantiles of scores rounded to 6 would end in exact halves
# ---------------------------------------------------------------------------

SLICE_ROWS = 512        # rows per matrix product: weightings x rows numbers at a time


def weight_lists(weights: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(record_id, groups array<int>, ws array<double>) of a long table
    (group, record_id, weight); a record has at most one entry per weighting."""
    packed = weights.groupBy(id_col).agg(F.collect_list(F.struct(F.col("group").cast("int").alias("g"), F.col("weight").cast("double").alias("w"))).alias("_w"))
    return packed.select(id_col, F.col("_w.g").alias("groups"), F.col("_w.w").alias("ws"))


def poisson_lists(rows: DataFrame, n_boot: int = N_BOOT, id_col: str = "record_id", seed: int = BOOT_SEED) -> DataFrame:
    """``rows`` with groups and ws of the Poisson(1) bootstrap: the same draws as
    ``bootstrap_poisson``, made where the row lies, without a table of draws."""
    cdf = poisson1_cdf()
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long")),
                      lambda r: F.struct(r.cast("int").alias("g"), count_le(cdf, hash_unit(F.lit(seed), r, F.col(id_col))).cast("double").alias("w")))
    drawn = rows.withColumn("_w", F.filter(own, lambda s: s["w"] > 0))
    return drawn.select(*rows.columns, F.col("_w.g").alias("groups"), F.col("_w.w").alias("ws"))


def dimension(rows: DataFrame, vec: str = "embedding") -> int:
    """Length of the vectors; 0 without any."""
    first = rows.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    return first["d"] if first else 0


def class_sums(rows: DataFrame, n_groups: int, vec: str = "embedding", label: str = "y", dim: int | None = None) -> DataFrame:
    """(group, y, n, s): weighted count and sum vector of each weighting and class.

    ``rows`` hold vec, label, groups and ws.  Rows without a label or vector take no part.
    ``dim`` saves the look at a first row where the caller knows the vectors' length.
    """
    dim = dimension(rows, vec) if dim is None else dim

    def run(batches):
        total = np.zeros((2, n_groups, dim + 1))
        for batch in batches:
            for lo in range(0, len(batch), SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                x = np.asarray(pa.compute.list_flatten(part.column(0)).to_numpy(zero_copy_only=False), np.float64).reshape(len(part), dim)
                x = np.hstack([x, np.ones((len(part), 1))])
                y = part.column(1).to_numpy(zero_copy_only=False)
                sizes = np.asarray(pa.compute.list_value_length(part.column(2)))
                row = np.repeat(np.arange(len(part)), sizes)
                group = pa.compute.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)
                w = pa.compute.list_flatten(part.column(3)).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = np.flatnonzero(y == c)
                    if len(own):
                        place = np.full(len(part), -1)
                        place[own] = np.arange(len(own))
                        mine = place[row] >= 0
                        flat = group[mine].astype(np.int64) * len(own) + place[row[mine]]
                        weight = np.bincount(flat, w[mine], n_groups * len(own)).reshape(n_groups, len(own))
                        total[c] += weight @ x[own]
        for c in (0, 1):
            held = np.flatnonzero(total[c, :, dim] > 0)
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.full(len(held), c), pa.int32()), pa.array(total[c, held, dim]),
                                                  pa.array(list(total[c, held, :dim]), pa.list_(pa.float64()))], names=["group", "y", "n", "s"])

    ready = rows.filter(F.col(label).isin(0, 1) & F.col(vec).isNotNull() & F.col("groups").isNotNull())
    parts = ready.select(F.col(vec).cast("array<double>").alias(vec), F.col(label).cast("int").alias(label), "groups", "ws").mapInArrow(run, "group int, y int, n double, s array<double>")
    return add_up(parts, ["group", "y"], dim)


def add_up(sums: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Sums of n and of s, component by component (dim plain sums, no lambda)."""
    each = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"_s{i}") for i in range(dim)])
    return each.select(*keys, "n", F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias("s"))


def complements(sums: DataFrame, set_size: int, dim: int | None = None) -> DataFrame:
    """Sums of all rows of a weighting's set but its own: sets are ``set_size``
    neighbouring groups (the folds of one repeat) that share out the rows."""
    setno = F.floor(F.col("group") / F.lit(set_size)).cast("int")
    own = sums.withColumn("_set", setno)
    whole = F.transform(F.arrays_zip("_t", "s"), lambda p: p["_t"] - p["s"])
    dim = dimension(sums, "s") if dim is None else dim
    totals = add_up(own.select(F.col("_set"), "y", "n", "s"), ["_set", "y"], dim).select(F.col("_set"), "y", F.col("n").alias("_n"), F.col("s").alias("_t"))
    # a fold without rows of a class still leaves out nothing of it
    folds = totals.select("*", F.explode(F.sequence(F.col("_set") * set_size, F.col("_set") * set_size + set_size - 1)).alias("group"))
    met = folds.join(sums.select("group", "y", "n", "s"), ["group", "y"], "left")
    rest = F.when(F.col("s").isNull(), F.col("_t")).otherwise(whole)
    return met.select("group", "y", (F.col("_n") - F.coalesce("n", F.lit(0.0))).alias("n"), rest.alias("s")).filter("n > 0")


def models(sums: DataFrame, scale: float = SCORE_SCALE) -> DataFrame:
    """(group, u, b): the direction of each weighting's scorer; b is 0."""
    def unit(c: int) -> Column:
        s = F.max(F.when(F.col("y") == c, F.transform("s", lambda v: v / F.col("n"))))
        return s.alias(f"_c{c}")

    both = sums.groupBy("group").agg(unit(1), unit(0))
    over = lambda c, x: F.when(norm(c) == 0, F.lit(0.0)).otherwise(x / norm(c))
    u = F.zip_with("_c1", "_c0", lambda a, b: F.lit(scale) * (over("_c1", a) - over("_c0", b)))
    return both.select("group", u.alias("u"), F.lit(0.0).alias("b"))


def unit_rows(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows scaled to length one; a zero vector stays zero."""
    length = F.sqrt(dot(vec, vec))
    return rows.withColumn("_l", length).withColumn(vec, F.when(F.col("_l") == 0, F.col(vec)).otherwise(F.transform(vec, lambda v: v / F.col("_l")))).drop("_l")


def refit_scores(scorers: DataFrame, rows: DataFrame, n_groups: int, digits: int = REFIT_DIGITS) -> DataFrame:
    """``rows`` (slots, embedding, ...) once for each group in ``slots``, with p of the group's
    scorer; rows with a ``group`` of their own have that one."""
    from .models import score_listed

    if "slots" not in rows.columns:
        rows = rows.withColumn("slots", F.array_compact(F.array(F.col("group").cast("int")))).drop("group")
    scored = score_listed(scorers.withColumnRenamed("group", "slot"), unit_rows(rows), n_groups)
    return scored.withColumnRenamed("slot", "group").withColumn("p", F.round("p", digits))


def bootstrap_scorers(train: DataFrame, n_boot: int = N_BOOT, mode: str = "exact", counts: DataFrame | None = None) -> DataFrame:
    """One scorer per bootstrap replicate of ``train`` (record_id, embedding, y).

    ``exact``: ``counts`` (replicate, record_id, draws) joins the rows once.
    ``poisson``: no table of draws at all; a replicate that drew only one class has no
    model.
    """
    rows = train.select("record_id", "embedding", "y")
    if mode == "poisson":
        own = poisson_lists(rows, n_boot)
    else:
        if counts is None:
            from .resample import bootstrap

            counts = bootstrap(train, n_boot)
        own = rows.join(weight_lists(counts.select(F.col("replicate").alias("group"), "record_id", F.col("draws").alias("weight"))), "record_id")
    return models(class_sums(own, n_boot))


def fold_scorers(train: DataFrame, folds: DataFrame, n_sets: int, k: int, set_col: str) -> DataFrame:
    """One scorer per (set, fold) fitted on the set's other folds; ``folds`` assigns
    (record_id, set_col, fold) without vectors.  group = set * k + fold."""
    long = folds.select((F.col(set_col) * k + F.col("fold")).alias("group"), "record_id", F.lit(1.0).alias("weight"))
    own = train.select("record_id", "embedding", "y").join(weight_lists(long), "record_id")
    return models(complements(class_sums(own, n_sets * k), k))
