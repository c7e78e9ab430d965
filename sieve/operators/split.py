"""Stratified hold-out, stratified k-fold (one or many shuffles) and repeated k-fold.

Membership is decided by an md5 hash of ``seed:record_id`` (reproducible in any
engine); the class quotas follow the usual rules exactly:

* hold-out: ``n_test = ceil(test_size * n)``; the train quota ``n - n_test`` is
  spread over classes by largest remainder (equal remainders: lower class first)
  and each class gives the rest to the test side;
* k-fold: rows sorted by class are dealt round-robin to folds, so fold sizes
  and per-class fold sizes differ by at most one.

Ranks inside a class use :func:`hash_rank`, which never sorts a whole class in
one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_key
from ..session import cut_lineage
from .prefix import hash_rank

# --- fixed values -----------------------------------------------------------
TEST_SIZE = 0.2
SPLIT_SEED = 42
CV_FOLDS = 3
CV_SEEDS = (42, 123, 456, 789, 2024)
OOF_FOLDS = 5
OOF_REPEATS = 10
# ---------------------------------------------------------------------------


def class_counts(df: DataFrame, label: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*extra_keys, label).agg(F.count(F.lit(1)).alias("n_class"))


def _largest_remainder(counts: DataFrame, label: str, total_quota, keys: Sequence[str] = ()) -> DataFrame:
    """Spread ``total_quota`` (column) over classes proportionally; largest
    remainders get the leftovers, lower class first on ties.  ``counts`` is the
    per-class table (classes x keys rows), never the data."""
    k = list(keys)
    w_all = Window.partitionBy(*k)
    c = (counts.withColumn("_n", F.sum("n_class").over(w_all))
               .withColumn("_cont", total_quota * F.col("n_class") / F.col("_n"))
               .withColumn("_floor", F.floor("_cont").cast("long"))
               .withColumn("_rem", F.col("_cont") - F.col("_floor"))
               .withColumn("_need", total_quota.cast("long") - F.sum("_floor").over(w_all))
               .withColumn("_order", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("_rem"), label))))
    return c.withColumn("quota", F.col("_floor") + (F.col("_order") <= F.col("_need")).cast("long")) \
            .select(*k, label, "n_class", "quota")


def stratified_holdout(df: DataFrame, label: str = "y", id_col: str = "record_id",
                       test_size: float = TEST_SIZE, seed: int = SPLIT_SEED,
                       out: str = "split") -> DataFrame:
    """Add ``split`` in {'train','test'}.  Rows without a label are in neither and go."""
    df = df.filter(F.col(label).isNotNull())
    counts = class_counts(df, label)
    n_total = F.sum("n_class").over(Window.partitionBy())
    counts = counts.withColumn("_n_test", F.ceil(F.lit(float(test_size)) * n_total))
    counts = counts.withColumn("_n_train", n_total - F.col("_n_test"))
    q = _largest_remainder(counts.select(label, "n_class", "_n_train"), label, F.col("_n_train").cast("double"))
    # the tiny quota table carries _n_train through the window above
    q = q.select(label, F.col("quota").alias("_train_quota"))
    ranked = hash_rank(df, [label], hash_key(F.lit(seed), F.col(id_col)), id_col, out="_pos")
    return (ranked.join(F.broadcast(q), [label])              # one row per class
                  .withColumn(out, F.when(F.col("_pos") <= F.col("_train_quota"), F.lit("train"))
                                    .otherwise(F.lit("test")))
                  .drop("_pos", "_train_quota"))


def stratified_kfold(df: DataFrame, label: str = "y", id_col: str = "record_id",
                     k: int = CV_FOLDS, seeds: Sequence[int] = CV_SEEDS,
                     seed_col: str = "seed", fold_col: str = "fold") -> DataFrame:
    """One row per (seed, record): ``fold`` in [0, k) for each shuffle seed.  Rows without
    a label are in no fold and go."""
    rows = df.filter(F.col(label).isNotNull()).select("*", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias(seed_col))
    counts = class_counts(rows, label, [seed_col])
    w = Window.partitionBy(seed_col).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(seed_col, label, F.coalesce(F.sum("n_class").over(w), F.lit(0)).alias("_off"))
    ranked = hash_rank(rows, [seed_col, label], hash_key(F.col(seed_col), F.col(id_col)), id_col, out="_pos")
    return (ranked.join(F.broadcast(offs), [seed_col, label])           # seeds x classes rows
                  .withColumn(fold_col, ((F.col("_off") + F.col("_pos") - 1) % k).cast("int"))
                  .drop("_off", "_pos"))


def repeated_kfold(df: DataFrame, label: str = "y", id_col: str = "record_id",
                   k: int = OOF_FOLDS, repeats: int = OOF_REPEATS, base_seed: int = SPLIT_SEED) -> DataFrame:
    """``repeats`` independent stratified k-fold assignments; adds ``repeat``, ``fold``."""
    seeds = [base_seed * 1000 + r for r in range(repeats)]
    out = stratified_kfold(df, label, id_col, k, seeds, seed_col="_seed")
    return out.withColumn("repeat", (F.col("_seed") - F.lit(base_seed * 1000)).cast("int")).drop("_seed")


def fold_lists(df: DataFrame, assign, key: str, label: str = "y", id_col: str = "record_id", vec: str = "embedding") -> DataFrame:
    """``df`` with ``folds``: one entry (``key``, fold) for each assignment that ``assign``
    (:func:`stratified_kfold` or :func:`repeated_kfold`) gives the row.  Only ids and labels
    are dealt, the vectors travel once.  Rows are told apart by a number of their own, so
    ids may repeat or be null."""
    rows = cut_lineage(df.select(id_col, vec, label)).withColumn("_row", F.monotonically_increasing_id())
    dealt = assign(rows.select("_row", id_col, label)).groupBy("_row").agg(F.collect_list(F.struct(key, "fold")).alias("folds"))
    return cut_lineage(rows.join(dealt, "_row").drop("_row"))


def other_folds(k: int, model) -> Column:
    """From ``folds``: ``model(entry, fold)`` for each entry and each of the ``k`` folds but its own."""
    each = lambda f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: g != f["fold"]), lambda g: model(f, g))
    return F.flatten(F.transform("folds", each))


def fold_sides(assigned: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) rows for one fold: complement and member."""
    return assigned.filter(F.col(fold_col) != fold), assigned.filter(F.col(fold_col) == fold)


def quota_table(n: int, class_sizes: dict[int, int], test_size: float = TEST_SIZE) -> dict[int, int]:
    """Driver-side check of the hold-out quotas (used by tests)."""
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    cont = {c: n_train * m / n for c, m in class_sizes.items()}
    fl = {c: math.floor(v) for c, v in cont.items()}
    need = n_train - sum(fl.values())
    for c in sorted(cont, key=lambda c: (-(cont[c] - fl[c]), c))[:need]:
        fl[c] += 1
    return {c: class_sizes[c] - fl[c] for c in class_sizes}
