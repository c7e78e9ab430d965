"""Driver tables recast as the record-screening data model.

* ``records``  documents LEFT JOIN labels: descriptors lang, source, n_chars, text;
  ``target`` = quality (null when unlabelled: those are the records to score).
* ``parts``    part: name / brand / type / size descriptors.
* ``vectors``  embeddings: ``y`` = label >= 5, ``split`` from the stratified hold-out.
* ``scored``   vectors with a deterministic score ``p`` = sigmoid(8 * (cos(e, mu1) -
  cos(e, mu0))) against the class centroids of the train split, rounded to 6 dp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import centroids, cosine, with_one_row
from ..session import reuse
from ..operators.moments import SCORE_DIGITS, SCORE_SCALE
from ..operators.split import stratified_holdout
from .tables import table

# --- fixed values -----------------------------------------------------------
POSITIVE_FROM_LABEL = 5      # embeddings.label >= 5 -> class 1
# ---------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars", "text"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return (docs.join(lab, "doc_id", "left")
                .select(F.col("doc_id").alias("record_id"), "lang", "source",
                        F.col("n_chars").cast("string").alias("n_chars"), "text",
                        F.col("quality").alias("target")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their label: a scan of ``documents`` alone."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars", "text"])
    return docs.select(F.col("doc_id").alias("record_id"), "lang", "source", F.col("n_chars").cast("string").alias("n_chars"), "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]) \
        .withColumnRenamed("p_partkey", "record_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    v = e.select(F.col("vec_id").alias("record_id"),
                 F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
                 (F.col("label") >= POSITIVE_FROM_LABEL).cast("int").alias("y"))
    return stratified_holdout(v, "y", "record_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    mu = centroids(v.filter(F.col("split") == "train"), "embedding", "y")   # classes x dim, bounded
    both = mu.agg(F.max(F.when(F.col("y") == 1, F.col("centroid"))).alias("mu1"),
                  F.max(F.when(F.col("y") == 0, F.col("centroid"))).alias("mu0"))   # one row
    s = with_one_row(v, both)
    s = (s.withColumn("cos1", cosine("embedding", "mu1"))
          .withColumn("cos0", cosine("embedding", "mu0")))
    z = F.lit(SCORE_SCALE) * (F.col("cos1") - F.col("cos0"))
    return s.select("record_id", "embedding", "y", "split", "cos1", "cos0",
                    F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), SCORE_DIGITS).alias("p"))


# --- long score tables -------------------------------------------------------
# Sweep, bootstrap and out-of-fold scores all come from refits (operators/linear_grid.py,
# operators/moments.py).
N_BOOT_SCORES = 1000
GROUP_SHARE = 0.25            # share of hold-out records tagged 'validation'


def screen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out records as the set to screen, with a group tag and a name."""
    from ..functions.numeric import hash_unit
    s = scored(spark, sf_dir).filter(F.col("split") == "test")
    grp = F.when(hash_unit(F.lit("group"), F.col("record_id")) < GROUP_SHARE, F.lit("validation")) \
           .otherwise(F.lit("screen"))
    return s.select("record_id", grp.alias("grp"), F.concat(F.lit("rec"), F.col("record_id").cast("string")).alias("name"),
                    "y", "p", "embedding", "cos1", "cos0")


def _sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(encoder, family, seed, grid_pos, fold, record_id, p, y): validation scores
    of every setting of the closed-form grid, refitted for each encoding, seed and fold of
    the train split."""
    from ..operators import linear_grid as lg
    return lg.sweep_scores(vectors(spark, sf_dir).filter(F.col("split") == "train"))


def _boot_scores(spark: SparkSession, sf_dir: str, n_boot: int = N_BOOT_SCORES) -> DataFrame:
    """(replicate, record_id, grp, name, p): the screened records under the centroid
    scorer refitted on each bootstrap replicate of the train split."""
    from ..operators import moments as mo
    train = vectors(spark, sf_dir).filter(F.col("split") == "train")
    scorers = mo.bootstrap_scorers(train, n_boot, counts=boot_counts(spark, sf_dir))
    s = screen_set(spark, sf_dir).select("record_id", "grp", "name", "embedding")
    x = s.withColumn("slots", F.sequence(F.lit(0), F.lit(n_boot - 1)))
    return mo.refit_scores(scorers, x, n_boot).withColumnRenamed("group", "replicate")


def _oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repeat, fold, record_id, y, p): scores of all labelled vectors under the
    centroid scorer refitted without their fold, for each repeat."""
    from ..operators import moments as mo
    from ..operators import split as sp
    v = vectors(spark, sf_dir).select("record_id", "embedding", "y")
    folds = sp.repeated_kfold(v.select("record_id", "y"))
    scorers = mo.fold_scorers(v, folds, sp.OOF_REPEATS, sp.OOF_FOLDS, "repeat")
    # a record's vector travels once, with the list of its folds
    own = folds.groupBy("record_id").agg(F.collect_list((F.col("repeat") * sp.OOF_FOLDS + F.col("fold")).cast("int")).alias("slots"))
    x = v.join(own, "record_id").select("record_id", "embedding", "y", "slots")
    scored = mo.refit_scores(scorers, x, sp.OOF_REPEATS * sp.OOF_FOLDS)
    return scored.select(F.floor(F.col("group") / sp.OOF_FOLDS).cast("int").alias("repeat"), (F.col("group") % sp.OOF_FOLDS).alias("fold"), "record_id", "y", "p")


# --- shared derived tables ----------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(spark, ("vectors", sf_dir), lambda: _vectors(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(spark, ("scored", sf_dir), lambda: _scored(spark, sf_dir))


def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(spark, ("sweep", sf_dir), lambda: _sweep_scores(spark, sf_dir))


def boot_scores(spark: SparkSession, sf_dir: str, n_boot: int = N_BOOT_SCORES) -> DataFrame:
    return reuse(spark, ("boot", sf_dir, n_boot), lambda: _boot_scores(spark, sf_dir, n_boot))


def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(spark, ("oof", sf_dir), lambda: _oof_scores(spark, sf_dir))


def boot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(replicate, record_id, draws): the exact bootstrap replicates of the train
    split, drawn once and shared by the replicate report and the replicate fits
    (materialise-once, as replicates are cached between steps)."""
    from ..operators import resample as rs
    return reuse(spark, ("boot_counts", sf_dir), lambda: rs.bootstrap(
        vectors(spark, sf_dir).filter(F.col("split") == "train").select("record_id", "y"), rs.N_BOOT, mode="exact"))
