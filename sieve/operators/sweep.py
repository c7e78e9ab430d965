"""Model-selection sweep with real fits: every (family, setting) x seed x fold.

* **Leak-free, hoisted features.**  Standardise -> PCA(95 %) is fitted once per
  (seed, fold) on that fold's training side only and reused by every setting of
  every family (refitting it per setting gives the same stages, since neither
  depends on the classifier).
* **Fits as Spark jobs.**  Each classifier fit is a Spark ML fit on the fold's
  persisted features; fits run side by side in a bounded pool of concurrent
  jobs.  The driver only schedules: training rows and scores stay on executors.
* **Scores as a written table.**  Each fit writes its validation scores to its
  own folder under the shared checkpoint folder (``spark.checkpoint.dir``); the
  folder is read back as the long table ``(encoder, family, seed, grid_pos,
  fold, record_id, p, y)`` that :mod:`selection` reduces to the winner.  A setting
  that its estimator rejects (bad parameters) gets no scores, so the chain (which
  requires every fold) drops it, as the reference does; every fit has a row in
  the log (:func:`sweep_status`).  Any other error, such as lost executors or a full
  disk, ends the sweep instead of passing for a bad setting.
* **Goes on after a restart.**  A fit's log row is written after its scores, in a
  folder named by the fit.  A sweep given the folder of an earlier one (``out_dir``)
  makes only the fits that have no log row, whatever ended the earlier one.  The folder
  belongs to one training set, which its first sweep notes as row count and sum of row
  hashes; with other rows, encoder or folds the sweep refuses to go on.

Families: logistic regression (L1 / L2), random forest, boosted trees, linear SVM
and RBF SVM (random Fourier features + linear SVM); SVM margins are turned into
probabilities by Platt scaling on the training margins.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .features import PCAByVariance, PopulationStandardScaler
from .models import as_features, classifier, platt, random_fourier_features, sized_for_fit
from .split import CV_FOLDS, CV_SEEDS, stratified_kfold

SWEEP_PARALLELISM = 4           # concurrent fit jobs
RFF_FEATURES = 200              # random Fourier features for the RBF family

SCORE_SCHEMA = ("encoder string, family string, seed int, grid_pos int, fold int, "
                "record_id long, p double, y int")
STATUS_SCHEMA = "encoder string, family string, seed int, grid_pos int, fold int, fitted boolean, message string"


def _fold_features(a: DataFrame, seed: int, fold: int, id_col: str, vec: str, label: str):
    """(train, validation, n_train, k): PCA features fitted on the training side."""
    mine = a.filter(F.col("seed") == seed)
    tr, _ = sized_for_fit(mine.filter(F.col("fold") != fold), vec)
    va = mine.filter(F.col("fold") == fold)
    stages = Pipeline(stages=[PopulationStandardScaler(inputCol="features", outputCol="_z"),
                              PCAByVariance(inputCol="_z", outputCol="_pc")]).fit(as_features(tr, vec))
    k = stages.stages[-1].n_components_

    def project(df: DataFrame) -> DataFrame:
        return (stages.transform(as_features(df, vec))
                      .select(F.col(id_col).cast("long").alias("record_id"), F.col(label).cast("int").alias("y"),
                              F.col(label).cast("double").alias("label"), F.col("_pc").alias("features"))
                      .persist(StorageLevel.MEMORY_AND_DISK))
    ptr, pva = project(tr), project(va)
    return ptr, pva, ptr.count(), k


def _rbf_gamma(value, train: DataFrame, k: int) -> float:
    if value == "auto":
        return 1.0 / k
    if value == "scale":       # 1 / (k * variance of all training feature values): one scalar
        var = train.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0]
        return 1.0 / (k * var) if var else 1.0 / k
    return float(value)


def _fit_scores(family: str, params: dict, train: DataFrame, valid: DataFrame, n: int, k: int,
                seed: int) -> DataFrame:
    """Validation rows (record_id, y, p) of one fitted setting."""
    if family == "SVM-RBF":
        gamma = _rbf_gamma(params["gamma"], train, k)

        def lift(df: DataFrame) -> DataFrame:
            a = df.withColumn("_x", vector_to_array("features"))
            a = random_fourier_features(a, k, gamma, RFF_FEATURES, seed, vec="_x", out="_x")
            return a.withColumn("features", array_to_vector("_x")).drop("_x")
        train, valid = lift(train), lift(valid)
        est = LinearSVC(regParam=1.0 / (float(params["C"]) * n), standardization=False, maxIter=1000)
    else:
        est = classifier(family, params, n, seed)
    model = est.fit(train)
    if family in ("SVM-RBF", "SVM-Linear"):
        def margins(df: DataFrame) -> DataFrame:
            return model.transform(df).select("record_id", "y", vector_to_array("rawPrediction")[1].alias("p"))
        cal = platt(margins(train))
        return margins(valid).select("record_id", "y", cal(F.col("p")).alias("p"))
    return model.transform(valid).select("record_id", "y", vector_to_array("probability")[1].alias("p"))


def model_sweep(train: DataFrame, grid: Sequence[tuple[str, int, str]], encoder: str = "given",
                seeds: Sequence[int] = CV_SEEDS, k: int = CV_FOLDS, id_col: str = "record_id",
                vec: str = "embedding", label: str = "y", parallelism: int = SWEEP_PARALLELISM,
                out_dir: str | None = None) -> DataFrame:
    """Validation scores of every setting in ``grid`` ((family, grid_pos, params
    JSON) rows, e.g. :func:`selection.grid_rows`) for each seed and fold."""
    spark = train.sparkSession
    out_dir = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"sweep-{uuid.uuid4().hex}")
    a = stratified_kfold(train.select(id_col, vec, label), label, id_col, k, seeds) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    _claim(train.select(id_col, vec, label), f"{encoder}, {k} folds", out_dir)
    # one row a fit: bounded by the grid, the seeds and the folds
    done = {(r.family, r.seed, r.grid_pos, r.fold) for r in sweep_status(spark, out_dir).collect()}

    def run(job):
        fam, pos, js, seed, fold, ptr, pva, n, kk = job
        name = f"{fam.replace(' ', '_')}-{pos}-{seed}-{fold}"
        try:
            s = _fit_scores(fam, json.loads(js), ptr, pva, n, kk, seed)
        except (IllegalArgumentException, ValueError) as e:  # the estimator rejects the setting
            s, message = None, str(e)
        if s is not None:
            (s.select(F.lit(encoder).alias("encoder"), F.lit(fam).alias("family"), F.lit(seed).alias("seed"),
                      F.lit(pos).alias("grid_pos"), F.lit(fold).alias("fold"), "record_id", "p", "y")
              .write.mode("overwrite").parquet(os.path.join(out_dir, "scores", f"fit={name}")))
        row = (encoder, fam, seed, pos, fold, s is not None, None if s is not None else message)
        spark.createDataFrame([row], STATUS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(out_dir, "status", f"fit={name}"))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for seed in seeds:
            # the k folds of one seed are in flight together (k persisted copies
            # of the training rows at most), then released
            open_jobs = {fold: [g for g in grid if (g[0], seed, g[1], fold) not in done] for fold in range(k)}
            feats = [(fold, *_fold_features(a, seed, fold, id_col, vec, label)) for fold in range(k) if open_jobs[fold]]
            jobs = [(fam, pos, js, seed, fold, ptr, pva, n, kk) for fold, ptr, pva, n, kk in feats for fam, pos, js in open_jobs[fold]]
            list(pool.map(run, jobs))
            for _, ptr, pva, _, _ in feats:
                ptr.unpersist()
                pva.unpersist()
    a.unpersist()
    scores = _read(spark, os.path.join(out_dir, "scores"), SCORE_SCHEMA)
    # scores whose log row is missing belong to a fit that was cut off and made again, or
    # to settings outside this grid
    asked = spark.createDataFrame([(f, p) for f, p, _ in grid], "family string, grid_pos int").distinct()
    kept = sweep_status(spark, out_dir).filter("fitted").filter(F.col("seed").isin(*map(int, seeds))) \
        .join(F.broadcast(asked), ["family", "grid_pos"]).select("encoder", "family", "seed", "grid_pos", "fold")
    return scores.join(F.broadcast(kept), ["encoder", "family", "seed", "grid_pos", "fold"], "left_semi")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _claim(rows: DataFrame, terms: str, out_dir: str) -> None:
    """Notes the training rows of a new folder, or compares them with those noted."""
    spark, path = rows.sparkSession, os.path.join(out_dir, "rows")
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hashes")) \
              .withColumn("terms", F.lit(terms))
    before = _read(spark, path, "n long, hashes string, terms string").first()
    if before is None:
        own.write.mode("overwrite").parquet(path)
    elif own.first() != before:
        raise ValueError(f"{out_dir} holds the sweep of other rows, another encoder or other folds")


def sweep_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per fit of the sweep written to ``out_dir``: whether its setting was
    fitted, else the estimator's message."""
    return _read(spark, os.path.join(out_dir, "status"), STATUS_SCHEMA)
