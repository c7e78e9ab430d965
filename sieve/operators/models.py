"""Classifier families and the standardise -> PCA -> classifier pipeline.

Two execution paths, chosen by training-set size:

* **distributed fit** (any size): a Spark ML ``Pipeline`` of population-sd
  scaler, PCA-by-variance and a Spark ML classifier; one distributed job per
  model.
* **many small fits** (training rows per model under ``SMALL_FIT_MAX_ROWS``):
  thousands of small linear pipelines (bootstrap replicates, CV folds, a C grid)
  are fitted side by side with ``groupBy(model key).applyInPandas``; each group
  is one model's training rows and returns only the fitted map.  Because
  standardise -> PCA -> logistic regression is linear up to the sigmoid, each
  model collapses to ``(u, b)`` with ``logit = u . x + b``; scoring is then a
  JVM-side join of the score rows with the (models x dim) table.

The C-parameterised penalty maps to Spark's ``regParam = 1 / (C * n)`` with
``standardization=False`` (same optimum for the L2 objective).
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot
from .features import PCA_VARIANCE, PCAByVariance, PopulationStandardScaler

# --- fixed values -----------------------------------------------------------
BEST_C = 0.001                  # selected model: L2 logistic regression, C = 0.001
PLATT_FOLDS = 5                 # inner folds of a probability fit
MAX_DEPTH_NONE = 30             # "no depth limit" mapped to Spark's deepest tree
SMALL_FIT_MAX_ROWS = 200_000    # rows per model for the many-small-fits path
# ---------------------------------------------------------------------------

FIT_PARTITION_BYTES = 64 << 20  # vector bytes per partition for iterative distributed fits


def sized_for_fit(df: DataFrame, vec: str = "embedding") -> tuple[DataFrame, int]:
    """Training rows in as many partitions as their size needs, never more than
    they already have (``coalesce``: no shuffle), and their count.

    Iterative Spark ML solvers run one job per iteration over every partition; a
    few hundred rows spread over the shuffle partitions spend most of each
    iteration on task overhead, while a large training set keeps its partitions.
    """
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, d = int(r["n"]), int(r["d"] or 1)
    parts = max(1, min(df.rdd.getNumPartitions(), math.ceil(n * d * 8 / FIT_PARTITION_BYTES)))
    return df.coalesce(parts), n



def as_features(df: DataFrame, vec: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec)))


def classifier(family: str, params: dict, n: int, seed: int = 42):
    """Spark ML estimator for one setting of a family (features -> label)."""
    if family == "Logistic Regression":
        l1 = params.get("penalty") == "l1"
        return LogisticRegression(regParam=1.0 / (float(params["C"]) * n), elasticNetParam=1.0 if l1 else 0.0,
                                  standardization=False, maxIter=int(params.get("max_iter", 2000)), tol=1e-8)
    if family == "Random Forest":
        depth = params.get("max_depth")
        # a node of fewer than min_samples_split rows isn't split: with leaves of at
        # least half as many rows none can be
        leaf = max(int(params["min_samples_leaf"]), math.ceil(int(params.get("min_samples_split", 2)) / 2))
        return RandomForestClassifier(numTrees=int(params["n_estimators"]),
                                      maxDepth=MAX_DEPTH_NONE if depth is None else int(depth),
                                      minInstancesPerNode=leaf, seed=seed)
    if family == "XGBoost":
        cb = float(params["colsample_bytree"])
        return GBTClassifier(maxIter=int(params["n_estimators"]), maxDepth=int(params["max_depth"]),
                             stepSize=float(params["learning_rate"]), subsamplingRate=float(params["subsample"]),
                             featureSubsetStrategy="all" if cb >= 1.0 else str(cb), seed=seed)
    if family == "SVM-Linear":
        return LinearSVC(regParam=1.0 / (float(params["C"]) * n), standardization=False, maxIter=1000)
    raise ValueError(f"no distributed estimator for {family}")


def fit_pipeline(train: DataFrame, family: str = "Logistic Regression", params: dict | None = None,
                 vec: str = "embedding", label: str = "y", seed: int = 42, variance: float = PCA_VARIANCE):
    """Fit standardise -> PCA(variance) -> classifier on ``train`` only."""
    params = params or {"C": BEST_C, "penalty": "l2"}
    train, n = sized_for_fit(train, vec)
    d = as_features(train, vec).withColumn("label", F.col(label).cast("double"))
    stages = [PopulationStandardScaler(inputCol="features", outputCol="_z"),
              PCAByVariance(inputCol="_z", outputCol="_pc", varianceRatio=variance)]
    clf = classifier(family, params, n, seed).setFeaturesCol("_pc").setLabelCol("label")
    return Pipeline(stages=stages + [clf]).fit(d)


def positive_score(model, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Positive-class probability (or margin for margin-only models) as ``p``."""
    out = model.transform(as_features(df, vec))
    col = "probability" if "probability" in out.columns else "rawPrediction"
    keep = [c for c in df.columns if c != vec]
    return out.select(*keep, vector_to_array(col)[1].alias("p"))


def platt(margins: DataFrame, score: str = "p", label: str = "y", max_iter: int = 100):
    """Platt scaling: logistic fit of the label on the margin; returns a function
    mapping a margin column to a probability column."""
    d = margins.select(array_to_vector(F.array(F.col(score))).alias("features"),
                       F.col(label).cast("double").alias("label"))
    m = LogisticRegression(regParam=0.0, maxIter=max_iter).fit(d)
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * c + F.lit(b))))


def inner_margins(train: DataFrame, fit, score, k: int = PLATT_FOLDS, id_col: str = "record_id", label: str = "y", vec: str = "embedding", seed: int = 42) -> DataFrame:
    """(record_id, y, p): each training row's margin from a model that did not see it.

    The training rows are dealt into ``k`` inner folds by label (ids and labels only);
    ``fit(rows)`` on the others gives the model, ``score(model, rows)`` the margins.
    The fits run side by side (a bounded pool of jobs).  With fewer than ``k`` rows of a
    class there are as many folds as the rarer class has rows; with less than two
    nothing can be held back and the margins are those of the training rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..session import cut_lineage
    from .split import stratified_kfold
    sizes = [r["count"] for r in train.groupBy(label).count().collect()]      # one row a class
    k = min(k, *sizes) if len(sizes) > 1 else 1
    rows = train.select(id_col, vec, label)
    if k < 2:
        return score(fit(rows), rows)
    folds = stratified_kfold(train.select(id_col, label), label, id_col, k=k, seeds=(seed,)).select(id_col, "fold")
    dealt = cut_lineage(rows.join(folds, id_col))

    def one(i: int) -> DataFrame:
        part = dealt.filter(F.col("fold") != i).drop("fold")
        return score(fit(part), dealt.filter(F.col("fold") == i).drop("fold")).select(id_col, label, "p")

    with ThreadPoolExecutor(min(k, PLATT_FOLDS)) as pool:
        parts = list(pool.map(one, range(k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fit_rff_svm(train: DataFrame, c: float = 1.0, vec: str = "embedding"):
    """standardise -> PCA -> random Fourier features (gamma = 1 / (components x
    variance)) -> linear SVM; gives a function from rows to rows with the margin ``p``."""
    scaler = PopulationStandardScaler(inputCol="features", outputCol="z").fit(as_features(train, vec))
    pca = PCAByVariance(inputCol="z", outputCol="pc").fit(scaler.transform(as_features(train, vec)))

    def proj(df: DataFrame) -> DataFrame:
        return pca.transform(scaler.transform(as_features(df, vec))).select("record_id", "y", vector_to_array("pc").alias("x"))

    own = proj(train)
    var = own.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]      # one scalar
    gamma = 1.0 / (pca.n_components_ * var) if var else 1.0 / pca.n_components_
    rows, n = sized_for_fit(random_fourier_features(own, pca.n_components_, gamma, vec="x", out="x"), "x")
    svm = LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=1000).fit(
        rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")))

    def margin(df: DataFrame) -> DataFrame:
        x = random_fourier_features(proj(df), pca.n_components_, gamma, vec="x", out="x")
        return svm.transform(x.select("record_id", "y", array_to_vector("x").alias("features"))).select("record_id", "y", vector_to_array("rawPrediction")[1].alias("p"))
    return margin


def random_fourier_features(df: DataFrame, d_in: int, gamma: float, n_features: int = 200, seed: int = 42,
                            vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """RBF kernel approximation z = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    W is D x d_in numbers fixed by the seed (bounded by the parameters, not the
    data) and applied per Arrow batch with one matrix product."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, d_in))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    @F.pandas_udf("array<double>")
    def rff(s: pd.Series) -> pd.Series:
        x = np.vstack(s.to_numpy()) if len(s) else np.zeros((0, d_in))
        z = scale * np.cos(x @ w.T + b)
        return pd.Series(list(z))
    return df.withColumn(out, rff(F.col(vec)))


# --------------------------------------------------------------------------- many small fits
def _logreg_newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, iters: int = 100) -> tuple[np.ndarray, float]:
    """min  C * sum_i w_i logloss_i + 0.5 ||beta||^2  (intercept not penalised)."""
    n, k = x.shape
    xa = np.hstack([x, np.ones((n, 1))])
    beta = np.zeros(k + 1)
    reg = np.eye(k + 1)
    reg[k, k] = 0.0
    for _ in range(iters):
        z = xa @ beta
        p = 1.0 / (1.0 + np.exp(-z))
        g = c * (xa.T @ (w * (p - y))) + reg @ beta
        h = c * (xa.T * (w * p * (1 - p))) @ xa + reg
        step = np.linalg.solve(h + 1e-12 * np.eye(k + 1), g)
        beta -= step
        if np.max(np.abs(step)) < 1e-10:
            break
    return beta[:k], float(beta[k])


def _components(cov: np.ndarray, variance: float) -> tuple[np.ndarray, int]:
    """The leading eigenvectors that hold the wanted share of the variance, and their number."""
    ev, vecs = np.linalg.eigh(cov)
    order = np.argsort(ev)[::-1]
    ev, vecs = np.clip(ev[order], 0.0, None), vecs[:, order]
    ratio = ev / ev.sum() if ev.sum() > 0 else np.ones_like(ev) / len(ev)
    k = int(np.searchsorted(np.cumsum(ratio), variance, side="right") + 1)
    k = min(k, len(ev))
    return vecs[:, :k], k


def _standardise_pca(x: np.ndarray, w: np.ndarray, variance: float = PCA_VARIANCE):
    """Weighted standardise (population sd) -> PCA(variance): (features, mu, sd, v, k)."""
    sw = w.sum()
    mu = (w[:, None] * x).sum(0) / sw
    xc = x - mu
    sd = np.sqrt((w[:, None] * xc * xc).sum(0) / sw)
    sd[sd == 0] = 1.0
    z = xc / sd
    v, k = _components((w[:, None] * z).T @ z / (sw - 1.0), variance)
    return z @ v, mu, sd, v, k


def _collapse(coef: np.ndarray, b0: float, mu: np.ndarray, sd: np.ndarray, v: np.ndarray):
    u = (v @ coef) / sd
    return u, b0 - float(u @ mu)


def linear_pipeline_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float,
                        variance: float = PCA_VARIANCE) -> tuple[np.ndarray, float, int]:
    """Weighted standardise (population sd) -> PCA(variance) -> L2 logistic
    regression, collapsed to logit = u . x + b.  Weights are draw counts."""
    f, mu, sd, v, k = _standardise_pca(x, w, variance)
    coef, b0 = _logreg_newton(f, y, w, c)
    u, b = _collapse(coef, b0, mu, sd, v)
    return u, b, k


def collapse_pipeline(model) -> tuple[np.ndarray, float, int]:
    """A fitted population-sd scaler -> PCA -> logistic regression pipeline as
    ``logit = u . x + b`` (each stage is affine).  A zero-variance input column
    scales to 0, so its weight is 0."""
    scaler, pca, lr = model.stages
    sm, ep = scaler.stages
    mean, std = sm.mean.toArray(), sm.std.toArray()
    f = ep.getScalingVec().toArray()
    w = pca.pc.toArray() @ lr.coefficients.toArray()
    scale = np.divide(f, std, out=np.zeros_like(std), where=std != 0)
    u = w * scale
    return u, float(lr.intercept) - float(u @ mean), int(pca.pc.numCols)


def _fit_linear_distributed(rows: DataFrame, keys: list[str], c_col: str | None, c: float, vec: str,
                            label: str, weight: str | None, pipeline: bool) -> DataFrame:
    """One distributed Spark ML fit per model key, collapsed to (u, b).

    The model keys (replicates, folds, grid points) are fixed by parameters, so
    their list and the fitted coefficients (models x dim numbers) are small; the
    training rows never leave the executors.  Draw counts become repeated rows,
    since Spark's scaler and PCA take no weights.
    """
    spark = rows.sparkSession
    key_rows = rows.select(*keys, *([c_col] if c_col else [])).distinct().collect()
    out = []
    for kr in key_rows:
        part = rows.filter(reduce(lambda a, b_: a & b_, [F.col(k) == F.lit(kr[k]) for k in keys]))
        if weight:
            part = part.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col(weight).cast("int")))) \
                       .drop("_copy")
        cc = float(kr[c_col]) if c_col else c
        if pipeline:
            n = part.count()
            u, b, k = collapse_pipeline(fit_pipeline(part, params={"C": cc, "penalty": "l2"}, vec=vec, label=label))
        else:
            part, n = sized_for_fit(part, vec)
            d = as_features(part, vec).withColumn("label", F.col(label).cast("double"))
            lr = classifier("Logistic Regression", {"C": cc, "penalty": "l2"}, n).fit(d)
            u, b, k = lr.coefficients.toArray(), float(lr.intercept), lr.numFeatures
        out.append(tuple(kr[k_] for k_ in keys) + ([float(x) for x in u], float(b), int(k), int(n)))
    schema = ", ".join([f"{k} {t}" for k, t in rows.select(*keys).dtypes]) + \
        ", u array<double>, b double, k int, n long"
    return spark.createDataFrame(out, schema)


def fit_linear_many(rows: DataFrame, keys: list[str], c_col: str | None = None, c: float = BEST_C,
                    vec: str = "embedding", label: str = "y", weight: str | None = None,
                    pipeline: bool = True, small_rows: int = SMALL_FIT_MAX_ROWS,
                    c_grid: list[tuple[int, float]] | None = None) -> DataFrame:
    """Fit one linear pipeline per ``keys`` group of training rows.

    Returns (keys..., u array<double>, b double, k int, n long).  Each group is
    one model's training set.  When every group has at most ``small_rows`` rows
    (checked first), all models are fitted side by side, one group per task;
    otherwise each model is one distributed Spark ML fit.

    ``c_grid`` ((grid_pos, C) pairs, a fixed parameter list) fits every C of the
    grid on each group's rows, adding ``grid_pos`` to the keys: the rows are
    shipped once and standardised / projected once per group, not once per C.
    """
    if c_grid is not None:
        grid = F.array(*[F.struct(F.lit(int(pos)).alias("grid_pos"), F.lit(float(cv)).alias("_C"))
                         for pos, cv in c_grid])
    big = rows.groupBy(*keys).count().filter(F.col("count") > small_rows).limit(1).count()
    if big:
        if c_grid is not None:        # one distributed fit per (group, C)
            rows = rows.select("*", F.explode(grid).alias("_g")).select("*", "_g.grid_pos", "_g._C").drop("_g")
            return _fit_linear_distributed(rows, keys + ["grid_pos"], "_C", c, vec, label, weight, pipeline)
        return _fit_linear_distributed(rows, keys, c_col, c, vec, label, weight, pipeline)
    cols = keys + [vec, label] + ([weight] if weight else []) + ([c_col] if c_col else [])
    out_keys = keys + (["grid_pos"] if c_grid is not None else [])
    schema = ", ".join([f"{k} {t}" for k, t in rows.select(*keys).dtypes]) + \
        (", grid_pos int" if c_grid is not None else "") + ", u array<double>, b double, k int, n long"
    settings = [(int(pos), float(cv)) for pos, cv in c_grid] if c_grid is not None else [(None, None)]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
        y = pdf[label].to_numpy().astype(np.float64)
        w = pdf[weight].to_numpy().astype(np.float64) if weight else np.ones(len(y))
        if pipeline:
            feats, mu, sd, v, k = _standardise_pca(x, w)          # once per group
        out = {kk: [] for kk in out_keys}
        out.update({"u": [], "b": [], "k": [], "n": []})
        for pos, cv in settings:
            cc = cv if cv is not None else (float(pdf[c_col].iloc[0]) if c_col else c)
            if pipeline:
                coef, b0 = _logreg_newton(feats, y, w, cc)
                u, b = _collapse(coef, b0, mu, sd, v)
            else:                                   # plain logistic regression on the raw features
                u, b = _logreg_newton(x, y, w, cc)
                k = x.shape[1]
            for kk in keys:
                out[kk].append(pdf[kk].iloc[0])
            if pos is not None:
                out["grid_pos"].append(pos)
            out["u"].append(u.tolist())
            out["b"].append(b)
            out["k"].append(k)
            out["n"].append(int(w.sum()))
        return pd.DataFrame(out)
    return rows.select(*cols).groupBy(*keys).applyInPandas(fit, schema)


def score_linear(models: DataFrame, rows: DataFrame, on: list[str], vec: str = "embedding",
                 carry: list[str] = (), max_models: int | None = None) -> DataFrame:
    """p = sigmoid(u . x + b) for rows joined to their models on ``on``;
    ``carry`` keeps further model keys (several models per join key).

    ``max_models`` is the caller's bound on the number of models (replicates,
    folds x repeats, a parameter grid: fixed by parameters, not by the data).
    With it the model table (``max_models`` x dim numbers) is broadcast, so the
    score rows stream through the join and are never the hashed side; the
    planner's estimate alone can mistake an exploded side for a small one.
    """
    m = models.select(*on, *carry, "u", "b")
    if max_models is not None:
        m = F.broadcast(m)
    j = rows.join(m, on)
    z = dot(vec, "u") + F.col("b")
    return j.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("u", "b")


LISTED_ROWS = 256     # rows whose scores under all models a task holds at a time


def score_listed(models: DataFrame, rows: DataFrame, max_models: int, slots: str = "slots", vec: str = "embedding") -> DataFrame:
    """``rows`` once for each entry of their ``slots`` (array<int>) that has a model, as
    ``slot``, with p = sigmoid(u . x + b); ``models`` are (slot, u, b), ``max_models`` at most.

    A row travels once with its list, not once per model: a task multiplies a slice of
    rows by the whole model table, whose size is fixed by parameters.  p is null where u
    is, or where the vector is null or holds one."""
    got = models.select("slot", "u", "b").limit(max_models + 1).collect()
    if len(got) > max_models:
        raise ValueError(f"more than {max_models} models")
    own = [r for r in got if r["u"] is not None]
    dim = len(own[0]["u"]) if own else 0
    place = {r["slot"]: i for i, r in enumerate(own)}
    at = np.full(max([r["slot"] for r in got], default=-1) + 2, -2)     # the last stands for all slots beyond
    for r in got:
        at[r["slot"]] = place.get(r["slot"], -1)
    u = np.array([r["u"] for r in own], np.float64).reshape(len(own), dim)
    b = np.array([r["b"] for r in own], np.float64)
    names = rows.columns
    kept = [c for c in names if c not in (slots, vec)]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), LISTED_ROWS):
                part = batch.slice(lo, LISTED_ROWS)
                x = np.full((len(part), dim), np.nan)
                null = np.ones(len(part), bool)
                for i, v in enumerate(part.column(names.index(vec))):
                    if v.is_valid and v.values.null_count == 0 and len(v.values) == dim:
                        x[i], null[i] = v.values.to_numpy(zero_copy_only=False), False
                asked = part.column(names.index(slots))
                sizes = np.asarray(pc.fill_null(pc.list_value_length(asked), 0))
                slot = np.asarray(pc.list_flatten(asked)).astype(np.int64)
                row = np.repeat(np.arange(len(part)), sizes)
                model = at[np.where((slot >= 0) & (slot < len(at) - 1), slot, -1)]
                held = model > -2
                slot, row, model = slot[held], row[held], model[held]
                with np.errstate(over="ignore", invalid="ignore"):
                    every = 1.0 / (1.0 + np.exp(-(x @ u.T + b)))
                p = every[row, model] if len(own) else np.full(len(row), np.nan)
                off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
                lists = (pa.array(slot, pa.int32()), pa.array(p, pa.float64(), mask=(model < 0) | null[row]))
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in kept], *[pa.ListArray.from_arrays(off, x) for x in lists]], names=[*kept, "_slot", "_p"])

    fields = [rows.schema[c] for c in kept] + [T.StructField("_slot", T.ArrayType(T.IntegerType())), T.StructField("_p", T.ArrayType(T.DoubleType()))]
    scored = rows.mapInArrow(run, T.StructType(fields))
    return scored.select(*kept, F.explode(F.arrays_zip("_slot", "_p")).alias("_s")).select(*kept, F.col("_s._slot").alias("slot"), F.col("_s._p").alias("p"))


def params_of(js: str) -> dict:
    return json.loads(js)


def rank_desc(df: DataFrame, score: str = "p", id_col: str = "record_id") -> DataFrame:
    """Rank by score, highest first (ties by id), without a single-task sort."""
    from .prefix import prefix_sums
    one = df.withColumn("_one", F.lit(1).cast("long"))
    r = prefix_sums(one, [], -F.col(score), ["_one"], tie_cols=[id_col], out_prefix="_before")
    return r.withColumn("rank", F.col("_before_one") + 1).drop("_one", "_before_one")


__all__ = ["classifier", "fit_pipeline", "positive_score", "platt", "random_fourier_features",
           "fit_linear_many", "score_linear", "score_listed", "linear_pipeline_fit", "rank_desc", "Window"]
