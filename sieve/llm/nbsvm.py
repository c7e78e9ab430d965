"""Text quality by naive Bayes support vectors.

A text is the set of its n-grams: 1- to 4-grams of characters (white space runs as one
space, case and punctuation as they are) and pairs of neighbouring words, hashed to
``BUCKETS`` places; a word next to its equal counts as one common pair.  An indicator
is scaled by the log ratio of the smoothed counts of the two classes, the scaled vector
to length one, and a linear classifier is fitted to hinge loss by dual coordinate
descent in numpy (random order, box constraint 0 to C, bias as one more component).

Learned from a sample of distinct labelled texts of at most ``train_rows`` rows (the
documented bound), half of either class where there are so many, chosen by a hash of the
text; class counts for the prior are those of all distinct labelled texts.  The sample is
cut into ``FOLDS``; the margins of a fold come from a fit without it, ratios included,
and a logistic curve through them, weighted to the prior, gives the score.  One more fit
of the whole sample gives the margins that are scored.

Texts are read whole.  Defined results: null or empty text has no n-gram and the score of
the bias; labels other than 0 and 1 are not learned from; a text with both labels counts
in both classes; without labels of both classes every score is the share of class 1 (0.5
without any); a null doc_id is not held out; repeated rows are scored alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_slices, cut_lineage, whole_text
from .langid import held_out

BUCKETS = 1 << 18
ORDERS = (1, 2, 3, 4)
TRAIN_ROWS = 4000
FOLDS, EPOCHS, BOUND = 5, 12, 1.0
SMOOTH = 1.0
CALL = 0.7
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def grams(text: str) -> np.ndarray:
    """The distinct places of the text's n-grams, ascending."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.concatenate([_SPACES[-1:], code, _SPACES[-1:]])
    gap = np.isin(code, _SPACES)
    keep = ~(gap & np.concatenate([[False], gap[:-1]]))
    code, gap = np.where(gap, np.uint32(32), code)[keep], gap[keep]
    if gap.all():
        return np.empty(0, np.int32)
    mixed = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(14)).astype(np.int32)
    out, h = [], np.full(len(code), 2_166_136_261, np.uint32)
    for n in ORDERS:
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(16_777_619)
        out.append(mixed(h + np.uint32(n)))
    # word hashes: sums of powers over the letters between two gaps
    at = np.flatnonzero(gap)
    powers = (code + np.uint32(1)) * np.uint32(0x85EBCA6B)
    powers ^= powers >> np.uint32(13)
    place = (np.arange(len(code)) - at[np.searchsorted(at, np.arange(len(code)), side="right") - 1]).astype(np.uint32)
    sums = np.add.reduceat(powers * (place * np.uint32(2) + np.uint32(0xC2B2AE35)), at[:-1], dtype=np.uint32)
    pair = np.where(sums[:-1] == sums[1:], np.uint32(7), sums[:-1] * np.uint32(31) + sums[1:])
    out.append(mixed(pair ^ np.uint32(0x27D4EB2F)))
    return np.unique(np.concatenate(out))


def log_ratios(bags: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    count = [np.full(BUCKETS, SMOOTH) for _ in range(2)]
    for own, y in zip(bags, label, strict=True):
        count[y][own] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, bound: float = BOUND, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + bound * sum of hinge losses: one dual
    variable at a time goes to its optimum within [0, bound].  ``rows``: (places, values)."""
    w, b = np.zeros(BUCKETS), 0.0
    sign = np.where(label == 1, 1.0, -1.0)
    dual = np.zeros(len(rows))
    square = np.array([v @ v for _, v in rows]) + 1.0  # the bias component is 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (v @ w[at] + b) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), bound)
            step = (new - dual[i]) * sign[i]
            if step:
                w[at] += step * v
                b += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


@dataclass
class Model:
    weight: np.ndarray  # by place: svm weight times log ratio
    square: np.ndarray  # by place: the log ratio's square
    bias: float
    slope: float
    level: float

    def margin(self, own: np.ndarray) -> float:
        length = float(self.square[own].sum()) ** 0.5
        return float(self.weight[own].sum()) / length + self.bias if length else self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(grams(text or "")) + self.level
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_margins(bags: list[np.ndarray], label: np.ndarray, **options) -> Model:
    """Without calibration."""
    ratio = log_ratios(bags, label)
    rows = []
    for own in bags:
        v = ratio[own]
        length = float(v @ v) ** 0.5
        rows.append((own, v / length) if length else (own[:0], v[:0]))
    w, b = hinge_fit(rows, label, **options)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), b, 1.0, 0.0)


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of a weighted logistic curve, by Newton steps; the targets are
    drawn in from 0 and 1 by a pseudo-count, so separable margins have a finite curve."""
    up, down = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    beta = np.array([1.0, np.log((up + 1) / (down + 1))])
    x = np.stack([margin, np.ones(len(margin))], axis=1)

    def loss(beta):
        z = x @ beta
        return float(weight @ (np.logaddexp(0, z) - target * z))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p) + 1e-12)[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-8:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(bags: list[np.ndarray], label: np.ndarray, class_rows: tuple[int, int], **options) -> Model:
    """``class_rows``: rows of class 0 and 1 that the sample stands for."""
    share = np.array(class_rows, float)
    if not share.all():
        level = 0.0 if not share.any() else float(np.log((share[1] + 1e-9) / (share[0] + 1e-9)))
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, level)
    fold = np.zeros(len(bags), int)
    for y in (0, 1):  # each fold holds its share of either class
        fold[label == y] = np.arange(int((label == y).sum())) % FOLDS
    margin = np.zeros(len(bags))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        if len(set(label[rest])) < 2:  # too few rows to hold any back
            rest = np.arange(len(bags))
        model = fit_margins([bags[i] for i in rest], label[rest], **options)
        for i in np.flatnonzero(fold == k):
            margin[i] = model.margin(bags[i])
    weight = (share / np.bincount(label, minlength=2))[label]
    whole = fit_margins(bags, label, **options)
    whole.slope, whole.level = logistic(margin, label, weight * len(bags) / weight.sum())
    return whole


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, h, label) of at most ``rows`` distinct labelled texts, and how many
    distinct texts each class has in all."""
    own = docs.select("doc_id", F.xxhash64(whole_text()).alias("h"))
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").distinct()
    keys = cut_lineage(own.join(marked, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")))
    many = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = (many.get(0, 0), many.get(1, 0))
    want = (min(many[0], max(rows // 2, rows - many[1])), min(many[1], max(rows // 2, rows - many[0])))
    # a bound on the hash keeps a little more than wanted; only those are put in order
    drawn = F.xxhash64("h", F.lit(1))
    share = [min(1.0, (n * 1.2 + 100) / max(1, m)) for n, m in zip(want, many, strict=True)]
    near = keys.withColumn("turn", F.pmod(drawn, F.lit(1 << 30))).filter(F.col("turn") < F.when(F.col("label") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    place = F.row_number().over(Window.partitionBy("label").orderBy("turn", "h"))
    few = near.withColumn("place", place).filter(F.col("place") <= F.when(F.col("label") == 1, want[1]).otherwise(want[0]))
    return few.select("doc_id", "h", "label"), many


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> Model:
    """Features are made where the texts lie; one task fits the bounded sample."""
    few, many = sample(docs, labels, rows)
    text = whole_text()
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(few), ["doc_id", "h"]).select("label", "h", "text")

    def featured(batches):
        for batch in batches:
            for part, texts in column_slices(batch, "text"):
                bags = [grams(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bags, pa.list_(pa.int32()))], names=["label", "h", "places"])

    def learn(found):
        import pandas as pd

        # a doc_id may hold a text twice
        own = found.sort_values(["label", "h"]).drop_duplicates(["label", "h"])
        model = train(list(own["places"]), own["label"].to_numpy(int), many, **options)
        return pd.DataFrame({"model": [pickle.dumps(model.__dict__)]})

    bags = texts.mapInArrow(featured, "label int, h long, places array<int>")
    got = bags.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "model binary").collect()
    return Model(**pickle.loads(got[0][0])) if got else train([], np.empty(0, int), (0, 0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score; the model's two arrays of ``BUCKETS`` floats are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model.__dict__)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        own = Model(**held.value)
        return pd.Series([own.score(t) for t in text], dtype=float)

    return docs.withColumn("score", scored("text"))


def judge(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, call: float = CALL) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    own = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = fit(own.filter(~F.col("held_out")), labels, rows)
    return predict(own, model).select("doc_id", "held_out", "score", (F.col("score") >= call).cast("int").alias("predicted"))
