"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the bag of its letter 2- to 4-grams within words (a boundary mark at
either end of a word), hashed to ``BUCKETS`` rows of an embedding table; the mean
of the rows goes through a linear softmax.  Table and softmax are trained together
by stochastic gradient descent in numpy on a sample of distinct labelled texts of
at most ``train_rows`` rows (the documented bound), drawn evenly over the labels
by a hash of the text.  A part of the sample is kept out of the training: on it
the temperature of the softmax is fitted, and the score below which a prediction
is rejected is set so that all but ``reject_rate`` of its right predictions stay.

Texts are read whole; sums over n-grams are taken in stretches of about ``STRETCH``
characters, which end behind a character that is no letter, so that no n-gram changes.

Defined results: null text, and text without a letter, is ``und`` with score 0 and
rejected; without any labelled row every text is ``und``; rows whose label is null
are not learned from; repeated rows are predicted alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_slices, cut_lineage, worker_state

BUCKETS, DIM = 1 << 14, 16
ORDERS = (2, 3, 4)
TRAIN_ROWS = 4000
EPOCHS, RATE = 12, 0.5
REJECT_RATE = 0.001
UND = "und"
STRETCH = 1_000_000
PART_BITS = 12


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the first plane, 32 for all else."""
    table = np.full(65_536, 32, np.uint32)
    for c in range(65_536):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 65_536 else c
    return table


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the text's letter n-grams; empty without a letter."""
    table = worker_state("letters", _letters)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) and code.max() > 65_535:  # letters of higher planes count as they are
        low = np.where(code < 65_536, table[np.minimum(code, 65_535)], 32)
        high = np.flatnonzero(code > 65_535)
        low[high] = [c if chr(c).isalpha() else 32 for c in code[high].tolist()]
    else:
        low = table[code]
    low = np.concatenate([[32], low, [32]]).astype(np.uint32)
    gap = low == 32
    low = low[~(gap & np.concatenate([[False], gap[:-1]]))]
    gap = low == 32
    if gap.all():
        return np.empty(0, np.int64)
    out = []
    for n in ORDERS:
        m = len(low) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ low[i : i + m]) * np.uint32(16_777_619)
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= gap[i : i + m]
        h ^= h >> np.uint32(15)
        out.append((h[~inner] * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64))
    return np.concatenate(out)


def stretches(text: str) -> Iterator[str]:
    """The text in parts that end behind a character other than a letter (a longer word stays whole)."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages): embedding rows already through the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray | None:
        """None without a letter."""
        total, n = np.zeros(len(self.langs)), 0
        for part in stretches(text):
            own = grams(part)
            if len(own):
                total += np.bincount(own, minlength=len(self.table)) @ self.table
                n += len(own)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return UND, 0.0
        z = z / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def train(texts: list[str], labels: list[str], buckets: int = BUCKETS, dim: int = DIM, reject_rate: float = REJECT_RATE, seed: int = 7) -> Model:
    """SGD over single texts; every fifth text is held back for the calibration."""
    langs = sorted(set(labels))
    bags = []
    for t, y in zip(texts, labels, strict=True):
        own = np.concatenate([np.empty(0, np.int64), *map(grams, stretches(t))])
        if len(own):
            idx, n = np.unique(own, return_counts=True)
            bags.append((idx, (n / n.sum()).astype(np.float32), langs.index(y)))
    if not bags or len(langs) < 2:
        return Model(langs, np.zeros((buckets, len(langs)), np.float32), np.zeros(len(langs)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = bags[::5] if len(bags) >= 20 else bags
    fit = [b for i, b in enumerate(bags) if i % 5] if len(bags) >= 20 else bags
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    step, steps = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            idx, w, y = fit[i]
            rate = RATE * (1 - step / steps)
            mean = w @ emb[idx]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            emb[idx] -= rate * len(idx) ** 0.5 * np.outer(w, back)
            step += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(float), 1.0, 0.0)
    z = np.array([w @ model.table[idx] + model.bias for idx, w, _ in held])
    y = np.array([b[2] for b in held])

    def chances(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = min(np.geomspace(0.2, 5, 60), key=lambda t: -np.log(chances(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = chances(model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    # an even softmax over the languages is what a text of none of them gets at best
    model.reject_below = float(min(right[int(reject_rate * len(right))] if len(right) else 0.0, 0.9)) * 0.75
    return model


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` distinct labelled texts, as many of each label as of any
    other where they have so many, in the order of a hash of the text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # copies of a text count once; the aggregate moves hashes, not texts, and is read twice below
    keys = known.groupBy("lang", F.xxhash64("text").alias("_h")).agg(F.min("doc_id").alias("doc_id"))
    keys = cut_lineage(keys.withColumn("_part", F.shiftright("_h", 64 - PART_BITS)))
    # the part of the hash range that holds a label's first rows, so that none is sorted whole in one task
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = keys.groupBy("lang", "_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    near = keys.join(counts.filter(F.col("_before") < rows).select("lang", "_part"), ["lang", "_part"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    few = near.withColumn("_turn", turn).filter(F.col("_turn") <= rows).orderBy("_turn", "lang").limit(rows)
    few = cut_lineage(few.select("doc_id", "lang"))
    return known.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, **options) -> Model:
    """Trains in one task on the bounded sample; the model comes to the driver."""
    import pickle

    def learn(texts):
        own = texts.sort_values(["doc_id", "lang"])
        import pandas as pd

        return pd.DataFrame({"model": [pickle.dumps(train(own["text"].tolist(), own["lang"].tolist(), **options).__dict__)]})

    got = sample(docs, rows).groupBy(F.lit(0).alias("one")).applyInPandas(learn, "model binary").collect()
    return Model(**pickle.loads(got[0][0])) if got else Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def judged(text):
        got = []
        for _, some in column_slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
            got += [model.predict(t) for t in some]
        lang, score = (pa.array([g[i] for g in got], kind) for i, kind in ((0, pa.string()), (1, pa.float64())))
        out = pa.array([g[0] == UND or g[1] < model.reject_below for g in got], pa.bool_())
        return pa.StructArray.from_arrays([lang, score, out], names=["lang_pred", "score", "rejected"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.withColumn("_judged", judged("text")).select(*names, "_judged.*")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected); a null doc_id is not held out."""
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = fit(own.filter(~F.col("held_out")), rows)
    return predict(own.select("doc_id", "held_out", "text"), model).drop("text")


def keep_known(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that a model of all labelled ones doesn't reject."""
    judged = predict(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), fit(docs, rows))
    return judged.filter(~F.col("rejected")).select("_row.*")
