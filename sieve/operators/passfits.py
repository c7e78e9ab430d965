"""Many standardise -> PCA -> logistic regression fits by passes over the rows.

The rows stand once, each with the list ``slots`` of the models it trains (and, if
wanted, its weight in each: draw counts).  What a fit needs of the rows adds up: the
moments of every model in a first pass (weighted counts, sums and products), then the
gradient and the curvature of each Newton step.  A task sums them up for a slice of
rows at a time with one matrix product for all models, and hands on one row a model;
those are added up and solved in one group a model.  No row is copied for a model, and a task
holds models x dim x dim numbers whatever the number of rows.

The steps are those of ``models.linear_pipeline_fit``: Newton from zero on the PCA
output.  That output is affine in the row, so a step's sums are taken on the rows
themselves and carried over by the model's own map.  Rows are shifted by the mean of
all of them, which keeps the products exact enough for columns far from 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .features import PCA_VARIANCE
from .models import BEST_C, _components

SLICE_NUMBERS = 2_000_000       # products of a slice of rows that a task holds at a time
TASK_FLOPS = 2_000_000_000      # work of a pass that is worth a task of its own
NEWTON_STEPS = 100
NEWTON_TOL = 1e-10


def _slices(batches, dim: int, shift: np.ndarray, n_slots: int):
    """(x with a column of ones, y, weight in each slot) of a slice of rows at a time."""
    many = max(1, SLICE_NUMBERS // max((dim + 1) * (dim + 2) // 2, n_slots, 1))
    for batch in batches:
        for lo in range(0, len(batch), many):
            part = batch.slice(lo, many)
            x = np.asarray(pc.list_flatten(part.column(0)).to_numpy(zero_copy_only=False), np.float64).reshape(len(part), dim)
            slot = np.asarray(pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False), np.int64)
            w = np.zeros((len(part), n_slots))
            # a row that names a slot twice counts twice
            np.add.at(w, (np.repeat(np.arange(len(part)), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)), slot),
                      pc.list_flatten(part.column(3)).to_numpy(zero_copy_only=False))
            yield np.hstack([x - shift, np.ones((len(part), 1))]), part.column(1).to_numpy(zero_copy_only=False), w


def _handed_on(sums: np.ndarray, numbers: list[int]):
    step = max(1, SLICE_NUMBERS // max(1, sums.shape[1]))
    for lo in range(0, len(numbers), step):
        part = sums[lo : lo + step]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[lo : lo + step], pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], names=["model", "s"])


def _square(upper: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros((side, side))
    out[np.triu_indices(side)] = upper
    return out + np.triu(out, 1).T


def fit_listed(rows: DataFrame, n_slots: int, c: float = BEST_C, vec: str = "embedding", label: str = "y", slots: str = "slots",
               weights: str | None = None, c_grid: list[tuple[int, float]] | None = None, variance: float = PCA_VARIANCE) -> DataFrame:
    """(slot int, [grid_pos int], u array<double>, b double, k int, n long): logit = u . x + b
    of each of the ``n_slots`` models that has rows.

    ``slots`` is array<int> with entries from 0 to ``n_slots`` - 1, ``weights`` an array of
    the same length (1 each without it).  ``c_grid`` ((grid_pos, C) pairs) fits every C on
    a slot's rows.  Rows without label or whole vector train nothing.  The number of models
    is fixed by parameters: the driver holds their coefficients, no row."""
    spark = rows.sparkSession
    ws = F.col(weights).cast("array<double>") if weights else F.transform(slots, lambda s: F.lit(1.0))
    whole = F.col(vec).isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v))
    held = rows.filter(whole & F.col(label).isNotNull() & (F.size(slots) > 0)).select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(slots).cast("array<int>").alias("slots"), ws.alias("ws"))
    held = cut_lineage(held)
    grid = c_grid if c_grid is not None else [(None, c)]
    schema = "slot int" + (", grid_pos int" if c_grid is not None else "") + ", u array<double>, b double, k int, n long"
    size = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    dim = int(size["d"])
    side, upper = dim + 1, np.triu_indices(dim + 1)
    shift = held.agg(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"].toArray()      # dim numbers
    tasks = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(2 * size["n"] * n_slots * len(grid) * len(upper[0]) / TASK_FLOPS)))
    if held.rdd.getNumPartitions() < tasks:
        held = cut_lineage(held.repartition(tasks))

    def moments(batches):
        total, seen = np.zeros((n_slots, len(upper[0]))), np.zeros(n_slots, bool)
        for x, _, w in _slices(batches, dim, shift, n_slots):
            total += w.T @ (x[:, upper[0]] * x[:, upper[1]])
            seen |= (w != 0).any(axis=0)
        own = np.flatnonzero(seen)
        yield from _handed_on(total[own], own.tolist())

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        """The model's map: row t of ``to`` is component t of the PCA output, the last is 1."""
        s = _square(np.sum(np.stack(rows["s"].to_numpy()), axis=0), side)
        n, mu = s[dim, dim], s[dim, :dim] / s[dim, dim]
        cov = s[:dim, :dim] / n - np.outer(mu, mu)
        var = np.diag(cov).copy()
        # a constant column is left with the rounding of its values
        flat = var <= np.maximum((8 * np.finfo(float).eps * np.abs(shift)) ** 2, 1e-14 * np.diag(s)[:dim] / n)
        sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
        cov[flat, :] = 0.0
        cov[:, flat] = 0.0
        v, k = _components(cov / np.outer(sd, sd) * (n / (n - 1.0)), variance)
        to = np.zeros((k + 1, side))
        to[:k, :dim] = (v / sd[:, None]).T
        to[:k, dim] = -to[:k, :dim] @ mu
        to[k, dim] = 1.0
        return pd.DataFrame({"model": [int(rows["model"].iloc[0])], "k": [k], "n": [int(round(n))], "to": [to.ravel().tolist()]})

    maps = cut_lineage(held.mapInArrow(moments, "model int, s array<double>").groupBy("model").applyInPandas(mapped, "model int, k int, n long, to array<double>"))
    own = {r["model"]: (r["k"], r["n"]) for r in maps.select("model", "k", "n").collect()}
    # model number -> (place in the PCA output, place in the shifted rows)
    state = {slot * len(grid) + i: (np.zeros(k + 1), np.zeros(side)) for slot, (k, _) in own.items() for i in range(len(grid))}
    moving = sorted(state)
    for _ in range(NEWTON_STEPS):
        if not moving:
            break
        at = np.stack([state[m][1] for m in moving])
        of = np.array(moving) // len(grid)

        def steps(batches, moving=moving, at=at, of=of):
            g, h = np.zeros((len(moving), side)), np.zeros((len(moving), len(upper[0])))
            for x, y, w in _slices(batches, dim, shift, n_slots):
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-(x @ at.T)))
                w = w[:, of]
                g += (w * (p - y[:, None])).T @ x
                h += (w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
            yield from _handed_on(np.hstack([g, h]), moving)

        now = {m: state[m][0] for m in moving}

        def moved(rows: pd.DataFrame) -> pd.DataFrame:  # sent before the next step changes ``now``
            out: list[tuple] = []
            sums, own_map = rows[rows["model"] >= 0], rows[rows["model"] < 0]
            if len(sums):
                to = np.asarray(own_map["s"].iloc[0]).reshape(-1, side)
                k = len(to) - 1
                reg = np.eye(k + 1)
                reg[k, k] = 0.0
                for m, s in sums.groupby("model")["s"]:
                    s, c_m = np.sum(np.stack(s.to_numpy()), axis=0), grid[m % len(grid)][1]
                    grad = c_m * (to @ s[:side]) + reg @ now[m]  # noqa: B023
                    curve = c_m * (to @ _square(s[side:], side) @ to.T) + reg
                    step = np.linalg.solve(curve + 1e-12 * np.eye(k + 1), grad)
                    beta = now[m] - step  # noqa: B023
                    out.append((m, beta.tolist(), (beta @ to).tolist(), float(np.max(np.abs(step)))))
            return pd.DataFrame(out, columns=["model", "beta", "at", "step"])

        sums = held.mapInArrow(steps, "model int, s array<double>").select(F.floor(F.col("model") / len(grid)).cast("int").alias("slot"), "model", "s")
        both = sums.unionByName(maps.select(F.col("model").alias("slot"), F.lit(-1).alias("model"), F.col("to").alias("s")))
        solved = both.groupBy("slot").applyInPandas(moved, "model int, beta array<double>, at array<double>, step double")
        moving = []
        for r in solved.collect():      # one row a model
            state[r["model"]] = (np.array(r["beta"]), np.array(r["at"]))
            if not r["step"] < NEWTON_TOL:
                moving.append(r["model"])
        moving.sort()
    out = []
    for m, (_, at) in sorted(state.items()):
        slot, (pos, _) = m // len(grid), grid[m % len(grid)]
        u = at[:dim]
        out.append((slot, *(() if c_grid is None else (int(pos),)), u.tolist(), float(at[dim] - u @ shift), *own[slot]))
    return spark.createDataFrame(out, schema)


__all__ = ["fit_listed"]
