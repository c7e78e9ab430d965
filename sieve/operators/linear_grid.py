"""Model selection over closed-form linear scorers, every setting really fitted.

Three families need no more from their training rows than each class's count, sum and
sum of squares: cosine to (shrunken) class centroids, the linear discriminant with a
diagonal covariance, and the difference of the class means.  Those moments add up, so
the rows are read once for all seeds and folds (:func:`moments.class_sums`): a fold's
training side is the seed's total less the fold's own sums, and every setting of every
family follows from the 2 x dim sums of its fold.  No training row is copied per fold
or setting, and the model table (encoders x seeds x folds x settings rows) is fixed by
parameters.

A record has three encodings: ``domain`` is its vector, ``general`` the signs of its
components, ``half`` the first half of the vector.  All are scaled to length one; a zero
vector stays zero.  A score is ``sigmoid(u . x + b)``, rounded to ``REFIT_DIGITS``.

Defined results: rows without a label or vector take no part; a training side without
rows of one class has no model, so its settings get no scores and the selection chain,
which asks for every fold, drops them; a component without spread, where no
regularisation is added either, counts nothing in the discriminant.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..session import cut_lineage
from . import moments as mo
from .models import score_listed
from .selection import grid_rows
from .split import CV_FOLDS, CV_SEEDS, stratified_kfold

LINEAR_GRIDS = {
    "Centroid cosine": [{"scale": [1, 2, 4, 8, 16], "shrink": [0, 0.25, 0.5]}],
    "Diagonal discriminant": [{"scale": [0.5, 1], "reg": [0.01, 0.1, 1, 10], "prior": [0, 1]}],
    "Mean difference": [{"scale": [1, 4, 16], "prior": [0, 1]}],
}
ENCODINGS = ("domain", "general", "half")


def encodings(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """``rows`` once for each encoding, with ``encoder`` and ``vec`` of length one."""
    x = F.col(vec)
    forms = {"domain": x, "general": F.transform(x, lambda v: F.signum(v)),
             "half": F.transform(x, lambda v, i: F.when(i < F.size(x) / 2, v).otherwise(F.lit(0.0)))}
    each = F.array(*[F.struct(F.lit(e).alias("encoder"), forms[e].alias("x")) for e in ENCODINGS])
    rest = [c for c in rows.columns if c != vec]
    long = rows.withColumn("_e", F.explode(each)).select(*rest, "_e.encoder", F.col("_e.x").alias(vec))
    return mo.unit_rows(long, vec)


def setting_structs(grids: dict = LINEAR_GRIDS) -> Column:
    """The grid as one literal array: family, grid_pos and the four parameters."""
    out = []
    for family, pos, js in grid_rows(grids):
        params = json.loads(js)
        own = [F.lit(float(params.get(k, 0))).alias(k) for k in ("scale", "shrink", "reg", "prior")]
        out.append(F.struct(F.lit(family).alias("family"), F.lit(pos).alias("grid_pos"), *own))
    return F.array(*out)


def _cols(*names: str) -> Column:
    return F.arrays_zip(*[F.col(n) for n in names])


def grid_models(sums: DataFrame, grids: dict = LINEAR_GRIDS) -> DataFrame:
    """(group, family, grid_pos, u, b) from class sums of [x, x * x] (:func:`moments.class_sums`)."""
    half = (F.size("s") / 2).cast("int")
    sums = sums.select("group", "y", "n", F.slice("s", F.lit(1), half).alias("s"), F.slice("s", half + 1, half).alias("q"))
    pick = lambda c, name: F.max(F.when(F.col("y") == c, F.col(name)))
    both = sums.groupBy("group").agg(*[pick(c, name).alias(f"{name}{c}") for c in (1, 0) for name in ("n", "s", "q")])
    both = both.filter(F.col("n1").isNotNull() & F.col("n0").isNotNull())
    n = F.col("n1") + F.col("n0")
    means = both.select("group", "n1", "n0", "q1", "q0",
                        F.transform("s1", lambda v: v / F.col("n1")).alias("c1"), F.transform("s0", lambda v: v / F.col("n0")).alias("c0"),
                        F.zip_with("s1", "s0", lambda a, b: (a + b) / n).alias("m"))
    within = F.transform(_cols("q1", "q0", "c1", "c0"), lambda z: F.greatest(
        (z["q1"] + z["q0"] - F.col("n1") * z["c1"] * z["c1"] - F.col("n0") * z["c0"] * z["c0"]) / n, F.lit(0.0)))
    spread = means.withColumn("v", within)
    spread = spread.withColumn("vbar", F.aggregate("v", F.lit(0.0), lambda t, v: t + v) / F.size("v"))
    spread = spread.withColumn("odds", F.log(F.col("n1") / F.col("n0"))).withColumn("_g", F.explode(setting_structs(grids)))
    each = spread.select("group", "c1", "c0", "m", "v", "vbar", "odds", "_g.*")

    shrunk = lambda c: F.zip_with(c, "m", lambda a, b: (F.lit(1.0) - F.col("shrink")) * a + F.col("shrink") * b)
    each = each.withColumn("e1", shrunk("c1")).withColumn("e0", shrunk("c0")).withColumn("l1", norm("e1")).withColumn("l0", norm("e0"))
    over = lambda x, length: F.when(F.col(length) == 0, F.lit(0.0)).otherwise(x / F.col(length))
    cosine = F.zip_with("e1", "e0", lambda a, b: F.col("scale") * (over(a, "l1") - over(b, "l0")))
    # one over the regularised variance; 1 for the plain difference of means
    weight = F.when(F.col("family") == "Mean difference", F.transform("v", lambda v: F.lit(1.0))).otherwise(F.transform("v", lambda v: F.when(
        v + F.col("reg") * F.col("vbar") > 0, F.lit(1.0) / (v + F.col("reg") * F.col("vbar"))).otherwise(F.lit(0.0))))
    each = each.withColumn("w", weight)
    linear = F.transform(_cols("c1", "c0", "w"), lambda z: F.col("scale") * (z["c1"] - z["c0"]) * z["w"])
    middle = F.aggregate(F.transform(_cols("c1", "c0", "w"), lambda z: (z["c1"] * z["c1"] - z["c0"] * z["c0"]) * z["w"]), F.lit(0.0), lambda t, v: t + v)
    by_centroid = F.col("family") == "Centroid cosine"
    return each.select("group", "family", "grid_pos", F.when(by_centroid, cosine).otherwise(linear).alias("u"),
                       F.when(by_centroid, F.lit(0.0)).otherwise(F.col("prior") * F.col("odds") - F.col("scale") * 0.5 * middle).alias("b"))


def _sums(rows: DataFrame, groups_per_encoder: int, set_size: int | None, dim: int) -> DataFrame:
    """Class sums of every encoding; ``rows`` hold record_id, embedding, y, groups, ws.
    With ``set_size`` those of all rows of a set but the group's own."""
    at = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), F.col("encoder")).cast("int") - 1
    long = encodings(rows).withColumn("groups", F.transform("groups", lambda g: g + at * groups_per_encoder))
    wide = long.withColumn("embedding", F.concat("embedding", F.transform("embedding", lambda v: v * v)))
    # two rows a group, read several times below: written once to the shared folder
    sums = cut_lineage(mo.class_sums(wide, len(ENCODINGS) * groups_per_encoder, dim=2 * dim).coalesce(1))
    return mo.complements(sums, set_size, dim=2 * dim) if set_size else sums


def _named(models: DataFrame, groups_per_encoder: int) -> DataFrame:
    encoder = F.element_at(F.array(*[F.lit(e) for e in ENCODINGS]), (F.floor(F.col("group") / groups_per_encoder) + 1).cast("int"))
    return models.withColumn("encoder", encoder)


def sweep_scores(train: DataFrame, seeds: Sequence[int] = CV_SEEDS, k: int = CV_FOLDS, grids: dict = LINEAR_GRIDS) -> DataFrame:
    """(encoder, family, seed, grid_pos, fold, record_id, p, y): validation scores of every
    setting, for each encoding, seed and fold of ``train`` (record_id, embedding, y)."""
    folds = stratified_kfold(train.select("record_id", "y"), k=k, seeds=seeds).select("record_id", "seed", "fold")
    turn = F.array_position(F.array(*[F.lit(int(s)) for s in seeds]), F.col("seed")).cast("int") - 1
    lists = mo.weight_lists(folds.select((turn * k + F.col("fold")).alias("group"), "record_id", F.lit(1.0).alias("weight")))
    rows = train.select("record_id", "embedding", "y").join(lists, "record_id")
    per = len(seeds) * k
    settings = [(family, pos) for family, pos, _ in grid_rows(grids)]
    number = F.create_map(*[F.lit(x) for i, (family, pos) in enumerate(settings) for x in (f"{family}:{pos}", i)])
    of = lambda group, i: (group * len(settings) + i).cast("int")
    models = grid_models(_sums(rows, per, k, mo.dimension(train)), grids)
    models = models.select(of(F.col("group"), number[F.concat_ws(":", "family", "grid_pos")]).alias("slot"), "u", "b")
    at = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), F.col("encoder")).cast("int") - 1
    every = F.flatten(F.transform("groups", lambda g: F.transform(F.sequence(F.lit(0), F.lit(len(settings) - 1)), lambda i: of(at * per + g, i))))
    asked = encodings(rows.drop("ws")).select("record_id", "y", "encoder", "embedding", every.alias("slots"))
    scored = score_listed(models, asked, len(ENCODINGS) * per * len(settings))
    named = F.element_at(F.array(*[F.struct(F.lit(family).alias("family"), F.lit(pos).alias("grid_pos")) for family, pos in settings]), F.col("slot") % len(settings) + 1)
    group = F.floor(F.col("slot") / len(settings)).cast("int") % per
    seed = F.element_at(F.array(*[F.lit(int(s)) for s in seeds]), (F.floor(group / k) + 1).cast("int"))
    return scored.select("encoder", named["family"].alias("family"), seed.alias("seed"), named["grid_pos"].alias("grid_pos"), (group % k).cast("int").alias("fold"), "record_id",
                         F.round("p", mo.REFIT_DIGITS).alias("p"), "y")


def refit_chosen(train: DataFrame, rows: DataFrame, chosen: DataFrame, grids: dict = LINEAR_GRIDS) -> DataFrame:
    """``rows`` (record_id, embedding, y) scored by the chosen setting refitted on all of
    ``train``; ``chosen`` (encoder, family, grid_pos, threshold) has one row.
    Returns (record_id, y, p, threshold)."""
    own = train.select("record_id", "embedding", "y", F.array(F.lit(0)).alias("groups"), F.array(F.lit(1.0)).alias("ws"))
    models = _named(grid_models(_sums(own, 1, None, mo.dimension(train)), grids), 1)
    best = models.join(F.broadcast(chosen), ["encoder", "family", "grid_pos"]).select("encoder", "u", "b", "threshold")
    asked = encodings(rows.select("record_id", "embedding", "y"))
    scored = asked.join(F.broadcast(best), "encoder")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot("embedding", "u") + F.col("b"))))
    return scored.select("record_id", "y", F.round(p, mo.REFIT_DIGITS).alias("p"), "threshold")
