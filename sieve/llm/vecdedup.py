"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one class first.  In each pass a vector's key is the signs of
its projections on 64 random directions, put together as one number; the passes of a
round are range-partitioned and sorted by key, each vector is compared with its
``window`` successors, and pairs whose cosine (double precision) reaches the bound
are united, within the task and then over all passes by connected components.
Vectors on either side of a range border aren't compared in that pass; other
passes have other borders.

Rounds have new directions, and each a window twice as wide as the one before, for
vectors that lie among many others: they go on until a round unites nothing that
earlier ones had not.  So passes and window grow with the data and its density, not by
a parameter.  What no round finds is not linked: the measured recall is in the README.

Links are then counted whole inside each component.  Members within half the
bound's angle of the component's mean direction all link to each other, so they
are counted and not compared; the others are compared with all members, in cells
of at most two chunks of ``chunk_rows``.  No pair of the two steps is written out.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different
length don't link; repeated rows are linked copies; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, n_partitions
from .components import components

BOUND = 0.9
PASSES, WINDOW, CHUNK_ROWS = 16, 12, 2048  # of the first round


def _matrix(col) -> np.ndarray:
    """Rows of equal length as one double matrix of unit vectors."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows vec_id, cls; classes cls, dim, vector, many, first); cls is null for vectors that link with nothing."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    own = vectors.select("vec_id", F.when(fine, F.transform(v, lambda x: x + 0.0)).alias("vector")).withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    many = own.filter(F.col("cls").isNotNull()).groupBy("cls", "vector").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("first"))
    return own.select("vec_id", "cls"), many.withColumn("dim", F.size("vector"))


def pass_links(classes: DataFrame, bound: float, passes: int, window: int, seed: int) -> DataFrame:
    """Links (a, b) between classes found in the passes, thinned to one tree for each
    connected part of a task's rows."""
    def project(batches):
        for batch in batches:
            cls, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = _matrix(batch.column(2).take(pa.array(at)))
                directions = np.random.default_rng([seed, int(d)]).standard_normal((passes * 64, int(d)))
                bits = np.packbits((x @ directions.T > 0).reshape(len(x), passes, 64), axis=2)
                keys = bits.reshape(len(x), passes, 8).view(">i8").reshape(len(x), passes).astype(np.int64)
                n = len(at)
                flat = pa.array(x.astype(np.float64).ravel())
                one = pa.ListArray.from_arrays(pa.array(np.arange(0, n * int(d) + 1, int(d)), pa.int32()), flat)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(keys[:, p]), pa.array(cls[at]), one],
                                                     names=["pass", "dim", "key", "cls", "vector"])

    keyed = classes.select("cls", "dim", "vector").mapInArrow(project, "pass int, dim int, key long, cls long, vector array<double>")
    dealt = keyed.repartitionByRange(n_partitions(classes.sparkSession), "pass", "dim", "key", "cls").sortWithinPartitions("pass", "dim", "key", "cls")

    def compare(batches):
        held: list = []  # the last rows, for the next batch: (pass, dim, cls, unit vector)
        for batch in batches:
            dim = batch.column(1).to_numpy()
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(dim)) + 1):
                if not len(part):
                    continue
                own = batch.slice(int(part[0]), len(part))
                d = int(dim[part[0]])
                at, cls, x = own.column(0).to_numpy(), own.column(3).to_numpy(), _matrix(own.column(4))
                if held and held[0] == d:
                    at, cls, x = np.concatenate([held[1], at]), np.concatenate([held[2], cls]), np.concatenate([held[3], x])
                parent: dict[int, int] = {}

                def root(i, parent=parent):
                    while parent.get(i, i) != i:
                        parent[i] = parent.get(parent[i], parent[i])
                        i = parent[i]
                    return i

                links = []
                for o in range(1, min(window, len(x) - 1) + 1):
                    cos = np.einsum("ij,ij->i", x[o:], x[:-o])
                    for i in np.flatnonzero((cos >= bound) & (at[o:] == at[:-o])).tolist():
                        a, b = int(cls[i]), int(cls[i + o])
                        ra, rb = root(a), root(b)
                        if ra != rb:
                            parent[ra] = rb
                            links.append((a, b))
                held = [d, at[-window:], cls[-window:], x[-window:]]
                a, b = zip(*links, strict=True) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _counted(members: DataFrame, bound: float, chunk_rows: int) -> DataFrame:
    """(cls, n) for the members of components: how many vectors of other classes it links with."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # the half angle, with a margin far above rounding
    near = math.cos(math.acos(bound) / 2) + 1e-9

    @F.pandas_udf("boolean")
    def inside(vector, center):
        import pandas as pd

        x, c = np.stack(vector.to_numpy()).astype(np.float64), np.stack(center.to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)
        return pd.Series(np.einsum("ij,ij->i", x, c) >= near * norm)

    @F.pandas_udf("array<double>")
    def unit(vector):
        return vector.map(lambda v: v / np.linalg.norm(v))

    members = members.withColumn("unit", unit("vector"))
    centers = members.groupBy("component").agg(vector_to_array(Summarizer.mean(array_to_vector("unit"))).alias("center"))
    members = cut_lineage(members.join(centers, "component").withColumn("inside", inside("unit", "center")).drop("center", "vector"))
    balls = members.filter("inside").groupBy("component").agg(F.sum("many").alias("ball"))
    shape = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("inside")).cast("long")).alias("outer"))
    loose = cut_lineage(members.join(shape.filter("outer > 0"), "component"))
    chunks = lambda n: F.ceil(F.col(n) / chunk_rows).cast("int")
    deal = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), chunks(n)).cast("int")
    left = loose.filter("not inside").withColumn("i", deal("outer", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), chunks("size") - 1)))
    right = loose.withColumn("j", deal("size", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), chunks("outer") - 1)))
    cells = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select("component", "i", "j", "side", "cls", "inside", "many", "unit")

    def count(cell):
        import pandas as pd

        l, r = cell[cell["side"] == 0], cell[cell["side"] == 1]
        if l.empty or r.empty:
            return pd.DataFrame({"cls": [], "n": []}).astype("int64")
        x, y = np.stack(l["unit"].to_numpy()), np.stack(r["unit"].to_numpy())
        hit = (x @ y.T >= bound) & (l["cls"].to_numpy()[:, None] != r["cls"].to_numpy()[None, :])
        out, inner = hit @ r["many"].to_numpy(), r["inside"].to_numpy()
        back = l["many"].to_numpy() @ hit  # what the outer ones add to members inside the ball
        return pd.DataFrame({"cls": np.concatenate([l["cls"], r["cls"][inner]]), "n": np.concatenate([out, back[inner]])}).astype("int64")

    outer = cells.groupBy("component", "i", "j").applyInPandas(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    whole = members.join(balls, "component", "left").join(outer, "cls", "left")
    ball = F.when(F.col("inside"), F.col("ball") - F.col("many")).otherwise(0)
    return whole.select("cls", (ball + F.coalesce("n", F.lit(0))).alias("n"))


def united(classes: DataFrame, bound: float, passes: int, window: int, seed: int = 11) -> DataFrame:
    """(cls, component) of the classes that link, by rounds of passes until one adds
    no union."""
    parts = None
    while True:
        links = cut_lineage(pass_links(classes, bound, passes, window, seed))
        if parts is not None:
            of = lambda end: parts.select(F.col("cls").alias(f"_{end}"), F.col("component").alias(f"_c{end}"))  # noqa: E731, B023
            named = links.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
            links = cut_lineage(named.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")).filter("a != b"))
        if links.isEmpty():
            return parts if parts is not None else links.select(F.col("a").alias("cls"), F.col("b").alias("component"))
        known = links if parts is None else links.unionByName(parts.select(F.col("cls").alias("a"), F.col("component").alias("b")))
        parts = cut_lineage(components(known).withColumnRenamed("node", "cls"))
        window, seed = 2 * window, seed + 1


def dedup(vectors: DataFrame, bound: float = BOUND, passes: int = PASSES, window: int = WINDOW, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows, classes = _classes(vectors)
    classes = cut_lineage(classes)
    parts = united(classes, bound, passes, window)
    members = cut_lineage(classes.join(parts, "cls"))
    counted = _counted(members.select("component", "cls", "vector", "many"), bound, chunk_rows)
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    of_part = members.select("cls", "component").join(least, "component").join(counted, "cls")
    of_class = classes.select("cls", "many", "first").join(of_part, "cls", "left").select(
        "cls", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = rows.join(of_class, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
