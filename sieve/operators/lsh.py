"""Approximate nearest neighbours by a locality-sensitive join, for two large sides.

Unit vectors go through Spark ML's bucketed random projections; queries and references
that share a bucket of any table are compared, and the best k of each query are
ranked by their exact cosine.  A bucket is cut into cells of at most ``SIDE`` rows a side,
each a cogroup task that hands on only the best k of its queries.  Nothing is tuned by hand: the k-th distances of a
bounded sample of queries, found exactly, give the distance that the join has to reach,
and the bucket width follows from the collision probability of a pair at that
distance, so that the wanted share of neighbours shares a bucket.  Queries that come
back with fewer than k references are searched exactly (``pruned.search``).

Equal vectors are one row of the join on either side: a reference row carries its k
smallest ids, so a group of copies that holds a third of a table adds no pairs.

Zero vectors, which have no direction, take part only in the exact search; rows
without id or vector take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_long
from ..session import cut_lineage
from .moments import unit_rows
from .neighbors import TOP_K
from .pruned import SLICE, improve, search, stacked

RECALL = 0.95
TABLES = 4
SAMPLE_QUERIES = 200
SIDE = 16_384          # rows on a side of a cell at most
SEED = 42


def collision(distance: float, width: float) -> float:
    """Probability that two points at ``distance`` fall into one bucket of ``width``."""
    if distance <= 0:
        return 1.0
    c = width / distance
    below = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def bucket_width(distance: float, share: float, tables: int = TABLES) -> float:
    """The narrowest bucket in which a pair at ``distance`` meets with probability
    ``share`` in one of the tables (halving; the probability grows with the width)."""
    low, high = 1e-6, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        if 1 - (1 - collision(distance, mid)) ** tables >= share:
            high = mid
        else:
            low = mid
    return high


@dataclass
class Plan:
    reach: float        # distance of unit vectors up to which pairs are kept
    width: float
    tables: int


def plan(queries: DataFrame, refs: DataFrame, n_queries: int, k: int, recall: float, tables: int) -> Plan:
    """Parameters from at most ``SAMPLE_QUERIES`` queries, searched exactly."""
    share = min(1.0, (1.5 * SAMPLE_QUERIES + 50) / max(1, n_queries))
    some = queries.filter(hash_long(F.lit("lsh"), F.col("id")) < F.lit(int(share * (1 << 32)))).limit(SAMPLE_QUERIES)
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ref_id")
    near = search(some, refs, k).rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * F.col("cosine")))
    got = near.agg(F.percentile(distance, recall).alias("typical"), F.max(distance).alias("far")).first()
    typical, far = float(got["typical"] or 0.0), float(got["far"] or 0.0)
    # most neighbours lie nearer than the one the width is set for, and meet more often
    return Plan(max(1.05 * far, 1e-3), bucket_width(max(typical, 1e-3), recall, tables), tables)


def distinct_vectors(rows: DataFrame, ids: int | None) -> DataFrame:
    """(key, ids, v): a row for each different unit vector with all its ids, or its
    ``ids`` smallest."""
    packed = unit_rows(rows, "v").withColumn("key", F.xxhash64("v"))
    if ids is not None:
        place = F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))
        packed = packed.withColumn("_p", place).filter(F.col("_p") <= ids)
    return packed.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _best_of_cell(k: int, least: float):
    """(head, key, ids, cosine): the best k references of a cell above ``least`` for each
    query, those of smaller ids first among equals."""
    def fn(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"head": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "ids": np.zeros(0, object), "cosine": np.zeros(0)})
        if qdf.empty or rdf.empty:
            return none
        rdf = rdf.sort_values("id", kind="stable")
        r, rid, key, every = stacked(rdf["v"]), np.arange(len(rdf)), rdf["key"].to_numpy(), rdf["ids"].to_numpy()
        r32, out = r.astype(np.float32), [none]
        for lo in range(0, len(qdf), SLICE):
            q = stacked(qdf["v"].iloc[lo : lo + SLICE])
            q32, asks, floor = q.astype(np.float32), np.arange(len(q)), np.full(len(q), least)
            best, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            for at in range(0, len(r), SLICE // 4):
                part = slice(at, at + SLICE // 4)
                improve(best, ids, asks, floor, q, q32, r[part], r32[part], rid[part], lambda s: s)
            row, col = np.nonzero(best > least)
            out.append(pd.DataFrame({"head": qdf["id"].to_numpy()[lo : lo + SLICE][row], "key": key[ids[row, col]], "ids": every[ids[row, col]], "cosine": best[row, col]}))
        return pd.concat(out)

    return fn


def bucket_join(q: DataFrame, r: DataFrame, model, k: int, reach: float) -> DataFrame:
    """(head, key, ids, cosine): the best k references of each query, several times over, among
    those nearer than ``reach`` that share a bucket of any table.  ``q`` are (id, v, f), ``r``
    have the ``key`` of their vector and its ``ids`` too."""
    def dealt(d: DataFrame) -> DataFrame:
        own = [c for c in d.columns if c != "f"]
        h = model.transform(d).select(*own, F.posexplode("h").alias("t", "b"))
        return h.select(*own, "t", vector_to_array("b")[0].cast("long").alias("b"))

    q, r = cut_lineage(dealt(q)), cut_lineage(dealt(r))
    pieces = lambda d, n: d.groupBy("t", "b").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(n))
    cells = pieces(q, "_qn").join(pieces(r, "_rn"), ["t", "b"])
    own = lambda n: (hash_long(F.col("id"), F.col("t")) % F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(cells, ["t", "b"]).select("id", "v", "t", "b", own("_qn").alias("x"), each("_rn").alias("y"))
    r = r.join(cells, ["t", "b"]).select("id", "v", "key", "ids", "t", "b", own("_rn").alias("y"), each("_qn").alias("x"))
    by = ["t", "b", "x", "y"]
    return q.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(_best_of_cell(k, 1 - reach * reach / 2), "head long, key long, ids array<long>, cosine double")


def approx_topk(queries: DataFrame, refs: DataFrame, k: int = TOP_K, recall: float = RECALL, tables: int = TABLES,
                qid: str = "record_id", rid: str = "record_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, ref_id, cosine): at least ``recall`` of the k nearest references
    of each query on average, with their exact cosine; ties go to the smaller id."""
    ready = lambda d, c: cut_lineage(d.select(F.col(c).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("id is not null and v is not null"))
    queries, refs = ready(queries, qid), ready(refs, rid)
    n = queries.count()
    empty = queries.sparkSession.createDataFrame([], "query_id long, rank int, ref_id long, cosine double")
    if not n or refs.isEmpty():
        return empty
    own = plan(queries, refs, n, k, recall, tables)
    directed = lambda d: d.filter(F.exists("v", lambda x: x != 0))
    # one row for each query vector: its ids are put back at the end
    left = cut_lineage(unit_rows(directed(queries), "v").withColumn("key", F.xxhash64("v")))
    q = left.groupBy("key", "v").agg(F.min("id").alias("id")).select("id", "v", array_to_vector("v").alias("f"))
    r = cut_lineage(distinct_vectors(directed(refs), k).select(F.col("ids")[0].alias("id"), "key", "ids", "v", array_to_vector("v").alias("f")))
    if q.isEmpty() or r.isEmpty():
        pairs = None
    else:
        lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=own.width, numHashTables=own.tables, seed=SEED).fit(r)
        # a pair of several buckets is one pair
        met = bucket_join(q, r, lsh, k, own.reach).groupBy("head", "key", "ids").agg(F.max("cosine").alias("cosine"))
        pairs = met.select(F.col("head").alias("id"), F.explode("ids").alias("ref_id"), "cosine")
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cosine"), "ref_id"))
    found = empty.select("query_id", "ref_id", "cosine")
    if pairs is not None:
        top = pairs.withColumn("_r", best("id")).filter(F.col("_r") <= k)
        heads = left.groupBy("key", "v").agg(F.min("id").alias("head")).select(F.col("key").alias("_k"), F.col("v").alias("_v"), "head")
        named = left.join(heads, (F.col("key") == F.col("_k")) & (F.col("v") == F.col("_v"))).select(F.col("id").alias("query_id"), "head")
        found = cut_lineage(named.join(top.select(F.col("id").alias("head"), "ref_id", "cosine"), "head").select("query_id", "ref_id", "cosine"))
    whole = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    rest = search(queries.join(whole, "id", "left_anti"), refs, k).rows
    every = found.join(whole.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)
    return every.withColumn("rank", best("query_id")).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "ref_id", "cosine")
