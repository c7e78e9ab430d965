"""Bootstrap replicates as long tables ``(replicate, record_id, draws)``.

* ``exact``: each replicate draws n row indices with replacement (hash of
  ``replicate:draw`` mod n) and is joined back to a dense row index; counts per
  replicate sum to n exactly.
* ``poisson``: each (record, replicate) gets a Poisson(1) count from a hash
  (inverse CDF), no index and no join; replicate sizes vary around n.  This is the
  mode for tables too large to index.

Replicates holding one class only are replaced by the next candidate replicate,
as a redraw would.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_le, hash_key, hash_unit
from .prefix import hash_rank

# --- fixed values -----------------------------------------------------------
N_BOOT = 1000
BOOT_SEED = 42
# ---------------------------------------------------------------------------

DRAWS_PER_SLICE = 4_000_000


def poisson1_cdf(kmax: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= k), k = 0..kmax."""
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def dense_index(df: DataFrame, id_col: str = "record_id", seed: int = BOOT_SEED,
                out: str = "row_idx") -> DataFrame:
    """0-based dense index in md5(seed:id) order, computed without a global sort."""
    return hash_rank(df, [], hash_key(F.lit(seed), F.col(id_col)), id_col, out=out) \
        .withColumn(out, F.col(out) - 1)


def drawn_rows(n: int, seed: int, first: int):
    """Batches (replicate, row_idx) of numbered draws: ``hash_index(seed, replicate, draw) % n``,
    many digests at a time."""
    def run(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            replicate, draw = number // n + first, number % n
            index = np.empty(len(number), np.int64)
            begins = np.flatnonzero(np.concatenate([[True], replicate[1:] != replicate[:-1]]))[: len(number)]
            for lo, hi in zip(begins, [*begins[1:], len(number)], strict=True):
                head = f"{seed}:{replicate[lo]}:".encode()
                digests = b"".join([md5(head + b"%d" % d).digest() for d in draw[lo:hi].tolist()])
                # the first 15 hex digits
                index[lo:hi] = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(replicate), pa.array(index % n)], names=["replicate", "row_idx"])

    return run


def bootstrap_exact(df: DataFrame, n_boot: int = N_BOOT, id_col: str = "record_id",
                    seed: int = BOOT_SEED, first: int = 0) -> DataFrame:
    """(replicate, record_id, draws) for candidate replicates first..first+n_boot-1."""
    spark = df.sparkSession
    idx = dense_index(df.select(id_col), id_col, seed)
    n = df.count()                                   # one scalar to the driver
    total = n_boot * n
    # the (replicate, draw) grid comes from one range cut into even slices, so no
    # task generates a whole replicate's draws
    slices = max(spark.sparkContext.defaultParallelism, math.ceil(total / DRAWS_PER_SLICE))
    draws = (spark.range(0, total, numPartitions=slices)
             .mapInArrow(drawn_rows(n, seed, first), "replicate long, row_idx long")
             .groupBy("replicate", "row_idx").agg(F.count(F.lit(1)).alias("draws")))
    return draws.join(idx, "row_idx").select("replicate", id_col, "draws")


def bootstrap_poisson(df: DataFrame, n_boot: int = N_BOOT, id_col: str = "record_id",
                      seed: int = BOOT_SEED, first: int = 0) -> DataFrame:
    """(replicate, record_id, draws) with Poisson(1) counts; zero counts omitted."""
    cdf = poisson1_cdf()
    u = hash_unit(F.lit(seed), F.col("replicate"), F.col(id_col))
    return (df.select(id_col, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n_boot - 1).cast("long"))).alias("replicate"))
              .withColumn("_u", u)
              .withColumn("draws", count_le(cdf, F.col("_u")).cast("long"))
              .filter(F.col("draws") > 0)
              .select("replicate", id_col, "draws"))


def two_class(counts: DataFrame, labels: DataFrame, id_col: str = "record_id", label: str = "y") -> DataFrame:
    """(replicate) of the candidates that contain both classes."""
    per = (counts.join(labels.select(id_col, label), id_col)
                 .groupBy("replicate").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")))
    return per.filter(F.col("_lo") != F.col("_hi")).select("replicate")


def bootstrap(df: DataFrame, n_boot: int = N_BOOT, id_col: str = "record_id", label: str = "y",
              seed: int = BOOT_SEED, mode: str = "exact") -> DataFrame:
    """Exactly ``n_boot`` two-class replicates as (replicate, record_id, draws).

    Candidates are drawn in rounds until enough hold both classes, as redraws would;
    the first ``n_boot`` of them are numbered 0..n_boot-1 in order of drawing.
    """
    gen = bootstrap_exact if mode == "exact" else bootstrap_poisson
    classes = df.filter(F.col(label).isNotNull()).agg(F.min(label), F.max(label)).first()
    if classes[0] is None or classes[0] == classes[1]:
        raise ValueError("a two-class bootstrap needs rows of both classes")
    drawn, round_size, parts, kept, found = 0, n_boot + max(10, n_boot // 10), [], [], 0
    while found < n_boot:
        counts = gen(df.select(id_col), round_size, id_col, seed, drawn)
        ok = [r[0] for r in two_class(counts, df, id_col, label).collect()]   # replicate numbers of one round
        parts.append(counts)
        kept += sorted(ok)
        drawn, found = drawn + round_size, len(kept)
        rate = max(found / drawn, 0.01)
        round_size = max(10, math.ceil(1.1 * (n_boot - found) / rate))
    numbers = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(kept[:n_boot])], "replicate long, _new long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # at most n_boot rows: bounded by a parameter
    return out.join(F.broadcast(numbers), "replicate").select(F.col("_new").alias("replicate"), id_col, "draws")


# --- summaries over replicate score tables (replicate, record_id, p) ----------
BOOT_PROBS = (0.025, 0.975)
BOX_PROBS = (0.025, 0.25, 0.5, 0.75, 0.975)


def boot_summary(scores: DataFrame, t: float, id_col: str = "record_id", p: str = "p") -> DataFrame:
    """Per record over replicates: mean, population sd, 2.5 / 97.5 percentiles
    (linear interpolation), share of replicates called positive at ``t``.

    Groups are records, each holding one value per replicate, so a group's size
    is bounded by the number of replicates whatever the table size.
    """
    pc = F.percentile(p, list(BOOT_PROBS))
    return (scores.groupBy(id_col)
                  .agg(F.avg(p).alias("p_boot_mean"), F.stddev_pop(p).alias("p_boot_sd"), pc.alias("_pc"),
                       F.avg((F.col(p) >= F.lit(float(t))).cast("double")).alias("freq_call"))
                  .select(id_col, "p_boot_mean", "p_boot_sd", F.col("_pc")[0].alias("p_boot_lo"),
                          F.col("_pc")[1].alias("p_boot_hi"), "freq_call"))


def replicate_ranks(scores: DataFrame, id_col: str = "record_id", p: str = "p") -> DataFrame:
    """Rank (1 = highest score, ties by id) of each record inside its replicate;
    running counts by bucket so no replicate is sorted in one task."""
    from .prefix import prefix_sums
    one = scores.select("replicate", id_col, p).withColumn("_one", F.lit(1).cast("long"))
    r = prefix_sums(one, ["replicate"], -F.col(p), ["_one"], tie_cols=[id_col], out_prefix="_before")
    return r.select("replicate", id_col, p, (F.col("_before_one") + 1).alias("rank"))


def rank_summary(ranks: DataFrame, id_col: str = "record_id") -> DataFrame:
    pc = F.percentile("rank", list(BOOT_PROBS))
    return (ranks.groupBy(id_col).agg(F.avg("rank").alias("rank_mean"), pc.alias("_pc"))
                 .select(id_col, "rank_mean", F.bround(F.col("_pc")[0], 0).alias("rank_lo"),
                         F.bround(F.col("_pc")[1], 0).alias("rank_hi")))


def box_stats(scores: DataFrame, id_col: str = "record_id", p: str = "p") -> DataFrame:
    """Per record: 2.5 / 25 / 50 / 75 / 97.5 percentiles of the replicate scores."""
    names = ["q025", "q25", "q50", "q75", "q975"]
    pc = F.percentile(p, list(BOX_PROBS))
    return (scores.groupBy(id_col).agg(pc.alias("_pc"))
                  .select(id_col, *[F.col("_pc")[i].alias(n) for i, n in enumerate(names)]))
