"""Ordered prefix sums and ranks that never put a whole group into one task.

A plain ``sum().over(partitionBy(g).orderBy(k))`` sorts every row of a group in
a single task; a group holding a third of the table would then hold a third of
the table in one task.  Here the order key is first cut into buckets (edges from
a mergeable quantile sketch per group, or from the leading hex digits of a hash
key), bucket totals are summed over the small (group, bucket) table, and the
row-level window runs per (group, bucket) only.  A value that many rows share fills a
bucket of its own, which is cut once more by the column that breaks ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_le
from ..session import n_partitions


def _default_buckets(df: DataFrame) -> int:
    return max(8, 2 * n_partitions(df.sparkSession))


def _with_bucket_by_sketch(df: DataFrame, group_cols: Sequence[str], key: str,
                           n_buckets: int, shared: bool = False) -> DataFrame:
    """Add ``_bucket`` in [0, n_buckets): monotone in ``key`` within each group.  With
    ``shared`` also ``_edges_here``: how many bucket edges the row's key is equal to."""
    def dealt(rows: DataFrame, edges) -> DataFrame:
        out = rows.withColumn("_bucket", count_le(edges, F.col(key), strict=True))
        return out.withColumn("_edges_here", count_le(edges, F.col(key)) - F.col("_bucket")) if shared else out

    probs = [i / n_buckets for i in range(1, n_buckets)]
    g = list(group_cols)
    if g:
        edges = df.groupBy(*g).agg(F.percentile_approx(key, probs, 10000).alias("_edges"))
        if g == [_ONE]:
            edges = F.broadcast(edges)      # one row: a proven size bound
        out = _join_groups(df, edges, g)
        return dealt(out, F.col("_edges")).drop("_edges")
    # no groups: n_buckets - 1 edge values come back to the driver as a literal
    row = df.agg(F.percentile_approx(key, probs, 10000).alias("_edges")).first()
    vals = [float(v) for v in (row[0] or [])]
    return dealt(df, sorted(vals))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def tie_buckets(df: DataFrame, group_cols: Sequence[str], tie_col: str | None, n_buckets: int) -> DataFrame:
    """Add ``_bucket`` and ``_tie``, monotone in (``_key``, ``tie_col``) within each group.

    A key that equals m > 1 edges of its group is shared by about m buckets' worth of
    rows and is the highest of its bucket; its rows are cut into m + 1 parts by the edges of
    a second sketch, of ``tie_col``.  So no (bucket, tie) part is much above the mean,
    and a group has fewer than 4 x ``n_buckets`` of them, those of null keys (bucket -1)
    included.  A tie column that isn't a number is not cut.
    """
    g = list(group_cols)
    d = _with_bucket_by_sketch(df, g, "_key", n_buckets, shared=True)
    d = d.withColumn("_bucket", F.coalesce("_bucket", F.lit(-1)))     # null keys come first, as in a plain window
    if tie_col is None or dict(df.dtypes).get(tie_col) not in _NUMBERS:
        return d.withColumn("_tie", F.lit(0)).drop("_edges_here")
    d = d.withColumn("_edges_here", F.coalesce("_edges_here", F.lit(n_buckets - 1)))
    heavy = F.col("_edges_here") > 1
    probs = [i / n_buckets for i in range(1, n_buckets)]
    at = d.filter(heavy).groupBy(*g, "_bucket").agg(F.percentile_approx(tie_col, probs, 10000).alias("_tie_edges"))
    d = _join_groups(d, at, g + ["_bucket"])
    part = F.floor(F.coalesce(count_le(F.col("_tie_edges"), F.col(tie_col), strict=True), F.lit(0)) * (F.col("_edges_here") + 1) / n_buckets)
    return d.withColumn("_tie", F.when(heavy, 1 + part).otherwise(0).cast("int")).drop("_edges_here", "_tie_edges")


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which a null equals a null."""
    r = right.withColumnsRenamed({c: f"_j_{c}" for c in keys})
    cond = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in keys]
    return left.join(r, cond, "left").drop(*[f"_j_{c}" for c in keys])


_ONE = "_one_group"

# Rows per group up to which one task may hold a whole group (a plain window, or
# Spark's exact ``percentile`` aggregate); larger groups take the bucketed paths.
SMALL_GROUP_ROWS = 1_000_000


def _group_shape(df: DataFrame, g: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, number of groups): one aggregation, two
    scalars to the driver."""
    if not g:
        return df.count(), 1
    r = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c"), F.count(F.lit(1))).first()
    return int(r[0] or 0), int(r[1] or 0)


def _bound(small_group_rows: int | None) -> int:
    return SMALL_GROUP_ROWS if small_group_rows is None else small_group_rows


def _largest_group(df: DataFrame, g: Sequence[str]) -> int:
    return _group_shape(df, g)[0]


def _spread(df: DataFrame, n_groups: int, *keys) -> DataFrame:
    """A plain window leaves its rows partitioned by the group key; with fewer
    groups than shuffle partitions (then at most that many x ``SMALL_GROUP_ROWS``
    rows) the rows are spread again by a row key, so that work downstream (joins,
    explodes) does not run in a handful of tasks."""
    n = n_partitions(df.sparkSession)
    return df.repartition(n, *keys) if n_groups < n else df




def prefix_sums(df: DataFrame, group_cols: Sequence[str], key: Column | str,
                sum_cols: Sequence[str], tie_cols: Sequence[str] = (),
                inclusive: bool = False, out_prefix: str = "cum_",
                n_buckets: int | None = None, totals: bool = False,
                small_group_rows: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` over rows of a group ordered by ``key`` then
    ``tie_cols`` (ascending; pass ``-p`` for descending).  Exclusive by default.

    Adds ``{out_prefix}{c}`` for each ``c`` in ``sum_cols``; with ``totals`` also
    the group total ``_total_{c}`` (carried on the bucket table that is joined
    anyway, so it costs no extra pass).  Groups of at most ``small_group_rows``
    rows (checked first) use a plain window per group instead of buckets.
    """
    g = list(group_cols)
    k = key if isinstance(key, Column) else F.col(key)
    end = 0 if inclusive else -1
    largest, n_groups = _group_shape(df, g)
    if largest <= _bound(small_group_rows):
        # every group fits one task: a plain running window per group
        w = Window.partitionBy(*g).orderBy(k, *tie_cols).rowsBetween(Window.unboundedPreceding, end)
        d = df
        for c in sum_cols:
            d = d.withColumn(f"{out_prefix}{c}", F.coalesce(F.sum(c).over(w), F.lit(0)))
        if totals:
            for c in sum_cols:
                d = d.withColumn(f"_total_{c}", F.sum(c).over(Window.partitionBy(*g)))
        return _spread(d, n_groups, *([F.col(c) for c in tie_cols] or [k]))
    first_tie = tie_cols[0] if tie_cols and isinstance(tie_cols[0], str) else None
    d = tie_buckets(df.withColumn("_key", k), g, first_tie, n_buckets or _default_buckets(df))
    tot = d.groupBy(*g, "_bucket", "_tie").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wb = Window.partitionBy(*g).orderBy("_bucket", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, "_bucket", "_tie", *[F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_off_{c}")
                                              for c in sum_cols],
                      *([F.sum(f"_bt_{c}").over(Window.partitionBy(*g)).alias(f"_total_{c}") for c in sum_cols]
                        if totals else []))
    d = _join_groups(d, offs, g + ["_bucket", "_tie"])
    wr = (Window.partitionBy(*g, "_bucket", "_tie").orderBy("_key", *tie_cols)
          .rowsBetween(Window.unboundedPreceding, end))
    for c in sum_cols:
        d = d.withColumn(f"{out_prefix}{c}", F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(wr), F.lit(0)))
    return d.drop("_key", "_bucket", "_tie", *[f"_off_{c}" for c in sum_cols])


def hash_rank(df: DataFrame, group_cols: Sequence[str], hex_key: Column | str,
              tie_col: str, out: str = "pos", hex_digits: int = 3,
              small_group_rows: int | None = None) -> DataFrame:
    """1-based rank inside each group, ordered by an md5 hex key then ``tie_col``.

    Buckets are the first ``hex_digits`` hex digits of the key (16**hex_digits of
    them, uniform by construction), so each row-level window sees about
    ``rows_in_group / 16**hex_digits`` rows however large a group is.  Groups of
    at most ``small_group_rows`` rows (checked first) use a plain window.
    """
    g = list(group_cols)
    hk = hex_key if isinstance(hex_key, Column) else F.col(hex_key)
    largest, n_groups = _group_shape(df, g)
    if largest <= _bound(small_group_rows):
        w = Window.partitionBy(*g).orderBy(hk, tie_col)
        return _spread(df.withColumn(out, F.row_number().over(w).cast("long")), n_groups, F.col(tie_col))
    d = (df.withColumn("_hk", hk)
           .withColumn("_hb", F.coalesce(F.conv(F.substring("_hk", 1, hex_digits), 16, 10).cast("int"), F.lit(-1))))
    cnt = d.groupBy(*g, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*g).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select(*g, "_hb", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    d = _join_groups(d, offs, g + ["_hb"])
    wr = Window.partitionBy(*g, "_hb").orderBy("_hk", tie_col)
    return d.withColumn(out, F.col("_off") + F.row_number().over(wr)).drop("_hk", "_hb", "_off")


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], n_buckets: int | None = None,
                    small_group_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy's default), exact, per group.

    Returns (group..., q_idx, q, value).  When the largest group has at most
    ``small_group_rows`` rows (checked first), Spark's exact ``percentile``
    aggregate computes all groups in one pass.  Otherwise the quantiles are found
    among distinct values with counts, located through bucketed prefix counts, so
    no task holds a whole group.
    """
    g = list(group_cols)
    df = df.filter(F.col(value_col).isNotNull())      # quantiles of the values there are
    if _largest_group(df, g) <= _bound(small_group_rows):
        qs = F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
        per = df.groupBy(*g).agg(F.percentile(F.col(value_col).cast("double"), [float(q) for q in probs]).alias("_v"))
        return (per.select(*g, "_v", F.posexplode(qs).alias("_i", "_t"))
                   .select(*g, "_t.q_idx", "_t.q", F.col("_v")[F.col("_i")].alias("value")))
    nb = n_buckets or _default_buckets(df)
    if not g:
        df, g = df.withColumn(_ONE, F.lit(0)), [_ONE]
    dist = df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_c"))
    dist = dist.withColumn("_key", F.col(value_col))
    dist = _with_bucket_by_sketch(dist, g, "_key", nb)
    tot = dist.groupBy(*g, "_bucket").agg(F.sum("_c").alias("_bn"))
    wb = Window.partitionBy(*g).orderBy("_bucket")
    btab = (tot.withColumn("_bstart", F.coalesce(F.sum("_bn").over(
                wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*g))))
    wr = Window.partitionBy(*g, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    dist = (dist.join(btab.select(*g, "_bucket", "_bstart"), g + ["_bucket"], "left")
                .withColumn("_lo", F.col("_bstart") + F.coalesce(F.sum("_c").over(wr), F.lit(0)))
                .withColumn("_hi", F.col("_lo") + F.col("_c")))
    # targets: two order statistics per (group, q)
    qs = F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    n_tab = btab.select(*g, "_n").distinct()
    tgt = (n_tab.select(*g, "_n", F.explode(qs).alias("_t"))
                .select(*g, "_n", "_t.q_idx", "_t.q")
                .withColumn("_h", F.col("q") * (F.col("_n") - 1))
                .withColumn("_r0", F.floor("_h").cast("long"))
                .withColumn("_r1", F.ceil("_h").cast("long"))
                .withColumn("_frac", F.col("_h") - F.col("_r0"))
                .select(*g, "q_idx", "q", "_frac",
                        F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("_r0").alias("_r")),
                                          F.struct(F.lit(1).alias("_side"), F.col("_r1").alias("_r")))).alias("_s"))
                .select(*g, "q_idx", "q", "_frac", "_s._side", "_s._r"))
    # which bucket holds rank r: bucket table is |groups| x n_buckets rows
    bsel = btab.select(*[F.col(c).alias(f"_b_{c}") for c in g], F.col("_bucket").alias("_b_bucket"),
                       "_bstart", (F.col("_bstart") + F.col("_bn")).alias("_bend"))
    cond = [F.col(c) == F.col(f"_b_{c}") for c in g] + [F.col("_r") >= F.col("_bstart"), F.col("_r") < F.col("_bend")]
    tb = tgt.join(bsel, cond, "inner").select(*g, "q_idx", "q", "_frac", "_side", "_r", "_b_bucket")
    dsel = dist.select(*[F.col(c).alias(f"_d_{c}") for c in g], F.col("_bucket").alias("_d_bucket"),
                       "_lo", "_hi", F.col(value_col).cast("double").alias("_v"))
    cond2 = [F.col(c) == F.col(f"_d_{c}") for c in g] + [F.col("_b_bucket") == F.col("_d_bucket"),
                                                         F.col("_r") >= F.col("_lo"), F.col("_r") < F.col("_hi")]
    hit = tb.join(dsel, cond2, "inner").select(*g, "q_idx", "q", "_frac", "_side", "_v")
    res = (hit.groupBy(*g, "q_idx", "q")
              .agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_v0"),
                   F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_v1"),
                   F.max("_frac").alias("_frac")))
    out = res.select(*g, "q_idx", "q",
                     (F.col("_v0") + F.col("_frac") * (F.col("_v1") - F.col("_v0"))).alias("value"))
    return out.drop(_ONE) if _ONE in g else out
