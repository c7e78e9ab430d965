"""Vector expressions over ``array<double>`` columns (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives 0 (as the reference's library does)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def centroids(df: DataFrame, vec: str, key: str) -> DataFrame:
    """Per-key mean vector: (key, centroid array<double>).

    Averages run per (key, dimension) so partial aggregation does the work and no
    task holds a whole class; the result is |keys| x dim values.
    """
    el = df.select(key, F.posexplode(vec).alias("dim", "x"))
    per = el.groupBy(key, "dim").agg(F.avg("x").alias("m"))
    return (per.groupBy(key)
               .agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_s"))
               .select(key, F.transform("_s", lambda s: s["m"]).alias("centroid")))


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a table that has exactly one row (a scalar record).

    The row is read through one scalar subquery (evaluated once, its value
    inlined into the projection), so no join is planned: the big side keeps
    its partitioning and its whole-stage codegen span.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col("_one")[c].alias(c) for c in cols])
