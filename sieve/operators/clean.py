"""Table-level cleaning: the ``clean`` transform over a record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, clean_name, clean_tag, is_valid_name, normalize_missing


def clean(df: DataFrame, columns: Sequence[str], name_col: str | None = None,
          tag_col: str | None = None, mode: str = "score") -> DataFrame:
    """Missing-token rule on ``columns`` (absent ones become 'Unknown'), then, in
    ``score`` mode, name and tag cleaning - in that order, so a cell such as
    'ND (classe 3)' ends as the literal 'ND'.  ``train`` mode does only the
    missing-token rule, as the training sheet had no name/tag cleaning.
    One ``select`` of composed expressions: a single narrow projection.
    """
    out = {}
    for c in columns:
        out[c] = normalize_missing(F.col(f"`{c}`")) if c in df.columns else F.lit(UNKNOWN)
    if mode == "score":
        if name_col:
            out[name_col] = clean_name(out[name_col])
        if tag_col:
            out[tag_col] = clean_tag(out[tag_col])
    keep = [F.col(f"`{c}`") for c in df.columns if c not in out]
    return df.select(*keep, *[e.alias(c) for c, e in out.items()])


def labelled(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows with a label, label cast to int; all-null rows dropped first.  The
    label goes through double, so sheet cells such as ``1.0`` are read as 1."""
    return (df.na.drop(how="all")
              .na.drop(subset=[label])
              .withColumn(label, F.col(label).cast("double").cast("int")))


def valid(df: DataFrame, name_col: str) -> DataFrame:
    return df.filter(is_valid_name(name_col))


def has_any_label(df: DataFrame, label: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Whether a (group of a) table carries any label at all."""
    if label not in df.columns:
        return df.groupBy(*by).agg(F.lit(0).alias("has_label"))
    return df.groupBy(*by).agg(F.max(F.col(label).isNotNull().cast("int")).alias("has_label"),
                               F.count(F.col(label)).alias("n_labelled"))
