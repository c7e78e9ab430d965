"""Reading the driver tables and exported record sheets; writing results."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# --- fixed values: cell texts that the sheet readers of data-frame libraries take for missing ---
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# -------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One driver table; selecting ``columns`` here keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def strip_column_names(df: DataFrame) -> DataFrame:
    """Column names with surrounding whitespace removed."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename_by_position(df: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """Rename columns by their 0-based position (sheets whose headers are unreliable)."""
    cols = df.columns
    return df.withColumnsRenamed({cols[i]: new for i, new in mapping.items() if i < len(cols)})


def read_sheet(spark: SparkSession, path: str, descriptor_cols: Sequence[str],
               label_col: str | None = None, extra_cols: Sequence[str] = (),
               null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Read a folder of exported record sheets (CSV) with a banner line above the header.

    Each file's header is its first row with two of the wanted names (or the only one
    wanted); rows before it are the banner, rows after it are records, however few of
    their cells are filled.  Columns are found by their trimmed header names, file by file, so
    files may differ in order.  A file without a header, or without the label or an
    extra column, is an error; a missing descriptor is an all-null column.  Every
    column is read as string (``50`` stays ``50``); cells may hold embedded newlines.
    ``record_id`` is a hash of the row's cells and, for rows that repeat, their count,
    so it doesn't change with the file layout.
    """
    raw = spark.read.option("header", "false").option("multiLine", "true").option("escape", '"').csv(path)
    wanted = list(descriptor_cols) + ([label_col] if label_col else []) + list(extra_cols)
    cells = F.array(*[F.col(c) for c in raw.columns])
    # a file with embedded newlines is read by one task from top to bottom, so ids grow with its lines
    lines = raw.select(cells.alias("_cells"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    names = F.transform("_cells", lambda v: F.trim(v))
    is_header = F.size(F.array_intersect(names, F.array(*[F.lit(w) for w in wanted]))) >= min(2, len(wanted))
    heads = lines.filter(is_header).groupBy("_file").agg(F.min("_at").alias("_head"), F.min_by(names, "_at").alias("_names"))
    needed = F.array(*[F.lit(c) for c in wanted if c not in descriptor_cols]).cast("array<string>")
    # one row a file, checked where it lies; a file at fault comes to the driver, not the list of files
    files = lines.select("_file").distinct().join(heads, "_file", "left")
    bad = files.filter(F.col("_names").isNull() | (F.size(F.array_except(needed, "_names")) > 0)).first()
    if bad is not None:
        raise ValueError(f"{bad['_file']}: no header row" if bad["_names"] is None else f"{bad['_file']}: not all of the columns {[c for c in wanted if c not in descriptor_cols]}")
    rows = lines.join(heads, "_file").filter(F.col("_at") > F.col("_head"))
    pick = lambda c: F.get("_cells", (F.array_position("_names", F.lit(c)) - 1).cast("int"))
    df = rows.select(*[F.when(F.array_contains("_names", F.lit(c)), pick(c)).alias(c) for c in wanted])
    for c in wanted:
        df = df.withColumn(c, F.when(F.trim(F.col(f"`{c}`")).isin(*null_tokens), F.lit(None)).otherwise(F.col(f"`{c}`")))
    df = df.na.drop(how="all")
    key = F.xxhash64(*[F.coalesce(F.col(f"`{c}`"), F.lit("\0")) for c in wanted])
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return df.withColumn("_key", key).withColumn("record_id", F.xxhash64("_key", again)).drop("_key")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def input_version(df: DataFrame) -> str:
    """Digest of the files that ``df`` reads (path, size, time of change), taken on the
    executors: a rewritten, added or removed file changes it.  Files without rows count
    nothing; ``df`` must be read straight from files."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    parts = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{parts['n']}:{parts['h']}"


def materialize_once(spark: SparkSession, path: str, build, version: str | None = None) -> DataFrame:
    """Read ``path`` if it was written before, else build, write and read it back.

    The cache of vectors / labels / replicates lives in a shared folder, so a lost
    executor or a later job rereads it instead of recomputing the encoder.  With
    ``version`` (such as :func:`input_version` of the inputs) the table of each
    version has its own folder below ``path``: changed inputs are built anew, and a
    reader of the earlier table keeps its files.
    """
    if version is not None:
        path = f"{path}/version={hashlib.sha256(version.encode()).hexdigest()[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    written = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not written:      # a failed read of a table that was written is an error, not an absent table
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
