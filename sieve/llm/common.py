"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, n_partitions

__all__ = ["column_slices", "cut_lineage", "documents", "freed", "n_partitions", "table", "whole_text", "worker_state"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(name: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def worker_state(key: str, build: Callable[[], object]):
    """An object built once per Python worker and reused by its later tasks, until
    another one is asked for: a worker lives on through later stages, whose memory
    would come on top of what an earlier operator kept.

    The package's functions are pickled by value, so their module globals are
    fresh in every task; the state therefore hangs on ``sys``.
    """
    store = sys.__dict__.setdefault("_sieve_worker_state", {})
    if key not in store:
        store.clear()
        freed()
        store[key] = build()
    return store[key]


def column_slices(batch: pa.RecordBatch, text: str, max_chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into slices of about ``max_chars`` bytes of text, so that what
    Python holds of one slice stays small.  Long texts are never cut."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > max_chars:
            part = batch.slice(lo, i - lo)
            yield part, col.slice(lo, i - lo).to_pylist()
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield batch.slice(lo), col.slice(lo).to_pylist()
    freed()


def freed() -> None:
    """Gives back what Arrow and the C library held of earlier batches: a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
