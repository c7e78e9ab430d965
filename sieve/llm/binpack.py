"""Packed token-id matrices: best-fit-decreasing with a segment tree over gaps.

Each Spark partition packs its own documents in blocks of a bounded number of
tokens, so nothing is shuffled and no group meets in one task; the price is at
most one part-filled row per block.  A row of the matrix holds ``capacity`` ids,
padded with the pad id, beside the cumulative lengths of its segments and the
positions that restart at 0 with each segment.  Overlong documents are cut into
pieces whose concatenation is the document's id stream, end marker included.

Defined results: null text is empty; an empty text is one segment holding the
separator alone; repeated rows are packed each; a null ``doc_id`` stays null in
``doc_ids``; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, whole_text
from .packing import SEPARATOR
from .tokens import word_tokenizer

PAD = 0
BLOCK_TOKENS = 2_000_000


class GapTree:
    """Segment tree over gap sizes 0..capacity; a leaf counts the rows with that gap."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, gap: int, by: int) -> None:
        i = gap + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest gap of at least ``length`` that some row has, or -1."""
        i = length + self.width
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers, in order of placing."""
    tree, rows, by_gap = GapTree(capacity), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        gap = tree.tightest(n)
        if gap < 0:
            row, gap = len(rows), capacity
            rows.append([])
        else:
            row = by_gap[gap].pop()
            tree.add(gap, -1)
        rows[row].append(item)
        by_gap.setdefault(gap - n, []).append(row)
        tree.add(gap - n, 1)
    return rows


SCHEMA = ("sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
          "input_ids binary, position_ids binary")


def pack_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per matrix row: ids and positions as little-endian unsigned 16-bit
    numbers, ``capacity`` of each (every id of the vocabulary must be below 65,536)."""
    if capacity > 65_536:
        raise ValueError("positions are 16-bit numbers")

    def packed(first: int, segments: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(s[2]) for s in segments], capacity)
        lens = [[len(segments[i][2]) for i in row] for row in rows]
        ids, positions = np.full((len(rows), capacity), PAD, "<u2"), np.zeros((len(rows), capacity), "<u2")
        for r, row in enumerate(rows):
            at = 0
            for i in row:
                own = segments[i][2]
                ids[r, at : at + len(own)] = own
                positions[r, at : at + len(own)] = np.arange(len(own))
                at += len(own)
        cols = [
            pa.array(range(first, first + len(rows)), pa.int64()),
            pa.array([sum(x) for x in lens], pa.int32()),
            pa.array([[segments[i][0] for i in row] for row in rows], pa.list_(pa.int64())),
            pa.array([[segments[i][1] for i in row] for row in rows], pa.list_(pa.int32())),
            pa.array([np.concatenate([[0], np.cumsum(x)]).tolist() for x in lens], pa.list_(pa.int32())),
            pa.array([x.tobytes() for x in ids], pa.binary()),
            pa.array([x.tobytes() for x in positions], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        tok, segments, held = word_tokenizer(tokenizer), [], 0
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in column_slices(batch, "text"):
                for doc_id, ids in zip(part.column(0).to_pylist(), tok.texts(texts), strict=True):
                    if len(ids) and int(ids.max()) > 65_535:
                        raise ValueError("an id doesn't fit 16 bits")
                    ids = np.append(ids, SEPARATOR).astype("<u2")
                    segments += [(doc_id, k, ids[s : s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
                    held += len(ids)
                    if held >= block_tokens:
                        out = packed(at, segments)
                        at, segments, held = at + len(out), [], 0
                        yield out
        if segments:
            yield packed(at, segments)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, tokenizer: str, path: str, capacity: int = 2048) -> None:
    """The matrices as Parquet files: one binary row of ids and one of positions each."""
    pack_matrices(docs, tokenizer, capacity).write.parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """Checksums in place of the binary columns."""
    return rows.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens",
                       F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
