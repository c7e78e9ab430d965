"""Best-fit packing of tokenised documents into fixed-length sequences.

Which pieces share a sequence depends on their lengths alone, so the plan is made
on the histogram of lengths (at most ``capacity`` rows, however large the corpus):
pieces above a third of the capacity pair at most twice per sequence, the longest
with the longest that fits beside it; the smaller ones, longest first, go to the
tightest gap that holds them.  Equal lengths move as one group, so a step of the
plan places many pieces.  Every piece then finds its place from its rank among
the pieces of its length: ranks come from counts per (length, bucket), where the
bucket is a hash of the piece, so a length that a third of all pieces share is
spread over all buckets.

Defined results: null text is empty; a document's ids end with one separator id
0, so an empty text is one piece of length 1; repeated rows are packed each; a
null ``doc_id`` is kept as it is; columns with other names are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_slices, cut_lineage, n_partitions, whole_text
from .tokens import word_tokenizer

CAPACITY = 2048
SEPARATOR = 0


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids
    with the separator, cut into pieces of at most ``capacity``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        tok = word_tokenizer(tokenizer)
        for batch in batches:
            for part, texts in column_slices(batch, "text"):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, ids in zip(part.column(0).to_pylist(), tok.texts(texts), strict=True):
                    data, n = ids.tobytes() + SEPARATOR.to_bytes(4, "little"), len(ids) + 1
                    for piece, start in enumerate(range(0, n, capacity)):
                        own = data[4 * start : 4 * (start + capacity)]
                        for k, v in zip(rows, (doc_id, piece, start, len(own) // 4, zlib.crc32(own), own), strict=True):
                            rows[k].append(v)
                kinds = {"piece": pa.int32(), "ids": pa.binary()}
                keep = [k for k in rows if with_ids or k != "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds.get(k, pa.int64())) for k in keep], names=keep)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces per sequence, first sequence, offset): from
    that rank on, pieces of that length fill sequences from the first one on, so
    many in each, beginning at the offset."""
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, how many)
    order: list[int] = []  # gaps that some sequence has
    made = 0

    def place(length: int, each: int, first: int, many: int, offset: int) -> None:
        """``each`` pieces into each of ``many`` sequences, the rest of them stays a gap."""
        steps.append((length, used[length], each, first, offset))
        used[length] += each * many
        left[length] -= each * many
        gap = capacity - offset - each * length
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first, many))

    def unplace(gap: int) -> tuple[int, int]:
        out = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.remove(gap)
        return out

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and (not left[large[i]] or large[i] == a and left[a] < 2):
            i -= 1
        b = large[i] if i >= 0 else 0
        many = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b:
            place(a, 2, made, many, 0)
        else:
            place(a, 1, made, many, 0)
            if b:
                gaps[capacity - a].pop()
                if not gaps[capacity - a]:
                    del gaps[capacity - a]
                    order.remove(capacity - a)
                place(b, 1, made, many, a)
        made += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(order, n)
            if i < len(order):
                gap = order[i]
                first, many = unplace(gap)
            else:
                gap, first, many = capacity, made, -(-left[n] // (capacity // n))
                made += many
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                place(n, each, first, full, capacity - gap)
            rest, done = left[n], full
            if done < many and 0 < rest < each:
                place(n, rest, first + done, 1, capacity - gap)
                done += 1
            if done < many:
                if gap not in gaps:
                    gaps[gap] = []
                    insort(order, gap)
                gaps[gap].append((first + done, many - done))
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` has doc_id,
    piece and length, and is read more than once: pass a stored table."""
    buckets = n_partitions(pieces.sparkSession)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # at most ``capacity`` rows come to the driver
    steps = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}, capacity)
    by_length = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(s[1:] for s in steps if s[0] == n), strict=True)) for n in {s[0] for s in steps}}
    own = Window.partitionBy("length", "_bucket").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns])
    ranked = (dealt.join(counts.drop("_n"), ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            first, each, base, offset = by_length[int(x)]
            k = np.searchsorted(first, r[at], side="right") - 1
            q = r[at] - first[k]
            seq[at], off[at] = base[k] + q // each[k], offset[k] + q % each[k] * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_p", place("length", "_rank")).select(*pieces.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_lineage(token_pieces(docs, tokenizer, capacity)), capacity)
