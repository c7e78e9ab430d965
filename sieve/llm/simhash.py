"""SimHash near-duplicates: pigeonhole blocks, block join, Hamming check.

A fingerprint has 64 bits; bit i is 1 if more than half of the text's shingle
hashes have it.  Fingerprints that differ in at most ``d`` bits agree on at least
``blocks - d`` of ``blocks`` equal blocks, so every choice of that many blocks is a
key and close pairs share one.  Rows are first brought down to distinct
fingerprints (a group of copies is one row), keyed rows meet in their bucket, and
each bucket compares its members by Hamming distance.  A bucket hands on one
tree of verified links for each of its connected parts instead of all pairs.

A bucket above ``bucket_rows`` members is cut into chunks, and every pair of its
chunks is a cell of its own, so no task holds more than two chunks of a bucket and
no pair is left out.

Defined results: null and empty texts, and texts of white space only, have
fingerprint zero and link like any other; a text with fewer words than a shingle
has one hash, of all its words; repeated rows share their fingerprint; the
component of rows whose every doc_id is null is null; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, cut_lineage, n_partitions, whole_text
from .components import components

BITS = 64
BLOCKS = 4
BUCKET_ROWS = 4096
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words: int, seed: int) -> int:
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(whole, seed)], "<u8")
    else:
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        start = np.concatenate([[0], np.cumsum(size)])
        ends = (start[words:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(start[: len(ends)].tolist(), ends, strict=True)), "<u8", len(ends))
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    by_byte = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BIT).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the long columns of ``keep``): the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            for part, texts in column_slices(batch, "text"):
                fps = np.array([fingerprint(t, words, seed) for t in texts], "<u8").view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *part.columns[2:]], names=["doc_id", "fp", *keep])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), *keep).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def tree_links(fps: np.ndarray, distance: int, split: int = 0) -> list[tuple[int, int]]:
    """A spanning tree of each connected part of the fingerprints under the distance.
    With ``split``, only pairs between the first ``split`` and the rest count."""
    n, out = len(fps), []
    if n < 2:
        return out
    left = np.arange(n)
    unsigned = fps.view(np.uint64)
    frontier: list[int] = []
    while len(left) or frontier:
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        at = frontier.pop()
        near = np.bitwise_count(unsigned[left] ^ unsigned[at]) <= distance
        if split:
            near &= (left < split) != (at < split)
        if near.any():
            hit = left[near]
            out += [(int(fps[at]), int(fps[x])) for x in hit]
            frontier += hit.tolist()
            left = left[~near]
    return out


def block_masks(distance: int, blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[i] for i in own)) for own in combinations(range(blocks), blocks - distance)]


def close_links(fps: DataFrame, distance: int = 2, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join exactly those
    which chains of pairs within the distance join."""
    if not 0 <= distance < blocks:
        raise ValueError("needs more blocks than bits that may differ")
    masks, n = block_masks(distance, blocks), n_partitions(fps.sparkSession)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("_k")).select("_k.part", "_k.key", "fp")
    sizes = cut_lineage(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = keyed.join(sizes, ["part", "key"])
    chunks = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = (met.withColumn("chunks", chunks).withColumn("own", own)
             .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
             .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"))
    dealt = cells.repartition(n, "part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "own", "fp")

    def run(batches):
        held = None  # the cell that may go on in the next batch
        for batch in batches:
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = rows[last:]
            yield of(rows[:last], cut[:-1])
        if held is not None:
            yield of(held, np.empty(0, np.int64))

    def of(rows, cut):
        links = []
        for cell in np.split(rows, cut):
            if len(cell) > 1:
                split = int((cell[:, 4] == cell[0, 2]).sum()) if cell[0, 2] != cell[0, 3] else 0
                links += tree_links(np.ascontiguousarray(cell[:, 5]), distance, split if split < len(cell) else 0)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def dedup(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links."""
    own = cut_lineage(fingerprints(docs, words, seed))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = components(close_links(classes.select("fp"), distance, blocks))
    near = cut_lineage(near)
    joined = classes.join(near, classes["fp"] == near["node"]).select("fp", "component", "first")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = near.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    of_class = classes.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return own.join(of_class, "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """One document of each group: of the group's smallest doc_id the text of the
    smallest hash, and of the rows that repeat both, one.

    Nulls: a row without doc_id comes after all others, so it stays only where the
    whole group has none; null and empty texts and texts of white space are one group,
    that of fingerprint zero.  Two texts under one doc_id are rows of their own: each
    stays or goes with its group.  An empty table gives no rows."""
    text = F.xxhash64(whole_text())
    own = cut_lineage(fingerprints(docs.select("doc_id", "text", text.alias("own")), words, seed, ("own",)))
    near = cut_lineage(components(close_links(own.select("fp").distinct(), distance, blocks)))
    group = own.join(near, own["fp"] == near["node"], "left").select(F.coalesce("component", "fp").alias("group"), "doc_id", "own")
    place = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("own").alias("_own"))
    keep = group.groupBy("group").agg(F.min(place).alias("_k")).select("_k.*")
    # the row travels as one struct: its columns may have any name
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), text.alias("_own"))
    key = ["_none", "_id", "_own"]
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")
