"""Prefix trie of conversations: adaptive radix trees over turn ids.

A turn's id is the 128-bit hash of its role and text, ``WIDTH`` bytes, big end first; a
conversation's key is the sequence of its ids.  Conversations with equal keys are one
entry (count, smallest conv_id, hash of the members).  The entries are dealt by ranges of
the key, and each task inserts stretches of its sorted range into an adaptive radix tree:
node layouts that grow as children come (up to 16 places: sorted bytes beside their
children; 48: places by byte; 256: children by byte) and one compressed path of bytes
per node.  Byte depths that are no multiple of ``WIDTH`` are inner to a turn;
only the others are nodes of the trie.

A trie node's entries are neighbours in the order of keys.  So the only trie nodes
that a stretch shares with others are the prefixes that its first key has in common
with the key before it, and its last key with the key after it.  What a stretch knows of
them is additive (a key ends in one stretch, a node begins in one) and is summed up by
Spark; all other nodes are complete at once.

Defined results: null role or text is empty; rows without conv_id are left out; rows of
the same turn are ordered by their id; repeated rows are turns of their own; other
columns are ignored; an empty table gives no rows.  A conversation's key is one value:
16 bytes a turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, n_partitions

WIDTH = 16
STRETCH_BYTES = 1 << 22  # keys in one tree
WORD = "[^ \t\n\x0b\f\r]+"
EMPTY = hashlib.sha256().hexdigest()


class Node:
    """``path``: the bytes that every key below shares after the byte that led here;
    ``entry``: the number of the key that ends here."""

    __slots__ = ("bytes", "children", "entry", "path")

    def __init__(self, path: bytes, entry: int | None = None) -> None:
        self.path, self.entry = path, entry
        self.bytes: bytearray = bytearray()  # up to 16 places: the sorted bytes; 48: places by byte; 256: unused
        self.children: list = []

    def child(self, byte: int) -> Node | None:
        n = len(self.bytes)
        if n == 256:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        if len(self.children) == 256:
            return self.children[byte]
        at = self.bytes.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Adds or replaces a child; a full layout gives way to the next larger one."""
        n = len(self.bytes)
        if not n and len(self.children) == 256:
            self.children[byte] = node
        elif n == 256:
            if self.bytes[byte]:
                self.children[self.bytes[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
            else:  # 48 -> 256 places
                wide = [self.children[at - 1] if at else None for at in self.bytes]
                wide[byte] = node
                self.bytes, self.children = bytearray(), wide
        else:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = node
            elif n < 16:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.children.insert(at, node)
            else:  # 16 -> 48 places
                places = bytearray(256)
                for i, b in enumerate(self.bytes):
                    places[b] = i + 1
                self.children.append(node)
                places[byte] = len(self.children)
                self.bytes = places

    def ordered(self) -> list[Node]:
        """Children by their byte."""
        if len(self.bytes) == 256:
            return [self.children[at - 1] for at in self.bytes if at]
        return [c for c in self.children if c is not None]


def insert(root: Node, key: bytes, entry: int) -> None:
    node, at = root, 0
    above: tuple[Node, int] | None = None
    while True:
        path, rest = node.path, key[at : at + len(node.path)]
        if path != rest:  # the compressed path parts here
            same = next((i for i, (x, y) in enumerate(zip(path, rest, strict=False)) if x != y), min(len(path), len(rest)))
            upper = Node(path[:same])
            node.path = path[same + 1 :]
            upper.put(path[same], node)
            if above is None:
                raise ValueError("the root has no path")
            above[0].put(above[1], upper)
            node = upper
        at += len(node.path)
        if at == len(key):
            node.entry = entry
            return
        below = node.child(key[at])
        if below is None:
            node.put(key[at], Node(key[at + 1 :], entry))
            return
        above, node, at = (node, key[at]), below, at + 1


def tree(keys: list[bytes]) -> Node:
    root = Node(b"")
    for i, key in enumerate(keys):
        insert(root, key, i)
    return root


def nodes(root: Node, keys: list[bytes], words: list, first: list, many: list, ends: list, before: int | None, after: int | None) -> dict[str, list]:
    """The trie nodes of a stretch, children before parents.  ``before`` and ``after``:
    turns that the first key shares with the key before it, the last with the next
    one (None: there is none)."""
    out: dict[str, list] = {c: [] for c, _ in PARTS}
    last = len(keys) - 1

    def emit(depth, lo, hi, conv, n, tops, leaves, total, fresh, entry):
        """One trie node; gives its row and the sums that go up."""
        shared = (lo == 0 and before is not None and depth <= before) or (hi == last and after is not None and depth <= after)
        begins = not (lo == 0 and before is not None and depth <= before)
        own = int(words[lo][depth - 1]) if depth else 0
        total, fresh = total + n * own, fresh + own * begins
        at = len(out["depth"])
        # children of shared nodes and the shared nodes meet by the hash of their turns
        mark = hashlib.md5(keys[lo][: depth * WIDTH]).digest() if shared else None
        inner = 0
        for row in tops:
            out["parent_conv_id"][row] = None if shared else conv
            out["parent"][row] = mark
            inner += out["begins"][row]
        for c, v in (("node", mark), ("parent", None), ("depth", depth), ("conv_id", conv), ("parent_conv_id", None), ("n_convs", n), ("n_children", inner),
                     ("n_leaves", leaves), ("total", total), ("fresh", fresh), ("ends_sha256", None if entry is None else ends[entry]), ("begins", begins)):
            out[c].append(v)
        return at, total, fresh

    # (node, depth in bytes where it ends, state: children still to visit, sums of those done)
    done: list[tuple] = []
    todo: list[tuple] = [(root, 0, False)]
    while todo:
        node, end, visited = todo.pop()
        below = node.ordered()
        if not visited:
            todo.append((node, end, True))
            todo += [(c, end + 1 + len(c.path), False) for c in reversed(below)]
            continue
        parts = [done.pop() for _ in below][::-1]
        entry = node.entry
        lo = entry if entry is not None else parts[0][0]
        hi = parts[-1][1] if parts else lo
        n, conv, leaves, total, fresh = (many[entry], first[entry], 0, 0, 0) if entry is not None else (0, None, 0, 0, 0)
        if entry is not None:
            turns = len(keys[entry]) // WIDTH
            leaves = int(not below and not (entry == last and after is not None and after == turns))
        tops: list[int] = []
        for p in parts:
            conv = p[2] if conv is None else min(conv, p[2])
            n, leaves, total, fresh = n + p[3], leaves + p[5], total + p[6], fresh + p[7]
            tops += p[4]
        # aligned depths on the way up the compressed path and the byte that led here
        begin = end - len(node.path) - 1 if node is not root else -1
        depth = end // WIDTH
        while depth * WIDTH > begin:
            at, total, fresh = emit(depth, lo, hi, conv, n, tops, leaves, total, fresh, entry if depth * WIDTH == end else None)
            tops, depth = [at], depth - 1
        done.append((lo, hi, conv, n, tops, leaves, total, fresh))
    return out


PARTS = (("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("total", pa.int64()), ("fresh", pa.int64()), ("ends_sha256", pa.string()), ("begins", pa.bool_()))
PARTS_DDL = ("node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, total long, fresh long, "
             "ends_sha256 string, begins boolean")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(F.col("turn").isNotNull().alias("timed"), "turn", key.alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return own.select("conv_id", F.col("all.id").alias("ids"), F.col("all.words").alias("words"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with the first crc32(conv_id) % ``most`` turns of the one whose
    conv_id is the multiple of ``every`` at or below it."""
    heads = own.filter(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("_base"), *[F.slice(c, 1, most - 1).alias(f"_{c}") for c in ("ids", "words")])
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    met = own.withColumn("_at", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).join(heads, F.col("_at") == F.col("_base"), "left")

    def turns(c):
        head = F.coalesce(F.slice(f"_{c}", F.lit(1), h), F.slice(c, F.lit(1), F.lit(0)))
        return F.concat(head, F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)

    return met.select("conv_id", turns("ids"), turns("words"))


def entries(sequences: DataFrame) -> DataFrame:
    """(key, words, conv_id, n, ends_sha256): the distinct keys."""
    key = F.unhex(F.array_join(F.transform("ids", lambda x: F.hex(x)), ""))
    dealt = sequences.select(key.alias("key"), "words", "conv_id").repartition(n_partitions(sequences.sparkSession), "key").sortWithinPartitions("key", "conv_id")

    def run(batches):
        now = None  # [key, words, first, n, hash]
        row = lambda: (*now[:4], now[4].hexdigest())
        for batch in batches:
            out = []
            for key, words, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != key:
                    if now is not None:
                        out.append(row())
                    now = [key, words, conv, 1, hashlib.sha256(str(conv).encode())]
                else:
                    now[3] += 1
                    now[4].update(f",{conv}".encode())
            yield of(out)
        if now is not None:
            yield of([row()])

    def of(rows):
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "words", "conv_id", "n", "ends_sha256"])

    return dealt.mapInArrow(run, "key binary, words array<int>, conv_id long, n long, ends_sha256 string")


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    lo = 0
    while lo < n:  # binary search for the first turn that differs
        mid = (lo + n + 1) // 2
        lo, n = (mid, n) if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH] else (lo, mid - 1)
    return lo


def borders(dealt: DataFrame) -> dict[int, tuple[int | None, int | None]]:
    """For each partition of sorted keys: turns that its first key shares with the key
    before, and its last with the next one.  One row per partition, whatever it holds."""
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("part")
    both = ends.select("part", "low", "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))

    @F.udf("int")
    def shared(a, b):
        return None if a is None or b is None else shared_turns(bytes(a), bytes(b))

    return {r["part"]: (r["x"], r["y"]) for r in both.select("part", shared("before", "low").alias("x"), shared("high", "after").alias("y")).collect()}


def trie(sequences: DataFrame, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """The trie nodes of (conv_id, ids, words)."""
    own = entries(sequences).repartitionByRange(n_partitions(sequences.sparkSession), "key").sortWithinPartitions("key")
    own = cut_lineage(own)
    around = borders(own)

    def run(batches):
        before, last_after = around.get(TaskContext.get().partitionId(), (None, None))
        held: list[tuple] = []
        size = 0

        def of(held, before, after):
            keys, words, first, many, ends = zip(*held, strict=True)
            got = nodes(tree(list(keys)), list(keys), words, first, many, ends, before, after)
            return pa.RecordBatch.from_arrays([pa.array(got[c], t) for c, t in PARTS], names=[c for c, _ in PARTS])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > stretch_bytes:
                    after = shared_turns(held[-1][0], row[0])
                    yield of(held, before, after)
                    held, size, before = [], 0, after
                held.append(row)
                size += len(row[0]) + 64
        if held:
            yield of(held, before, last_after)

    parts = cut_lineage(own.mapInArrow(run, PARTS_DDL))
    # nodes that several stretches share
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "fresh")]
    known = F.max("parent").alias("parent"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("ends_sha256").alias("ends_sha256")
    open_ = cut_lineage(parts.filter("node is not null").groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), *known, *sums))
    above = open_.select(F.col("node").alias("_n"), F.col("conv_id").alias("_conv"))
    own = parts.filter("node is null").select(open_.columns)
    met = open_.unionByName(own.filter("parent is not null")).join(above, F.col("parent") == F.col("_n"), "left")
    met = met.withColumn("parent_conv_id", F.coalesce("_conv", "parent_conv_id")).drop("_n", "_conv")
    every = own.filter("parent is null").unionByName(met)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("fresh")).alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def of_conversations(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(turns_of(conversations)))
