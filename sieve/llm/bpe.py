"""Byte-level BPE by merge replay over the words of a block of texts.

The distinct pieces of a block that a worker has not met yet form one corpus.
Their bytes lie in one flat array; an inverted index maps the rank of each
mergeable pair to the positions of its left element.  Ranks are taken from a heap
in ascending order; all positions of a rank merge at once and only the pairs with
the merged token's two neighbours are looked up again and indexed.  Positions
whose pair has changed meanwhile are skipped.  Where a merge makes a pair of lower
rank than its own, waves of equal rank could differ from the piece-wise order, so
those pieces are merged one by one instead (this doesn't occur where every token
encodes to itself).

Defined results: null text is empty; an empty text has no ids; the decoded bytes
are the text's UTF-8; repeated rows are encoded each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, whole_text, worker_state
from .tokens import Vocabulary, ragged_take

NONE = 1 << 40
# the white space of the split pattern; every match lies inside one white-space run and the word after it
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.by_id[i] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = len(self.by_id)
        pairs = sorted((self.ranks[t[:k]] * self.base + self.ranks[t[k:]], i) for t, i in self.ranks.items()
                       for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.vocabulary = Vocabulary(self.chunks)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """Piece-wise merging, lowest rank first, leftmost first."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the count of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        total = int(ends[-1])
        tok = np.empty(total + 2, np.int64)
        tok[:total] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), size)
        # neighbours within the piece; ``total`` stands for none to the right, ``total + 1`` to the left
        after, before = np.arange(1, total + 3), np.arange(-1, total + 1)
        after[ends - 1], before[ends - size] = total, total + 1
        live = np.ones(total, bool)
        pair = np.full(total + 2, NONE, np.int64)  # rank of the pair that begins here
        has = np.flatnonzero(after[:total] < total)
        pair[has] = self.rank(tok[has], tok[after[has]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks < NONE], ranks[ranks < NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, own in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(own)

        add(has)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            at = at[live[at] & (pair[at] == r)]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs of one token: every other pair
                keep, taken = [], -1
                for a, b in zip(at.tolist(), right.tolist(), strict=True):
                    if a != taken:
                        keep.append(a)
                        taken = b
                at = np.array(keep)
                right = after[at]
            far, near = after[right], before[at]
            tok[at], live[right], after[at] = r, False, far
            before[far[far < total]] = at[far < total]
            pair[right] = NONE
            pair[at] = NONE
            ahead, behind = at[far < total], near[near < total]
            pair[ahead] = self.rank(tok[ahead], tok[after[ahead]])
            pair[behind] = self.rank(tok[behind], tok[after[behind]])
            new = np.unique(np.concatenate([ahead, behind]))
            back = new[pair[new] < r]
            if len(back):
                odd.update(word[back].tolist())
            add(new)
        ids, lens = tok[:total][live].astype("<u4"), np.bincount(word[live], minlength=len(pieces))
        if odd:
            each = np.split(ids, np.cumsum(lens)[:-1])
            for w in odd:
                each[w] = np.array(self.one(pieces[w]), "<u4")
            ids, lens = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, lens

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks are split by the pattern; the distinct pieces are merged once."""
        number: dict[str, int] = {}
        split = [self.split.findall(c) for c in chunks]
        at = [number.setdefault(p, len(number)) for s in split for p in s]
        ids, lens = self.replay([p.encode() for p in number])
        ends = np.cumsum(lens)
        counts = lens[np.array(at)]
        out = ragged_take(ids, ends - lens, lens, np.array(at))
        upto = np.concatenate([[0], np.cumsum(counts)])
        n_pieces = np.fromiter(map(len, split), np.int64, len(split))
        return out, np.diff(upto[np.concatenate([[0], np.cumsum(n_pieces)])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lens = self.vocabulary.texts([CHUNK.findall(t) for t in texts])
        ends = np.cumsum(lens)
        return [ids[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


def replayer(path: str, pattern: str) -> MergeReplay:
    return worker_state(f"replay:{path}", lambda: MergeReplay(path, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]); ids are
    little-endian unsigned 32-bit numbers."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        replay = replayer(ranks, pattern)
        for batch in batches:
            for part, texts in column_slices(batch, "text", 2_000_000):
                all_ids = replay.encode(texts)
                cols = [part.column(0), pa.array(map(len, all_ids), pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in all_ids]),
                        pa.array([hashlib.sha256(replay.decode(x)).hexdigest() for x in all_ids])]
                cols += [pa.array([x.tobytes() for x in all_ids], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text) from the ids."""
    def run(batches):
        replay = replayer(ranks, pattern)
        for batch in batches:
            texts = [None if x is None else replay.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
