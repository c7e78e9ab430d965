"""Token ids of whole texts by a word-level BPE file of the ``tokenizers`` library.

The library merges each word slowly and texts repeat their words, so words are
numbered in a vocabulary that a Python worker keeps between tasks, only unseen
words are merged, and ids are gathered with numpy.  Unseen words go through the
byte-rank merger of ``tiktoken`` over the same vocabulary: with the end-of-word
suffix written as one sentinel byte, the pair with the lowest token id is the
pair with the lowest merge rank.  The two mergers agree if every token of the
vocabulary encodes to itself (a pair that the rank merger joins and the merge
list lacks would be a token that the list can't reach); the tests check that for
the whole vocabulary.  Words with characters outside Latin script, special
tokens or control characters go through the library itself; so do texts with
control characters that Python and the library class differently as white space.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, islice

import numpy as np

from .common import worker_state

END, MARK = "\x00", "\x01"
# Latin letters, digits and marks whose normalisation and lower case are the same everywhere.
PLAIN = re.compile("[\x02-įı-ſ]*")
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """The pieces ``idx`` of a flat array, one after the other."""
    n = lens[idx]
    ends = np.cumsum(n)
    if not len(idx) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts[idx] - ends + n, n) + np.arange(ends[-1])]


class Vocabulary:
    """Numbers strings and keeps the ids of each; ``encode`` gives the ids of
    unseen strings as (all ids, count of each).  Beyond ``most`` strings the later
    half is forgotten, which costs time only."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.lens = np.empty(0, "<u4"), np.empty(0, np.int64)

    def texts(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For texts given as their strings: all ids, and the count for each text."""
        known = len(self.number)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.number) > known:
            ids, lens = self.encode(list(islice(self.number, known, None)))
            self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
        ends = np.cumsum(self.lens)
        out = ragged_take(self.flat, ends - self.lens, self.lens, idx)
        upto = np.concatenate([[0], np.cumsum(self.lens[idx])])
        bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
        if len(self.number) > self.most:
            keep = self.most // 2
            self.number = defaultdict(None, islice(self.number.items(), keep))
            self.number.default_factory = self.number.__len__
            self.flat, self.lens = self.flat[: ends[keep - 1]].copy(), self.lens[:keep].copy()
        return out, np.diff(bounds)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_merger(path: str):
    """``tiktoken`` encoder over the file's vocabulary; the end-of-word suffix is byte 0."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix, chars = model["end_of_word_suffix"], byte_chars()
    ranks = {}
    for token, i in model["vocab"].items():
        if token.startswith("<|") and token.endswith("|>"):
            continue
        body, end = (token[: -len(suffix)], END.encode()) if token.endswith(suffix) and token != suffix else (token, b"")
        ranks[bytes(chars[c] for c in body) + end] = i
    return tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})


def plain_pieces() -> re.Pattern:
    """The file's split pattern over the plain characters, for the faster ``re``."""
    of = lambda kind: re.escape("".join(c for c in map(chr, range(2, 0x180)) if unicodedata.category(c)[0] == kind))
    space = "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{space}{of('L')}{of('N')}]+")


class WordTokenizer:
    """ids of whole texts, as the library's ``encode`` without special tokens gives them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.merger, self.pieces = Tokenizer.from_file(path), rank_merger(path), plain_pieces()
        self.mark = self.merger.encode_ordinary(MARK + END)[0]
        self.vocabulary = Vocabulary(self.words)

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def plain_words(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``n`` plain words that stand in ``text`` with a mark between them."""
        pieces = self.pieces.findall(text.lower())
        ids = np.array(self.merger.encode_ordinary(f"{END}\n".join(pieces) + END), "<u4")
        cut = np.flatnonzero(ids == self.mark)
        lens = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        assert len(lens) == n, "a word held the mark"
        return np.delete(ids, cut), lens

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = f"\n{MARK}\n".join(words)
        if text.count(MARK) == len(words) - 1 and "<|" not in text and PLAIN.fullmatch(text.replace(MARK, "")):
            return self.plain_words(text, len(words))
        each: list[np.ndarray] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            ids, lens = self.plain_words(f"\n{MARK}\n".join(words[i] for i in plain), len(plain))
            for i, x in zip(plain, np.split(ids, np.cumsum(lens)[:-1]), strict=True):
                each[i] = x
        each = [self.by_library(w) if x is None else x for w, x in zip(words, each, strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        odd = [bool(ODD_SPACE.search(t)) for t in texts]
        ids, lens = self.vocabulary.texts([[] if o else t.split() for t, o in zip(texts, odd, strict=True)])
        ends = np.cumsum(lens)
        return [self.by_library(t) if o else ids[e - n : e] for t, o, e, n in zip(texts, odd, ends.tolist(), lens.tolist(), strict=True)]


def word_tokenizer(path: str) -> WordTokenizer:
    return worker_state(f"words:{path}", lambda: WordTokenizer(path))
