"""Byte-level BPE with a segment tree of pair ranks.

The vocabulary is a file of `base64 rank` lines whose place is a parameter. Each pre-token's bytes are the leaves of a
segment tree, FAN children to a node, that holds the smallest (rank, position) of each span, so the root is the leftmost pair of least
rank; a merge touches the pair at its own place, the one before and the one after, each by a walk to the root. A pre-token of n
bytes takes O(n log n), also when it is a hundred thousand bytes without a space.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Words between single spaces, and pre-tokens of those that have several, that a task remembers; two generations are held at most, until it ends.
CACHE_ENTRIES = 240_000
#: Children of a node of the segment tree: few levels, and the least of so many is found by one call.
FAN = 16
#: Longer ones are encoded anew each time, so that the caches' bytes are bounded too.
CACHE_CHARS = 48
#: Characters of all kinds, between which a pattern is tried for that.
_PROBES = "".join(map(chr, range(0x21, 0x7F))) + "éß漢٣①€—\u0301😀"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    #: Keys order by rank, then by place; a leaf without a pair has `none`. Small shifts keep most keys in one machine word.
    shift, find = n.bit_length(), ranks.get
    none = len(ranks) << shift
    leaves = [none if (r := find(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)]
    #: Levels above the leaves, up to one of FAN nodes at most, whose least is the root.
    above, top = [], leaves
    while len(top) > FAN:
        top = [min(top[k : k + FAN]) for k in range(0, len(top), FAN)]
        above.append(top)
    #: Token i spans piece[i:end[i]]; before[i] is the token before it.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    mask = (1 << shift) - 1
    while (least := min(top, default=none)) < none:
        i = left = least & mask
        gone = end[i]
        stop = end[i] = end[gone]
        r = None
        if stop < n:
            before[stop] = i
            r = find(piece[i : end[stop]])
        leaves[i] = none if r is None else r << shift | i
        if gone < n - 1:  # the last token has no leaf, as it begins no pair
            leaves[gone] = none
        else:
            gone = i
        if i:
            left = before[i]
            r = find(piece[left:stop])
            leaves[left] = none if r is None else r << shift | left
        if above:
            # The three changed leaves go up together; where their paths meet, one is left.
            below, a, b, c = leaves, left, i, gone
            for level in above:
                a, b, c = a // FAN, b // FAN, c // FAN
                for k in {a, b, c}:
                    level[k] = min(below[k * FAN : (k + 1) * FAN])
                below = level
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def _is_even(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between words.

    Such a text falls into words, each with the space before it, whose matches are the text's own, where no match of the pattern reaches
    over such a space or line feed.
    """
    words = text.split()
    gaps = len(words) - 1
    return text.count(" ") + text.count("\n") == gaps and len(text) - sum(map(len, words)) == gaps


class _Memo(dict):
    """Text to its ids as little-endian 32-bit integers; the older generation goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        if (ids := self.old.get(text)) is None:
            ids = self.make(text)
        if len(text) <= CACHE_CHARS:
            self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = _Memo(self._merged)
        self.words = _Memo(self._word)
        self.feed = self._pieces("\n")
        self.even = self._falls_into_words()

    def _falls_into_words(self) -> bool:
        """Whether the pattern's matches end before a single space and on either side of a line feed, tried between all pairs of probes."""
        own = {c: self.split(c) for c in _PROBES}
        spaced = {c: self.split(f" {c}") for c in _PROBES}
        feed = self.split("\n")
        return all(self.split(f"{a} {b}") == own[a] + spaced[b] and self.split(f"{a}\n{b}") == own[a] + feed + own[b] for a in _PROBES for b in _PROBES)

    def forget(self) -> None:
        self.pieces.forget()
        self.words.forget()

    def _merged(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks)
        return pack("<%dI" % len(ids), *ids)

    def _word(self, word: str) -> bytes:
        """Of a word with the space before it, or, marked by a line feed, of one that a line begins with. A single pre-token is remembered as a word alone."""
        found = self.split(word[1:] if word[:1] == "\n" else f" {word}")
        return self._merged(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        words[0] = "\n" + words[0]
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        ids = self.feed.join(map(self._line, text.split("\n"))) if self.even and _is_even(text) else self._pieces(text)
        if len(self.pieces) + len(self.words) > CACHE_ENTRIES:
            self.pieces.age()
            self.words.age()
        return np.frombuffer(ids, "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens. Null and empty texts give no ids; repeated rows give equal rows; other columns are ignored."""

    def rows(texts: list[bytes]) -> dict[str, list]:
        c = codec(path, pattern)
        ids = [c.encode(t.decode("utf-8", "replace")) for t in texts]
        return {"ids": [x.astype("i4") for x in ids], "n_tokens": [len(x) for x in ids]}

    return map_texts(df, id_col, text_col, rows, "ids array<int>, n_tokens long", lambda: codec(path, pattern).forget())


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of a table of ids, a row for each row; null and no ids give the empty text; other columns are ignored."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, F.col(ids_col).alias("__ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no ids; repeated rows give equal rows; other columns are ignored."""

    def rows(texts: list[bytes]) -> dict[str, list]:
        c = codec(path, pattern)
        n, of_ids, of_text = [], [], []
        for t in texts:
            ids = c.encode(t.decode("utf-8", "replace"))
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_text.append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
        return {"n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_texts(df, id_col, text_col, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: codec(path, pattern).forget())
