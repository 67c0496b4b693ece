"""Periodic runs of words, by a suffix automaton whose end-position sets are merged small-to-large.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, 2 * q) words long, that no neighbouring
word extends keeping period q. In the automaton of a word sequence, each state stands for substrings that end at the same
places. The states' ordered sets of end positions are merged up the suffix links, the smaller into the larger; two places
that become neighbours there at a distance d of at most the state's length are the ends of a square's halves, of smallest
period d, since a shorter one would put a place between them. Every run has such a seed; seeds are extended to whole runs.

A run's words all lie in windows of LEAST / 2 words that occur twice in the run. So the automaton is built for stretches
that such windows cover, and texts without repetition cost one sort; this leaves out no run.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Words that a run has at least, whatever its period.
LEAST = 12
#: Places of a block of an ordered set; a full one is halved, so that an insertion moves no more than that many.
BLOCK = 1024
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """An ordered set of whole numbers in blocks."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Puts in x, which isn't there; gives the places before and after it."""
        blocks, last = self.blocks, self.last
        k = min(bisect_left(last, x), len(last) - 1)
        block = blocks[k]
        i = bisect_left(block, x)
        block.insert(i, x)
        self.size += 1
        before = block[i - 1] if i else blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        last[k] = block[-1]
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            last[k : k + 1] = [block[half - 1], block[-1]]
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """By state: length, suffix link, and end position (-1 of clones); state 0 is the empty substring."""
    length, link, end, follow = [0], [-1], [-1], [{}]
    tail = 0
    for at, c in enumerate(s):
        new = len(length)
        length.append(length[tail] + 1)
        end.append(at)
        follow.append({})
        p = tail
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                clone = len(length)
                link.append(clone)
                length.append(length[p] + 1)
                end.append(-1)
                follow.append(follow[q].copy())
                link.append(link[q])
                link[q] = clone
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
        tail = new
    return length, link, end


def seeds(s: list[int]) -> dict[int, list[int]]:
    """By distance d: places e, so that the words up to e and those up to e + d are alike for d words or more, d their smallest period."""
    length, link, end = automaton(s)
    sets: list[Places | None] = [Places(e) if e >= 0 else None for e in end]
    found: dict[int, list[int]] = {}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        p, own = link[v], sets[v]
        sets[v] = None
        if not p:
            continue  # substrings of length 0 seed nothing
        other, most = sets[p], length[p]
        if other is None:
            sets[p] = own
            continue
        if own.size > other.size:
            own, other = other, own
        sets[p], behind, after = other, None, None
        # Ascending, so that `before` is final; `after` is, unless the next one put in comes before it.
        for x in own:
            if after is not None and x > after and after - behind <= most:
                found.setdefault(after - behind, []).append(behind)
            before, after = other.insert(x)
            if before is not None and x - before <= most:
                found.setdefault(x - before, []).append(before)
            behind = x
        if after is not None and after - behind <= most:
            found.setdefault(after - behind, []).append(behind)
    return found


def runs_of_ids(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    n, out = len(s), []
    for d, ends in seeds(s).items():
        upto = -1
        for e in sorted(ends):
            if e <= upto:
                continue  # in the run that was found last
            a = upto = e
            while a and s[a - 1] == s[a - 1 + d]:
                a -= 1
            while upto + 1 + d < n and s[upto + 1] == s[upto + 1 + d]:
                upto += 1
            if upto - a + 1 + d >= max(least, 2 * d):
                out.append((a, upto - a + 1 + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _covered(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of places that windows of k words occurring twice cover; hashes that are alike by chance only add to them."""
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _MUL + ids[i : i + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    step = np.zeros(len(ids) + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    step[starts] += 1
    step[starts + k] -= 1
    on = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    number, k = {}, max(1, least // 2)
    fresh = count()
    ids = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.uint64, len(words))
    todo, out = [(0, len(ids))], []
    while todo:
        first, end = todo.pop()
        if end - first < least:
            continue
        parts = _covered(ids[first:end], k)
        if parts == [(0, end - first)]:
            out += [(first + a, n, q) for a, n, q in runs_of_ids(ids[first:end].tolist(), least)]
        else:  # windows that occur twice in a part are fewer than those of the whole
            todo += [(first + a, first + b) for a, b in parts]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, n, period in found:
        step[start + period] += 1
        step[start + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _each(df: DataFrame, id_col: str, text_col: str, least: int, make, schema: str) -> DataFrame:
    def rows(texts):
        out = [make(words, runs(words, least)) for words in map(bytes.split, texts)]
        columns = [c.split() for c in schema.split(", ")]
        # Typed, since a batch may have nothing but nulls.
        return {n: pa.array([r[i] for r in out], pa.int64() if kind == "long" else pa.string()) for i, (n, kind) in enumerate(columns)}

    return map_texts(df, id_col, text_col, rows, schema)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, start, length, period: a row for each run of each text; words are runs of anything but space and 0x09-0x0D.

    Texts without runs, null and empty ones give no row. Repeated rows give their runs again; ids may be null; other columns
    are ignored.
    """

    names = ("start", "length", "period")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))

    def rows(texts):
        return {"runs": pa.array([[dict(zip(names, r, strict=True)) for r in runs(words, least)] for words in map(bytes.split, texts)], kind)}

    listed = map_texts(df, id_col, text_col, rows, "runs array<struct<start:long,length:long,period:long>>")
    return listed.select(id_col, F.inline("runs"))


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, text: the words outside runs and the first period of each run, joined by single spaces; null and empty texts become empty, a row for each row."""
    return _each(df, id_col, text_col, least, lambda words, found: (b" ".join(collapsed(words, found)).decode("utf-8", "replace"),), "text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256: a row for each row.

    The longest run is that of the greatest length, then of the smallest start and period. Null and empty texts have no words,
    and their digests are those of the empty string. Ids may be null or repeated; other columns are ignored.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def make(words, found):
        a, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        return len(found), a, n, q, 1000 * n // q if q else None, sha("".join(f"{x},{y},{z}\n" for x, y, z in found).encode()), sha(b" ".join(collapsed(words, found)))

    return _each(df, id_col, text_col, least, make, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def with_planted_period(id_col: Column, text: Column) -> Column:
    """The text's words, joined by spaces, and for one id in ten (by CRC-32) its tail replaced by repeats of the tail's first words.

    With h the CRC-32 of the decimal id and g = floor(h / 10): if h % 10 is 0, each word from a = g % n on becomes word
    a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). Null ids plant nothing.
    """
    h = F.crc32(id_col.cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + F.pmod(i, p)).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), tail)

    # One array element, so that the words are taken once and not in each place that names them.
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)
