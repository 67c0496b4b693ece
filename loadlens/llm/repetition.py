"""Repetition coverage of texts: characters inside duplicated n-grams and lines, found with rolling hashes in numpy.

Words are runs of anything but white space (space, 0x09-0x0D). Word ids are exact within a text; the hash of an n-gram is
rolled from that of the (n-1)-gram, so all lengths cost one multiplication a word each. The three-word windows behind
n_repeat_words are compared exactly, not by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: n-gram lengths and the most of a long text's word characters that duplicated ones may cover.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Words that a text of any length may repeat besides: a line of ten words said twice is no fault of a short text. They add
#: ALLOWED_WORDS / n_words to each of the limits above, 0.33 at 60 words and 0.02 at 1,000.
ALLOWED_WORDS = 20
#: The most of a text's characters that lines equal to an earlier one may cover.
LINE_LIMIT = 0.30
#: The most symbols a word.
SYMBOL_LIMIT = 0.30
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the n-word windows that begin where `starts` is true."""
    step = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: bytes, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, float]:
    """The counts of one text; shares lie in 0 to 1 and are 0 for a text without words."""
    words = text.split()
    n = len(words)
    symbols = sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))
    seen, dup_lines, line_chars, dup_chars = set(), 0, 0, 0
    if n:
        for line in text.split(b"\n"):
            if line and not line.isspace():
                line_chars += len(line)
                if line in seen:
                    dup_lines += 1
                    dup_chars += len(line)
                else:
                    seen.add(line)
    out = {"n_words": n, "n_symbols": symbols, "n_dup_lines": dup_lines, "dup_line_share": dup_chars / line_chars if line_chars else 0.0}
    out |= {f"dup_{k}_share": 0.0 for k in lengths}
    if not n:
        return out | {"word_chars": 0, "n_repeat_words": 0}
    joined = b"".join(words)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, n)
    if joined.isascii():
        sizes = np.fromiter(map(len, words), np.int64, n)
    else:
        heads = np.concatenate([[0], np.cumsum(_HEAD[np.frombuffer(joined, np.uint8)])])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
        sizes = np.diff(heads[np.concatenate([[0], ends])])
    chars = int(sizes.sum())
    out |= {"word_chars": chars, "n_repeat_words": 0}
    if n >= 4 and len(index) < n:
        pairs = ids[:-1] * np.uint64(len(index)) + ids[1:]
        twice = _repeated(pairs)
        maybe = twice[:-1] & twice[1:]  # a repeated triple is made of two repeated pairs
        if maybe.any():
            rank = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
            flag = np.zeros(n - 2, bool)
            at = np.flatnonzero(maybe)
            flag[at] = _repeated(rank[at] * np.uint64(len(index)) + ids[at + 2])
            if flag.any():
                out["n_repeat_words"] = int(_covered(flag, 3, n).sum())
                rolled, k = _mix(ids), 1
                h = rolled
                for size in sorted(lengths):
                    while k < size and len(h) > 1:
                        h = h[:-1] * _BASE + rolled[k:]
                        k += 1
                    if k == size and (dup := _repeated(h)).any():
                        out[f"dup_{size}_share"] = float(sizes[_covered(dup, size, n)].sum()) / chars
    return out


def _mix(ids: np.ndarray) -> np.ndarray:
    x = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """id, counts and covered shares. Null and empty texts have zeros; ids may be null or repeated; other columns are ignored."""
    ints = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shares = ("dup_line_share", *(f"dup_{k}_share" for k in lengths))

    def rows(texts):
        found = [measure(t, lengths) for t in texts]
        return {k: [x[k] for x in found] for k in (*ints, *shares)}

    return map_texts(df, id_col, text_col, rows, ", ".join([*(f"{k} long" for k in ints), *(f"{k} double" for k in shares)]))


def judge(measured: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT, allowed_words: int = ALLOWED_WORDS) -> DataFrame:
    """Adds base_failed and kept to what repetition() returns; texts without words fail the base."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = (F.col("dup_line_share") > line_limit) | (F.col("n_symbols") > symbol_limit * F.col("n_words"))
    for k, most in (limits or NGRAM_LIMITS).items():
        over |= F.col(f"dup_{k}_share") > most + allowed_words / F.greatest("n_words", F.lit(1))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & ~over)
