"""Alignment of two tokenizers over whole texts, by distinct segments.

A byte-level BPE (A) and a sentence-piece BPE (B) encode space + text. Texts are cut into segments before white-space runs
that begin with a character before which neither vocabulary can merge: A's pattern ends a token there, and no entry of
either vocabulary holds the character after anything but white space. That is read from the vocabularies, not assumed; where
it doesn't hold, fewer cuts are made, down to one segment a text. Every segment's tokens are then the text's own.

1. Texts become blocks of rows: a block lists its different segments once, and each text as numbers of that list.
2. A shuffle brings all places of a segment, at most one a block, together; it is tokenised and aligned once, and the alignment
   joined to each of its places on the way back to the blocks. This takes no second copy of the segments and no group in memory.
3. Texts are composed from their block's alignments, with the pairs of ids that they link as numbers of the block's pairs.
4. What a pair counts depends on all texts: each block's counts of texts are summed by pair, brought back to the blocks, of which
   each has few thousand pairs, and added up for each text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Bytes of text of a block: what one call holds at a time, but for a longer single text.
BLOCK_BYTES = 32 << 20
#: Segments that one row of a block lists, and that are tokenised in one call.
LISTED = 4096
#: Places that a task gathers before it deals them out by block.
GATHERED = 1 << 17
#: Characters that may begin a white-space run before which a text is cut.
CUTS = (" ", "\n", "\t")
#: Whether a link is the first of its token of A, and of B; one that is both begins a group.
NEW_A, NEW_B = 1, 2
_SPACE = "▁"
#: White space that isn't single spaces and line feeds between words.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|\s\Z").search


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _after_text(entry: str, cut: str) -> bool:
    """Whether the character stands somewhere in the entry after another than white space."""
    return any(c == cut and not entry[k - 1].isspace() for k, c in enumerate(entry) if k)


class Pair:
    """Both tokenizers, the bytes of their tokens, and the verified cuts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of_char()
        entries = {i: bytes(map(byte.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        self.bytes_a = [entries.get(i, b"") for i in range(max([*entries, *self.a.get_vocab().values()]) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        texts = [p.replace(_SPACE, " ") for p in pieces]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else t.encode() for i, (p, t) in enumerate(zip(pieces, texts, strict=True))]
        self.packed_a, self.packed_b = ([packed(np.array([i])) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_SPACE)
        self.cuts = "".join(c for c in CUTS if self._safe(c, texts))
        self.fast = set(" \n") <= set(self.cuts)
        self.split = re.compile(rf"(?<=[^\s\u180e])(?=[{re.escape(self.cuts)}])").split if self.cuts else lambda t: [t]

    def _safe(self, cut: str, texts: list[str]) -> bool:
        """Whether both vocabularies allow a cut before a white-space run that begins with the character."""
        made = json.loads(self.a.to_str())
        before = made["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or made["normalizer"] is not None:
            return False
        if any(_after_text(t.decode("utf-8", "replace"), cut) for t in self.bytes_a):
            return False
        if any(_after_text(t, cut) for i, t in enumerate(texts) if not self.b.is_byte(i)):
            return False
        # B puts a space before what it encodes. A segment that begins with another character is encoded with it and the
        # token of that space left out, so the space must stay a token of its own; a lone space is encoded after a line feed.
        whole = {texts[i] for i in (*self.b.encode("\n "), *self.b.encode("\n")) if not self.b.is_byte(i)} <= {" "}
        return whole and self.space != self.b.unk_id() and not any("\n" in t or cut != " " and f" {cut}" in t for i, t in enumerate(texts) if not self.b.is_byte(i))

    def segments(self, text: str) -> list[str]:
        """Of space + text."""
        return self.split(f" {text}")

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        out = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                out[k] = [self.space]
            elif s[0] != " ":
                if out[k][:1] != [self.space]:
                    raise ValueError("the space before a segment isn't a token of its own")
                out[k] = out[k][1:]
        return out

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]

    def align(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """For each: its links in order, as packed ids of A, packed ids of B, and a step for each; all empty if not both have its bytes."""
        return [self._aligned(s.encode("utf-8"), a, b) for s, a, b in zip(segments, self.encode_a(segments), self.encode_b(segments), strict=True)]

    def _aligned(self, text: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes, bytes]:
        own_a, own_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if not a or b"".join(own_a) != text or b"".join(own_b) != text:
            return b"", b"", b""
        ends_a, ends_b = [*accumulate(map(len, own_a))], [*accumulate(map(len, own_b))]
        i = j = 0
        step, last = NEW_A | NEW_B, len(text)
        links_a, links_b, steps = [], [], bytearray()
        while True:
            links_a.append(self.packed_a[a[i]])
            links_b.append(self.packed_b[b[j]])
            steps.append(step)
            x, y = ends_a[i], ends_b[j]
            if x == y:
                if x == last:
                    return b"".join(links_a), b"".join(links_b), bytes(steps)
                i, j, step = i + 1, j + 1, NEW_A | NEW_B
            elif x < y:
                i, step = i + 1, NEW_A
            else:
                j, step = j + 1, NEW_B


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One per Python worker."""
    return Pair(path_a, path_b)


class _Numbers(dict):
    """Keys to their numbers, in the order of their coming. A key is a segment without the space that it begins with, or one that begins with a line feed."""

    def __init__(self, segments: list[str]):
        super().__init__()
        self.segments = segments

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.segments)
        self.segments.append(key if key[:1] == "\n" else f" {key}")
        return n


class _Whole(_Numbers):
    """Any other segments, by themselves."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.segments)
        self.segments.append(key)
        return n


class _Block:
    """Texts as numbers of the segments that are listed once."""

    def __init__(self, p: Pair):
        self.p, self.ids, self.texts, self.bytes, self.segments = p, [], [], 0, []
        self.plain, self.other = _Numbers(self.segments), _Whole(self.segments)

    def _number(self, segment: str) -> int:
        if segment[0] == " " and segment[1:2] != "\n":
            return self.plain[segment[1:]]
        return self.plain[segment] if segment[0] == "\n" else self.other[segment]

    def add(self, ident, text: str | None) -> None:
        if text and self.p.fast and not _UNEVEN(f" {text}"):
            # Single spaces and line feeds between words: each begins a segment.
            keys = text.replace("\n", " \n").split(" ")
            numbers = np.fromiter(map(self.plain.__getitem__, keys), np.int32, len(keys))
        else:
            numbers = np.array([self._number(s) for s in self.p.segments(text)] if text else [], np.int32)
        self.ids.append(ident)
        self.texts.append(numbers)
        self.bytes += len(text or "")

    def made(self) -> tuple[list[bytes], list[str]]:
        """The texts as packed numbers, and the list, the most frequent segments first so that they take least bytes."""
        n = len(self.segments)
        often = np.bincount(np.concatenate(self.texts), minlength=n)
        order = np.argsort(-often, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return [packed(place[t]) for t in self.texts], [self.segments[i] for i in order.tolist()]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as groups of seven bits, the lowest first; all but the last of a number have the eighth bit."""
    parts = [numbers & 0x7F]
    left, sizes = numbers >> 7, np.ones(len(numbers), np.int64)
    while left.any():
        sizes += left > 0
        parts.append(left & 0x7F)
        left = left >> 7
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, part in enumerate(parts):
        has = sizes > k
        out[(ends - sizes + k)[has]] = part[has] | np.where(sizes[has] > k + 1, 0x80, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    sizes = np.diff(np.concatenate([[-1], ends]))
    out = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (b[(ends - sizes + 1 + k)[has]].astype(np.int64) & 0x7F) << 7 * k
    return out


def _blocks(docs: DataFrame, kind: str, path_a: str, path_b: str) -> DataFrame:
    """block, then of a text's row id and numbers, of a list's row first (its first number) and segments."""

    names = ["block", "id", "numbers", "first", "segments"]

    def rows(block: _Block, number: int, to: pa.DataType):
        numbers, segments = block.made()
        for at in range(0, len(numbers), 1000):
            ids, part = block.ids[at : at + 1000], numbers[at : at + 1000]
            columns = pa.array([number] * len(part), pa.int64()), pa.array(ids, to), pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)
        for at in range(0, len(segments), LISTED):
            columns = pa.array([number]), pa.nulls(1, to), pa.nulls(1, pa.binary()), pa.array([at]), pa.array([segments[at : at + LISTED]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)

    def run(batches):
        number, block, to = TaskContext.get().partitionId() << 32, None, pa.null()
        for b in batches:
            to = b.column(0).type
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = block or _Block(pair(path_a, path_b))
                block.add(ident, text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    yield from rows(block, number, to)
                    number, block = number + 1, None
        if block:
            yield from rows(block, number, to)

    return docs.mapInArrow(run, f"block long, id {kind}, numbers binary, first long, segments array<string>")


def _attached(places: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """block, numbers, sizes, a, b, steps: the links of a block's segments, as many places a row as a task has of a block at a time.

    places (block, i, segment) come sorted by segment, all of one segment in one partition.
    """
    names = ["block", "numbers", "sizes", "a", "b", "steps"]

    def made(blocks: list[int], places: list[int], links: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        order = np.argsort(blocks, kind="stable")
        of, edges = np.unique(np.array(blocks)[order], return_index=True)
        rows: list[list] = [[] for _ in names]
        for block, part in zip(of.tolist(), np.split(order, edges[1:]), strict=True):
            a, b, steps = zip(*[links[k] for k in part.tolist()], strict=True)
            values = block, packed(np.array(places)[part]), packed(np.fromiter(map(len, steps), np.int64, len(steps))), b"".join(a), b"".join(b), b"".join(steps)
            for column, v in zip(rows, values, strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=names)

    def run(batches):
        blocks, numbers, links, last, held = [], [], [], None, None
        for b in batches:
            for at in range(0, b.num_rows, LISTED):
                part = b.slice(at, LISTED)
                segments = part.column(2).to_pylist()
                new = [s for k, s in enumerate(segments) if s != (segments[k - 1] if k else last)]
                aligned = iter(pair(path_a, path_b).align(new))
                for s in segments:
                    if s != last:
                        last, held = s, next(aligned)
                    links.append(held)
                blocks += part.column(0).to_pylist()
                numbers += part.column(1).to_pylist()
                if len(blocks) >= GATHERED:
                    yield made(blocks, numbers, links)
                    blocks, numbers, links = [], [], []
        if blocks:
            yield made(blocks, numbers, links)

    return places.mapInArrow(run, "block long, numbers binary, sizes binary, a binary, b binary, steps binary")


def _joined(rows: pa.Table, name: str) -> np.ndarray:
    return unpacked(b"".join(rows[name].to_pylist()))


def _group_texts(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, step: np.ndarray) -> Iterator[bytes]:
    """By segment, of `sizes` links: the ids of A and B in each group, as `a1,a2|b1;a3|b2,b3`."""
    upto = np.cumsum(sizes)
    for first in range(0, len(sizes), LISTED):
        counts = sizes[first : first + LISTED].tolist()
        part = slice(int(upto[first] - sizes[first]), int(upto[min(first + LISTED, len(sizes)) - 1]))
        links = zip(map(str, a[part].tolist()), map(str, b[part].tolist()), step[part].tolist(), strict=True)
        for n in counts:
            text = own_b = ""
            for x, y, s in islice(links, n):
                if s == NEW_A:
                    text = f"{text},{x}"
                elif s == NEW_B:
                    own_b = f"{own_b},{y}"
                else:
                    text = f"{text}|{own_b};{x}" if text else x
                    own_b = y
            yield f"{text}|{own_b}".encode() if n else b""


_COMPOSED = "of long, id {}, n_a long, n_b long, n_groups long, n_links long, sha binary, codes binary, times binary, code long, pair long, n long"


def _composed(texts: pa.Table, rows: pa.Table) -> pa.Table:
    """Of a block: a row a text with its sums, the digest of its groups and its pairs as codes with times; and a row a pair with its code and texts."""
    order, sizes = _joined(rows, "numbers"), _joined(rows, "sizes")
    a, b, step = _joined(rows, "a"), _joined(rows, "b"), np.frombuffer(b"".join(rows["steps"].to_pylist()), np.uint8)
    # Segments by number: where each one's links begin, and how many there are.
    count, begin = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order], begin[order] = sizes, np.cumsum(sizes) - sizes
    ok, segment = count > 0, np.repeat(order, sizes)
    sums = np.stack([*(np.bincount(segment, (step & bit) == bit, len(order)) for bit in (NEW_A, NEW_B, NEW_A | NEW_B)), count], axis=1).astype(np.int64)
    groups = [b""] * len(order)
    for i, text in zip(order.tolist(), _group_texts(sizes, a, b, step), strict=True):
        groups[i] = text
    pairs, code, often = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
    # The most frequent pairs get the smallest codes, which take one byte.
    place = np.empty(len(pairs), np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(pairs))
    code = place[code]
    out: dict[str, list] = {k: [] for k in ("sums", "sha", "codes", "times")}
    total = np.zeros(len(pairs), np.int64)
    for x in texts["numbers"]:
        at = unpacked(x.as_py())
        if len(at) and ok[at].all():
            own, times = np.unique(at, return_counts=True)
            n = count[own]
            linked = code[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)]
            weight = np.bincount(linked, np.repeat(times, n)).astype(np.int64)
            codes = np.flatnonzero(weight)
            total[codes] += 1
            made = times @ sums[own], hashlib.sha256(b";".join(map(groups.__getitem__, at.tolist()))).digest(), packed(np.diff(codes, prepend=0)), packed(weight[codes])
        else:
            made = np.zeros(4, np.int64), None, b"", b""
        for column, v in zip(out.values(), made, strict=True):
            column.append(v)
    of, used = (texts["of"] if len(texts) else rows["block"])[0].as_py(), np.flatnonzero(total)
    by_code = pairs[np.argsort(place)]
    sums_of = np.array(out["sums"], np.int64).reshape(-1, 4)
    t, p = len(texts), len(used)
    return pa.table({
        "of": pa.array([of] * (t + p), pa.int64()), "id": pa.concat_arrays([texts["id"].combine_chunks(), pa.nulls(p, texts["id"].type)]),
        **{c: pa.concat_arrays([pa.array(sums_of[:, k]), pa.nulls(p, pa.int64())]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        **{c: pa.array(out[c] + [None] * p, pa.binary()) for c in ("sha", "codes", "times")},
        **{c: pa.concat_arrays([pa.nulls(t, pa.int64()), pa.array(v)]) for c, v in (("code", used), ("pair", by_code[used]), ("n", total[used]))},
    })


def _counted(texts: pa.Table, rows: pa.Table) -> pa.Table:
    """The texts with n_best and count_sum from the block's pairs (code, n, best)."""
    size = max(rows["code"].to_pylist(), default=-1) + 1
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[rows["code"].to_numpy()], best[rows["code"].to_numpy()] = rows["n"].to_numpy(), rows["best"].to_numpy()
    sums = []
    for codes, times in zip(texts["codes"], texts["times"], strict=True):
        c, w = np.cumsum(unpacked(codes.as_py())), unpacked(times.as_py())
        sums.append((int(w @ best[c]), int(w @ n[c])))
    return pa.table({**{c: texts[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "sha")}, **{c: pa.array([s[k] for s in sums], pa.int64()) for k, c in enumerate(("n_best", "count_sum"))}})


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row.

    Null and empty texts, and texts of which either tokenizer's tokens haven't the bytes, have no tokens: zeros and an empty
    string. Each row counts as a text of its own, so repeated rows count again and give equal rows. Ids may be null; other
    columns are ignored; an empty table gives none. The vocabularies' files must be on every executor.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    blocks = keep(_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), kind, path_a, path_b), "blocks")
    texts = blocks.filter("numbers is not null").select(F.col("block").alias("of"), "id", "numbers")
    lists = blocks.filter("segments is not null").select("block", "first", F.posexplode("segments").alias("k", "segment"))
    places = lists.select("block", (F.col("first") + F.col("k")).cast("int").alias("i"), "segment").repartition("segment").sortWithinPartitions("segment")
    attached = _attached(places, path_a, path_b)
    composed = keep(texts.groupBy("of").cogroup(attached.groupBy("block")).applyInArrow(_composed, _COMPOSED.format(kind)), "composed")

    pairs = composed.filter("pair is not null").select(F.col("of").alias("block"), "code", "pair", "n")
    counts = keep(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_a = F.shiftrightunsigned("pair", 32)
    # A row for each id of A at most, so its size is that of A's vocabulary.
    most = keep(counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most")), "pairs-most")
    judged = keep(counts.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs-judged")
    brought = pairs.drop("n").join(judged, "pair").select("block", "code", "n", "best")
    made = composed.filter("pair is null").select("of", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "codes", "times")
    out = made.groupBy("of").cogroup(brought.groupBy("block")).applyInArrow(_counted, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, sha binary, n_best long, count_sum long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce(F.lower(F.hex("sha")), F.lit("")).alias("groups_sha256"))
