"""Media columns: payloads as lossless 8-bit samples, and signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a known format may begin; a validator for each format
reads the structure there (chunk lengths, markers, checksums) and gives its true length, or rejects the place. From
what is confirmed, the declared type is corrected and media embedded in other bytes are carved out. The same walk over the bytes
notes the marks that end a PDF or a zip, so that no validator searches for them, and walks over markers and boxes remember
where they have been: bytes full of false beginnings take no more than linear time in them.

Texts hold media in encoded form; their runs of base64 and hexadecimal digits are decoded, sniffed and carved too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices

#: Payloads are padded with PAD up to a positive multiple of BLOCK bytes.
BLOCK, PAD = 576, b"\xff"
#: Samples a second that the stored form declares.
RATE = 8000
# Magic bytes of the formats known here, and the type of each.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"ftyp": "video/mp4",
}


#: Bytes between kept CRCs; bytes inflated at a time; what may stand before a block of an unknown stream.
CRC_STEP, INFLATED, _WINDOW = 4096, 1 << 16, bytes(1 << 15)
# Marks that the ends of a PDF and of a zip are found by.
ENDS = (b"%%EOF", b"startxref", b"PK\x05\x06")
#: Encoded runs of a text that are decoded: base64 and hexadecimal digits, of so many characters at least.
LEAST_RUN = 48
_RUNS = re.compile(rb"(?:[0-9a-fA-F]{2}){%d,}(?![0-9A-Za-z+/])|[A-Za-z0-9+/]{%d,}={0,2}" % (LEAST_RUN // 2, LEAST_RUN))


class Marks:
    """What one walk over the bytes gave the validators: beginnings, end marks, and where walks over markers have ended."""

    def __init__(self, data: bytes, search: bool = True):
        self.data = data
        self.begins: list[tuple[int, str]] = []
        self.pdfs: list[int] = []
        ends: dict[bytes, list[int]] = {m: [] for m in ENDS}
        for last, (kind, magic) in _automaton().iter(data.decode("latin-1")) if search else ():
            at = last + 1 - len(magic)
            if magic in ends:
                ends[magic].append(at)
                continue
            self.begins.append((at, kind))
            if kind == "application/pdf":
                self.pdfs.append(at)
        self.eofs, self.xrefs = ends[b"%%EOF"], ends[b"startxref"]
        #: By the beginning that a zip's end record implies, the last such record's end.
        self.zips: dict[int, int] = {}
        for end in ends[b"PK\x05\x06"]:
            if end + 22 <= len(data):
                size, first, note = struct.unpack_from("<IIH", data, end + 12)
                if first + size <= end and end + 22 + note <= len(data):
                    self.zips[end - first - size] = end + 22 + note
        #: By kind of walk, and place: 1 more than the end of the walk from there, -1 if it fails, 0 if no walk has come there.
        self.ended: dict[str, array] = {}
        #: Chunk chains: by place, the next place, a place further on, and how many places follow.
        self.chain: dict[int, tuple[int, int, int]] = {}
        #: Deflate streams: by the place of a block, end and bytes.
        self.deflated: dict[int, tuple[int, int]] = {}
        self.crcs: list[int] = []

    def walk(self, name: str, p: int, step) -> int:
        """Follows step(p) from p: a larger place goes on, a negative one ends the walk at its opposite, 0 fails. Gives the end, or 0."""
        if p > len(self.data):
            return 0
        if (ended := self.ended.get(name)) is None:
            ended = self.ended[name] = array("q", bytes(8 * (len(self.data) + 1)))
        path = []
        while not (end := ended[p]):
            path.append(p)
            at = step(self.data, p)
            if at <= 0 or at > len(self.data):
                end = 1 - at if at < 0 else -1
                break
            p = at
        for q in path:
            ended[q] = end
        return max(0, end - 1)

    def chained(self, p: int, end: int) -> bool:
        """Whether chunks (a tag, a length in four bytes, so many bytes, even) follow each other from p to end exactly.

        Each place is worked out once. Jumps over ever longer parts of a chain make a question take the logarithm of its length.
        """
        b, chain, path = self.data, self.chain, []
        at = p
        while at not in chain and at + 8 <= len(b):
            path.append(at)
            n = int.from_bytes(b[at + 4 : at + 8], "little")
            at += 8 + n + (n & 1)
        if at not in chain:
            chain[at] = (at, at, 0)
        for q in reversed(path):
            jump = chain[at][1]
            far = chain[jump][1]
            # Two jumps of one length make one of twice the length.
            chain[q] = (at, far if chain[at][2] - chain[jump][2] == chain[jump][2] - chain[far][2] else at, chain[at][2] + 1)
            at = q
        at = p
        while at < end and chain[at][0] != at:
            after, jump, _ = chain[at]
            at = jump if jump <= end else after
        return at == end

    def crc(self, first: int, end: int) -> int:
        """CRC-32 of data[first:end]: directly, or from those of the bytes before either, which are kept for each CRC_STEP bytes."""
        view = memoryview(self.data)
        if end - first <= 2 * CRC_STEP:
            return zlib.crc32(view[first:end])
        if not self.crcs:
            self.crcs = [0]
            for at in range(0, len(self.data), CRC_STEP):
                self.crcs.append(zlib.crc32(view[at : at + CRC_STEP], self.crcs[-1]))

        def before(p: int) -> int:
            return zlib.crc32(view[p - p % CRC_STEP : p], self.crcs[p // CRC_STEP])

        # The CRC of the bytes before `first`, carried over as many zero bytes as follow, is what they add to the longer one.
        carried, left, k = before(first), end - first, 0
        while left:
            if left & 1:
                t = _zeros(k)
                carried = t[0][carried & 255] ^ t[1][carried >> 8 & 255] ^ t[2][carried >> 16 & 255] ^ t[3][carried >> 24]
            left, k = left >> 1, k + 1
        return before(end) ^ carried


@lru_cache(maxsize=None)
def _zeros(k: int) -> list[list[int]]:
    """What 2 ** k zero bytes make of a CRC-32 register: by byte of the register, a table of its values' shares; it is linear."""

    def through(t: list[list[int]], x: int) -> int:
        return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]

    if not k:
        # Without the inversions at both ends a zero byte shifts the register; crc32(b"\0", x) inverts before and after.
        step = lambda x: zlib.crc32(b"\0", x ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return [[step(v << 8 * i) for v in range(256)] for i in range(4)]
    half = _zeros(k - 1)
    return [[through(half, half[i][v]) for v in range(256)] for i in range(4)]


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit PCM."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples of what wav() has made; ValueError for any other bytes."""
    if not (size := _riff_size(Marks(media, False), 0)) or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE")
    at = 12
    while at + 8 <= size:
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _riff_size(m: Marks, at: int) -> int:
    b = m.data
    if at + 12 > len(b):
        return 0
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if at + size > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return 0
    return size if size >= 12 and m.chained(at + 12, at + size) else 0


def _png_step(m: Marks):
    def step(b: bytes, p: int) -> int:
        if p + 12 > len(b) or p + 12 + (n := int.from_bytes(b[p : p + 4], "big")) > len(b):
            return 0
        if m.crc(p + 4, p + 8 + n) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        return -(p + 12 + n) if b[p + 4 : p + 8] == b"IEND" else p + 12 + n

    return step


def _png(m: Marks, at: int) -> int:
    if m.data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    return max(0, m.walk("png", at + 8, _png_step(m)) - at)


def _jpeg_step(b: bytes, p: int) -> int:
    if p + 2 > len(b) or b[p] != 0xFF:
        return 0
    mark = b[p + 1]
    if mark == 0xD9:
        return -(p + 2)
    if mark == 0x01 or 0xD0 <= mark <= 0xD8:
        return p + 2
    if p + 4 > len(b):
        return 0
    p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
    if mark == 0xDA:  # entropy-coded bytes up to the next marker that isn't stuffing or a restart
        found = _MARKER(b, p)
        return found.start() if found else 0
    return p


def _jpeg(m: Marks, at: int) -> int:
    return max(0, m.walk("jpeg", at + 2, _jpeg_step) - at)


#: Bytes after 0xFF that make it a marker.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S).search


def _block_step(b: bytes, p: int) -> int:
    """Over a GIF's sub-blocks, up to the empty one."""
    if p >= len(b):
        return 0
    return p + 1 + b[p] if b[p] else -(p + 1)


def _colours(b: bytes, p: int) -> int:
    """Bytes of the table of colours that the flags at p announce."""
    return 3 << (b[p] & 7) + 1 if b[p] & 0x80 else 0


def _gif_step(m: Marks):
    def step(b: bytes, p: int) -> int:
        if p >= len(b):
            return 0
        if b[p] == 0x3B:
            return -(p + 1)
        if b[p] == 0x21:
            return m.walk("gif blocks", p + 2, _block_step)
        return m.walk("gif blocks", p + 11 + _colours(b, p + 9), _block_step) if b[p] == 0x2C and p + 10 <= len(b) else 0

    return step


def _gif(m: Marks, at: int) -> int:
    if at + 13 > len(m.data):
        return 0
    return max(0, m.walk("gif", at + 13 + _colours(m.data, at + 10), _gif_step(m)) - at)


def _bmp(m: Marks, at: int) -> int:
    b = m.data
    if at + 54 > len(b):
        return 0
    size, rest, first, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if rest or planes != 1 or head < 40 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    return size if size == first + (width * bits + 31) // 32 * 4 * abs(height) and at + size <= len(b) else 0


def _ogg_step(b: bytes, p: int) -> int:
    if p + 27 > len(b) or b[p : p + 4] != b"OggS" or b[p + 4] or (n := b[p + 26]) + p + 27 > len(b):
        return 0
    end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
    return 0 if end > len(b) else -end if b[p + 5] & 4 else end


def _ogg(m: Marks, at: int) -> int:
    return max(0, m.walk("ogg", at, _ogg_step) - at)


def _flac_step(b: bytes, p: int) -> int:
    if p + 4 > len(b) or (end := p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")) > len(b):
        return 0
    return -end if b[p] & 0x80 else end


def _flac(m: Marks, at: int) -> int:
    if m.data[at + 4 : at + 8] not in (b"\0\0\0\x22", b"\x80\0\0\x22"):
        return 0
    # Frames carry no total length: to the end of the bytes.
    return len(m.data) - at if m.walk("flac", at + 4, _flac_step) else 0


def _pdf(m: Marks, at: int) -> int:
    """To the last end mark before the next PDF begins: updates append to a file and leave the older marks in it."""
    after = bisect_right(m.pdfs, at)
    until = m.pdfs[after] if after < len(m.pdfs) else len(m.data)
    k = bisect_right(m.eofs, until - 5) - 1
    if k < 0 or m.eofs[k] < at:
        return 0
    x = bisect_right(m.xrefs, m.eofs[k]) - 1
    return m.eofs[k] + 5 - at if x >= 0 and m.xrefs[x] > at else 0


def _zip(m: Marks, at: int) -> int:
    """By the last end record that says the archive begins here; records of archives stored inside say other places."""
    return max(0, m.zips.get(at, 0) - at)


def _inflated(b: bytes, p: int, d) -> tuple[int, int]:
    """Where a stream that begins at p ends, and the bytes it gives; zeros if it doesn't end. No more than INFLATED bytes are held."""
    size, most = 0, 64
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):
            part = d.unconsumed_tail
            if not part:
                part = b[p : p + most]
                p, most = p + len(part), min(4 * most, INFLATED)
            size += len(d.decompress(part, INFLATED))
    except zlib.error:
        return 0, 0
    return (p - len(d.unused_data), size) if d.eof else (0, 0)


def _deflated(m: Marks, p: int) -> tuple[int, int]:
    """End and bytes of a deflate stream from p, as its blocks alone say, or zeros: stored ones are passed over, each place once.

    From a block of another kind on, zlib says it, with a full window before the block, so that no distance is too far.
    """
    b, known, path, found = m.data, m.deflated, [], (0, 0)
    while (held := known.get(p)) is None:
        path.append(p)
        n = int.from_bytes(b[p + 1 : p + 3], "little")
        if p + 5 > len(b) or b[p] & 6:
            held = _inflated(b, p, zlib.decompressobj(-15, zdict=_WINDOW)) if p < len(b) and b[p] & 6 != 6 else found
        elif n ^ int.from_bytes(b[p + 3 : p + 5], "little") != 0xFFFF or p + 5 + n > len(b):
            held = found
        elif b[p] & 1:
            held = (p + 5 + n, n)
        else:
            p += 5 + n
            continue
        known[path.pop()] = held
        break
    for q in reversed(path):
        end, size = held
        held = known[q] = (end, size + int.from_bytes(b[q + 1 : q + 3], "little")) if end else found
    return held


def _gzip(m: Marks, at: int) -> int:
    """By inflating, from every place; where stored blocks come first, only if the blocks lead to an end with the right number of bytes."""
    b = m.data
    # Without flags the header has ten bytes.
    if at + 10 < len(b) and not b[at + 3] and not b[at + 10] & 6:
        end, size = _deflated(m, at + 10)
        if not end or size & 0xFFFFFFFF != int.from_bytes(b[end + 4 : end + 8], "little"):
            return 0
    return max(0, _inflated(b, at, zlib.decompressobj(31))[0] - at)


def _mp4_step(b: bytes, p: int) -> int:
    if p + 8 > len(b):
        return -p
    n = int.from_bytes(b[p : p + 4], "big")
    return p + n if n >= 8 and p + n <= len(b) and b[p + 4 : p + 8].isalnum() else -p


def _mp4(m: Marks, at: int) -> int:
    """at: of the first box, whose type is `ftyp`; boxes follow as long as they are whole."""
    size = m.walk("mp4", at, _mp4_step) - at if at >= 0 else 0
    return size if size > 16 else 0


_LENGTH = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff_size, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4}
_RIFF = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in [*MAGIC.items(), *((e, "") for e in ENDS)]:
        a.add_word(magic.decode("latin-1"), (kind, magic))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the confirmed media from left to right; what lies inside another is left out."""
    found, end, marks = [], 0, Marks(data)
    for at, kind in marks.begins:
        at -= 4 * (kind == "video/mp4")
        if at < end or not (size := _LENGTH[kind](marks, at)):
            continue
        found.append((at, size, _RIFF.get(data[at + 8 : at + 12], kind) if kind == "riff" else kind))
        end = at + size
    return found


def kind_of(data: bytes) -> str | None:
    """The confirmed type of bytes that are one medium from their beginning on, by that beginning alone."""
    for magic, kind in MAGIC.items():
        # The ends of a PDF and of a zip must be searched for.
        if data.startswith(magic, 4 * (kind == "video/mp4")) and _LENGTH[kind](Marks(data, kind in ("application/pdf", "application/zip")), 0):
            return _RIFF.get(data[8:12], kind)
    return None


def decoded(text: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(offset, encoding, bytes) of the runs of base64 and hexadecimal digits; base64 is cut to whole groups of four."""
    for run in _RUNS.finditer(text):
        digits = run[0]
        if len(digits) % 2 == 0 and not digits.translate(None, b"0123456789abcdefABCDEF"):
            yield run.start(), "hex", bytes.fromhex(digits.decode())
        else:
            plain = digits.rstrip(b"=")
            plain = plain[: len(plain) - (len(plain) % 4 == 1)]
            yield run.start(), "base64", base64.b64decode(plain + b"=" * (-len(plain) % 4))


def stored(text: bytes) -> tuple[bytes, bytes]:
    """A text's padded payload, and its stored form."""
    payload = text + PAD * (-len(text) % BLOCK or (0 if text else BLOCK))
    return payload, wav(payload)


def media_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "text/plain") -> DataFrame:
    """Texts as media: sizes and digests of the payload read back and of the stored form, and what sniffing says.

    `feature` is `type;kept or corrected;embedded=n:list;carved=n:list`: the stored form's confirmed type, `corrected` if it
    isn't the declared one; the media in the payload's own bytes as type@offset+length; and the media carved out of its
    encoded runs as encoding@offset of the run/type@offset+length/first 16 digits of their SHA-256. Null and empty texts are one block of padding; ids may
    be null or repeated; other columns are ignored.
    """

    def rows(texts):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for t in texts:
            media = stored(t)[1]
            back = wav_samples(media)
            inside = sniff(back)
            kind = kind_of(media) or "application/octet-stream"
            parts = ",".join(f"{k}@{a}+{n}" for a, n, k in inside)
            carved = [f"{how}@{place}/{k}@{a}+{n}/{hashlib.sha256(b[a : a + n]).hexdigest()[:16]}" for place, how, b in decoded(t) for a, n, k in sniff(b)]
            for k, v in (("n_bytes", len(t)), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-32:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", f"{kind};{'kept' if kind == declared else 'corrected'};embedded={len(inside)}:{parts};carved={len(carved)}:{','.join(carved)}")):
                out[k].append(v)
        return out

    return map_texts(df, id_col, text_col, rows, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def carve(df: DataFrame, id_col: str, payload_col: str, declared_col: str) -> DataFrame:
    """One row for each confirmed medium of a binary column: id, offset, length, type, declared, corrected type of the whole, bytes.

    A payload without any gives one row with null offset and `application/octet-stream` or the declared type if that has no
    signature here. Null payloads are empty.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    known = set(MAGIC.values()) | set(_RIFF.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at_row, rest = [], []
            for i, (data, declared) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                found = sniff(data or b"")
                whole = next((k for a, n, k in found if not a), None) or ("application/octet-stream" if declared in known or declared is None else declared)
                for a, n, k in found or [(None, None, None)]:
                    at_row.append(i)
                    rest.append({"offset": a, "length": n, "type": k, "declared": declared, "corrected": whole, "media": data[a : a + n] if n else None})
            made = pa.Table.from_pylist(rest, schema=pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("declared", pa.string()), ("corrected", pa.string()), ("media", pa.binary())])).combine_chunks()
            for x in made.to_batches():
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at_row, pa.int64())), *x.columns], names=[id_col, *x.schema.names])

    source = df.select(F.col(id_col), F.col(payload_col).cast("binary").alias("__payload"), F.col(declared_col).cast("string").alias("__declared"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, offset long, length long, type string, declared string, corrected string, media binary")


def _bytes_of(n: Column, size: int, big: bool = False) -> Column:
    """A number as so many bytes, the lowest first unless `big`."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    parts = [F.substring(digits, 1 + 2 * i, 2) for i in range(size)]
    return F.unhex(F.concat(*(parts if big else reversed(parts))))


def wrapped(kind: str, data: Column) -> Column:
    """Bytes as a medium: `wav` of 8-bit samples, `bmp` of one line of 8-bit pixels, or `mp4` with a box of data; native."""
    n, b = F.octet_length(data).cast("long"), lambda x: F.lit(x)
    if kind == "wav":
        odd = n % 2
        return F.concat(b(b"RIFF"), _bytes_of(n + odd + 36, 4), b(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"), _bytes_of(n, 4), data, F.when(odd == 1, b(b"\0")).otherwise(b(b"")))
    if kind == "bmp":
        fill = F.pmod(-n, F.lit(4))
        pad = F.when(fill == 0, b(b"")).when(fill == 1, b(b"\0")).when(fill == 2, b(b"\0\0")).otherwise(b(b"\0\0\0"))
        return F.concat(b(b"BM"), _bytes_of(n + fill + 54, 4), b(struct.pack("<III", 0, 54, 40)), _bytes_of(n, 4), b(struct.pack("<iHH", 1, 1, 8) + b"\0" * 24), data, pad)
    if kind == "mp4":
        return F.concat(b(b"\0\0\0\x14ftypisom\0\0\0\0isom"), _bytes_of(n + 8, 4, True), b(b"mdat"), data)
    raise ValueError(f"no such medium: {kind}")
