"""SimHash near-dedup by segment popcounts.

A fingerprint's bits are the majority votes of the XXH64 hashes of a text's word shingles. The fingerprint is mapped to
the popcounts of its segments; the Manhattan distance of two such vectors is never more than the Hamming distance of the
fingerprints, so a range join under that distance misses no pair. The join's grid: the segments form BLOCKS blocks, and
of two fingerprints within `bits` bits at most `bits` blocks can differ, so both lie in one cell of some choice of
BLOCKS - bits blocks. Pairs of a cell are held against the Manhattan bound, then verified on the fingerprints.

Equal fingerprints are one vertex. A cell of more than CELL_MOST fingerprints doesn't emit its pairs: its fingerprints,
each with the 64 that differ from it in one bit, are grouped by those values instead, and each group is linked to its least
member. Two fingerprints within two bits share such a value, and any two that share one lie within two bits, so this is
exact and linear.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, keep, map_texts, slices
from .components import components

SEED = 42
#: Bits of a segment, and blocks that the 64 / SEGMENT segments form.
SEGMENT, BLOCKS = 2, 5
#: The most fingerprints of a cell whose pairs are emitted.
CELL_MOST = 32
_EVEN = 0x5555555555555555


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of anything but space and 0x09-0x0D."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, joined by spaces; fewer words make one shingle, none makes none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - k] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp long (the 64 bits, signed). Null and empty texts have 0."""

    def rows(texts):
        found = np.array([fingerprint(shingle_hashes(words_of(t), shingle)) for t in texts], np.uint64)
        return {"fp": found.view(np.int64).tolist()}

    return map_texts(df, id_col, text_col, rows, "fp long")


def embedding(fp: Column) -> Column:
    """The popcounts (0, 1 or 2) of the 32 two-bit segments, each in its own segment's place of a long; no carries, so no overflow."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(fp: Column, bits: int) -> Column:
    """By choice of blocks, the cell that the fingerprint's popcounts lie in, with the choice's number."""
    segments = 64 // SEGMENT
    edges = [round(i * segments / BLOCKS) for i in range(BLOCKS + 1)]
    counts = embedding(fp)
    out = []
    for k, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - bits)):
        mask = sum(((1 << SEGMENT * (edges[b + 1] - edges[b])) - 1) << SEGMENT * edges[b] for b in blocks)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(k).alias("k"), counts.bitwiseAND(F.lit(mask)).alias("at")))
    return F.array(*out)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _manhattan(a: Column, b: Column) -> Column:
    """Of two embeddings: a segment's popcounts differ by 2 where they are 0 and 2, by 1 where their parities differ, else by 0."""
    odd = a.bitwiseXOR(b).bitwiseAND(F.lit(_EVEN))
    full = F.shiftrightunsigned(a.bitwiseXOR(b), 1).bitwiseAND(F.lit(_EVEN)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(full)


def links(distinct: DataFrame, bits: int = 2, most: int = CELL_MOST) -> DataFrame:
    """a, b: links between different fingerprints of a table of distinct ones (column fp), enough to connect every pair within `bits`."""
    if not 0 < bits <= 2:
        raise ValueError("bits must be 1 or 2: larger cells than CELL_MOST are resolved by one-bit neighbours")
    rows = distinct.select("fp", F.explode(_cells(F.col("fp"), bits)).alias("c")).select("fp", "c.k", "c.at")
    size = rows.groupBy("k", "at").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keep(rows.join(size, ["k", "at"]), "simhash-cells")
    few, many = shared.filter(F.col("n") <= most), shared.filter(F.col("n") > most)
    pairs = few.select("k", "at", F.col("fp").alias("a")).join(few.select("k", "at", F.col("fp").alias("b")), ["k", "at"])
    near = pairs.filter((F.col("a") < F.col("b")) & (_manhattan(embedding(F.col("a")), embedding(F.col("b"))) <= bits) & (_distance(F.col("a"), F.col("b")) <= bits)).select("a", "b")
    crowded = many.select("fp").distinct()
    values = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)))
    around = crowded.select("fp", F.explode(values).alias("v"))
    least = around.groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b <> most").select("v", "b")
    stars = around.join(least, "v").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    if bits == 1:
        stars = stars.filter(_distance(F.col("a"), F.col("b")) <= 1)
    return near.union(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the least id reachable over links).

    Texts without words have the zero fingerprint, which links like any other. Repeated rows and equal texts share a
    component; a null id is in a component but never names it, unless all its ids are null. Other columns are ignored.
    """
    fps = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min(id_col).alias("__least"))
    found = keep(links(by_fp.select("fp"), bits).distinct(), "links")
    roots = components(found)
    # A root that is no fingerprint's least id yet: the component's is the least over its fingerprints.
    named = by_fp.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = keep(named, "named")
    lone = named.groupBy("root").agg(F.min("__least").alias("component_id"))
    of_fp = named.select("fp", "root").join(lone, "root").select("fp", "component_id")
    out = fps.join(of_fp, "fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of 0.8 and more on word shingles -------------------------------------------------------------------

#: A pair of similarity s shares a band with chance 1 - (1 - s ** ROWS) ** BANDS: 0.9995 at 0.8.
BANDS, ROWS = 20, 5
#: Texts of a shingle's block, and pairs of a text, that one key of a join holds.
BLOCK = 512
#: Turns of heads before crowded groups are searched whole.
MOST_TURNS = 4
_MUL, _ADD = (np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1))


def sample_fingerprints(hashes: np.ndarray) -> list[int]:
    """By band, a fingerprint of the shingles that are least in ROWS random orders: equal ones for equal choices."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * _MUL + _ADD
        least = np.minimum(least, mixed.min(axis=0))
    h = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = (key ^ h[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, component_id: components over exact copies (words alike) and pairs whose sets of shingles have that Jaccard similarity.

    Candidates: SimHash links of near_groups(), and equal fingerprints of min-wise samples, since two texts of similarity
    0.8 differ in 8 to 15 bits of one fingerprint, which no grid separates from chance at scale. A text first meets one head
    only, the least of the heads of its groups; each candidate is verified on whole shingle sets, and what is alike becomes
    one component before any further pair is made. Groups that still hold several components go on to _settled(), which
    searches them whole.

    Null and empty texts are one text without words and so copies of each other. Repeated rows, and rows of one id, give
    a row each; rows with a null id are in no group but that of their copies (component_id is null if all of them have no
    id). Other columns are ignored, whatever their names; an empty table gives none.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[0].dataType.simpleString()

    def rows(batches):
        for b in slices(batches):
            key, fp, size, bands = [], [], [], []
            for t in as_bytes(b.column(1)):
                words = words_of(t)
                h = shingle_hashes(words, shingle)
                key.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                fp.append(fingerprint(h))
                size.append(len(np.unique(h)))
                bands.append(sample_fingerprints(h) if len(h) else [])
            made = [pa.array(key), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["id", "key", "fp", "m", "bands"])

    made = keep(docs.mapInArrow(rows, f"id {kind}, key string, fp long, m long, bands array<long>"), "samples")
    copies = made.groupBy("key").agg(F.min("id").alias("id"), *(F.min_by(c, "id").alias(c) for c in ("fp", "m", "bands")))
    copies = keep(copies.filter("id is not null"), "copies")
    # A band's number is part of its fingerprint, so `at` alone names a group.
    banded = copies.select("id", "m", F.explode("bands").alias("at"))
    text = F.struct("id", "m")
    heads = banded.groupBy("at").agg(F.count("*").alias("n"), F.min(text).alias("h")).filter("n > 1")
    members = keep(banded.join(heads, "at"), "members")
    met = members.filter("id <> h.id").filter(_sizes_allow(F.col("m"), F.col("h.m"), similarity)).groupBy("id").agg(F.min("h.id").alias("a")).select("a", F.col("id").alias("b"))
    by_fp = copies.groupBy("fp").agg(F.min("id").alias("id"))
    near = links(by_fp.select("fp")).select("a", "b")
    of_fp = by_fp.select("fp", "id")
    near = near.join(of_fp.withColumnRenamed("fp", "a").withColumnRenamed("id", "x"), "a").join(of_fp.withColumnRenamed("fp", "b").withColumnRenamed("id", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same_fp = copies.join(of_fp.withColumnRenamed("id", "a"), "fp").select("a", F.col("id").alias("b"))
    pairs = keep(_ordered(met.union(near).union(same_fp)), "pairs")

    def sets(batches):
        for b in slices(batches):
            h = [np.unique(shingle_hashes(words_of(t), shingle)).view(np.int64) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], names=["id", "h"])

    wanted = members.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    held = keep(docs.join(wanted, "id", "left_semi").mapInArrow(sets, f"id {kind}, h array<long>").dropDuplicates(["id"]), "shingles")
    roots = _settled(members.drop("h"), held, pairs, similarity)
    of_copy = copies.select("key", "id").join(roots.withColumnRenamed("v", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("component_id"))
    return made.select(F.col("id").alias(id_col), "key").join(of_copy, "key", "left").select(id_col, "component_id")


def _sizes_allow(m: Column, n: Column, similarity: float) -> Column:
    """Whether sets of m and n members can have that similarity."""
    return F.least(m, n) >= similarity * F.greatest(m, n)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_sets(pairs: DataFrame, held: DataFrame, side: str) -> DataFrame:
    """pairs with the set of the text in column `side`, as h_side.

    A text of many pairs is dealt to blocks of BLOCK pairs, with its set once for each block, so that no task gets all of them.
    """
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = pairs.join(many, side, "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int"))).drop("blocks")
    sets = held.select(F.col("id").alias(side), F.col("h").alias(f"h_{side}")).join(many, side, "left")
    sets = sets.select(side, f"h_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    return dealt.join(sets, [side, "block"]).drop("block")


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, h) have that Jaccard similarity."""
    both = _with_sets(_with_sets(pairs.select("a", "b"), held, "b"), held, "a")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return both.select("a", "b", common.alias("c"), (F.size("h_a") + F.size("h_b")).alias("s")).filter(F.col("c") >= similarity * (F.col("s") - F.col("c"))).select("a", "b")


def _settled(members: DataFrame, held: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """v, root: components over the verified pairs, and over all further ones of that similarity that share a group `at`.

    A group of several components gives all its pairs across them if it has at most CELL_MOST texts. In larger ones each
    text meets one head of another component, drawn anew in each turn, for as long as such turns merge anything; this only
    saves work, since what is then left of these groups goes on to _across(), which loses no pair.
    """
    roots = components(keep(_verified(pairs, held, similarity), "alike"))
    placed = members.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    for turn in range(MOST_TURNS + 1):
        mixed = placed.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("at")
        placed = keep(placed.join(mixed, "at"), "mixed")
        many = placed.filter(F.col("n") > CELL_MOST)
        if turn == MOST_TURNS:
            break
        head = F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id", "m", "root")
        met = many.join(many.groupBy("at").agg(F.min(head).alias("h")), "at").filter((F.col("root") != F.col("h.root")) & _sizes_allow(F.col("m"), F.col("h.m"), similarity))
        met = met.groupBy("id").agg(F.min("h").alias("h")).select(F.col("h.id").alias("a"), F.col("id").alias("b"))
        alike = keep(_verified(met, held, similarity), "alike")
        if alike.isEmpty():
            break
        roots = components(keep(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(alike), "stars"))
        placed = placed.drop("root").join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    few = placed.filter(F.col("n") <= CELL_MOST)
    small = few.join(few.select("at", F.struct("id", "m", "root").alias("h")), "at").filter("id < h.id")
    small = small.filter((F.col("root") != F.col("h.root")) & _sizes_allow(F.col("m"), F.col("h.m"), similarity)).select(F.col("id").alias("a"), F.col("h.id").alias("b"))
    large = keep(many.select("id", "m", "root").distinct(), "crowded")
    new = keep(_ordered(small.union(_across(large, held, similarity))).join(pairs, ["a", "b"], "left_anti"), "new-pairs")
    alike = keep(_verified(new, held, similarity), "alike")
    return components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(alike))


def _across(texts: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of texts (id, m, root) of different roots, among them each whose sets have that Jaccard similarity.

    Shingles are ordered by how many of the texts hold them. The first shingle, in that order, that a pair has in common bounds
    what they can share by what is left of either set, so it must come early in both: in the first 11 % of the smaller and
    the first 20 % of the larger set at 0.8. Pairs are made for each shingle among texts that hold it that early. Of a
    shingle's texts those of its most frequent root don't meet each other; the others are dealt to blocks of BLOCK texts.
    """
    each = held.join(texts.select("id"), "id", "left_semi").select("id", F.explode("h").alias("g"))
    often = keep(each.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    # Shingles of one text alone come first and join nothing; they only move the others' places.
    lists = each.join(often, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("l"))
    ranked = texts.join(lists, "id").select("id", "m", "root", F.posexplode("l").alias("i", "x"), F.size("l").alias("k"))
    ranked = ranked.select("id", "m", "root", (F.col("m") - F.col("k") + F.col("i")).alias("i"), F.col("x.g").alias("g"))
    slack, part = 1e-6, 2 * similarity / (1 + similarity)
    early = keep(ranked.filter(F.col("m") - F.col("i") >= similarity * F.col("m") - slack).withColumn("first", F.col("m") - F.col("i") >= part * F.col("m") - slack), "early")
    by_root = early.groupBy("g", "root").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    cells = by_root.groupBy("g").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.max("first").alias("first"))
    cells = keep(cells.filter((F.col("n") > F.col("most.n")) & F.col("first")).select("g", F.col("most.root").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks")), "cells")
    # Sizes of a pair that can be alike lie in one class or in neighbouring ones.
    size = F.floor(F.log(F.col("m").cast("double")) / (math.log(1 / similarity) * (1 + 1e-9))).cast("int")
    rows = early.join(cells, "g").select("g", "id", "m", "root", "i", "first", "most", "blocks", size.alias("size"))
    # Of a pair, one text at least holds the shingle as early as `first` says: texts that do meet all, the others only those that do.
    # The latter are met here if they are of the most frequent root; else they have met the text as its `other`.
    meets_all = F.col("first").cast("int")
    other = rows.filter("root <> most").select("g", F.pmod(F.xxhash64("id", "g"), F.col("blocks")).cast("int").alias("block"), meets_all.alias("kind"), F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size"), F.struct("id", "m", "root", "i").alias("o"))
    kinds = F.when(F.col("first") & (F.col("root") == F.col("most")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    all_ = rows.select("g", "size", "id", "m", "root", "i", F.explode(kinds).alias("kind"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("b")).select("*", F.explode("b").alias("block")).drop("b")
    met = all_.join(other, ["g", "size", "kind", "block"]).filter((F.col("root") != F.col("o.root")) & _sizes_allow(F.col("m"), F.col("o.m"), similarity))
    left = F.least(F.col("m") - F.col("i"), F.col("o.m") - F.col("o.i"))
    return met.filter(left >= part / 2 * (F.col("m") + F.col("o.m")) - slack).select(F.col("id").alias("a"), F.col("o.id").alias("b"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each component the row of its least id stays; of texts without words one stays, and null ids stay.

    Null and empty texts count as texts without words. Rows of one id count as one document and go or stay together; columns
    are as they were, whatever their names; an empty table gives none.
    """
    groups = similar_groups(docs, id_col, text_col, shingle, similarity)
    gone = groups.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
