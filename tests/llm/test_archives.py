"""Periodic runs, the content-addressed archive and the alignment of two tokenizers, against plain versions."""

import base64
import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loadlens.llm import aligning, queries, runs, warc
from loadlens.llm.common import table

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_runs(w, least=12):
    """Every maximal stretch whose words q apart are alike, less those that a smaller period has."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - a + q
            if n >= max(least, 2 * q) and not any(w[a : a + n - p] == w[a + p : a + n] for p in range(1, q)):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(w):
    found = plain_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(found), *longest, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("least", [1, 2, 4, 12])
def test_runs_of_random_words(least):
    r = random.Random(least)
    for _ in range(800):
        n, k = r.randint(0, 70), r.choice([1, 2, 2, 3, 5, 20])
        w = [b"%d" % r.randint(0, k) for _ in range(n)]
        if n > 5 and r.random() < 0.5:
            a, p = r.randint(0, n - 1), r.randint(1, 9)
            w = [w[a + (i - a) % p] if a <= i and a + (i - a) % p < n else w[i] for i in range(n)]
        assert runs.runs(w, least) == plain_runs(w, least), w


def test_runs_in_many_blocks(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 4)
    r = random.Random(9)
    for _ in range(200):
        w = [b"%d" % r.randint(0, 1) for _ in range(r.randint(30, 150))]
        assert runs.runs(w) == plain_runs(w)


def test_runs_of_long_texts():
    """A Fibonacci word, one word again and again, a long period: the automaton's worst cases, without time that grows with a square."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 20_000:
        a, b = b, b + a
    found = runs.runs(b)
    assert len(found) > 1000 and all(b[i] == b[i + q] for i, n, q in found[:50] for i in range(i, i + n - q))
    assert runs.runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert runs.runs([b"%d" % (i % 777) for i in range(20_000)]) == [(0, 20_000, 777)]
    assert runs.runs([b"%d" % i for i in range(100_000)]) == []


def test_runs(docs, empty, texts):
    out = runs.digests(docs)
    assert out.columns == ["doc_id", *RUN_COLUMNS]
    rows = defaultdict(set)
    for r in out.collect():
        rows[r["doc_id"]].add(tuple(r[c] for c in RUN_COLUMNS))
    assert all(len(v) == 1 for v in rows.values()) and len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        if len(t or "") < 20_000:
            assert rows[i] == {plain_digest((t or "").encode().split())}, i
    assert runs.digests(empty).count() == runs.find(empty).count() == 0
    one = docs.filter("doc_id = 7")
    assert [tuple(r) for r in runs.find(docs.sparkSession.createDataFrame([(1, "z " + "a b c " * 5), (2, None)], "doc_id long, text string")).collect()] == [(1, 1, 15, 3)]
    assert runs.collapse(one).select("text").distinct().first()[0] == " ".join(texts[7].split())


def test_runs_of_batches_without_any(spark):
    df = spark.createDataFrame([(i, f"a{i} b") for i in range(50)] + [(99, "a b c " * 9)], "doc_id long, text string").repartition(51)
    assert runs.digests(df).filter("n_runs > 0").count() == 1 and runs.find(df).count() == 1 and runs.collapse(df).filter("text = 'a b c'").count() == 1


def test_runs_query(spark):
    """The planted tails and their runs, over the whole table, by the rule in plain Python."""
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op11_periodic_runs(spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p, planted = 1 + (n - a) // (3 + g % 8), planted + 1
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n < 1500:
            assert got[doc_id] == plain_digest(w), doc_id
    assert planted > 5


def pages_of(spark):
    rows = [(i, f"http://a/{i % 3}", h, "x", 1) for i, h in enumerate(["same", "same", "", None, "other\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n", "漢字 é", "same"])]
    rows += [(None, None, "same", None, None), (None, "", "only without an id", None, None), (3, "http://b/\r\nWARC-Type: x", None, "y", 2), (5, "http://a/2", "漢字 é", "x", 1), (5, "http://a/2", "漢字 é", "x", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, header int").repartition(3)


def digest32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, tmp_path, least):
    pages = pages_of(spark)
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path, least=least)
    assert spark.read.parquet(f"{path}/payloads").count() == 5  # each different payload once
    out = warc.read_archive(spark, path)
    owner = {}
    for p, _, h, *_ in pages.collect():
        owner[h or ""] = max(owner.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, *_ in pages.collect():
        b = (h or "").encode()
        top = owner[h or ""]
        again = len(b) >= least and top >= 0 and p != top
        want.append((p, "revisit" if again else "response", top if again else None, len(b), digest32(b), b))
    got = [(r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_archive_files(spark, tmp_path):
    """Records as WARC files, parsed by their lengths: payloads with record headers inside do no harm."""
    headers, payloads = warc.archive(pages_of(spark))
    found = warc.records(headers, payloads)
    warc.write_files(found, f"file://{tmp_path}/files")
    back = [(dict(r.fields), bytes(r.block)) for r in warc.read_files(spark, f"file://{tmp_path}/files").collect()]
    assert len(back) == 12
    of = Counter((f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), b.split(b"\r\n\r\n", 1)[1]) for f, b in back)
    want = Counter((r.record_type, r.payload_digest, bytes(r.payload) if r.record_type == "response" else b"") for r in found.collect())
    assert of == want
    assert all(("WARC-Refers-To" in f) == ("WARC-Profile" in f) == (f["WARC-Type"] == "revisit") for f, _ in back)
    assert {f.get("WARC-Target-URI") for f, _ in back} == {None, "http://a/0", "http://a/1", "http://a/2", "http://b/%0D%0AWARC-Type: x"}
    with pytest.raises(ValueError, match="whole record"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


@pytest.mark.parametrize("change, said", [("concat(payload, X'00')", "stored payload"), (None, "the one that its header names")])
def test_archive_is_verified(spark, change, said):
    headers, payloads = warc.archive(pages_of(spark))
    bad = payloads.withColumn("payload", F.expr(change)) if change else payloads.filter("length(payload) > 4")
    with pytest.raises(PySparkException, match=said):
        warc.records(headers, bad).collect()


def test_archive_of_nothing(spark):
    headers, payloads = warc.archive(pages_of(spark).filter("1 = 0"))
    assert headers.count() == payloads.count() == warc.records(headers, payloads).count() == 0


def plain_alignment(p, rows):
    """Whole texts, all pairs of tokens compared, counts in dictionaries."""
    made = []
    for ident, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (p.a.encode(whole.decode(), add_special_tokens=False).ids, p.b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [p.bytes_a[i] for i in a], [p.bytes_b[i] for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append((ident, None))
            continue

        def spans(tokens):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            return out

        sa, sb = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        inside = [([], []) for _ in cuts]
        for side, tokens, spans_ in ((0, a, sa), (1, b, sb)):
            for i, (_, y) in zip(tokens, spans_):
                inside[bisect_left(cuts, y)][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in inside]
        links, j0 = [], 0
        for i, (x, y) in zip(a, sa):
            while j0 < len(sb) and sb[j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < y:
                links.append((i, b[j]))
                j += 1
        made.append((ident, (len(a), len(b), len(groups), links, sha(";".join(groups)))))
    counts = Counter(x for _, m in made if m for x in set(m[3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return Counter((ident, *((0,) * 6 + ("",) if m is None else (m[0], m[1], m[2], len(m[3]), sum(counts[x] == most[x[0]] for x in m[3]), sum(counts[x] for x in m[3]), m[4]))) for ident, m in made)


ODD = [" ", "\n", " \n", "a\n\n b  c\t\td\r\n e᠎  f   g 　 h", "x\x1c y \x85 z", "▁a ▁", "<s> <0x41> <|endoftext|> </s>", "  lead", "trail ", "\ttab", "can't we'll ' s don ' t", "漢字 漢字\n漢字", "a \n b", "\r\r x", ");\r\n x"]


def test_segments_have_the_tokens_of_the_text(texts):
    p, r = aligning.Pair(A, B), random.Random(3)
    assert p.cuts == " \n\t" and p.fast
    parts = [*" \n\t\r ab1!é漢▁ ᠎😀\x1c　;)", "'s", "ing", " "]
    for t in [*(t for t in texts if t), *ODD, *("".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1500))]:
        block = aligning._Block(p)
        block.add(1, t)
        segments = [block.segments[i] for i in block.texts[0]]
        assert "".join(segments) == f" {t}"
        a, b = p.a.encode(f" {t}", add_special_tokens=False).ids, p.b.encode(t)
        whole = b"".join(map(p.bytes_a.__getitem__, a)) == b"".join(map(p.bytes_b.__getitem__, b)) == f" {t}".encode()
        assert whole == all(steps for *_, steps in p.align(segments)), t
        if whole:
            assert (sum(p.encode_a(segments), []), sum(p.encode_b(segments), [])) == (a, b), t


def test_no_cuts_where_a_vocabulary_merges_across(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={"a": 0, "Ġ": 1, "aĠ": 2}, merges=[("a", "Ġ")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    t.save(str(tmp_path / "a.json"))
    p = aligning.Pair(str(tmp_path / "a.json"), B)
    assert p.cuts == "" and p.segments("a a") == [" a a"]


def test_packed_numbers():
    import numpy as np

    x = np.array([0, 1, 127, 128, 16383, 16384, 5_000_000, 2, 1 << 40])
    assert aligning.unpacked(aligning.packed(x)).tolist() == x.tolist()
    assert aligning.packed(x[:0]) == b"" and aligning.unpacked(b"").tolist() == []


@pytest.mark.parametrize("size", [2000, aligning.BLOCK_BYTES])
def test_alignment(spark, docs, empty, texts, size, monkeypatch):
    """Small blocks too, and shared ids, null ids, repeated rows and columns of the names used inside."""
    monkeypatch.setattr(aligning, "BLOCK_BYTES", size)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, block int, segment string").repartition(3)
    out = aligning.align(df, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == plain_alignment(aligning.pair(A, B), rows)
    assert aligning.align(empty, A, B).count() == 0


def test_alignment_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_cross_tokenizer(spark, SF).collect())) == plain_alignment(aligning.pair(A, B), rows)
