"""The row-wise operators against plain versions, text by text."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loadlens.llm import bpe, licenses, media, repetition, secrets

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def by_id(df):
    rows = {}
    for r in df.collect():
        assert rows.setdefault(r["doc_id"], r) == r  # repeated rows give equal rows
    return rows


def check(out, texts, of, columns):
    rows = by_id(out)
    assert None in rows and len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        want = of(t or "")
        assert tuple(rows[i][c] for c in columns) == want, (i, (t or "")[:80])


def test_bpe(docs, empty, texts):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})

    def of(t):
        ids = encoding.encode_ordinary(t)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    check(bpe.digests(docs, PATH, PATTERN), texts, of, ("n_tokens", "ids_sha256", "decoded_sha256"))
    assert bpe.digests(empty, PATH, PATTERN).count() == 0
    back = by_id(bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts))


def test_bpe_cache_turnover(monkeypatch):
    codec = bpe.Codec(PATH, PATTERN)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    texts = [f"word{i % 7} other{i % 5}, new{i}" for i in range(60)]
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert [codec.encode(t).tolist() for t in texts] == [encoding.encode_ordinary(t) for t in texts]


def test_merges_of_pieces_of_all_lengths():
    """Against merging the least pair found by a scan, over one level of the tree, two and three."""
    ranks, r = bpe.read_ranks(PATH), random.Random(3)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    for n in (*range(1, 40), 255, 256, 257, 258, 300, 700):
        for letters in (b"ab", b"etaoin shrdlu", bytes(range(256))):
            piece = bytes(r.choices(letters, k=n))
            assert bpe.merge(piece, ranks) == ([ranks[piece]] if piece in ranks else plain(piece)), piece


def test_bpe_takes_words_once(monkeypatch):
    """A word is split once, whether a space or a line feed stands before it, and a single pre-token is kept as a word alone."""
    codec, split = bpe.Codec(PATH, PATTERN), []
    plain = codec.split
    codec.split = lambda t: split.append(t) or plain(t)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    text = "\n".join(["gloriously zxqvy it's 7x"] * 50)
    assert codec.encode(text).tolist() == encoding.encode_ordinary(text)
    assert sorted(split) == sorted(["gloriously", " zxqvy", " it's", " 7x"]) and not any("zxqvy" in p for p in codec.pieces)
    for odd in ("", " ", "\n", "a  b", "a\tb  c", " a", "a ", "a\n", "a\n\nb", "a \nb", "a\u3000b", "a\x1cb c", "a\u2028b", "a\xa0 b"):
        assert codec.encode(odd).tolist() == encoding.encode_ordinary(odd), odd


def test_bpe_of_another_pattern():
    """Punctuation that takes the line feed after it: words are no texts of their own then."""
    ranks = {bytes([i]): i for i in range(256)} | {b"!\n": 256}
    pattern = r"[^\s\w]+\n*|\w+| ?[^\s]+|\s+"
    codec = bpe.Codec(PATH, PATTERN)
    assert codec.even
    codec.ranks, codec.split = ranks, __import__("regex").compile(pattern).findall
    codec.forget()
    codec.even = codec._falls_into_words()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert not codec.even and codec.encode("a!\nb").tolist() == encoding.encode_ordinary("a!\nb") == [97, 256, 98]


def plain_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, x in enumerate(zip(words, words[1:], words[2:])) if triples[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_repetition(docs, empty, texts):
    out = repetition.judge(repetition.repetition(docs))
    check(out, texts, plain_rules, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert not out.filter("base_failed and kept").count()
    assert repetition.judge(repetition.repetition(empty)).count() == 0


@pytest.mark.parametrize("k", [5, 7])
def test_repetition_shares(k):
    words = ("a b c d e f g h " * 2 + " ".join(f"u{i}" for i in range(30))).split()
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    inside = {i + j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(k)}
    want = sum(len(words[i]) for i in inside) / sum(map(len, words))
    assert repetition.measure(" ".join(words).encode())[f"dup_{k}_share"] == pytest.approx(want)


def test_repetition_limits(spark):
    """A line said twice passes in a short text; in long ones the limits are those of the shares alone, whatever their order."""

    def text(n, twice):
        own = [f"u{i:05}" for i in range(n - 2 * twice)]
        line = [f"r{i:05}" for i in range(twice)]
        return " ".join(line + own + line)

    rows = [(0, text(60, 10)), (1, text(60, 14)), (2, text(5000, 10)), (3, text(5000, 360)), (4, text(5000, 500)), (5, text(5000, 1000)), (6, text(400, 80)), (7, text(5000, 230))]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.judge(repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert kept == {i: (False, i in (0, 2, 7)) for i in range(8)}


def plain_licenses(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(docs, empty, texts):
    out = licenses.scan(docs)
    check(out, texts, plain_licenses, ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    for r in out.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(empty).count() == 0


def test_license_chains():
    a = licenses.automaton()
    words = ["x"] * 5 + licenses.TEMPLATES["mit"].split() + ["y"] * 40 + licenses.TEMPLATES["isc"].split()[:6]
    words[30] = "changed"
    spans = a.chain(a.scan([w.encode() for w in words])[1])
    mit = next(s for s in spans if s[0] == "mit")
    assert mit[1] == 5 and mit[2] == 5 + len(licenses.TEMPLATES["mit"].split()) and mit[4] > 0.95
    assert all(s[0] != "isc" for s in spans)
    text = licenses.TEMPLATES["bsd"].encode().upper() + b" 123"
    assert a.chain(a.scan(licenses.words_of(text))[1])[0][0] == "bsd"


def test_matching_statistics_against_brute_force():
    import random

    templates = {"p": "a b c a b d a b c e", "q": "b c a b c a", "r": "e e e a b"}
    a = licenses.Automaton(templates, {"b c": "x", "a b d": "y", "c a b c a": "z"})
    r = random.Random(1)
    inside = {k: {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)} for k, t in enumerate(templates.values()) for w in [t.split()]}
    for _ in range(300):
        words = [r.choice("abcdef") for _ in range(r.randint(0, 25))]
        hits, matches = a.scan([w.encode() for w in words])
        want = [(i, label) for p, label in (("b c", "x"), ("a b d", "y"), ("c a b c a", "z")) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert sorted(hits) == sorted(want)
        ends = []
        for k, passages in inside.items():
            stat = [max((n for n in range(1, i + 1) if tuple(words[i - n : i]) in passages), default=0) for i in range(1, len(words) + 1)]
            ends += [(i + 1, n, k) for i, n in enumerate(stat) if n >= licenses.LEAST_WORDS and (i + 1 == len(stat) or stat[i + 1] != n + 1)]
        assert sorted((e, n, k) for e, n, k, _ in matches) == sorted(ends)
        for e, n, k, v in matches:
            w = list(templates.values())[k].split()
            assert sorted(a.places[v][k]) == [i for i in range(n, len(w) + 1) if w[i - n : i] == words[e - n : e]]


def test_license_chains_against_all_chains():
    """Every chain of every template is written out; kept spans must be disjoint, possible and of the greatest sum."""
    import itertools
    import random

    templates = {"p": "a b c d a b c e f a b c", "q": "b c d a f e", "r": "a b c a b d e"}
    a = licenses.Automaton(templates, {})
    r = random.Random(2)
    several = 0
    for _ in range(400):
        words = [w for _ in range(r.randint(0, 5)) for k in [r.randrange(3)] for t in [list(templates.values())[k].split()] for i in [r.randrange(4)] for w in [*t[i : i + r.randint(3, 8)], *"xyzxyzxyz"[: r.choice((0, 1, 7))]]]
        matches = a.scan([w.encode() for w in words])[1]
        got = a.chain(matches)
        for k, (name, t) in enumerate(templates.items()):
            t = t.split()
            links = [(e - n, e, i - n, i) for e, n, m, _ in matches if m == k for i in range(n, len(t) + 1) if t[i - n : i] == words[e - n : e]]

            def chains(last, t_end=len(links), links=links):
                """(cover, first) of all chains that end with this link."""
                s, e, b, u = links[last]
                yield e - s, s
                for i in range(t_end):
                    _, e0, _, u0 = links[i]
                    new = e - s - max(0, e0 - s, u0 - b)
                    if new > 0 and e0 < e and s - e0 <= licenses.MOST_GAP and b - u0 <= licenses.MOST_GAP:
                        yield from ((c + new, f) for c, f in chains(i))

            best = {j: max(chains(j)) for j in range(len(links))}
            fit = sorted({(f, links[j][1], c) for j, (c, f) in best.items() if c >= licenses.ENOUGH_WORDS or (c >= licenses.LEAST_CHAIN and c >= licenses.LEAST_COVER * len(t))})
            disjoint = lambda spans: all(x[1] <= y[0] for x, y in itertools.pairwise(sorted(spans)))
            most = max((sum(x[2] for x in some) for n in range(len(fit) + 1) for some in itertools.combinations(fit, n) if disjoint(some)), default=0)
            mine = [(s, e, c) for m, s, e, c, _ in got if m == name]
            assert set(mine) <= set(fit) and disjoint(mine) and sum(x[2] for x in mine) == most
            several += len(mine) > 1
    assert several


def test_license_templates_of_the_caller(spark):
    df = spark.createDataFrame([(1, "One two THREE four, six!"), (2, "released under the")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df, templates={"own": "one two three four five"}, phrases={"three four": "b"}).collect()}
    assert (rows[1]["labels"], rows[1]["base_labels"], rows[1]["spans"][0]["covered"]) == ("b,own", "b", 4)
    assert rows[2]["labels"] == "" and licenses.scan(df).filter("doc_id = 2").first()["labels"] == ""


def plain_media(t):
    b = t.encode()
    payload = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
    return len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_media(docs, empty, texts):
    out = media.media_of_texts(docs)
    check(out, texts, plain_media, ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    assert media.media_of_texts(empty).count() == 0
    assert {r["feature"].split(";")[0] for r in out.collect()} == {"audio/wav"}


def png():
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_carving(spark):
    import gzip

    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"," + bytes(8) + b"\0" + b"\x02\x02\x44\x01\x00" + b";"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\x02\xff\xd9"
    gz, sound = gzip.compress(b"hello" * 9, mtime=0), media.wav(b"abc")
    rows = [(1, b"noise" + png() + b"RIFF fake" + gif + jpeg + b"tail", "image/jpeg"), (2, png(), "text/plain"), (3, None, None), (4, b"", "image/png"), (5, gz + b"x" + sound, "image/png"), (6, png()[:-3], "text/css"), (7, media.wav(png() * 2), "audio/wav")]
    out = media.carve(spark.createDataFrame(rows, "id int, payload binary, type string"), "id", "payload", "type").collect()
    found = {}
    for r in out:
        found.setdefault(r["id"], []).append((r["offset"], r["type"], r["corrected"], r["media"] and bytes(r["media"])))
    assert [x[1] for x in found[1]] == ["image/png", "image/gif", "image/jpeg"] and found[1][0][3] == png() and found[1][1][3] == gif and found[1][2][3] == jpeg
    assert found[2] == [(0, "image/png", "image/png", png())]
    assert found[3] == [(None, None, "application/octet-stream", None)] == found[4]
    assert [(x[1], x[3]) for x in found[5]] == [("application/gzip", gz), ("audio/wav", sound)]
    assert found[6] == [(None, None, "text/css", None)]
    assert [x[1] for x in found[7]] == ["audio/wav"] and [x[2] for x in media.sniff(media.wav_samples(found[7][0][3]))] == ["image/png"] * 2


def plain_secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def test_secrets(docs, empty, texts):
    out = secrets.scan(docs)
    check(out, texts, lambda t: plain_secrets(t)[:4], ("n_assign", "n_access", "n_hex", "base_sha256"))
    for i, r in by_id(out).items():
        if i is not None:
            base = plain_secrets(texts[i] or "")[4].split(",")
            assert set(filter(None, base)) <= set(r["spans"].split(","))
    assert secrets.scan(empty).count() == 0
    assert not [n for n in out._jdf.queryExecution().toString().split() if "Python" in n]


def test_many_secrets_in_one_text(spark):
    text = "é token=abcdefg, " * 1500
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r["base_sha256"] == plain_secrets(text)[3] and r["n_assign"] == 1500


def test_random_battery(spark):
    import random

    r = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choice(b64) for _ in range(n)) for n in (32, 40, 44, 64, 88) for _ in range(40)]
    prose = [f"chapter-{i}-of-the-long-book-2024-01-{i % 28 + 1}" for i in range(400)] + ["a1" * 30, "version-1-0-0-release-candidate"]
    rows = [(i, f"see {x} there") for i, x in enumerate([*keys, *prose])]
    found = {r["doc_id"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).filter("spans like '%random%'").collect()}
    assert len([i for i in found if i < len(keys)]) >= 0.9 * len(keys)
    assert len([i for i in found if i >= len(keys)]) <= 0.03 * len(found)


def test_redaction(docs, texts, spark):
    df = spark.createDataFrame([(1, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é b', 5), (2, "clean", 5), (3, None, 5), (4, "deadbeef" * 4, 5)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in secrets.redacted(df, length_col="n_chars").collect()}
    assert out[1]["text"] == 'a <secret>" é b' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean" and out[2]["n_chars"] == 5 and out[3]["text"] is None and out[4]["text"] == "<secret>"
    kept = secrets.redacted(docs)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()
    for r in kept.filter("doc_id is not null").collect():
        if not plain_secrets(texts[r["doc_id"]] or "")[4] and "secret>" not in (r["text"] or ""):
            assert r["text"] == texts[r["doc_id"]]


def plain_battery(token):
    plain = token.replace("-", "+").replace("_", "/")
    alphabet = next(a for a in secrets.ENCODINGS if set(plain) <= set(a))
    n, k, v = len(plain), len(alphabet), [alphabet.index(c) for c in plain]
    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    x, df = max(0.0, k * sum(c * c for c in Counter(v).values()) / n - n), k - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    chi = normal(z) / 2 if z > 0 else 1 - normal(z) / 2
    runs = normal((sum((a < k / 2) != (b < k / 2) for a, b in zip(v, v[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    mid = (k - 1) / 2
    serial = normal(sum((a - mid) * (b - mid) for a, b in zip(v, v[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    t = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in (chi, runs, serial)) / 3
    return chi, runs, serial, 1 / (math.pi * t) if t > 1e6 else 0.5 - math.atan(t) / math.pi


def keys(r, n, size):
    return ["".join(r.choice(a) for _ in range(size)) for a in secrets.ENCODINGS for _ in range(n)]


def test_battery_against_plain(spark):
    r = random.Random(11)
    made = [k for size in (20, 33, 64, 200) for k in keys(r, 3, size)] + ["a1" * 20, "abcdefghijklmnopqrstuvwxyz0123456789", "internationalisation-of-2-things", "A" * 30 + "b2"]
    df = spark.createDataFrame([(t,) for t in made], "t string").select("t", secrets.battery(F.col("t")).alias("b")).select("t", "b.*")
    for row in df.collect():
        want = plain_battery(row["t"])
        for got, w in zip((row["chi"], row["runs"], row["serial"], row["p"]), want):
            assert math.isclose(got, w, rel_tol=1e-5, abs_tol=1e-12), row["t"]
    by = {row["t"]: row["p"] for row in df.collect()}
    assert by["a1" * 20] < 1e-6 and by["A" * 30 + "b2"] < 1e-6


def test_battery_keeps_keys_of_every_encoding(spark):
    """Random keys beside odd ones: few are turned down, at any length and in any encoding."""
    r = random.Random(12)
    made = [(k, True) for size in (20, 24, 32, 52, 64, 128) for k in keys(r, 25, size) if re.search("[0-9]", k) and re.search("[A-Za-z]", k)] + [("ab1" * r.randint(8, 30), False) for _ in range(200)]
    df = spark.createDataFrame([(i, f"see {k} there") for i, (k, _) in enumerate(made)], "doc_id long, text string")
    found = {x["doc_id"] for x in secrets.scan(df).filter("spans like '%random%'").collect()}
    real = {i for i, (_, good) in enumerate(made) if good}
    long = {i for i in real if len(made[i][0]) >= 32}
    print("keys found", len(found & real) / len(real), "of 32 and more", len(found & long) / len(long), "odd ones", len(found - real))
    assert len(found & long) > 0.98 * len(long) and len(found & real) > 0.9 * len(real) and not found - real


def test_benjamini_hochberg(spark):
    r = random.Random(13)
    rows = [(r.randint(20, 150), r.choice([0, 0, 1, 2, 5, 9, 14, 30, 400])) for _ in range(600)]
    got = secrets.benjamini_hochberg(spark.createDataFrame(rows, "n int, nats int"), F.col("nats"), 0.01)
    for k, low in enumerate(secrets.BANDS):
        high = [*secrets.BANDS, 10**9][k + 1]
        own = sorted((x for n, x in rows if low <= n < high), reverse=True)
        good = [x for i, x in enumerate(own) if x > 0 and math.exp(-x) <= 0.01 * sum(y >= x for y in own) / len(own)]
        assert got.get(k) == min(good, default=None)


def plain_redacted(t, spans):
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [t[at:s], secrets.MASK]
        at = max(at, e)
    return "".join(out) + t[at:]


def test_masked_against_plain(spark):
    r = random.Random(14)
    rows = []
    for i in range(60):
        t = "".join(r.choice("ab é漢😀") for _ in range(r.choice([5, 60, 900])))
        spans = sorted({tuple(sorted(r.sample(range(len(t) + 1), 2))) for _ in range(r.choice([1, 3, 70, 200]))})
        rows.append((i, t, [{"s": a, "k": 0, "e": b} for a, b in spans]))
    df = spark.createDataFrame(rows, "i int, t string, spans array<struct<s:int,k:int,e:int>>")
    got = {x["i"]: x["m"] for x in df.select("i", secrets._masked(F.col("t"), F.col("spans")).alias("m")).collect()}
    assert all(got[i] == plain_redacted(t, [(x["s"], x["e"]) for x in spans]) for i, t, spans in rows)


def test_redacted_many_secrets_and_clashing_names(spark, empty):
    text = " ".join(f"token=abcdef{i:06d}" for i in range(50_000))
    df = spark.createDataFrame([(1, text, "x", "y", 1.5), (2, None, None, "z", None), (3, "", "", "", 0.0)], "doc_id long, text string, __base string, __random string, __spans double")
    began = time.time()
    out = {x["doc_id"]: x for x in secrets.redacted(df).collect()}
    assert out[1]["text"] == " ".join(["token=abcdef000000".replace("token=abcdef000000", secrets.MASK)] * 50_000) and time.time() - began < 60
    assert (out[1]["__base"], out[1]["__random"], out[1]["__spans"]) == ("x", "y", 1.5) and out[2]["text"] is None and out[3]["text"] == ""
    assert secrets.redacted(df).schema == df.schema and secrets.redacted(empty).count() == 0


def chunk(kind, data=b""):
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


#: False beginnings whose walks all lead far: GIF sub-blocks, FLAC blocks, RIFF chunks, PNG with a chunk up to the end, gzip with stored blocks.
HOSTILE = (
    b"GIF89a" + b"\0" * 7 + b"\x21\xf9\x01\x01", b"GIF87a!" * 9, b"fLaC\0\0\0\x22" + b"\0" * 34 + b"\x01\0\0\0", b"fLaC\0\0\0\x22" + b"a" * 12,
    b"RIFF\0\x10\0\0WAVE", b"RIFF\x0c\0\0\0WAVEdata\0\0\0\0", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + b"\0\x40\0\0aaaa",
    b"\x1f\x8b\x08\0\0\0\0\0\0\x03", b"\x1f\x8b\x08\0\0\0\0\0\0\x03\0\xf6\xff\x09\0" + b"\0" * 5,
)


def test_crc_of_parts():
    data = random.Random(4).randbytes(70_000)
    m, r = media.Marks(data), random.Random(5)
    for _ in range(300):
        a, b = sorted((r.randrange(70_001), r.randrange(70_001)))
        assert m.crc(a, b) == zlib.crc32(data[a:b])


def test_chains_end_where_chunks_do():
    r = random.Random(6)
    for _ in range(300):
        data = b"".join(b"tag " + r.choice([0, 1, 2, 3, 8, 9]).to_bytes(4, "little") + b"x" * r.choice([0, 1, 2, 3, 4, 8, 9, 10]) for _ in range(r.randint(1, 40)))
        m = media.Marks(data)
        for _ in range(30):
            p, end = r.randrange(len(data)), r.randrange(len(data) + 1)
            at = p
            while at < end and at + 8 <= len(data):
                n = int.from_bytes(data[at + 4 : at + 8], "little")
                at += 8 + n + (n & 1)
            assert m.chained(p, end) == (at == end), (p, end)


def test_gzip_after_a_false_one():
    import gzip

    whole = gzip.compress(b"payload " * 50_000)
    data = b"\x1f\x8b\x08\0\0\0\0\0\0\x03 nothing " + whole + b" after"
    assert media.sniff(data) == [(19, len(whole), "application/gzip")]


def test_gzip_within_what_a_false_one_reads():
    """Stored blocks, or compressed ones, that run far and then fail; what begins within them is found, and so is what lies in a cut-off file."""
    import gzip

    r = random.Random(8)
    whole = gzip.compress(bytes(r.choices(b"abcdefgh", k=30_000)), mtime=0)
    block = b"\0" + (60_000).to_bytes(2, "little") + (60_000 ^ 0xFFFF).to_bytes(2, "little")
    stored = b"\x1f\x8b\x08\0\0\0\0\0\0\x03" + block + b"x" * 30_000 + whole
    assert media.sniff(stored + b"\xff" * 60_000) == [(30_015, len(whole), "application/gzip")]
    inner = gzip.compress(whole * 3 + r.randbytes(50_000), 0, mtime=0)
    assert media.sniff(inner) == [(0, len(inner), "application/gzip")]
    assert media.sniff(inner[:-1]) == [(k * len(whole) + 15, len(whole), "application/gzip") for k in range(3)]
    bad = inner[:-8] + bytes([inner[-8] ^ 1]) + inner[-7:]
    assert len(media.sniff(bad)) == 3
    named = gzip.compress(b"abc" * 9, mtime=0)
    named = named[:3] + b"\x08" + named[4:10] + b"name\0" + named[10:]
    assert media.sniff(b"-" + named) == [(1, len(named), "application/gzip")]
    # Compressed bytes without an end, and a whole file after their middle.
    false = gzip.compress(bytes(r.choices(b"abcdefgh", k=200_000)), mtime=0)[:40_000]
    assert (len(false), len(whole), "application/gzip") in media.sniff(false + whole)


def test_wrapped_media_are_found(spark):
    """Native wrapping, carved again: whole, after other bytes, and one in another."""
    data = [b"abc", b"a", b"BM fLaC RIFF" * 9, b"x" * 1000, "漢字".encode()]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "doc_id long, payload binary")
    for kind, name in (("wav", "audio/wav"), ("bmp", "image/bmp"), ("mp4", "video/mp4")):
        made = df.select("doc_id", F.concat(F.lit(b"zz"), media.wrapped(kind, F.col("payload"))).alias("payload"), F.lit(None).cast("string").alias("declared"))
        sizes = {r.doc_id: len(r.payload) - 2 for r in made.collect()}
        rows = media.carve(made, "doc_id", "payload", "declared").collect()
        assert {(r.doc_id, r.offset, r.length, r.type, r.corrected) for r in rows} == {(i, 2, n, name, "application/octet-stream") for i, n in sizes.items()}
        assert all(bytes(r.media)[:2] != b"zz" and data[r.doc_id] in bytes(r.media) for r in rows)
    both = df.select("doc_id", media.wrapped("mp4", media.wrapped("wav", F.col("payload"))).alias("payload"), F.lit("audio/wav").alias("declared"))
    assert {(r.type, r.corrected, r.offset) for r in media.carve(both, "doc_id", "payload", "declared").collect()} == {("video/mp4", "video/mp4", 0)}
    assert media.wav(b"abc") == bytes(df.filter("doc_id = 0").select(media.wrapped("wav", F.col("payload"))).first()[0])


def test_sniff_hostile_bytes_take_linear_time():
    n = 10_000_000
    for part in (b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff\xda\0\x02", b"OggS", b"\0\0\0\x0cftypmp42", b"%PDF-startxref", b"PK\x05\x06" + b"\0" * 18, *HOSTILE):
        began = time.time()
        media.sniff(part * (n // len(part)))
        assert time.time() - began < 30, part


def test_sniff_nested_and_updated():
    import io
    import zipfile

    def zipped(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    outer = zipped(a=b"x" * 40, inner=zipped(b=b"y" * 30), c=b"z")
    assert media.sniff(b"head" + outer + b"tail") == [(4, len(outer), "application/zip")]
    pdf = b"%PDF-1.4 one startxref 9 %%EOF more startxref 20 %%EOF"
    assert media.sniff(pdf + b" rest %PDF-1.5 no end") == [(0, len(pdf), "application/pdf")]
    assert media.sniff(b"%PDF-1.5 %%EOF") == []
    wav = media.wav(b"abc")
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cfreeabcd"
    assert media.sniff(wav + mp4) == [(0, len(wav), "audio/wav"), (len(wav), len(mp4), "video/mp4")]


def test_carved_from_encoded_runs(spark):
    import base64

    wav = media.wav(bytes(range(64)))
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x10freeabcdefgh" * 2
    text = "img data:audio/wav;base64," + base64.b64encode(wav).decode() + " and " + mp4.hex() + " end " + "A" * 200
    r = media.media_of_texts(spark.createDataFrame([(1, text), (2, "plain text " * 20), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    of = lambda b: hashlib.sha256(b).hexdigest()[:16]
    assert r[0]["feature"].endswith(f";carved=2:base64@26/audio/wav@0+{len(wav)}/{of(wav)},hex@{text.index(mp4.hex())}/video/mp4@0+{len(mp4)}/{of(mp4)}")
    assert r[1]["feature"].endswith("carved=0:") and r[2]["feature"].endswith("carved=0:")
