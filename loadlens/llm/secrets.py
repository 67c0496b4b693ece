"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control; DataFrame functions only.

Candidates are long runs of the alphabets that keys are written in. For each, an encoding is inferred from its characters
(hex, base32, base36, base62, base64) and three tests hold it against random text of that encoding: chi-squared uniformity
over the alphabet, a runs test on the upper and lower half of it, and lag-one serial correlation. Their p-values are
combined by the Cauchy rule, and the Benjamini-Hochberg rule over all candidates of a length band says which of them are
not random: a short band with few odd candidates needs stronger evidence than a long one with many.

What is left may still be prose that is too short to be told from random text. So a second control follows, over the same
bands: the log-likelihood ratio of random against word-like text bounds the chance of prose by exp(-ratio), and the rule
picks the least ratio that is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

# The base patterns, in the order that ties are listed; least lengths of the part that counts.
ASSIGN = r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
# For access and hex a least length within the pattern finds the same places as dropping shorter matches: both take whole runs.
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
#: Candidates of the battery: their alphabet and least length. Each needs a digit and a letter.
CANDIDATE, LEAST = "[A-Za-z0-9+/_-]{20,}", 20
#: The share of random ones among what the battery turns down, of prose among what is reported, and bins of -ln p that both controls count in.
BATTERY_FDR, FDR, BINS = 0.001, 0.01, 512
#: Entries of an array that are summed, or cut out of a text, together.
CHUNK = 64
#: Length bands of the controls begin at these numbers of characters.
BANDS = (20, 32, 48, 64, 128)
MASK = "<secret>"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by their alphabets; a candidate has the first that holds all its characters (- and _ counting as + and /).
ENCODINGS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER + "234567", _LOWER.upper() + "234567", _LOWER + _DIGITS, _LOWER.upper() + _DIGITS, _LOWER.upper() + _LOWER + _DIGITS, _LOWER.upper() + _LOWER + _DIGITS + "+/")
# The rational fit of the complementary error function, relative error under 1.2e-7 everywhere.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# Letters of European prose by falling frequency; with digits after them they give the word-like model.
_PROSE = "etainorsldcumphgfbvywqkxzj"


_LOG_LETTER, _LOG_FALL, _LOG_DIGIT, _LOG_OTHER, _LOG_STAY, _LOG_TURN = (math.log(x) for x in (0.13, 0.87, 0.1, 0.25, 0.92, 0.08))
_SPAN = "array<struct<s:int,k:int,e:int>>"
_CANDIDATES = "array<struct<s:int,e:int,n:int,p:double,llr:double>>"


def _sum(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _chunks(values: Column) -> Column:
    """The array in pieces of CHUNK; none for an empty one."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK)))


def _running(values: Column) -> Column:
    """Running sums of an int array. Sums of chunks come first, so n entries take n * CHUNK / 2 steps and (n / CHUNK) squared / 2."""

    def prefix(x: Column) -> Column:
        inside = lambda c, k: _bound(_sum(F.slice(x["t"], 1, k), "int"), lambda b: F.transform(c, lambda _, i: b + _sum(F.slice(c, 1, i + 1), "int")))
        return F.flatten(F.transform(x["c"], inside))

    chunks = _chunks(values)
    return _bound(F.struct(chunks.alias("c"), F.transform(chunks, lambda c: _sum(c, "int")).alias("t")), prefix)


def _places(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds `name`: array of (m, s, e), the pattern's matches in __t with their places in code points; null if there are none.

    Matches alternate with the pieces that the pattern splits the text into, so lengths give the places.
    """
    df = df.withColumn(f"{name}_m", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)))
    some = F.size(f"{name}_m") > 0
    df = df.withColumn(f"{name}_g", F.when(some, F.split("__t", pattern, -1)))
    steps = F.zip_with(F.slice(f"{name}_g", 1, F.size(f"{name}_m")), F.col(f"{name}_m"), lambda g, m: F.length(g) + F.length(m))
    df = df.withColumn(f"{name}_g", F.when(some, steps))
    df = df.withColumn(f"{name}_g", F.when(some, _running(F.col(f"{name}_g"))))
    found = F.zip_with(f"{name}_m", f"{name}_g", lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("s"), e.alias("e")))
    return df.withColumn(name, F.when(some, found)).drop(f"{name}_m", f"{name}_g")


def two_sided(z: Column) -> Column:
    """The chance that a standard normal value is at least as far from 0 as z."""

    def of(x: Column) -> Column:
        t = 1 / (1 + 0.5 * x)
        poly = F.lit(_ERFC[-1])
        for c in reversed(_ERFC[:-1]):
            poly = F.lit(c) + t * poly
        return t * F.exp(poly - x * x)

    return _bound(F.abs(z) / math.sqrt(2), of)


def chi_squared_p(x: Column, df: Column) -> Column:
    """The upper tail of a chi-squared value, by the cube-root normal approximation."""
    part = 2 / (9.0 * df)
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)
    return _bound(z, lambda v: F.when(v > 0, two_sided(v) / 2).otherwise(1 - two_sided(v) / 2))


def cauchy(*ps: Column) -> Column:
    """One p-value of several, whatever their dependence."""
    inside = lambda p: F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    total = sum((F.tan((0.5 - inside(p)) * math.pi) for p in ps), F.lit(0.0))
    # 0.5 - atan(t) / pi loses all digits for large t, where it is 1 / (pi t).
    return _bound(total / len(ps), lambda t: F.when(t > 1e6, 1 / (math.pi * t)).otherwise(0.5 - F.atan(t) / math.pi))


def battery(token: Column) -> Column:
    """chi, runs, serial (p-values of the three tests), p (all of them together) and llr (random against word-like) of a candidate."""
    size = F.length(token)
    plain = F.translate(token, "-_", "+/")
    alphabet = F.lit(ENCODINGS[-1])
    for of in reversed(ENCODINGS[:-1]):
        alphabet = F.when(F.translate(plain, of, "") == "", of).otherwise(alphabet)
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    places = _bound(alphabet, lambda a: F.struct(F.length(a).alias("k"), F.transform(chars, lambda c: (F.instr(a, c) - 1).cast("double")).alias("v")))
    made = F.struct(size.alias("n"), places.alias("at"), chars.alias("c"))

    def tests(x: Column) -> Column:
        n, k, v, c = x["n"], x["at"]["k"], x["at"]["v"], x["c"]
        pairs = F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        squares = _sum(F.transform(F.array_distinct(v), lambda u: F.pow(F.size(F.filter(v, lambda w: w == u)).cast("double"), F.lit(2))))
        chi = chi_squared_p(F.greatest(F.lit(0.0), k * squares / n - n), k - 1)
        turns = _sum(F.transform(pairs, lambda p: ((p["a"] < k / 2) != (p["b"] < k / 2)).cast("double")))
        runs = two_sided((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        mid = (k - 1) / 2
        serial = two_sided(_sum(F.transform(pairs, lambda p: (p["a"] - mid) * (p["b"] - mid))) / ((k * k - 1) / 12 * F.sqrt((n - 1).cast("double"))))
        kind = lambda ch: F.when(ch.rlike("[a-z]"), 0).when(ch.rlike("[A-Z]"), 1).when(ch.rlike("[0-9]"), 2).otherwise(3)
        letter = lambda ch: F.lit(_LOG_LETTER) + _LOG_FALL * (F.instr(F.lit(_PROSE), F.lower(ch)) - 1)
        prose = _sum(F.transform(c, lambda ch: F.when(kind(ch) < 2, letter(ch)).when(kind(ch) == 2, _LOG_DIGIT).otherwise(_LOG_OTHER)))
        moves = _bound(F.transform(c, kind), lambda ks: _sum(F.zip_with(F.slice(ks, 1, n - 1), F.slice(ks, 2, n - 1), lambda a, b: F.when(a == b, _LOG_STAY).otherwise(_LOG_TURN))))
        llr = -n * F.log(k.cast("double")) - prose - moves
        done = F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), llr.alias("llr"))
        return _bound(done, lambda d: F.struct(d["chi"].alias("chi"), d["runs"].alias("runs"), d["serial"].alias("serial"), cauchy(d["chi"], d["runs"], d["serial"]).alias("p"), d["llr"].alias("llr")))

    return _bound(made, tests)


def _kept(found: Column, k: int, pattern: str, group: int, least: int) -> Column:
    """The base spans of a kind whose group has enough characters."""
    good = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least) if group else found
    return F.coalesce(F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))), F.array().cast(_SPAN))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __base (base spans as start, kind's place in KINDS, end) and __random (candidates with their tests), both empty arrays where none.

    Null texts are empty; all other columns stay. A candidate is tested whole, however long it is: while it is, it takes a few
    arrays with an entry for each character (about 100 bytes a character, so 100 MB for an encoded file of a megabyte).
    """
    df = docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        df = _places(df, f"__{kind}", pattern)
        base.append(_kept(F.col(f"__{kind}"), k, pattern, group, least))
    df = _places(df, "__cand", CANDIDATE)
    mixed = F.filter("__cand", lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))

    def tested(x: Column) -> Column:
        return _bound(battery(x["m"]), lambda t: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.length(x["m"]).alias("n"), t["p"].alias("p"), t["llr"].alias("llr")))

    df = df.withColumn("__random", F.coalesce(F.transform(mixed, tested), F.array().cast(_CANDIDATES)))
    return df.withColumn("__base", F.concat(*base)).drop("__t", "__cand", *(f"__{k[0]}" for k in KINDS))


def _nats(p_or_llr: Column) -> Column:
    """Whole nats of evidence, at most BINS - 1: p-values are rounded up to exp(-whole nats), which keeps a control on the safe side."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(p_or_llr).cast("int")))


def _in_band(n: Column, of: dict[int, int], other: int) -> Column:
    """The value of the length's band, or `other` for a band without one."""
    out = F.lit(other)
    for k, least in enumerate(BANDS):
        out = F.when(n >= least, of.get(k, other)).otherwise(out)
    return out


def benjamini_hochberg(rows: DataFrame, nats: Column, fdr: float) -> dict[int, int]:
    """By length band, the least whole number of nats that the rule accepts, of rows with n; bands in which it accepts none are not there.

    At most BINS rows for each band are sorted, and one for each reaches the driver.
    """
    bins = rows.groupBy(_in_band(F.col("n"), {k: k for k in range(len(BANDS))}, 0).alias("band"), nats.alias("nats")).agg(F.count("*").alias("c"))
    over = Window.partitionBy("band").orderBy(F.desc("nats"))
    ranked = bins.select("band", "nats", F.sum("c").over(over).alias("rank"), F.sum("c").over(Window.partitionBy("band")).alias("m"))
    good = ranked.filter((F.col("nats") > 0) & (F.exp(-F.col("nats").cast("double")) <= fdr * F.col("rank") / F.col("m")))
    return {r["band"]: r["nats"] for r in good.groupBy("band").agg(F.min("nats").alias("nats")).collect()}


def cuts(found: DataFrame, fdr: float = FDR, battery_fdr: float = BATTERY_FDR) -> tuple[dict[int, int], dict[int, int]]:
    """By length band: nats of the battery's p from which a candidate isn't random, and nats of the ratio from which one is reported.

    What the battery turns down counts in the second control as having no evidence at all.
    """
    x = found.select(F.explode("__random").alias("x")).select("x.n", "x.llr", _nats(-F.log("x.p")).alias("odd"))
    odd = benjamini_hochberg(x, F.col("odd"), battery_fdr)
    random = F.col("odd") < _in_band(F.col("n"), odd, BINS)
    return odd, benjamini_hochberg(x, F.when(random, _nats(F.col("llr"))).otherwise(0), fdr)


def _accepted(cut: tuple[dict[int, int], dict[int, int]]) -> Column:
    """The spans of accepted candidates, with the kind's place after the base kinds."""
    odd, need = cut
    good = F.filter("__random", lambda x: (_nats(-F.log(x["p"])) < _in_band(x["n"], odd, BINS)) & (_nats(x["llr"]) >= _in_band(x["n"], need, BINS)))
    return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    """kind:start:end, by start, then kind, then end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("random"))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans for every row; `random` spans are the battery's.

    Null and empty texts have none. Repeated rows are scanned alike, but each counts in the false-discovery control; ids may
    be null; other columns are ignored.
    """
    found = keep(candidates(docs.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col), "secrets")
    base = F.col("__base")
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")
    n = [of_kind(k).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, _accepted(cuts(found, fdr)))).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans (sorted by start) replaced by MASK.

    Spans are worked off in chunks, each on its own stretch of the text, so a text of n spans is gone through n / CHUNK times.
    """
    end = lambda x: x["e"]
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))

    def whole(x: Column) -> Column:
        def stretch(c: Column, k: Column) -> Column:
            def of(y: Column) -> Column:
                def piece(p: Column, i: Column) -> Column:
                    done = lambda upto: F.when(p["s"] >= upto, F.concat(F.substring(y["t"], upto - y["b"] + 1, p["s"] - upto), F.lit(MASK))).otherwise("")
                    return _bound(F.greatest(y["b"], most(F.slice(y["e"], 1, i))), done)

                return F.array_join(F.transform(c, piece), "")

            return _bound(most(F.slice(x["m"], 1, k)), lambda b: _bound(F.struct(b.alias("b"), F.transform(c, end).alias("e"), F.substring(text, b + 1, F.greatest(b, F.get(x["m"], k)) - b).alias("t")), of))

        return F.concat(F.array_join(F.transform(x["c"], stretch), ""), F.substring(text, most(x["m"]) + 1, F.length(text)))

    chunks = _chunks(spans)
    return _bound(F.struct(chunks.alias("c"), F.transform(chunks, lambda c: F.array_max(F.transform(c, end))).alias("m")), whole)


def redacted(docs: DataFrame, text_col: str = "text", fdr: float = FDR, length_col: str | None = None) -> DataFrame:
    """docs with every span replaced by MASK, overlapping spans by one; length_col, if given, gets a changed text's length.

    Rows without any span, null and empty texts among them, and all other columns stay as they were, whatever their names;
    repeated rows are masked alike. An empty table gives none.
    """
    whole = F.struct(F.lit(0).alias(text_col), *(c for c in docs.columns if c != text_col)).alias("__row")
    found = keep(candidates(docs.select(whole, F.col(text_col).alias("__own")), "__own"), "secrets")
    df = found.withColumn("__spans", F.array_sort(F.concat("__base", _accepted(cuts(found, fdr)))))
    some = F.size("__spans") > 0
    df = df.withColumn("__new", F.when(some, _masked(F.col("__own").cast("string"), F.col("__spans"))).otherwise(F.col("__own")))
    kinds = dict(docs.dtypes)

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("__new").alias(c)
        old = F.col("__row").getField(c)
        return (F.when(some, F.length("__new").cast(kinds[c])).otherwise(old) if c == length_col else old).alias(c)

    return df.select(*(column(c) for c in docs.columns))
