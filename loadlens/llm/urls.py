"""URL filter: rules first, then the ratio of two character language models.

Accepted and rejected URLs each give a variable-order Markov model: counts of the characters that follow contexts of up
to ORDER characters, smoothed by interpolating each order with the next lower one (Witten-Bell weights). A URL's
log-likelihood difference, divided by its length, is held against a cut.

The counts are exact and stay Spark tables: one row for each context and character, joined to the different ones that the URLs
to be judged hold. Hosts are dealt to FOLDS folds, and a URL is judged by the seeds of the other folds only: every table holds
a count for each fold left out. So no model has seen a host that it judges, and the cut is calibrated on differences of seeds
that their models haven't seen either.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Rules as (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Longest context, and folds of hosts.
ORDER, FOLDS = 5, 4
#: Bins of the calibration's histogram over differences of -BOUND to BOUND a character.
BINS, BOUND = 400, 4.0
#: Begins and ends a URL.
_END = "\x01"


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: both empty for a null url and for one without `://`."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)\A([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.substring(whole, F.length(host) + 1, F.length(whole))
    return df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; ties: the longer host, then the order given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(url: Column) -> Column:
    """By character of the URL, and its end: the ORDER characters before it (padded at the beginning), and itself."""
    chars = F.split(F.concat(F.lit(_END * ORDER), url, F.lit(_END)), "")
    # One array element, so that the characters are taken once and not for each of them.
    return F.flatten(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), ""))))


def counts(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of seeds (url, fold, accepted 1 or 0): (gram, n) and (context, total, kinds), n and so on being arrays of 2 * FOLDS numbers.

    Number y * FOLDS + f counts seeds of class y outside fold f. Grams are contexts of 0 to ORDER characters and one that followed.
    """
    each = seeds.select((F.col("accepted") * FOLDS + F.col("fold")).alias("at"), F.explode(grams(F.col("url"))).alias("gram"))
    whole = each.groupBy("gram").agg(*(F.count_if(F.col("at") == i).alias(f"c{i}") for i in range(2 * FOLDS)))
    # Shorter contexts from the sums of the longest, of which there are fewer than characters.
    shorter = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substr("gram", F.lit(ORDER + 2) - k))).alias("gram"), *(f"c{i}" for i in range(2 * FOLDS)))
    summed = shorter.groupBy("gram").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(2 * FOLDS)))
    others = [sum(F.col(f"c{y * FOLDS + g}") for g in range(FOLDS) if g != f) for y in (0, 1) for f in range(FOLDS)]
    followed = keep(summed.select("gram", F.array(*others).alias("n")), "url-grams")
    by_context = followed.groupBy(F.substr("gram", F.lit(1), F.length("gram") - 1).alias("context"))
    sums = by_context.agg(*(F.sum(F.col("n")[i]).alias(f"t{i}") for i in range(2 * FOLDS)), *(F.count_if(F.col("n")[i] > 0).alias(f"k{i}") for i in range(2 * FOLDS)))
    return followed, keep(sums.select("context", *(F.array(*(f"{x}{i}" for i in range(2 * FOLDS))).alias(name) for x, name in (("t", "total"), ("k", "kinds")))), "url-contexts")


def log_ratios(wanted: DataFrame, followed: DataFrame, contexts: DataFrame) -> DataFrame:
    """wanted (gram, all different) with `ratio`: by fold left out, the log of the character's accepted over its rejected probability."""
    orders = wanted.select(F.col("gram").alias("whole"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substr("gram", F.lit(ORDER + 2) - k))).alias("k", "gram"))
    orders = orders.withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1))
    held = keep(orders.join(followed, "gram", "left").select("whole", "k", "context", "n"), "url-orders").join(contexts, "context", "left")
    lists = held.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("k", "n", "total", "kinds"))).alias("orders"))

    def p(i: int) -> Column:
        def step(before: Column, x: Column) -> Column:
            total, kinds, n = x["total"][i], x["kinds"][i], F.coalesce(x["n"][i], F.lit(0))
            return F.when(total > 0, (n + kinds * before) / (total + kinds)).otherwise(before)

        return F.aggregate("orders", F.lit(1 / 256), step)

    return lists.select(F.col("whole").alias("gram"), F.array(*(F.log(p(FOLDS + f)) - F.log(p(f)) for f in range(FOLDS))).alias("ratio"))


def differences(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """url, fold, difference for different rows of urls (url, fold): accepted minus rejected log-likelihood, a character, by the seeds of other folds."""
    each = keep(urls.select("url", "fold", F.explode(grams(F.col("url"))).alias("gram")), "url-characters")
    # Written, so that the join's sides are plain exchanges, whose skewed partitions Spark splits: all URLs share some characters.
    ratios = keep(log_ratios(each.select("gram").distinct(), *counts(seeds)), "url-ratios")
    return each.join(ratios, "gram").groupBy("url", "fold").agg(F.avg(F.get("ratio", F.col("fold"))).alias("difference"))


def cut_of(scored: DataFrame) -> float:
    """Where the two error rates meet, in the middle of the best places, for scored seeds (difference, accepted); 0, with a warning, if a class has none."""
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("difference") + BOUND) * BINS / (2 * BOUND))))
    hist = np.zeros((2, BINS))
    for y, b, n in scored.filter("accepted is not null").groupBy("accepted", bin_.alias("b")).count().collect():  # 2 * BINS rows at most
        hist[y, b] = n
    if not hist.sum(1).all():
        warnings.warn("URL filter: one class has no seeds, so the cut isn't calibrated and stays 0", stacklevel=2)
        return 0.0
    below = np.concatenate([[0], np.cumsum(hist[1] / hist[1].sum())])  # accepted seeds under a cut
    above = 1 - np.concatenate([[0], np.cumsum(hist[0] / hist[0].sum())])  # rejected ones over it
    best = np.flatnonzero(np.isclose(worst := np.maximum(below, above), worst.min()))
    return float((best[0] + best[-1]) / 2 * 2 * BOUND / BINS - BOUND)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, difference for every page; nothing else is read.

    The longest rule that fits decides; else the models do, a difference under the cut being `block`. Rejected seeds are what
    the rules block, accepted ones all other pages, each URL by the folds that its host isn't in; the cut comes from the pages that a
    rule decides. With `labelled` (columns url
    and accepted, 1 or 0; rows with a null in either are left out), its rows are seeds too, and of the pages only those that a rule
    decides. If there are no seeds of one class, its probabilities are uniform and nothing can be calibrated: the cut is then 0,
    with a warning. Null urls have empty host and path and are the empty URL; ids may be null or repeated; repeated URLs count
    as often as they come.
    """
    own = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    df = parts(pages.select(F.col(id_col).alias("__id"), own.alias("url")), "url")
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    df = df.select("__id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"), fold.alias("fold"))
    accepted = F.when(F.col("ruled") == "block", 0).otherwise(1).alias("accepted")
    seeds, certain = df.select("url", "fold", accepted), df.filter("ruled IS NOT NULL").select("url", "fold", accepted)
    if labelled is not None:
        more = parts(labelled.select(F.col("url").cast("string").alias("url"), F.col("accepted").cast("int").alias("accepted")).dropna(), "url")
        seeds = certain = certain.unionAll(more.select("url", fold.alias("fold"), "accepted"))
    urls = df.select("url", "fold") if labelled is None else df.select("url", "fold").unionAll(certain.select("url", "fold"))
    scored = keep(differences(urls.distinct(), seeds), "url-differences").drop("fold")
    # The pages that no rule decides are to be judged; that they are accepted seeds of other hosts' models says nothing of the cut.
    cut = cut_of(certain.join(scored, "url"))
    method = F.when(F.col("difference") < cut, "block").otherwise("allow")
    out = df.join(scored, "url")
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "difference")
