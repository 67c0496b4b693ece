"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Levels such as domain, language, source form a tree. The token budget goes down it: a node's budget is shared among its
children by weight, no child gets more than its leaves can give (their tokens times the epochs allowed), and what one
can't take goes to its siblings, so that a shortage passes to an ancestor's siblings only when a whole subtree is used
up. Each leaf then takes whole documents in a seeded order, epoch after epoch, as long as the tokens before a document are
within its budget.

The share-out is a water level: sorted by capacity over weight, the children that are filled come first, so one window for
each level solves it. The order of a leaf is dealt to buckets of its hash, whose sums tell in which bucket its budget ends;
no task sees a whole leaf, and whole rows are filtered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Buckets that a leaf's order is dealt to: the first hex digits of the order's hash.
BUCKET_DIGITS = 3


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds budget to rows with parent columns, parent_budget, weight and capacity (whole tokens)."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[c for c in nodes.columns if c.startswith("l_")])
    whole = Window.partitionBy(*parent)
    filled = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = nodes.withColumn("__rest", F.col("parent_budget") - filled).withColumn("__weights", weights)
    # The first child, in this order, whose share of what is left isn't more than it can give; from there on all get their share.
    part = F.col("__rest").cast("double") * F.col("weight") / F.col("__weights")
    level = level.withColumn("__short", part < F.col("capacity"))
    first = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[c for c in nodes.columns if c.startswith("l_")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("__at", F.first(F.when(F.col("__short"), F.struct("__rest", "__weights")), ignorenulls=True).over(first))
    share = F.floor(F.col("__at.__rest").cast("double") * F.col("weight") / F.col("__at.__weights")).cast("long")
    return level.withColumn("budget", F.when(F.col("__at").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), share))).drop("__rest", "__weights", "__short", "__at")


def budgets(leaves: DataFrame, levels: list[str], weights: list[DataFrame | None], budget: int, epochs: int = 1) -> DataFrame:
    """levels, tokens, budget: whole tokens for each leaf of a table of levels and tokens.

    weights: for each level a table of the level's columns so far and `weight`, or None for weight 1; nodes that a table
    doesn't list, or lists with a null or negative weight, get 0 and with it nothing, and what lies below them is no capacity
    of the nodes above. Null names are names.
    """
    names = [f"l_{i}" for i in range(len(levels))]
    leaf = leaves.select(*(F.col(c).alias(n) for c, n in zip(levels, names, strict=True)), F.col("tokens").cast("long").alias("tokens"))
    # Only leaves that every level lists with a positive weight can take anything: others give their nodes no capacity.
    listed: list[DataFrame | None] = []
    usable = leaf
    for i, given in enumerate(weights):
        if given is None:
            listed.append(None)
            continue
        keys = names[: i + 1]
        listed.append(given.select(*(F.col(c).alias(n) for c, n in zip(levels[: i + 1], keys, strict=True)), F.col("weight").cast("double").alias("weight")).filter("weight > 0"))
        usable = _meet(usable, listed[i].select(*keys).distinct(), keys, "left_semi")
    above = None
    for i in range(len(levels)):
        keys = names[: i + 1]
        node = usable.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("long").alias("capacity"))
        node = _meet(node, above, names[:i], "inner") if i else node.withColumn("parent_budget", F.lit(budget).cast("long"))
        node = node.withColumn("weight", F.lit(1.0)) if listed[i] is None else _meet(node, listed[i], keys, "inner")
        some = _share(node, names[:i] or [F.lit(0)])
        above = some.select(*keys, F.col("budget").alias("parent_budget"))
    out = _meet(leaf, above, names, "left")
    return out.select(*(F.col(n).alias(c) for c, n in zip(levels, names, strict=True)), "tokens", F.coalesce("parent_budget", F.lit(0)).cast("long").alias("budget"))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null equals null; the right side's keys go."""
    right = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"r_{k}"])
    return left.join(right, on, how).drop(*(f"r_{k}" for k in keys))


def cuts(slim: DataFrame, names: list[str], budget: DataFrame, seed: int, epochs: int) -> DataFrame:
    """names, __last, __upto: a leaf takes its ids in the order of (epoch, md5) up to these; slim has names, __id and __n.

    Sums of buckets tell in which bucket a leaf's budget ends, and only that bucket's ids are put in order. One row a leaf;
    leaves that take nothing have none.
    """
    rows = _meet(slim, budget, names, "inner")
    dealt = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__o", order_of(F.col("__id"), F.col("__epoch"), seed)).withColumn("__k", F.substring("__o", 1, BUCKET_DIGITS))
    sums = dealt.groupBy(*names, "__budget", "__epoch", "__k").agg(F.sum("__n").alias("__sum"))
    begin = Window.partitionBy(*names).orderBy("__epoch", "__k").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(begin), F.lit(0))).filter("__start < __budget")
    edge = starts.groupBy(*names).agg(F.max(F.struct("__epoch", "__k", "__start")).alias("__at")).select(*names, F.col("__at.__epoch").alias("__epoch"), F.col("__at.__k").alias("__k"), F.col("__at.__start").alias("__start"))
    inside = _meet(dealt, edge, [*names, "__epoch", "__k"], "inner").groupBy(*names, "__budget", "__epoch", "__start", "__o").agg(F.sum("__n").alias("__sum"))
    before = F.col("__start") + F.coalesce(F.sum("__sum").over(Window.partitionBy(*names).orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("__before", before).filter("__before < __budget").groupBy(*names).agg(F.max("__epoch").alias("__last"), F.max("__o").alias("__upto"))


def order_of(id_: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def taken(docs: DataFrame, levels: dict[str, Column], weights: list[DataFrame | None], budget_share: float, tokens: Column, id_col: str = "doc_id", seed: int = 0, epochs: int = 1) -> DataFrame:
    """The rows chosen, all columns as they were, and `__epoch` from 0; a document is there once for each epoch that takes it.

    levels: names, as the weights have them, and what gives them. The budget is budget_share of all tokens. Within an epoch
    a leaf's order is that of md5(seed:epoch:id), and an id is taken while the tokens before it are within the budget; rows
    of one id (repeated rows, rows without an id) come together. Documents without tokens come at their place in the order;
    null tokens are 0. An empty table gives none.

    Tokens are counted once, into slim rows. Whole rows are never shuffled: they meet a row a leaf, which Spark broadcasts
    if that is small, and are filtered where they lie.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    named = {n: c for n, c in zip(names, levels.values(), strict=True)}
    slim = keep(docs.select(*(c.alias(n) for n, c in named.items()), F.col(id_col).alias("__id"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("__n")), "mix-rows")
    leaves = keep(slim.groupBy(*names).agg(F.sum("__n").alias("tokens")), "leaves")
    all_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    weights = [w if w is None else w.withColumnsRenamed(dict(zip(levels, names, strict=True))) for w in weights]
    budget = keep(budgets(leaves, names, weights, int(all_tokens * budget_share), epochs).filter("budget > 0").withColumnRenamed("budget", "__budget").drop("tokens"), "budgets")
    cut = keep(cuts(slim, names, budget, seed, epochs), "cuts")
    rows = _meet(docs.withColumns(named), cut, names, "inner")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))) if epochs > 1 else F.lit(0)
    rows = rows.withColumn("__epoch", epoch)
    upto = (F.col("__epoch") < F.col("__last")) | (F.col("__epoch") == F.col("__last")) & (order_of(F.col(id_col), F.col("__epoch"), seed) <= F.col("__upto"))
    return rows.filter(upto).select(*docs.columns, "__epoch")


def select(docs: DataFrame, levels: list[str], weights: list[DataFrame | None], budget_share: float, tokens: str = "tokens", id_col: str = "doc_id", seed: int = 0, epochs: int = 1) -> DataFrame:
    """taken() by columns of docs, with `epoch` in place of a column of that name."""
    out = taken(docs, {c: F.col(c) for c in levels}, weights, budget_share, F.col(tokens), id_col, seed, epochs)
    return out.select(*(c for c in docs.columns if c != "epoch"), F.col("__epoch").alias("epoch"))
