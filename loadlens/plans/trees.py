"""Many regression forests at once, grown level by level from keyed histograms of binned features.

A training set (`spec`) is a key, and so are its trees: a level of all trees of all sets is one aggregate by node, feature
and bin. Variants are subsets of the features. They choose their splits from the same histograms, and those that have split
alike so far share a node, so leaving out a feature that a tree doesn't use costs nothing, and no row is read again for it.

Rows to be predicted walk down with the training rows. What comes to the driver is the depth's loop alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.stats import correlation
from loadlens.sources.io import materialize

#: Targets are summed as whole millionths, so that sums, and with them ties of splits, don't depend on the order of rows.
UNIT = 1_000_000
# The chances that a Poisson number of mean 1 is at most 0, 1, 2, 3, 4.
_POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)


def edges_of(df: DataFrame, features: list[str], bins: int = 16) -> list[list[float]]:
    """By feature, at most bins - 1 different values that part its rows into groups of about one size; nulls are left out."""
    found = df.select(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features))).approxQuantile([f"f{i}" for i in range(len(features))], [k / bins for k in range(1, bins)], 0.001)
    return [sorted(set(x)) for x in found]


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """An array of each feature's bin: 0 for null and NaN, else 1 and how many edges the value is above."""

    def one(c: str, at: list[float]) -> Column:
        x = F.col(c).cast("double")
        above = F.size(F.filter(F.array(*map(F.lit, at)), lambda e: e < x)) if at else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + above).cast("byte")

    return F.array(*(one(c, at) for c, at in zip(features, edges, strict=True)))


def drawn(seed: int, *key: Column) -> Column:
    """How often a bootstrap draws a row: a Poisson number of mean 1 from a hash of its key."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    return sum((u > p).cast("int") for p in _POISSON)


def in_share(seed: int, share: float, feature: Column, *tree: Column) -> Column:
    """Whether a tree, named by its key, looks at a feature."""
    return F.pmod(F.xxhash64(F.lit(seed), *tree, feature), F.lit(1000)) < F.lit(int(share * 1000))


def _best_splits(histogram: DataFrame, alive: DataFrame, least: int) -> DataFrame:
    """node, variant, feature, bin: the split of the greatest gain; ties go to the least feature, then bin."""
    # A window holds the bins of one feature in one node.
    bins = Window.partitionBy("node", "feature")
    upto = bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, s, all_n, all_s = F.col("n").cast("double"), F.col("s").cast("double"), F.col("all_n"), F.col("all_s").cast("double")
    run = histogram.select("node", "feature", "bin", F.sum("w").over(upto).alias("n"), F.sum("wy").over(upto).alias("s"), F.sum("w").over(bins).alias("all_n"), F.sum("wy").over(bins).alias("all_s"))
    gain = (s * s / n + (all_s - s) * (all_s - s) / (all_n - n) - all_s * all_s / all_n) / float(UNIT) ** 2
    cut = run.filter((F.col("n") >= least) & (F.col("all_n") - F.col("n") >= least)).select("node", "feature", "bin", F.round(gain, 6).alias("gain")).filter("gain > 0")
    by_feature = cut.groupBy("node", "feature").agg(F.max(F.struct("gain", (-F.col("bin")).alias("b"))).alias("top")).select("node", "feature", "top.*")
    met = alive.join(by_feature, "node").filter(F.array_contains("features", F.col("feature")))
    top = met.groupBy("node", "variant").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), "b")).alias("top"))
    return top.select("node", "variant", (-F.col("top.f")).alias("feature"), (-F.col("top.b")).alias("bin"))


def forests(rows: DataFrame, variants: DataFrame, **forest) -> DataFrame:
    """spec, variant, id, value: predictions of grown()'s trees for the rows whose y is null, a mean over the trees' leaves."""
    return grown(rows, variants, **forest)[0]


def grown(rows: DataFrame, variants: DataFrame, *, trees: int = 5, depth: int = 4, least: int = 5, share: float = 1.0, bootstrap: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The predictions of forests(), and the trees: spec, tree, variant, node, value, n, feature and bin of each node (null: a leaf).

    A node's name is its spec, tree, and the splits that lead to it.

    rows: spec int, id (any type), y double (null: to be predicted), bins array. variants: spec, variant, features (array of places in
    bins). A spec without training rows predicts nothing. With `share`, each tree looks at that share of the features.
    """
    weight = drawn(seed, F.col("spec"), F.col("tree"), F.col("id")) if bootstrap else F.lit(1)
    each = rows.select("spec", "id", F.round(F.col("y") * UNIT).cast("long").alias("y"), "bins", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.withColumn("w", F.when(F.col("y").isNotNull(), weight).otherwise(0)).filter("w > 0 or y is null")
    root = F.concat_ws("/", F.col("spec").cast("string"), F.col("tree").cast("string"))
    members = materialize(each.select("spec", "tree", "id", "y", "bins", "w", root.alias("node")), "tree-members")
    alive = variants.select("spec", "variant", "features", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("variant", "features", root.alias("node"))
    found = nodes = None
    for level in range(depth + 1):
        learnt = members.filter("w > 0")
        totals = learnt.groupBy("node", "spec", "tree").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w") / UNIT).alias("value"), F.sum("w").alias("n"))
        decided = alive.join(totals, "node")
        if level < depth:
            spread = learnt.select("spec", "node", "tree", "w", (F.col("w") * F.col("y")).alias("wy"), F.posexplode("bins").alias("feature", "bin"))
            if share < 1:
                spread = spread.filter(in_share(seed, share, F.col("feature"), F.col("spec"), F.col("tree")))
            histogram = spread.groupBy("node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
            decided = decided.join(_best_splits(histogram, alive, least), ["node", "variant"], "left")
        else:
            decided = decided.withColumns({"feature": F.lit(None).cast("int"), "bin": F.lit(None).cast("int")})
        decided = materialize(decided, "tree-nodes")
        stopped = members.filter("y is null").join(decided.filter("feature is null").select("node", "variant", "value"), "node").select("spec", "variant", "id", "value")
        found = stopped if found is None else found.unionAll(stopped)
        own = decided.select("spec", "tree", "variant", "node", "value", "n", "feature", "bin")
        nodes = own if nodes is None else nodes.unionAll(own)
        if level == depth:
            break
        # A row goes on once for each different split of its node, whatever the number of variants that made it.
        split = decided.filter("feature is not null").select("node", "feature", "bin").distinct()
        side = lambda left: F.concat_ws("/", "node", F.concat_ws(":", F.col("feature"), F.col("bin"), left))
        goes_left = F.when(F.get("bins", F.col("feature")) <= F.col("bin"), "L").otherwise("R")
        members = materialize(members.join(split, "node").select("spec", "tree", "id", "y", "bins", "w", side(goes_left).alias("node")), "tree-members")
        both = decided.filter("feature is not null").select("variant", "features", F.explode(F.array(side(F.lit("L")), side(F.lit("R")))).alias("node"))
        alive = both
    return found.groupBy("spec", "variant", "id").agg(F.avg("value").alias("value")), nodes


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """spec, tree, variant, value and path of each leaf: for each feature on its way, the bins over low and up to high that lead there, and `share`.

    share is what part of the training rows that meet the feature's splits on the way go the leaf's way: the product of their shares.
    """
    part = F.split("node", "/")
    # Each step of a leaf's way, with the rows of the node before and after it; a way has as many steps as the trees are deep.
    leaves = nodes.filter("feature is null").select("spec", "tree", "variant", "node", "value", F.posexplode_outer(F.slice(part, F.lit(3), F.size(part))).alias("k", "step"))
    steps = leaves.withColumns({
        "after": F.array_join(F.slice(part, F.lit(1), F.coalesce(F.col("k"), F.lit(0)) + 3), "/"), "before": F.array_join(F.slice(part, F.lit(1), F.coalesce(F.col("k"), F.lit(0)) + 2), "/"),
        "feature": F.split("step", ":")[0].cast("int"), "bin": F.split("step", ":")[1].cast("int"), "side": F.split("step", ":")[2],
    })
    size = materialize(nodes.select("variant", "node", "n"), "tree-sizes")
    met = steps.join(size.withColumnsRenamed({"node": "before", "n": "n0"}), ["variant", "before"]).join(size.withColumnsRenamed({"node": "after", "n": "n1"}), ["variant", "after"], "left")
    key = ["spec", "tree", "variant", "node", "value"]
    each = met.groupBy(*key, "feature").agg(
        F.coalesce(F.max(F.when(F.col("side") == "R", F.col("bin"))), F.lit(-1)).alias("low"), F.coalesce(F.min(F.when(F.col("side") == "L", F.col("bin"))), F.lit(127)).alias("high"),
        F.coalesce(F.product(F.col("n1") / F.col("n0")), F.lit(1.0)).alias("share"),
    )
    listed = F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "low", "high", "share")))
    return each.groupBy(*key).agg(listed.alias("path")).drop("node")


def _permutations(others: Column, m: Column) -> Column:
    """The sum over subsets S of the other m - 1 features of |S|! (m - 1 - |S|)! / m! times what S lets through and the rest's shares.

    A polynomial's coefficients are collected by the size of S, a feature at a time.
    """
    def with_one(c: Column, f: Column) -> Column:
        shifted, same = F.concat(F.array(F.lit(0.0)), c), F.concat(c, F.array(F.lit(0.0)))
        return F.zip_with(same, shifted, lambda a, b: a * f["share"] + b * f["fits"])

    by_size = F.aggregate(others, F.array(F.lit(1.0)), with_one)
    return F.aggregate(F.transform(by_size, lambda c, k: c * F.factorial(k) * F.factorial(m - 1 - k) / F.factorial(m)), F.lit(0.0), lambda a, b: a + b)


def attributions(rows: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """spec, variant, id, feature, phi: Shapley values of a prediction by path shares; with feature null, the base value.

    rows: spec, id, bins. The values of a row sum up to its prediction. Rows meet the leaves of their spec's trees, of which there
    are at most trees * 2 ** depth a variant; features that a leaf's way doesn't ask for have no part in it.
    """
    leaves = materialize(leaf_paths(nodes), "tree-leaves")
    met = rows.select("spec", "id", "bins").join(leaves, "spec")
    fits = F.transform("path", lambda p: F.struct(p["feature"].alias("feature"), p["share"].alias("share"), ((F.get("bins", p["feature"]) > p["low"]) & (F.get("bins", p["feature"]) <= p["high"])).cast("double").alias("fits")))
    met = met.select("spec", "variant", "id", "value", fits.alias("path")).withColumn("m", F.size("path"))
    own = F.transform("path", lambda p: F.struct(p["feature"].alias("feature"), (F.col("value") * (p["fits"] - p["share"]) * _permutations(F.filter("path", lambda o: o["feature"] != p["feature"]), F.col("m"))).alias("phi")))
    base = F.struct(F.lit(None).cast("int").alias("feature"), F.aggregate("path", F.col("value"), lambda a, p: a * p["share"]).alias("phi"))
    parts = met.select("spec", "variant", "id", F.explode(F.concat(F.array(base), own)).alias("x"))
    return parts.groupBy("spec", "variant", "id", "x.feature").agg((F.sum("x.phi") / trees).alias("phi"))


def importance(phi: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """spec, variant, feature, mean_abs, direction: 1, -1 or 0 by the sign of the correlation of a feature's bins with its values; rows as above.

    Features without a part in a row count 0 there.
    """
    n = rows.groupBy("spec").agg(F.count("*").alias("rows"))
    pairs = phi.filter("feature is not null").join(rows.select("spec", "id", "bins"), ["spec", "id"]).select("spec", "variant", "feature", "phi", F.get("bins", F.col("feature")).cast("double").alias("x"))
    g = pairs.groupBy("spec", "variant", "feature").agg(F.sum(F.abs("phi")).alias("s"), correlation("x", "phi").alias("r"))
    sign = F.when(F.isnan("r") | F.col("r").isNull(), 0).otherwise(F.signum(F.round("r", 9)).cast("int"))
    return g.join(n, "spec").select("spec", "variant", F.get(F.array(*map(F.lit, features)), F.col("feature")).alias("feature"), (F.col("s") / F.col("rows")).alias("mean_abs"), sign.alias("direction"))
