"""Models of Spark ML behind one protocol: fit(train, features, label) gives a function that adds a prediction column.

Loops on the driver run over folds, targets and settings only, of which there are a few; every fit is a Spark job over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators.opcal import hourly_regime
from loadlens.operators.splits import evaluable, fold_rows, usable

Predictor = Callable[[DataFrame, str], DataFrame]
Fit = Callable[[DataFrame, list[str], str], Predictor]
SEED = 42


#: What trees take a null or NaN feature for: a value below all others, which a split can part from them.
MISSING = -1.0e9


def _vector(df: DataFrame, features: list[str], missing: float | None = MISSING) -> DataFrame:
    """Adds the features as a vector; without a value for missing ones, a null or NaN fails the job."""
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    filled = df.withColumns(known if missing is None else {c: F.coalesce(x, F.lit(missing)) for c, x in known.items()})
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(filled)


def _spark_fit(estimator) -> Fit:
    def fit(train: DataFrame, features: list[str], label: str) -> Predictor:
        model = estimator().setFeaturesCol("__x").setLabelCol(label).setPredictionCol("__p").fit(_vector(train, features))

        def predict(df: DataFrame, out: str) -> DataFrame:
            made = model.transform(_vector(df.withColumn("__keep", F.struct(*df.columns)), features))
            return made.select("__keep.*", F.col("__p").alias(out))

        predict.model = model
        return predict

    return fit


def seasonal_naive(train: DataFrame, features: list[str], label: str) -> Predictor:
    """The value of the same hour a week before."""
    return lambda df, out: df.withColumn(out, F.col(f"{label}_lag168"))


def forest(trees: int = 60, depth: int = 10) -> Fit:
    return _spark_fit(lambda: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True, checkpointInterval=-1))


def boosted(trees: int = 40, depth: int = 5, step: float = 0.1, loss: str = "absolute") -> Fit:
    return _spark_fit(lambda: GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, lossType=loss, seed=SEED, checkpointInterval=-1))


def regimes(regressor: Fit, edges: tuple[float, float] = (30.0, 70.0), classes: int = 3, least: int = 20) -> Fit:
    """A gate foretells the regime of an hour and a regressor of that regime the value; regimes of fewer than `least` rows use one for all."""

    def fit(train: DataFrame, features: list[str], label: str) -> Predictor:
        regime = hourly_regime(F.col(label), edges)
        train = train.withColumn("__r", (regime if classes == 3 else (F.col(label) >= edges[1]).cast("int")).cast("double"))
        counts = {int(r["__r"]): r["count"] for r in train.groupBy("__r").count().collect() if r["__r"] is not None}
        whole = regressor(train, features, label)
        own = {k: regressor(train.filter(F.col("__r") == k), features, label) for k, n in counts.items() if n >= least}
        gate = RandomForestClassifier(numTrees=40, maxDepth=8, seed=SEED, featuresCol="__x", labelCol="__r", predictionCol="__g", rawPredictionCol="__raw", probabilityCol="__prob").fit(_vector(train, features)) if len(counts) > 1 else None

        def predict(df: DataFrame, out: str) -> DataFrame:
            gated = gate.transform(_vector(df, features)).drop("__x", "__raw", "__prob") if gate else df.withColumn("__g", F.lit(float(next(iter(counts), 0))))
            gated = df.columns and gated.select(*df.columns, F.col("__g").cast("int").alias("__g"))
            parts = whole(gated, "__whole")
            for k, p in own.items():
                parts = p(parts, f"__p{k}")
            value = F.col("__whole")
            for k in own:
                value = F.when(F.col("__g") == k, F.col(f"__p{k}")).otherwise(value)
            return parts.select(*df.columns, F.col("__g").alias("regime"), value.alias(out))

        return predict

    return fit


def peak_classifier(train: DataFrame, features: list[str], label: str = "y_cls", trees: int = 30, depth: int = 4) -> Predictor:
    """Probability of a peak; positives weigh as much as negatives. One class only: its rate."""
    n = {int(r[label]): r["count"] for r in train.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if len(n) < 2:
        rate = float(next(iter(n), 0))
        return lambda df, out: df.withColumn(out, F.lit(rate))
    weighted = train.withColumn("__w", F.when(F.col(label) == 1, n[0] / n[1]).otherwise(1.0))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED, featuresCol="__x", labelCol=label, weightCol="__w", predictionCol="__p", checkpointInterval=-1).fit(_vector(weighted, features))

    def predict(df: DataFrame, out: str) -> DataFrame:
        made = model.transform(_vector(df.withColumn("__keep", F.struct(*df.columns)), features))
        return made.select("__keep.*", vector_to_array("probability")[1].alias(out))

    predict.model = model
    return predict


def cross_validate(feat: DataFrame, folds: DataFrame, fits: dict[str, Fit], features: list[str], targets: tuple[str, ...] = ("y_avg", "y_peak")) -> DataFrame:
    """Out-of-fold rows: model, fold and, for each target, pred_*; trained on usable rows of the fold, shown all evaluable ones."""
    rows = fold_rows(feat, folds)
    names = [r["fold"] for r in folds.select("fold").collect()]
    out = None
    for name, fit in fits.items():
        for fold in names:
            train = rows.filter((F.col("fold") == fold) & (F.col("role") == "train")).filter(usable())
            part = rows.filter((F.col("fold") == fold) & (F.col("role") == "val")).filter(evaluable())
            for t in targets:
                part = fit(train.filter(F.col(t).isNotNull()), features, t)(part, f"pred{t[1:]}").drop("regime")
            part = part.withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def isotonic(df: DataFrame, p: str = "prob", y: str = "y_cls") -> list[tuple[float, float]]:
    """Knots of a monotone calibration; levels beyond the ends. Its size is that of the distinct scores left after pooling."""
    rows = df.filter(F.col(p).isNotNull()).select(F.col(p).alias("f"), F.col(y).cast("double").alias("l"))
    m = IsotonicRegression(featuresCol="f", labelCol="l").fit(rows)
    return list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist(), strict=True))


def calibrate_forward(df: DataFrame, p: str = "prob", y: str = "y_cls") -> DataFrame:
    """prob_cal of each fold from the folds before it; the first one keeps its scores."""
    from loadlens.functions.stats import interpolate

    out, folds = None, sorted(r["fold"] for r in df.select("fold").distinct().collect())
    for f in folds:
        part, past = df.filter(F.col("fold") == f), df.filter(F.col("fold") < f)
        value = F.col(p) if f == folds[0] else interpolate(F.col(p), isotonic(past, p, y))
        part = part.withColumn("prob_cal", value)
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(predict: Predictor, df: DataFrame, features: list[str], label: str, repeats: int = 3) -> DataFrame:
    """feature, increase of the mean absolute error when the feature's values are dealt to other rows.

    Values are dealt by two hash orders within blocks of rows, so no task sorts the whole table.
    """
    from pyspark.sql import Window

    base = predict(df, "__p").agg(F.avg(F.abs(F.col(label) - F.col("__p")))).first()[0]
    rows, out = df.withColumn("__b", F.xxhash64("site_id", "ts") % 64), []
    for c in features:
        total = 0.0
        for r in range(repeats):
            order = lambda salt: Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(f"{c}{salt}"), "site_id", "ts"))  # noqa: B023, E731
            a = rows.withColumn("__i", F.row_number().over(order(r)))
            b = rows.select("__b", F.row_number().over(order(f"other{r}")).alias("__i"), F.col(c).alias("__v"))
            mixed = a.join(b, ["__b", "__i"]).withColumn(c, F.col("__v")).drop("__v", "__i", "__b")
            total += predict(mixed, "__p").agg(F.avg(F.abs(F.col(label) - F.col("__p")))).first()[0] - base
        out.append((c, total / repeats))
    return df.sparkSession.createDataFrame(out, "feature string, increase double")


def random_search(train: DataFrame, val: DataFrame, features: list[str], label: str, trials: int = 4, seed: int = SEED) -> list[dict]:
    """Settings drawn by a seed with their validation error and the best so far; no model-based sampler."""
    rng, out, best = np.random.default_rng(seed), [], float("inf")
    for i in range(trials):
        p = {"trees": int(rng.integers(10, 40)), "depth": int(rng.integers(3, 7)), "step": float(np.exp(rng.uniform(np.log(0.03), np.log(0.3))))}
        err = boosted(**p)(train, features, label)(val, "__p").agg(F.avg(F.abs(F.col(label) - F.col("__p")))).first()[0]
        best = min(best, err)
        out.append({"trial": i, "mae": err, "best": best, **p})
    return out


def peak_rules(df: DataFrame, features: list[str], label: str = "y_cls", depth: int = 3, least: int = 20) -> DataFrame:
    """leaf, rule, n, n_pos, rate: paths of a shallow tree as predicates, counted again on the raw rows."""
    n = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}
    weighted = df.withColumn("__w", F.when(F.col(label) == 1, n.get(0, 1) / max(n.get(1, 1), 1)).otherwise(1.0))
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, featuresCol="__x", labelCol=label, weightCol="__w", seed=SEED).fit(_vector(weighted, features))
    leaves, path = [], []
    for line in model.toDebugString.splitlines()[1:]:
        level, text = (len(line) - len(line.lstrip()) - 2), line.strip()
        path = path[:level]
        if text.startswith("Predict"):
            leaves.append(" and ".join(path) or "true")
        else:
            inner = text[text.index("(") + 1 : -1].split()
            path = [*path, f"coalesce(nanvl({features[int(inner[1])]}, null), {MISSING!r}D) {inner[2]} {inner[3]}"]
    which = F.lit(None).cast("int")
    for i, rule in enumerate(leaves):
        which = F.when(F.expr(rule), i).otherwise(which)
    named = F.array(*map(F.lit, leaves))
    g = df.withColumn("leaf", which).groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"))
    return g.select("leaf", F.get(named, F.col("leaf")).alias("rule"), "n", "n_pos", (F.col("n_pos") / F.col("n")).alias("rate"))


def standardize(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """`z` array: features by the mean and sample deviation of the training rows only; a missing feature fails."""
    model = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(_vector(train, features, None))
    return model.transform(_vector(df.withColumn("__keep", F.struct(*df.columns)), features, None)).select("__keep.*", vector_to_array("__z").alias("z"))
