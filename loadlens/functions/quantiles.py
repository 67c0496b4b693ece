"""Linear quantile regression by reweighted least squares: each step is one aggregate of products, for all keys and quantiles at once.

The pinball loss of a residual r is q * r above and (q - 1) * r below. A step solves the normal equations with weights
(q or 1 - q) / max(|r|, SMALLEST) of the step before, whose sums Spark makes; only sums of one size for any number of rows,
(features + 1) * (features + 4) / 2 numbers a key and quantile, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Residuals count as at least so much in a weight, of the target's spread; steps; what is added to the diagonal, of its own size.
SMALLEST, STEPS, RIDGE = 1e-4, 40, 1e-9

Fits = dict[tuple[object, float], np.ndarray]


def fit(df: DataFrame, features: list[str], label: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9), key: str | None = None, steps: int = STEPS) -> Fits:
    """By key (None without one) and quantile, the intercept and the features' coefficients. Rows with a null or NaN in any of them are left out."""
    named = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select((F.col(key) if key else F.lit(None).cast("int")).alias("k"), F.col(label).cast("double").alias("y"), *named)
    whole = F.lit(True)
    for c in rows.columns[1:]:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    rows = rows.filter(whole)
    # Features are brought to one size, so that the equations are well posed; the coefficients are brought back at the end.
    scale = rows.groupBy("k").agg(*(f(c).alias(f"{n}_{c}") for c in rows.columns[1:] for n, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()  # a row a key
    size = {r["k"]: (np.array([r[f"m_{c}"] for c in rows.columns[1:]]), np.array([r[f"s_{c}"] or 1.0 for c in rows.columns[1:]])) for r in scale}
    at: Fits = {(k, q): np.zeros(len(features) + 1) for k in size for q in qs}
    n = len(features) + 1
    upper = np.triu_indices(n)
    wide = len(upper[0]) + n

    def partial(now: Fits, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[object, float], np.ndarray] = {}
            for b in batches:
                keys = np.array(b.column(0).to_pylist(), object)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
                for k in set(keys.tolist()):
                    mean, spread = size[k]
                    z = (values[keys == k] if k is not None else values) - mean
                    z /= spread
                    x = np.concatenate([np.ones((len(z), 1)), z[:, 1:]], axis=1)
                    for q in qs:
                        r = z[:, 0] - x @ now[k, q]
                        w = np.ones(len(r)) if first else np.where(r > 0, q, 1 - q) / np.maximum(np.abs(r), SMALLEST)
                        xw = x * w[:, None]
                        sums[k, q] = sums.get((k, q), 0) + np.concatenate([(xw.T @ x)[upper], xw.T @ z[:, 0]])
            made = [(k, q, s.tolist()) for (k, q), s in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], b_type), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.list_(pa.float64()))], names=["k", "q", "v"])

        return run

    kind = rows.schema["k"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    b_type = to_arrow_type(kind)
    for step in range(steps + 1):
        parts = rows.mapInArrow(partial(at, step == 0), f"k {kind.simpleString()}, q double, v array<double>")
        total = parts.select("k", "q", F.posexplode("v").alias("i", "v")).groupBy("k", "q", "i").agg(F.sum("v").alias("v")).collect()
        got: dict[tuple[object, float], np.ndarray] = {}
        for r in total:
            got.setdefault((r["k"], r["q"]), np.zeros(wide))[r["i"]] = r["v"]
        moved = 0.0
        for kq, v in got.items():
            a = np.zeros((n, n))
            a[upper] = v[: -n]
            a = a + np.triu(a, 1).T
            new = np.linalg.solve(a + np.diag(RIDGE * np.diag(a) + 1e-300), v[-n:])
            moved, at[kq] = max(moved, float(np.abs(new - at[kq]).max())), new
        if step and moved < 1e-7:
            break
    out: Fits = {}
    for (k, q), beta in at.items():
        mean, spread = size[k]
        slopes = beta[1:] * spread[0] / spread[1:]
        out[k, q] = np.concatenate([[mean[0] + spread[0] * beta[0] - slopes @ mean[1:]], slopes])
    return out


def table(df: DataFrame, fits: Fits, features: list[str]) -> DataFrame:
    """key, quantile, feature, coefficient of fits, for keeping; the intercept's feature is null."""
    rows = [(None if k is None else str(k), float(q), c, float(v)) for (k, q), beta in fits.items() for c, v in zip([None, *features], beta, strict=True)]
    return df.sparkSession.createDataFrame(rows, "key string, quantile double, feature string, coefficient double")


def linear(coefficients: dict[str | None, float]) -> Column:
    """A prediction from kept coefficients; null where a feature is."""
    return sum((F.col(c).cast("double") * v for c, v in coefficients.items() if c is not None), F.lit(float(coefficients.get(None, 0.0))))


def ordered(quantiles: dict[str, Column]) -> dict[str, Column]:
    """Predictions of rising quantiles put in order, so that none crosses another; names keep their order, nulls come last."""
    held = F.array_sort(F.array(*quantiles.values()))
    return {name: F.get(held, F.lit(i)) for i, name in enumerate(quantiles)}


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.when(y >= p, q * (y - p)).otherwise((1 - q) * (p - y))


def interval_table(df: DataFrame, y: str, quantiles: dict[str, float], keys: list[str]) -> DataFrame:
    """keys, n, pinball_* and under_* of each column of predicted quantiles, and share and width of the outermost pair's interval."""
    names = list(quantiles)
    lo, hi = F.col(names[0]), F.col(names[-1])
    each = [x for c, q in quantiles.items() for x in (F.avg(pinball(F.col(y), F.col(c), q)).alias(f"pinball_{c}"), F.avg((F.col(y) <= F.col(c)).cast("double")).alias(f"under_{c}"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *each, F.avg(F.col(y).between(lo, hi).cast("double")).alias("coverage"), F.avg(hi - lo).alias("width"))
