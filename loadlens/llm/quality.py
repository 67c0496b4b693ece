"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

For each class: its mean, and its covariance shrunk towards the pooled one and then towards a scaled identity. A text's
score comes from the difference of the two Gaussian log densities, which use Cholesky factors made once. Moments are
summed by Spark from every labelled training row, about a fixed point amid usual texts so that no digits cancel; the
driver sees two vectors and two small matrices, however many rows there are. Spark adds the tasks' sums in any order, so
the last digits of a score may differ between runs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts

#: Shrinkage of a class covariance towards the pooled one, and then of either towards its mean variance.
TO_POOLED, TO_SPHERE = 0.1, 0.02
#: The log-density difference is divided by this before the logistic function: it orders texts alike, but keeps far ones apart.
TEMPERATURE = 10.0
#: Rows scored below it are low quality.
THRESHOLD = 0.3

FEATURES = ("words", "word_length", "longest_word", "upper", "digit", "symbol", "exclaim", "pipe", "punct", "distinct", "top_word", "repeated_line", "line_words", "stop_rate")
_CLASS = np.zeros(256, np.int64)
for _k, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>~^=+{}[]\\@_", b"!?", b"|", b".,;:'\"()-/"), 1):
    _CLASS[list(_of)] = _k


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    _, upper, digit, symbol, exclaim, pipe, punct = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7).tolist()
    letters = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    # Shares of a few words say little: each is drawn towards a common value by pseudo-counts.
    share = lambda x, of: float(np.log1p(50.0 * x / (of + 120)))  # noqa: E731  of letters
    return [
        float(np.log(n + 10)), float(np.log((letters + 150) / (n + 30))), float(np.log(max(map(len, counts)) + 10)), share(upper, letters), share(digit, letters), share(symbol, letters), share(exclaim, letters), share(pipe, letters),
        share(punct, letters), float(np.log((len(counts) + 20) / (n + 20))), float(np.log1p(50.0 * max(counts.values()) / (n + 30))), float(np.log1p(20.0 * (len(lines) - len(set(lines))) / (len(lines) + 4))), float(np.log((n + 20) / (len(lines) + 2))), float(np.log((short + 12) / (n + 30))),
    ]


#: Moments are taken about the statistics of this sentence.
_ORIGIN = np.array(statistics(b"Most of what people read each day, in 2 or 3 sittings, was written by someone who wanted them to understand it.\n" * 3))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x array<double>."""

    def rows(texts):
        return {"x": [statistics(t) for t in texts]}

    return map_texts(df, id_col, text_col, rows, "x array<double>")


@dataclass
class Discriminant:
    """Of classes 0 and 1: means, inverse Cholesky factors of the shrunk covariances, and log normalisers with the priors."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; 0.5 without a model of both classes."""
        if len(self.means) < 2 or not len(x):
            return np.full(len(x), 0.5)
        log = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip((log[1] - log[0]) / TEMPERATURE, -30, 30)))


def fit(labelled: DataFrame, label_col: str = "quality", x_col: str = "x", to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """From rows of features and a 0/1 label; other labels and nulls don't count. One class missing: a model that gives 0.5."""
    d = len(FEATURES)

    def partial(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist(), float) - _ORIGIN
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                q[c] += own.T @ own
        sums = np.concatenate([n[:, None], s, q.reshape(2, -1)], axis=1)
        m = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], m), pa.int32()), pa.array(np.tile(np.arange(m), 2), pa.int32()), pa.array(sums.ravel())], names=["c", "i", "v"])

    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(x_col), F.col(label_col).cast("int")).mapInArrow(partial, "c int, i int, v double")
    sums = np.zeros((2, 1 + d + d * d))
    for c, i, v in rows.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows at any size
        sums[c, i] = v
    n = sums[:, 0]
    if min(n) < 2:
        return Discriminant([], [], [])
    means = [sums[c, 1 : 1 + d] / n[c] for c in (0, 1)]
    scatter = [sums[c, 1 + d :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    means = [m + _ORIGIN for m in means]
    pooled = sum(scatter) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * (np.trace(cov) / d + 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets)


def score(feats: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted of rows of features."""
    kind = feats.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = model.score(np.array(b.column(1).to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype("i4"))], names=[id_col, "score", "predicted"])

    return feats.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether a row's label must not be learnt: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per id that isn't held out; ids whose rows disagree, and null labels, are left out."""
    one = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col), F.max(label_col).alias("__most"))
    return one.filter(F.col(label_col) == F.col("__most")).drop("__most")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for every document, by a model of the training labels.

    Null and empty texts are scored as texts without words. Repeated rows are scored alike; ids may be null; other columns
    are ignored. An empty table, or labels of one class only, give scores of 0.5.
    """
    feats = keep(features(docs, id_col, text_col), "quality-features")
    model = fit(feats.join(training_labels(labels, id_col).hint("shuffle_hash"), id_col))
    return score(feats, model, id_col, threshold).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they were.

    The statistics are computed twice, once to fit and once to filter, which costs less than a shuffle of the texts.
    """
    model = fit(features(docs, id_col, text_col).join(training_labels(labels, id_col).hint("shuffle_hash"), id_col))

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        x = np.array([statistics((t or "").encode("utf-8", "replace")) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x) >= threshold, dtype=bool)

    return docs.filter(good(F.col(text_col).cast("string")))
