"""Quality classifier: regularised quadratic discriminant (operator 3).

A text becomes transformed statistics (logarithms of lengths and ratios).  Spark
adds up the moments of each class over all labelled rows; the class covariances
are shrunk towards their mean and towards a sphere.  The score compares the two
classes' log densities, whose Mahalanobis terms use Cholesky factors made once.

Defined results: empty and null texts are scored by their (empty) statistics;
without labelled rows every score is 0.5; a class without rows has the prior of
half a row and the other's density.  Several labels for one id count as one, the
least; rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import fold, id_and_text, map_batches, materialise, small_batches

STATISTICS = ("words", "word_length", "letters", "upper", "digits", "symbols", "bangs", "punctuation", "wide",
              "line_length", "repeated_lines", "different_words", "top_word", "same_again", "short_words", "sentence_words")
#: Shrinkage of a class covariance: towards the mean of both classes, and towards a sphere.
TO_POOLED, TO_SPHERE = 0.2, 0.05
#: Added to ratios before their logarithm.
LEAST = 1e-3

_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
_CLASSES = np.zeros(256, "i8")
for _number, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!",
                                    b".,;:?'\"()-"), start=1):
    _CLASSES[list(_members)] = _number
_CLASSES[128:] = 7


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    data = np.frombuffer(text.encode(), "u1")
    classes = np.bincount(_CLASSES[data], minlength=8)
    size = max(1, len(data))
    words = text.lower().split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    again = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    ratio = lambda x, of: math.log(x / of + LEAST)
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / n), ratio(classes[1] + classes[2], size), ratio(classes[2], size),
        ratio(classes[3], size), ratio(classes[4], size), ratio(classes[5], size), ratio(classes[6], size), ratio(classes[7], size),
        math.log1p(len(text) / max(1, len(lines))), ratio(len(lines) - len(set(lines)), max(1, len(lines))),
        ratio(len(counts), n), ratio(max(counts.values(), default=0), n), ratio(again, n),
        ratio(sum(len(w) <= 3 for w in words), n), math.log1p(len(words) / (1 + len(_SENTENCE_END.findall(text)))),
    ]


def statistics_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (array of the statistics) of every row's whole text."""
    small_batches(df.sparkSession)

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        return {"x": pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}

    return map_batches(id_and_text(df, id_col, text_col), made, "x array<double>").drop("text")


class Model:
    """Priors, means and whitening factors of the two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        """moments: for each class the rows, the mean and the covariance."""
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.known = sum(n.values()) > 0
        if not self.known:
            return
        d = len(STATISTICS)
        pooled = sum(n[k] * moments[k][2] for k in moments) / sum(n.values())
        self.terms = []
        for k in (0, 1):
            _, mean, own = moments.get(k, moments.get(1 - k))
            cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
            cov = (1 - TO_SPHERE) * cov + (TO_SPHERE * np.trace(cov) / d + 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            constant = math.log((n[k] + 0.5) / (sum(n.values()) + 1)) - np.log(np.diag(factor)).sum()
            self.terms.append((mean, np.linalg.inv(factor), constant))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if not self.known:
            return np.full(len(x), 0.5)
        density = [c - 0.5 * ((x - mean) @ white.T).__pow__(2).sum(axis=1) for mean, white, c in self.terms]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def train(labelled: DataFrame) -> Model:
    """Fit on rows ``x``, ``quality``; Spark sums up the moments, a row for each class comes back."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.avg(a).alias(f"m{i}") for i, a in enumerate(x)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    moments = {}
    for r in labelled.groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        cov = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        moments[int(r.quality)] = (float(r.n), np.array([r[f"m{i}"] for i in range(d)]), cov)
    return Model(moments)


def score(table: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of a statistics table."""

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        x = np.array(batch.column("x").to_pylist(), "f8").reshape(-1, len(STATISTICS))
        s = model.scores(x)
        return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype("i4"))}

    return map_batches(table, made, "score double, predicted int").drop("x")


def classify_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, then score all rows."""
    table = materialise(statistics_table(docs))
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    learn = table.filter(fold(F.col("doc_id"), 3) != 1).join(known, "doc_id")
    scored = score(table, train(learn))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
