"""Language identification in two steps (operator 2).

A text becomes hashed counts of its 1- to 3-byte sequences (lower case), as square
roots of frequencies.  One-versus-one linear support vector machines first choose
the language family, others then choose among the languages of that family.

The machines are fitted by Spark on a bounded sample of the labelled rows
(``SAMPLE_PER_LANGUAGE`` for each language, chosen by a hash of the id); the
weights are small and go to the workers with the function that scores.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and
where nothing could be learned; with one learned language every other text is of
that language.  Rows are judged one by one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import fold, id_and_text, map_batches, materialise, small_batches, stored

# Families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
}
DIMENSIONS, ORDERS = 2048, (1, 2, 3)
#: Labelled rows that the machines are fitted on, about, for each language.
SAMPLE_PER_LANGUAGE = 1000
ITERATIONS, REGULARISATION = 25, 1e-4


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members.split()), f"only {lang}")


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of hashed byte sequences; unit length."""
    data = np.frombuffer(text.lower().encode(), "u1").astype("u4")
    counts = np.zeros(DIMENSIONS)
    for n in ORDERS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, "u4")
            for i in range(n):
                code = code * np.uint32(16777619) ^ data[i:len(data) - n + 1 + i]
            code ^= code >> np.uint32(15)
            counts += np.bincount((code * np.uint32(2654435769)) >> np.uint32(21), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


class Model:
    """One-versus-one machines: for (a, b) a positive margin speaks for b."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.by_family: dict[str, list[str]] = {}
        for lang in languages:
            self.by_family.setdefault(family_of(lang), []).append(lang)
        self.machines: dict[tuple[str, str, str], tuple[np.ndarray, float]] = {}

    def groups(self) -> list[tuple[str, list[str]]]:
        """The choices to be made: among families (named ""), and among the languages of each."""
        return [("", sorted(self.by_family)), *sorted(self.by_family.items())]

    def choose(self, group: str, options: list[str], x: np.ndarray) -> tuple[str, float]:
        """The option with most wins (of equals the greater margin, then the first), and how sure the closest is."""
        margins = {o: [] for o in options}
        for a, b in combinations(options, 2):
            weights, bias = self.machines[group, a, b]
            m = float(weights @ x + bias)
            margins[a].append(-m)
            margins[b].append(m)
        best = max(options, key=lambda o: (sum(m > 0 for m in margins[o]), sum(margins[o]), -options.index(o)))
        least = min(margins[best], default=30.0)
        return best, 1 / (1 + float(np.exp(-2 * min(30.0, max(-30.0, least)))))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        family, sure = self.choose("", sorted(self.by_family), x)
        lang, more = self.choose(family, self.by_family[family], x)
        return lang, sure * more


def train(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows ``doc_id``, ``text``, ``lang`` (rows without a language or a text teach nothing)."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    model = Model(sorted(sizes))
    if len(sizes) < 2:
        return model
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_language / n))))
    some = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])

    def vectors(batch: pa.RecordBatch) -> dict[str, object]:
        made = [features(t) for t in batch.column("text").to_pylist()]
        return {"x": pa.array([v.tolist() for v in made], pa.list_(pa.float64()))}

    made = map_batches(some.select("lang", "text"), vectors, "x array<double>").drop("text")
    # the sample is written by all tasks of the scan; only its few rows are taken together
    sample = materialise(stored(made).select("lang", array_to_vector("x").alias("x")).coalesce(8))
    families = F.create_map(*(F.lit(x) for lang in sizes for x in (lang, family_of(lang))))
    for group, options in model.groups():
        label = families[F.col("lang")] if group == "" else F.col("lang")
        for a, b in combinations(options, 2):
            pair = sample.select("x", label.alias("name")).filter(F.col("name").isin(a, b))
            pair = pair.select("x", (F.col("name") == b).cast("double").alias("y")).persist()
            fit = LinearSVC(featuresCol="x", labelCol="y", maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False).fit(pair)
            pair.unpersist()
            model.machines[group, a, b] = (np.array(fit.coefficients.toArray()), float(fit.intercept))
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row's whole text."""
    small_batches(df.sparkSession)

    def predict(batch: pa.RecordBatch) -> dict[str, object]:
        made = [model.predict(t) for t in batch.column("text").to_pylist()]
        return {"lang_pred": pa.array([m[0] for m in made], pa.string()), "score": pa.array([m[1] for m in made], pa.float64())}

    return map_batches(id_and_text(df, id_col, text_col), predict, "lang_pred string, score double").drop("text")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` outside the held-out fold, then judge all of them."""
    model = train(docs.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
