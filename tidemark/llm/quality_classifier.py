"""A regularised quadratic discriminant over document statistics.

Each text gives a handful of statistics (shares, ratios and logarithms, so that they are near normal within a class).
Class means and covariances come from one aggregate over the labelled rows: counts, sums and sums of products, by fold.
Each covariance is shrunk towards the pooled one and then towards its own diagonal, and gets a floor.  Their Cholesky
factors are kept in the model; a score is the logistic function of the difference of the two log densities, each a
Mahalanobis distance through its factor, plus the log odds of the classes.

How much to shrink is chosen by cross-validation within the learning folds: sums add up, so the models without a fold
come from the same aggregate, and one pass over the labelled rows adds up the log loss of each choice on the fold left
out.  The held-out fold takes no part.

Statistics use the text alone: no label, language, source or id takes part in a score.

Nulls and edge cases: a null or empty text has the statistics of an empty text and gets a score as any other; rows with
a null label or doc_id are not learnt from; rows that repeat are learnt and scored as often as they occur; with a class
missing among the labels, all scores are the share of label 1 (0.5 without labels), and with one missing without some
fold, the middle choice is taken; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, n_words

FOLDS = 5

#: Score from which a document is predicted to be of quality 1.
CUT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The transformed statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda n, of: F.sqrt(n / F.greatest(of, F.lit(1)))
    words = n_words(text)
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    distinct = F.size(F.array_distinct(split))
    return {
        "log_words": F.log1p(words),
        "word_length": F.log1p(length / F.greatest(words, F.lit(1))),
        "distinct": distinct / F.greatest(words, F.lit(1)),
        "distinct_growth": F.log1p(distinct) / F.log1p(F.greatest(words, F.lit(1))),
        "symbols": share(count(r"[#*$%&<>{}\[\]|@^~_=+\\/]"), words),
        "upper": share(count(r"\p{Lu}"), length),
        "marks": share(count(r"[!?]"), words),
        "stops": share(count(r"[.,;:]"), words),
        "digits": share(count(r"\p{Nd}"), length),
        "lines": share(count(r"\n"), words),
        "echoes": share(count(r"(?<![^ ])([^ ]+) \1(?![^ ])"), words),
    }


NAMES = ("log_words", "word_length", "distinct", "distinct_growth", "symbols", "upper", "marks", "stops", "digits", "lines", "echoes")


@dataclass(frozen=True)
class Shrinkage:
    """Shares of the pooled covariance and of the own diagonal, and what is added to the diagonal."""

    pooled: float
    diagonal: float
    floor: float


#: What cross-validation chooses from.
CHOICES = tuple(Shrinkage(*x) for x in product((0.05, 0.2, 0.5), (0.05, 0.2, 0.5), (1e-4, 1e-3, 1e-2)))


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors, log determinants and log odds of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    shrinkage: Shrinkage | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        density = np.zeros((2, len(x)))
        for k in range(len(self.means)):
            z = (x - self.means[k]) @ self.factors[k].T
            density[k] = -0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[k]
        odds = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-odds))


#: Number of rows, sums and sums of products of a class.
Sums = tuple[int, np.ndarray, np.ndarray]


def class_sums(labelled: DataFrame) -> dict[tuple[int, int], Sums]:
    """Of each (fold, label): its sums.  One aggregate; its result has a row for each fold and class."""
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
    sums = [F.sum(n) for n in NAMES] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i, j in pairs]
    out = {}
    for r in labelled.groupBy("fold", "label").agg(F.count("*"), *sums).collect():
        square = np.zeros((len(NAMES), len(NAMES)))
        for (i, j), v in zip(pairs, r[3 + len(NAMES) :], strict=True):
            square[i, j] = square[j, i] = v
        out[r[0], r[1]] = r[2], np.array(r[3 : 3 + len(NAMES)], float), square
    return out


def model_of(sums: dict[tuple[int, int], Sums], shrinkage: Shrinkage, without: int | None = None) -> Model:
    """The model of all folds but one."""
    got = [[v for (fold, label), v in sums.items() if label == k and fold != without] for k in (0, 1)]
    if not got[0] or not got[1]:
        odds = 0.0 if not got[0] and not got[1] else (np.inf if got[1] else -np.inf)
        return Model(np.zeros((0, len(NAMES))), np.zeros((0, 0, 0)), np.zeros(0), odds)
    n, total_x, total_xx = zip(*([sum(x[i] for x in of) for i in range(3)] for of in got), strict=True)
    means = [total_x[k] / n[k] for k in (0, 1)]
    scatters = [total_xx[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    factors, dets = [], []
    for k in (0, 1):
        cov = (1 - shrinkage.pooled) * scatters[k] / n[k] + shrinkage.pooled * sum(scatters) / sum(n)
        cov = (1 - shrinkage.diagonal) * cov + shrinkage.diagonal * np.diag(np.diag(cov)) + shrinkage.floor * np.eye(len(NAMES))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Model(np.array(means), np.array(factors), np.array(dets), float(np.log(n[1] / n[0])), shrinkage)


def fit(labelled: DataFrame, choices: tuple[Shrinkage, ...] = CHOICES) -> Model:
    """Fit to rows with the statistics, `label` (0 or 1) and `fold`, with the choice of least cross-validated log loss."""
    labelled = labelled.filter("label in (0, 1)").select("fold", "label", *NAMES)
    sums = class_sums(labelled)
    folds = sorted({fold for fold, _ in sums})
    models = {fold: [model_of(sums, c, fold) for c in choices] for fold in folds}
    if len(folds) < 2 or any(m.shrinkage is None for of in models.values() for m in of):
        return model_of(sums, choices[len(choices) // 2])

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                one = rows["label"].to_numpy() == 1
                for i, model in enumerate(models[fold]):
                    p = model.scores(rows[list(NAMES)].to_numpy(float))
                    yield pd.DataFrame({"choice": [i], "loss": [-np.log(np.maximum(np.where(one, p, 1 - p), 1e-15)).sum()]})

    found = labelled.mapInPandas(losses, "choice int, loss double").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()
    # Sums of floats differ in their last digits from run to run; equal losses go to the first choice.
    return model_of(sums, choices[min(found, key=lambda r: (float(f"{r['loss']:.6g}"), r["choice"]))["choice"]])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with `score`; a row carries the statistics by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=model.scores(batch[list(NAMES)].to_numpy(float)))

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", score double")


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted, statistics) for every row of `docs` (doc_id, text).

    `labels` (doc_id, label) is learnt from outside the held-out fold, which is fold 0.
    """
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    rows = materialise(docs.select("doc_id", held, *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]))
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("label"))
    learnt = rows.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold > 0").join(known, F.col("doc_id") == F.col("_id"))
    model = fit(materialise(learnt.select("fold", "label", *NAMES)))
    return score(rows, model).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
