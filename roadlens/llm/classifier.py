"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are transformed (roots of shares, logarithms of counts) so that classes are roughly normal. Each class has a
mean and a covariance, summed over the labelled training rows by Spark; the covariance is shrunk towards a multiple of the identity by the
closed form of oracle-approximating shrinkage. The Cholesky factors are computed once; a score is the difference of the classes'
log densities (Mahalanobis distance and log determinant) plus the log prior, divided by the number of statistics and put through the
logistic function.

Defined cases: a null or empty text has all statistics zero and is scored like any other; labels with a null quality or id are ignored, ids
with several labels take the majority (none on a tie), repeated rows are scored (and, if labelled, learned) one by one; with fewer than two
rows of a class in training, every score is the smoothed share of label 1. Only text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .measures import COUNTS, counts
from .text import WordHashes, mapped, read

STATISTICS = ("length", "word_length", "symbols", "upper", "marks", "digits", "stops", "repeats", "copied_lines", "variety", "wide")


def statistics(c: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row per document, from the columns of COUNTS."""
    x = dict(zip(COUNTS, c.T.astype(np.float64)))
    per = lambda a, b: np.sqrt(x[a] / np.maximum(x[b], 1))
    letters = np.maximum(x["n_upper"] + x["n_lower"], 1)
    return np.stack([
        np.log1p(x["n_words"]), np.log1p(x["word_chars"] / np.maximum(x["n_words"], 1)), per("n_symbols", "word_chars"), np.sqrt(x["n_upper"] / letters),
        per("n_marks", "word_chars"), per("n_digits", "word_chars"), per("n_stops", "word_chars"), per("n_repeat_words", "n_words"),
        per("n_dup_lines", "n_lines"), np.log1p(x["n_distinct"]) / np.maximum(np.log1p(x["n_words"]), 1), per("n_bytes", "word_chars")], axis=1)


@dataclass
class Gaussian:
    mean: np.ndarray
    whitener: np.ndarray  # inverse of the Cholesky factor
    log_weight: float  # log prior minus half the log determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.log_weight - 0.5 * (((x - self.mean) @ self.whitener.T) ** 2).sum(axis=1)


@dataclass
class Model:
    """Scores of statistics; without two classes only the share of label 1."""
    classes: tuple[Gaussian, Gaussian] | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        z = (self.classes[1].log_density(x) - self.classes[0].log_density(x)) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage towards the mean variance."""
    p = len(cov)
    mu, squares, trace2 = np.trace(cov) / p, (cov * cov).sum(), np.trace(cov) ** 2
    bottom = (n + 1 - 2 / p) * (squares - trace2 / p)
    weight = 1.0 if bottom <= 0 else min(1.0, ((1 - 2 / p) * squares + trace2) / bottom)
    weight = max(weight, 0.01)
    return (1 - weight) * cov + weight * max(mu, 1e-6) * np.eye(p)


def fitted(rows: DataFrame, names: list[str], label: str) -> Model:
    """Means and covariances of both classes as sums: a few hundred numbers reach the driver, whatever the size of ``rows``."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = {r[0]: r for r in rows.groupBy(label).agg(
        F.count(F.lit(1)), *[F.sum(n) for n in names], *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).collect()}
    n = {k: float(got[k][1]) if k in got else 0.0 for k in (0, 1)}
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n.values()) < 2:
        return Model(None, share)
    # all classes are measured in the pooled spread of each statistic, so the shrinkage target suits each of them
    total = {k: np.array(got[k][2:2 + p], np.float64) for k in (0, 1)}
    square = {k: np.zeros((p, p)) for k in (0, 1)}
    for k in (0, 1):
        for (i, j), v in zip(pairs, got[k][2 + p:]):
            square[k][i, j] = square[k][j, i] = v
    cov = {k: square[k] / n[k] - np.outer(total[k] / n[k], total[k] / n[k]) for k in (0, 1)}
    spread = np.sqrt(np.maximum((cov[0].diagonal() * n[0] + cov[1].diagonal() * n[1]) / (n[0] + n[1]), 1e-8))
    classes = []
    for k in (0, 1):
        factor = np.linalg.cholesky(shrunk(cov[k] / np.outer(spread, spread), n[k]))
        classes.append(Gaussian(total[k] / n[k], np.linalg.inv(factor) / spread, float(np.log(n[k] / (n[0] + n[1])) - np.log(factor.diagonal()).sum())))
    return Model((classes[0], classes[1]), share)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    hashes = WordHashes()

    def run(batches):
        for batch in batches:
            c = np.array([counts(t.as_py(), hashes) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            x = statistics(c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", *STATISTICS])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def scored(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``rows`` with ``score``."""
    def run(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(n), np.float64) for n in names], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], [*batch.schema.names, "score"])
    return mapped(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double")


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and its quality by majority."""
    share = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("share"))
    return share.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_classifier(spark, sf_dir: str) -> DataFrame:
    names = list(STATISTICS)
    rows = written(described(read(spark, sf_dir, "documents")), "classifier-statistics")
    known = rows.join(labelled(read(spark, sf_dir, "labels")), "doc_id").filter(~held_out(F.col("doc_id")))
    out = scored(rows, fitted(known, names, "label"), names)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
