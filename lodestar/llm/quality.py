"""Quality classifier: regularised quadratic discriminant analysis.

Method: transformed statistics of each whole text; per class a mean and a covariance, shrunk
towards the pooled covariance and its average variance.  A score is the logistic of the
difference of the two log densities, whose Mahalanobis terms come from the inverses of Cholesky
factors computed once.  Class sums are aggregated by Spark over all rows to learn from;
the driver only sees one row of sums for each class.

Defined results: a null or empty text has all-zero statistics and is scored like any other;
labels that are null count as absent, and repeated labels weigh as often as they stand there; with no row of a
class every score is the share of label 1, or one half without labels; repeated rows are scored
one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, texts

#: Weight of the pooled covariance in each class's, and of the average variance in both; chosen, like the
#: statistics, by the errors on one fold of the rows to learn from, never on the held-out fold.
POOLED, ROUND = 0.5, 0.1
#: A document is good from this score on.
THRESHOLD = 0.3
#: One in so many documents is held out from learning.
FOLDS = 5

_KIND = np.full(256, 6)
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[[10]] = 4
_KIND[[*map(ord, ".,;:'\"!?()-")]] = 5
_KIND[128:] = 7
_COUNT = np.zeros((256, 8))
_COUNT[np.arange(256), _KIND] = 1
NAMES = ("words", "lower", "upper", "digit", "blank", "newline", "mark", "symbol", "other", "word_size", "distinct", "bang", "doubled")
N = len(NAMES)


def statistics(text: str) -> list[float]:
    """Transformed statistics: shares by square root, counts by logarithm."""
    data = text.encode()
    if not data:
        return [0.0] * N
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.sqrt(counts @ _COUNT / len(data))
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    size = np.log1p(len(data) / n)
    doubled = sum(map(str.__eq__, words, words[1:])) / n
    return [np.log1p(n), *share.tolist(), size, np.log1p(distinct) / np.log1p(n), (counts[33] / len(data)) ** 0.5, doubled**0.5]


def document_statistics(df: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each whole text."""

    def work(batch):
        return {"doc_id": batch.column("doc_id"), "x": list(map(statistics, batch.column("text").to_pylist()))}

    return arrow_rows(texts(df), lambda: work, "doc_id long, x array<double>")


def held_out(doc_id="doc_id"):
    """True for the documents that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


class Discriminant:
    """Two Gaussian classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """sums: per class its rows, their sum, and the sum of their outer products."""
        total = sum(n for n, _, _ in sums.values())
        self.prior = sums[1][0] / total if 1 in sums and total else 0.5 if not total else 0.0
        self.classes = None
        if len(sums) < 2 or min(n for n, _, _ in sums.values()) < 2:
            return
        means = {k: s / n for k, (n, s, _) in sums.items()}
        own = {k: ss / n - np.outer(means[k], means[k]) for k, (n, _, ss) in sums.items()}
        pooled = sum(n * own[k] for k, (n, _, _) in sums.items()) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale, self.classes = scale, {}
        for k, (n, _, _) in sums.items():
            mixed = ((1 - POOLED) * own[k] + POOLED * pooled) / np.outer(scale, scale)
            mixed = (1 - ROUND) * mixed + ROUND * np.trace(mixed) / N * np.eye(N)
            factor = np.linalg.cholesky(mixed)
            self.classes[k] = (means[k] / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The likelihood of label 1 for each row of statistics."""
        if self.classes is None:
            return np.full(len(x), self.prior)
        log = {}
        for k, (mean, inverse, half_log_det, log_prior) in self.classes.items():
            z = (x / self.scale - mean) @ inverse.T
            log[k] = log_prior - half_log_det - 0.5 * (z * z).sum(1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def learn(rows: DataFrame) -> Discriminant:
    """Fits the classes to rows of x and y (0 or 1)."""
    flat = rows.select("y", *(F.col("x")[i].alias(f"x{i}") for i in range(N)))
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    sums = flat.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(N)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs))
    out = {}
    for r in sums.collect():
        outer = np.zeros((N, N))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = r[f"s{i}_{j}"]
        out[r["y"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(N)]), outer)
    return Discriminant(out)


def fitted(facts: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of the labelled rows not held out; facts: doc_id and x."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out())
    return learn(facts.join(known, "doc_id").select("x", "y"))


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from the labelled ones not held out."""
    facts = materialize(document_statistics(df), "statistics")
    model = fitted(facts, labels)

    def work(batch):
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N)
        return {"doc_id": batch.column("doc_id"), "score": model.score(x)}

    scored = arrow_rows(facts, lambda: work, "doc_id long, score double", None)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def good_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of df whose whole text is predicted to be good, with all their columns; no row is moved."""
    model = fitted(document_statistics(df), labels)

    def keep(batches):
        import pyarrow as pa

        from .common import slices

        for batch in slices(batches):
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, N)
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return df.mapInArrow(keep, df.schema)
