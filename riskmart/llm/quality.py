"""Document quality by a regularised quadratic discriminant.

Every text becomes a short vector of transformed statistics. Class means and covariances come from sums over all
labelled training rows; covariances shrink towards the pooled one and towards its diagonal. A score is the logistic of
the difference of the two Gaussian log densities plus the log prior ratio, from Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import fold, staged

#: Bytes counted as marks: punctuation that running prose hardly uses.
MARKS = b"#$%&*+/<=>@[]^_`{|}~\\!?"
FEATURES = ["length", "words", "word_bytes", "marks", "shouts", "capitals", "digits", "stops", "bars", "lines", "distinct",
            "repeats", "wide", "top"]
UPPER = bytes(range(0x41, 0x5B))
DIGITS = b"0123456789"
WIDE = bytes(range(0x80, 0x100))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; a null text counts as empty, and an empty one gives zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return [0.0] * len(FEATURES)
    n = len(b)
    words = b.split()
    w = max(len(words), 1)

    def share(kinds: bytes) -> float:
        return float(np.sqrt((n - len(b.translate(None, kinds))) / n))

    lowered = {}
    for x in words:
        lowered[x] = lowered.get(x, 0) + 1
    return [float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(n / w)), share(MARKS), float(np.sqrt(b.count(b"!") / w)),
            share(UPPER), share(DIGITS), float(np.sqrt(b.count(b".") / w)), float(np.sqrt(b.count(b"|") / w)),
            float(np.sqrt(b.count(b"\n") / w)), len(lowered) / w,
            float(np.sqrt(sum(map(eq, words, words[1:])) / w)), share(WIDE), float(np.sqrt(max(lowered.values(), default=0) / w))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and one column for each statistic, from whole texts."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x.as_py()) for x in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(FEATURES)))],
                                             names=["doc_id", *FEATURES])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(compute, f"doc_id {kind}, " + ", ".join(f"`{c}` double" for c in FEATURES))


class Discriminant:
    """Two Gaussians with shrunk covariances; `factors` are the inverses of their Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_diagonal: float = 0.05):
        self.counts = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
        self.fitted = min(self.counts) >= 2
        if not self.fitted:
            return
        d = len(FEATURES)
        self.means, own = [], []
        for k in (0, 1):
            n, s, q = sums[k]
            mean = s / n
            self.means.append(mean)
            own.append((q / n - np.outer(mean, mean)) * n / (n - 1))
        pooled = sum(c * n for c, n in zip(own, self.counts)) / sum(self.counts)
        self.factors, self.logs = [], []
        for k in (0, 1):
            a = max(to_pooled, d / (d + self.counts[k]))
            c = (1 - a) * own[k] + a * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
            low = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(low))
            self.logs.append(float(np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; the smoothed share of class 1 where a class is missing."""
        prior = np.log((self.counts[1] + 1) / (self.counts[0] + 1))
        if not self.fitted:
            return np.full(len(x), 1 / (1 + np.exp(-prior)))
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - log for m, f, log in zip(self.means, self.factors, self.logs)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + prior, -700, 700)))


def fit(rows: DataFrame, label: str = "label") -> Discriminant:
    """Fit on rows with the statistics and a 0/1 label; sums of products are formed by one grouped aggregate."""
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    found = rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count("*"), *(F.sum(f"`{c}`") for c in FEATURES), *(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).collect()
    sums = {}
    at = {c: i for i, c in enumerate(FEATURES)}
    for r in found:
        q = np.zeros((len(FEATURES), len(FEATURES)))
        for (a, b), v in zip(pairs, r[2 + len(FEATURES):]):
            q[at[a], at[b]] = q[at[b], at[a]] = v
        sums[int(r[0])] = (float(r[1]), np.array(r[2:2 + len(FEATURES)], float), q)
    return Discriminant(sums)


def op7_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every whole text; learn from labelled rows outside fold 0 of 5.

    Null and empty texts get the score of a text whose statistics are all zero. A document with several labels counts
    once with the larger one, null labels are ignored. Repeated documents are scored one by one. Without labels of both
    classes every score is the smoothed share of class 1.
    """
    rows = staged(features(docs).withColumn("held_out", fold(F.col("doc_id"), 5) == 0), "quality")
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label")).filter("label is not null")
    model = fit(rows.filter("not held_out").join(known, "doc_id"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
