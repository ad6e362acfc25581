"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel of two words sums, over all three-letter subsequences they share, the product of their weights; a
subsequence that spans s letters weighs DECAY ** s, so letters inserted into an insult weaken the match but do not
break it. Landmarks are the words of labelled sentences that tell the classes apart best. A word's Nyström vector is
its normalised kernel row against the landmarks times the inverse root of the landmarks' own kernel matrix; a text
keeps, for every landmark, its closest word, and a linear machine is trained on these vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm.common import fold

#: Subsequences of this many letters, spanning at most SPAN; DECAY weighs a letter of the span.
ORDER, SPAN, DECAY = 3, 7, 0.8
#: Kernel values below this count as 0, so most words leave no trace in a text.
FLOOR = 0.5
LANDMARKS = 96
#: A landmark is this many standard deviations more frequent in toxic rows than expected; the best LEAST stay in any case.
EXCESS, LEAST = 2.0, 4
#: Rows of each class that the machine is trained on, chosen by a hash of the identifier: a documented bound.
ROWS = 6000
#: Known words kept by one worker.
WORDS = 200_000

_INNER = [np.array(c) for c in combinations(range(1, SPAN), ORDER - 1)]
_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
_SPELLED = re.compile(r"\b(?:[^\W\d_][\s.\-*_]{1,2}){3,}[^\W\d_]\b")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, without marks at their ends; words with marks inside also without
    these, and letters spelled out one by one join."""
    text = (text or "").lower()
    found = set(text.split())
    out = {m[0] for w in found if (m := _WORD.search(w))}
    out |= {"".join(filter(str.isalnum, w)) for w in out if not w.isalnum()}
    for m in _SPELLED.finditer(text):
        out.add("".join(c for c in m[0] if c.isalnum()))
    return out


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence codes, weights) of equally long words, one row each; positions past the end give code 0."""
    n, length = codes.shape
    padded = np.zeros((n, length + SPAN), np.int64)
    padded[:, :length] = codes
    keys, weights = [], []
    for inner in _INNER:
        key, alive = padded[:, :length], np.ones((n, length), bool)
        for i in inner:
            then = padded[:, i:i + length]
            key = key * 1_114_112 + then
            alive = alive & (then > 0)
        keys.append(np.where(alive, key, 0))
        weights.append(np.where(alive, DECAY ** (int(inner[-1]) + 1), 0.0))
    return np.concatenate(keys, axis=1), np.concatenate(weights, axis=1)


def _groups(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of equally long words: their places in the batch and their code points, one row a word."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(batch):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        step = max(1, 400_000 // (max(length, 1) * len(_INNER)))
        for at in range(0, len(places), step):
            chosen = places[at:at + step]
            codes = np.frombuffer("".join([batch[i] for i in chosen]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield np.array(chosen), codes.astype(np.int64).reshape(len(chosen), length)


def _norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself: equal subsequences of one word add up before they are squared."""
    order = np.argsort(keys, axis=1)
    k, w = np.take_along_axis(keys, order, 1), np.take_along_axis(weights, order, 1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    run = np.cumsum(new.ravel()) - 1
    sums = np.bincount(run, weights=w.ravel())
    rows = np.repeat(np.arange(len(k)), new.sum(axis=1))
    return np.bincount(rows, weights=sums ** 2, minlength=len(k))


class Kernel:
    """Normalised kernel of any words against fixed landmark words.

    Subsequences are told by numbers over the letters of the landmarks alone; one with another letter has none. Each is
    kept with the few landmarks that have it. A word's own norm is at least what its length says (equal subsequences only
    add to it), so it is formed only where the value could reach FLOOR.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = sorted(set("".join(landmarks)) - {"\0"})
        self.base = len(letters) + 1
        self.ids = np.zeros(0x110000, np.int32 if self.base <= 128 else np.int64)
        self.ids[[ord(c) for c in letters]] = np.arange(1, self.base)
        table: dict[int, dict[int, float]] = {}
        for places, codes in _groups(landmarks):
            keys, weights = _subsequences(codes)
            norm = np.sqrt(np.maximum(_norms(keys, weights), 1e-300))
            for numbers, weight in self._numbered(codes):
                for row, place in enumerate(places.tolist()):
                    for number in numbers[row][numbers[row] >= 0].tolist():
                        own = table.setdefault(number, {})
                        own[place] = own.get(place, 0.0) + weight / norm[row]
        self.keys = np.array(sorted(table), np.int64)
        each = [sorted(table[k].items()) for k in self.keys.tolist()]
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in each], dtype=np.int64)))
        self.owner = np.array([p for x in each for p, _ in x], np.int64)
        self.value = np.array([v for x in each for _, v in x], float)
        # by number where the numbers are few, else by search
        self.direct = None
        if self.base <= 128:
            self.direct = np.full(self.base ** 3, -1, np.int32)
            self.direct[self.keys] = np.arange(len(self.keys))

    def _numbered(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Numbers (negative: none) and weight of the subsequences with each pair of inner distances."""
        n, length = codes.shape
        ids = np.zeros((n, length + SPAN), self.ids.dtype)
        ids[:, :length] = self.ids[codes]
        # a missing letter in any place makes the number negative
        none = ids.dtype.type(-self.base ** 3)
        one, two, three = (np.where(ids > 0, ids * ids.dtype.type(self.base ** k), none) for k in (2, 1, 0))
        for inner in _INNER:
            i, j = int(inner[0]), int(inner[1])
            yield one[:, :length] + two[:, i:i + length] + three[:, j:j + length], DECAY ** (j + 1)

    def _known(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a subsequence of a landmark, and its place in the table."""
        if self.direct is not None:  # no subsequence has the number 0
            at = self.direct[np.maximum(numbers, 0)]
            row, column = np.nonzero(at >= 0)
            return row, at[row, column]
        row, column = np.nonzero(numbers >= 0)
        wanted = numbers[row, column]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        right = self.keys[at] == wanted
        return row[right], at[right]

    def __call__(self, batch: list[str]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(batch), m), np.float32)
        if not len(self.keys):
            return out
        for places, codes in _groups(batch):
            n, length = codes.shape
            cells, values, least = [], [], 0.0
            for numbers, weight in self._numbered(codes):
                row, at = self._known(numbers)
                owners = self.first[at + 1] - self.first[at]
                entry = np.repeat(self.first[at] - np.cumsum(owners) + owners, owners) + np.arange(owners.sum())
                cells.append(np.repeat(row * m, owners) + self.owner[entry])
                values.append(self.value[entry] * weight)
                least += weight ** 2 * max(0, length - (round(np.log(weight) / np.log(DECAY)) - 1))
            sums = np.bincount(np.concatenate(cells), np.concatenate(values), n * m).reshape(n, m)
            top = sums.max(axis=1)
            # a null character is no letter and lowers the norm: such words are always looked at
            some = np.flatnonzero((top > 0) & ((top >= 0.999 * FLOOR * np.sqrt(least)) | (codes == 0).any(axis=1)))
            if len(some):
                norm = np.sqrt(np.maximum(_norms(*_subsequences(codes[some])), 1e-300))
                out[places[some]] = sums[some] / norm[:, None]
        out[out < FLOOR] = 0
        return out


class Texts:
    """Closest word of a text for each landmark, with a bounded store of words already met."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.known, self.vectors = kernel, {}, []

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = [words(t) for t in texts]
        if len(self.known) > WORDS:
            self.known, self.vectors = {}, []
        new = [w for w in set().union(*found) if w not in self.known] if found else []
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            values = self.kernel(part)
            some = values.any(axis=1)
            for w, v, keep in zip(part, values, some):
                self.known[w] = len(self.vectors) if keep else -1
                if keep:
                    self.vectors.append(v)
        out = np.zeros((len(texts), len(self.kernel.landmarks)), np.float32)
        for i, own in enumerate(found):
            at = [k for k in map(self.known.__getitem__, own) if k >= 0]
            if at:
                out[i] = np.max([self.vectors[k] for k in at], axis=0)
        return out


class Machine:
    """Linear support vector machine on Nyström vectors, with a logistic link fitted on its margins."""

    def __init__(self, kernel: Kernel, x: np.ndarray, y: np.ndarray, share: float, cost: float = 1.0, steps: int = 400):
        self.share, self.fitted = share, len(np.unique(y)) == 2 and len(kernel.landmarks) > 0
        if not self.fitted:
            return
        own = kernel(kernel.landmarks)
        own = (own + own.T) / 2
        values, vectors = np.linalg.eigh(own.astype(float))
        keep = values > 1e-3
        self.map = vectors[:, keep] / np.sqrt(values[keep])
        z = x @ self.map
        sign = np.where(y == 1, 1.0, -1.0)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        # squared hinge loss, by Newton steps on the rows inside the margin
        z1 = np.column_stack([z, np.ones(len(z))])
        w = np.zeros(z1.shape[1])
        ridge = np.diag([*np.ones(z.shape[1]), 1e-6])
        for _ in range(min(steps, 30)):
            inside = sign * (z1 @ w) < 1
            a = z1[inside] * weight[inside, None]
            new = np.linalg.solve(ridge + 2 * cost * a.T @ z1[inside], 2 * cost * a.T @ sign[inside])
            if np.allclose(new, w, atol=1e-7):
                break
            w = new
        self.w = w
        # Platt's link with smoothed targets; the constant is moved to the share of toxic rows among all labels
        m = z1 @ w
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
            v = p * (1 - p) + 1e-9
            h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-8:
                break
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(n1 / n0)
        self.a, self.b = a, b + odds

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        m = (x @ self.map) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -500, 500)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, rows: int = ROWS) -> tuple[Kernel, Machine]:
    """Learn from labelled documents outside fold 2 of 4.

    Per class, the `rows` labelled identifiers with the smallest hash are used; word counts, landmark choice and the
    machine rest on them. Labels other than 0 and 1 are ignored; landmarks have 3 to 40 letters. The counts are formed by a distributed aggregate; the driver gets the chosen words and one
    short vector for each chosen row.
    """
    spark = docs.sparkSession
    valid = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), 4) != 2))
    known = valid.groupBy("doc_id").agg(F.max("label").alias("label"))
    ranked = known.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    chosen = None
    for k in (0, 1):
        part = ranked.filter(F.col("label") == k).orderBy("order", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    sums = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    share = (sums.get(1, 0) + 0.5) / (sum(sums.values()) + 1)
    picked = spark.createDataFrame(chosen.select("doc_id", "label").collect(), chosen.select("doc_id", "label").schema)
    sample = _texts(docs).join(F.broadcast(picked), "doc_id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0), batch.column(1)):
                y = y.as_py()
                for w in words(text.as_py()):
                    tally.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()),
                                              pa.array([v[1] for v in tally.values()], pa.int64())], names=["word", "clean", "toxic"])

    # a word tells the classes apart by the signed root of its likelihood ratio, here by its excess among toxic rows
    counts = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = picked.groupBy("label").count().collect()
    n = {int(r[0]): r[1] for r in n}
    scale = n.get(1, 0) / max(n.get(0, 0), 1)
    excess = (F.col("toxic") - F.col("clean") * scale) / F.sqrt(F.col("toxic") + F.col("clean") * scale + 1)
    ranked_words = counts.filter((F.length("word") >= ORDER) & (F.length("word") <= 40) & (F.col("toxic") > 0)).orderBy(
        excess.desc(), "word").limit(landmarks).select("word", excess.alias("excess")).collect()
    top = [r["word"] for k, r in enumerate(ranked_words) if k < LEAST or r["excess"] >= EXCESS]
    kernel = Kernel(sorted(top))
    shared = spark.sparkContext.broadcast(kernel)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = texts([t.as_py() for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    found = sample.mapInArrow(vectors, "label int, x binary").toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in found["x"]]).reshape(len(found), len(top)).astype(float)
    y = found["label"].to_numpy().astype(int) if len(found) else np.zeros(0, int)
    order = np.lexsort([*x.T[::-1], y]) if len(x) else np.zeros(0, int)
    return kernel, Machine(kernel, x[order], y[order], share)


def score(docs: DataFrame, model: tuple[Kernel, Machine]) -> DataFrame:
    """All columns of docs and `score`; the vector of a text is formed from all its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, machine = shared.value
        texts = Texts(kernel)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                s = machine.score(texts([t.as_py() for t in part.column(1)]).astype(float))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    return boxed.mapInArrow(run, T.StructType([T.StructField("row", boxed.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; learned from the labels as in op4_toxicity."""
    return score(docs, train(docs, labels)).filter(F.col("score") < threshold).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op4_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every whole text for toxicity; labels of fold 2 of 4 are never learned from.

    Null, empty and blank texts match no landmark and get the score of such a text. A document with several labels
    counts once with the larger one, null labels are ignored; without labels of both classes every score is the
    smoothed share of toxic labels. Repeated rows are scored one by one. Only doc_id and text are read.
    """
    model = train(docs, labels)
    rows = score(_texts(docs), model)
    return rows.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
