"""Language-model scores from a subword lattice.

A text is its words, each behind one boundary mark, and an end token. Every word has a lattice of segmentations into the
pieces of an existing vocabulary, single bytes included: a piece with the boundary mark, then pieces without, then a
stop. Scores weight all segmentations, and the forward recursion in log space sums them to the word's marginal
probability. Words met in training have one more arc, the whole word, weighted with its discounted relative frequency;
the mass that the discount frees goes to the lattice of pieces. No arc crosses a boundary mark, so the marginal
probability of a text is the product over its words and its end token, and each distinct word's lattice is computed once.
Inside a text a third kind of arc repeats an earlier word of that text, in proportion to how often it has occurred there.

Piece weights start from the scores stored with the vocabulary and are re-estimated from all distinct training words by
expectation maximisation (expected uses of every piece from forward and backward sums). The probabilities of all
texts add up to one at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import fold, part_hashes, prefixes, staged

#: Boundary mark inside this module: a space, which no word contains.
MARK = b" "
#: Sentencepiece writes the boundary mark as this character.
PIECE_MARK = "▁"
#: Words sent to every task by their count; beyond these, words meet their counts in a join.
KNOWN_WORDS = 150_000
#: Rows of rare words that a task hands on at a time.
RARE_ROWS = 100_000
#: Distinct words that one task counts before it hands them on.
TALLY = 200_000
PASSES = 3
#: Weight of the arcs that repeat an earlier word: REPEAT * k / (k + WARM) after k words.
REPEAT, WARM = 0.25, 20
MISSING = -1e30


def vocabulary(path: str | None = None) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece model with their stored scores; by default the public one of 32,000 pieces.

    Pieces that no lower-cased word can contain are left out; every byte is present.
    """
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    lowest = 0.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i).replace(PIECE_MARK, " ").encode(), model.get_score(i)
        if piece.lower() == piece and MARK not in piece[1:]:
            pieces[piece] = score
            lowest = min(lowest, score)
    for x in range(256):
        pieces.setdefault(bytes([x]), lowest - 1)
    return sorted(pieces.items())


class Lattice:
    """Piece probabilities with vectorised forward and backward sums over batches of words."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        """`logs` has the natural logarithm of each piece's weight and, last, that of the stop; the weights of pieces with
        the boundary mark are scaled to one, and those of all others together with the stop."""
        self.pieces = pieces
        first = np.array([*(p[:1] == MARK for p in pieces), False])
        logs = np.asarray(logs, float).copy()
        for group in (first, ~first):
            logs[group] -= np.logaddexp.reduce(logs[group])
        self.logs, self.stop = logs[:-1], float(logs[-1])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for length, places in by.items():
            hashes = np.array([_hash(pieces[i]) for i in places], np.uint64)
            order = np.argsort(hashes)
            self.tables[length] = hashes[order], np.array(places)[order]
        self.longest = max(by)

    @classmethod
    def initial(cls, vocabulary: list[tuple[bytes, float]]) -> "Lattice":
        """Probabilities from stored scores. Scores of a merge-rank vocabulary are minus the rank, read as Zipf's law;
        true log probabilities (none below -100) are taken as they are."""
        scores = np.array([s for _, s in vocabulary])
        logs = scores if scores.min() > -100 else -np.log(-scores + 10)
        return cls([p for p, _ in vocabulary], np.append(logs, logs.max()))

    def _ids(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the piece that starts at each place of each word, or -1."""
        n, size = codes.shape
        flat = prefixes(codes.ravel())
        out = {}
        for length, (hashes, places) in self.tables.items():
            if length > size:
                continue
            starts = (np.arange(n)[:, None] * size + np.arange(size - length + 1)[None, :]).ravel()
            h = part_hashes(flat, starts, starts + length)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            out[length] = np.where(hashes[at] == h, places[at], -1).reshape(n, -1)
        return out

    def _forward(self, ids: dict[int, np.ndarray], n: int, size: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        logs = {k: np.where(v >= 0, self.logs[v], MISSING) for k, v in ids.items()}
        a = np.full((n, size + 1), MISSING)
        a[:, 0] = 0
        for j in range(1, size + 1):
            terms = np.stack([a[:, j - k] + logs[k][:, j - k] for k in logs if k <= j])
            top = terms.max(axis=0)
            a[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return a, logs

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, byte codes) of equally long words, the boundary mark in front."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, places in by.items():
            step = max(1, 200_000 // (length + 1))
            for at in range(0, len(places), step):
                part = places[at:at + step]
                codes = np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8).reshape(len(part), length + 1)
                yield np.array(part), codes

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the marginal probability of each word behind a boundary mark."""
        out = np.zeros(len(words))
        for places, codes in self.batches(words):
            out[places] = self._forward(self._ids(codes), *codes.shape)[0][:, -1] + self.stop
        return out

    def uses(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of every piece, summed over the given words."""
        out = np.zeros(len(self.pieces))
        for places, codes in self.batches(words):
            n, size = codes.shape
            ids = self._ids(codes)
            a, logs = self._forward(ids, n, size)
            b = np.full((n, size + 1), MISSING)
            b[:, size] = 0
            for i in range(size - 1, -1, -1):
                terms = np.stack([logs[k][:, i] + b[:, i + k] for k in logs if i + k <= size])
                top = terms.max(axis=0)
                b[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
            for k, piece in ids.items():
                expected = np.exp(a[:, :size - k + 1] + logs[k] + b[:, k:] - a[:, size][:, None])
                known = piece >= 0
                out += np.bincount(piece[known], weights=expected[known], minlength=len(out))
        return out


def _hash(piece: bytes) -> np.uint64:
    sums = prefixes(np.frombuffer(piece, np.uint8))
    return part_hashes(sums, np.zeros(1, np.int64), np.array([len(piece)]))[0]


def split_words(text: str | None) -> list[bytes]:
    """Words of a whole text in UTF-8, A-Z lowered; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_table(docs: DataFrame) -> DataFrame:
    """Every distinct word of all texts with its count in training documents (`c`, 0 if it is only in held-out ones).

    Tasks count up to TALLY distinct words at a time, so rows shrink before the shuffle and memory stays bounded.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "c"])
            tally.clear()
            return batch

        for batch in batches:
            for train, text in zip(batch.column(0), batch.column(1)):
                found = Counter(split_words(text.as_py()))
                if train.as_py():
                    for w, n in found.items():
                        tally[w] = tally.get(w, 0) + n
                else:
                    for w in found:
                        tally.setdefault(w, 0)
                if len(tally) > TALLY:
                    yield out()
        yield out()

    return docs.select("train", "text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def reestimate(lattice: Lattice, table: DataFrame, smoothing: float = 0.1) -> Lattice:
    """One pass of expectation maximisation over all distinct training words.

    Tasks add up expected uses, one row for each piece; the driver gets one number for each piece.
    """
    shared = table.sparkSession.sparkContext.broadcast(lattice)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(len(shared.value.pieces) + 1), 0
        for batch in batches:
            total[:-1] += shared.value.uses(batch.column(0).to_pylist())
            words += batch.num_rows
        total[-1] = words
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "uses"])

    found = table.filter("c > 0").select("word").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(
        F.sum("uses").alias("uses")).collect()
    uses = smoothing * np.exp(np.append(lattice.logs, lattice.stop)) + 1e-9
    for piece, n in found:
        uses[piece] += n
    return Lattice(lattice.pieces, np.log(uses))


def train(table: DataFrame, pieces: list[tuple[bytes, float]] | None = None, passes: int = PASSES) -> Lattice:
    """Piece weights from the stored scores and `passes` passes over all training words."""
    lattice = Lattice.initial(pieces or vocabulary())
    for _ in range(passes):
        lattice = reestimate(lattice, table)
    return lattice


def discount(once: int, twice: int) -> float:
    """What a whole-word arc gives up, from the numbers of words met once and twice; between 0.1 and 0.9."""
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)


def repeats(n: int) -> tuple[list[float], list[float], list[float]]:
    """For places 0 to n in a text: the weight kept for the other arcs, the weight of one earlier occurrence, and the
    decimal logarithm of the former."""
    k = np.arange(n + 1)
    weight = REPEAT * k / (k + WARM)
    return (1 - weight).tolist(), (weight / np.maximum(k, 1)).tolist(), np.log10(1 - weight).tolist()


def op3_lm_score(docs: DataFrame, pieces: list[tuple[bytes, float]] | None = None, known_words: int = KNOWN_WORDS, passes: int = PASSES) -> DataFrame:
    """One row per document with its token counts, base score and lattice score.

    Null, empty and blank texts consist of the end token alone. Repeated rows are scored one by one. Without training
    documents N and every count are 0, the base is -log10(V + 1) a token, pieces keep the vocabulary's own scores, and the
    model gives half of its mass to the end token.

    The most frequent words (at most `known_words`, all with the same or a higher count) go to every task together with
    their scores; the others meet theirs in a join of (document, word) rows, so the vocabulary may grow without bound.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "train", fold(F.col("doc_id"), 10) != 0)
    table = staged(word_table(rows), "lm-words")
    n_texts = rows.filter("train").count()
    words, total, once, twice = table.filter("c > 0").agg(
        F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n, v = total + n_texts, words + (n_texts > 0)
    lattice = train(table, pieces, passes if n else 0)
    shared = spark.sparkContext.broadcast(lattice)
    d = discount(once, twice)
    free = float(np.log(d * v / n)) if n else float(np.log(0.5))
    model_end = float(np.log10((n_texts - d) / n)) if n else float(np.log10(0.5))
    norm = float(np.log10(n + 0.1 * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces_log = shared.value.word_logs(batch.column(0).to_pylist()) + free
            arc = np.maximum(batch.column(1).to_numpy() - d, 0) / max(n, 1)
            arc_log = np.log(arc, out=np.full(len(arc), MISSING), where=arc > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.logaddexp(pieces_log, arc_log) / np.log(10))], names=["word", "c", "log"])

    scored = staged(table.mapInArrow(score, "word binary, c long, log double"), "lm-scores")
    # the lowest count for which the words of that or a higher count fit into the bound
    sizes = scored.groupBy(F.floor(F.log2(F.greatest("c", F.lit(1))) * 8).alias("class")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    least, room = None, known_words
    for size in sorted(sizes.collect(), key=lambda r: -r["class"]):
        if size["n"] > room:
            break
        room, least = room - size["n"], size["least"]
    frequent = {} if least is None else {r[0]: (r[1], r[2]) for r in scored.filter(F.col("c") >= least).toLocalIterator()}
    top = spark.sparkContext.broadcast({bytes(w): (float(np.log10(c + 0.1)) - norm, log, c > 0, 10 ** log) for w, (c, log) in frequent.items()})
    end = (float(np.log10((n_texts if n else 0) + 0.1)) - norm, model_end)

    names = ["doc_id", "h", "train", "word", "times", "keep", "add", "n_tokens", "n_known", "base", "log"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        keep, add, lost = repeats(1000)
        kinds = dict(zip(names[2:], (pa.bool_(), pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64(),
                                     pa.float64(), pa.float64())))

        def rows_of(whole: pa.RecordBatch, found: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([whole.column(0), whole.column(3), *(
                pa.array(found[c], t) if c in found else pa.nulls(whole.num_rows, t) for c, t in kinds.items())], names=names)

        for batch in batches:
            docs = {c: [] for c in ("n_tokens", "n_known", "base", "log")}
            owner, rare = [], {c: [] for c in ("word", "times", "keep", "add")}
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = split_words(text)
                tokens = len(words) + 1
                if tokens > len(keep):
                    keep, add, lost = repeats(2 * tokens)
                first: dict[bytes, int] = {}
                later: dict[bytes, list[int]] = {}
                for k, w in enumerate(words):
                    if first.setdefault(w, k) != k:
                        later.setdefault(w, []).append(k)
                base, seen = end[0], int(n_texts > 0)
                log = end[1] + lost[tokens - 1] + sum(map(lost.__getitem__, first.values()))
                unknown = 0
                for w in first:
                    if w in known:
                        b, own, some, _ = known[w]
                        base, log, seen = base + b, log + own, seen + some
                    else:
                        again = later.get(w)
                        rare["word"].append(w)
                        rare["times"].append(1 + len(again) if again else 1)
                        rare["keep"].append([keep[k] for k in again] if again else None)
                        rare["add"].append([j * add[k] for j, k in enumerate(again, 1)] if again else None)
                        unknown += 1
                owner.extend([at] * unknown)
                for w, again in later.items():
                    if w in known:
                        b, _, some, p = known[w]
                        base, seen = base + len(again) * b, seen + len(again) * some
                        for j, k in enumerate(again, 1):
                            log += log10(keep[k] * p + j * add[k])
                for column, value in zip(docs.values(), (tokens, seen, base, log)):
                    column.append(value)
            yield rows_of(batch, docs | {"train": batch.column(2)})
            # one row for each rare word of a text
            for i in range(0, len(owner), RARE_ROWS):
                part = slice(i, i + RARE_ROWS)
                yield rows_of(batch.select([0, 2, 2, 3]).take(pa.array(owner[part], pa.int64())), {c: v[part] for c, v in rare.items()})

    walked = staged(rows.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "train", "h").mapInArrow(
        walk, f"doc_id {kind}, h long, train boolean, word binary, times long, keep array<double>, add array<double>, n_tokens long, n_known long, base double, log double"), "lm-walk")
    p = F.pow(F.lit(10.0), "log")
    again = F.aggregate(F.zip_with("keep", "add", lambda k, a: F.log10(k * p + a)), F.lit(0.0), lambda x, y: x + y)
    rare = walked.filter("word is not null").select("doc_id", "h", "word", "times", "keep", "add").join(scored, "word").groupBy("doc_id", "h").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - norm)).alias("more_base"), F.sum(F.col("log") + F.coalesce(again, F.lit(0.0))).alias("more_log"))
    # repeated rows (same identifier and text) share one group: their rare words were added up as often as they occur
    whole = walked.filter("word is null").groupBy("doc_id", "h").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("train", "n_tokens", "n_known", "base", "log")))
    more = rare.withColumnRenamed("doc_id", "id2").withColumnRenamed("h", "h2")
    joined = whole.join(more, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("more_known") / F.col("copies"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more_base") / F.col("copies"), F.lit(0.0))).alias("base_score"),
        (F.col("log") + F.coalesce(F.col("more_log") / F.col("copies"), F.lit(0.0))).alias("score"))
