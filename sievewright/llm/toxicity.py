"""Toxicity by multiple-instance learning: sentences are instances, documents are bags joined by noisy-or."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, word_key

#: Labelled documents the model is fitted on at most, in the order of a hash of their ids.
FIT_ROWS = 12_000
#: Words whose weights a worker keeps; it changes no result.
KEPT_WORDS = 100_000
#: Features that a task counts before it sends the sums on.
HELD_FEATURES = 100_000
#: Features with a weight: those whose presence tells the labels apart best.
WORDS = 3000
#: Documents that a feature must occur in to be one of them.
LEAST_DOCS = 4
#: Probability from which a sentence is located as offending.
OFFENDING = 0.5

_END = b".!?\n"
_FOLD = bytes(10 if b in _END else b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Words (letters, digits and what is not ASCII, A-Z lower-cased) of each run without . ! ? and line ends."""
    return [s.split() for s in text.encode("utf-8", "replace").translate(_FOLD).split(b"\n")] if text else []


def features(word: bytes) -> list[bytes]:
    """The word as a whole, and its beginnings of 4 to 8 characters, which inflected forms share."""
    chars = word.decode("utf-8", "replace")
    return [b"=" + word_key(word), *(b"^" + chars[:n].encode() for n in range(4, min(8, len(chars)) + 1))]


def _sampled(docs: DataFrame, labels: DataFrame, label_col: str, fit_rows: int, learn: Column | None) -> DataFrame:
    """(text, y) of labelled documents: those that `learn` admits, fit_rows at most."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(11)), "id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")  # a repeated id counts once


def _word_table(sample: DataFrame, words: int, least_docs: int) -> list[bytes]:
    """The features that separate the labels best by the z-score of their document frequencies."""

    def sums(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n0": pa.array([x[0] for x in seen.values()], pa.int64()), "n1": pa.array([x[1] for x in seen.values()], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, y in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in {w for s in sentences(text) for w in s} for f in features(w)}:
                    seen.setdefault(f, [0, 0])[int(y)] += 1
                if len(seen) > HELD_FEATURES:
                    yield sums(seen)
                    seen = {}
        yield sums(seen)

    counts = sample.mapInArrow(count, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = sample.agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b")).first()
    a, b = float(total["a"] or 0), float(total["b"] or 0)
    if not a or not b:
        return []
    p = (F.col("n0") + F.col("n1")) / (a + b)
    z = F.abs(F.col("n1") / b - F.col("n0") / a) / F.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
    best = counts.where(F.col("n0") + F.col("n1") >= least_docs).withColumn("z", z).orderBy(F.desc("z"), "word").limit(words)
    return [bytes(r["word"]) for r in best.select("word").collect()]


class NoisyOr:
    """Word weights and a bias for sentences; a document is toxic if at least one sentence is."""

    def __init__(self, words: list[bytes], prior: float = 0.0) -> None:
        self.words = words
        self.weight = np.zeros(len(words))
        self.bias = -6.0
        #: chance that a document is labelled without an offending sentence
        self.leak = prior
        self._index()

    def fit(self, bags: list[list[np.ndarray]], empty: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.1, decay: float = 4e-4) -> None:
        """bags: of each document the sentences that hold known words, as word numbers; empty: how many do not.

        Maximises the likelihood of the document labels under noisy-or by Adam on all documents at once.
        """
        doc = np.array([d for d, bag in enumerate(bags) for _ in bag], dtype=np.int64)
        parts = [s for bag in bags for s in bag]
        sent = np.repeat(np.arange(len(parts)), [len(s) for s in parts]) if parts else np.zeros(0, np.int64)
        word = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        theta = np.concatenate([self.weight, [self.bias, -3.0]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        n, k = len(y), len(self.words)
        for t in range(1, steps + 1):
            z = theta[k] + np.bincount(sent, theta[word], len(parts))
            p, p0, leak = _sigmoid(z), _sigmoid(theta[k]), _sigmoid(theta[k + 1])
            clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + empty * np.log1p(-p0) + np.log1p(-leak)
            # d(loss)/d(log clean): a clean document gains from it, a toxic one loses
            pull = np.where(y == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0)
            by_sentence = -pull[doc] * p
            grad = np.zeros_like(theta)
            grad[:k] = np.bincount(word, by_sentence[sent], k) / n + decay * theta[:k] / 10
            grad[k] = (by_sentence.sum() - (pull * empty).sum() * p0) / n
            grad[k + 1] = -(pull.sum() * leak) / n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weight, self.bias, self.leak = theta[:k], float(theta[k]), float(_sigmoid(theta[k + 1]))
        self._index()

    def _index(self) -> None:
        self.index = {w: float(x) for w, x in zip(self.words, self.weight, strict=True) if abs(x) > 1e-3}
        self.memo: dict[bytes, float] = {}

    def word_weight(self, word: bytes) -> float:
        """The sum of the weights of a word's features, kept for the next time."""
        if len(self.memo) > KEPT_WORDS:
            self.memo.clear()
        x = self.memo[word] = sum(self.index.get(f, 0.0) for f in features(word))
        return x

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The document's probability, and the sentences (by number) with theirs that hold a weighted word."""
        known, weight = self.memo.get, self.word_weight
        marked, empty = [], 0
        for k, s in enumerate(sentences(text)):
            x = sum([weight(w) if v is None else v for w, v in zip(s, map(known, s), strict=True)])
            if x:
                marked.append((k, float(_sigmoid(self.bias + x))))
            else:
                empty += 1
        clean = np.log1p(-self.leak) + empty * np.log1p(-_sigmoid(self.bias))
        for _, p in marked:
            clean += np.log1p(-min(p, 1 - 1e-12))
        return float(-np.expm1(clean)), marked


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, learn: Column | None = None) -> NoisyOr:
    """Learn from document labels alone. Without labels of both kinds every text gets the same score."""
    sample = _sampled(docs, labels, label_col, fit_rows, learn).persist()
    try:
        words = _word_table(sample, WORDS, LEAST_DOCS)
        number = {w: k for k, w in enumerate(words)}

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bags, empty = [], []
                for text in texts_of(batch):
                    known = [[number[f] for w in s for f in features(w) if f in number] for s in sentences(text)]
                    bags.append([s for s in known if s])
                    empty.append(len(known) - len(bags[-1]))
                yield pa.RecordBatch.from_pydict({"bag": pa.array(bags, pa.list_(pa.list_(pa.int32()))), "empty": pa.array(empty, pa.int64()), "y": batch.column(1)})

        rows = sample.mapInArrow(coded, "bag array<array<int>>, empty long, y double").toArrow()
    finally:
        sample.unpersist()
    model = NoisyOr(words)
    if rows.num_rows and words:
        bags = [[np.array(s, dtype=np.int64) for s in bag] for bag in rows.column("bag").to_pylist()]
        model.fit(bags, rows.column("empty").to_numpy().astype(float), rows.column("y").to_numpy())
    return model


def scores(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", offending: float = OFFENDING) -> DataFrame:
    """Rows (id, score, sentences): score from 0 to 1; sentences of probability `offending` or more, located.

    Places are code points, end exclusive. A null or empty text has no sentences and the score of the leak alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            values, places = [], []
            for text in texts_of(batch, "text"):
                value, marked = score(text)
                values.append(value)
                bad = {k: p for k, p in marked if p >= offending}
                places.append(located(text, bad) if bad else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(places, spans)], ["id", "score", "sentences"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")


def located(text: str, wanted: dict[int, float]) -> list[dict]:
    """Start and end of the sentences with these numbers."""
    found, at = [], 0
    for k, part in enumerate(re.split(r"[.!?\n]", text)):
        if k in wanted:
            lead = len(part) - len(part.lstrip())
            found.append({"start": at + lead, "end": at + len(part), "score": wanted[k]})
        at += len(part) + 1
    return found


def not_toxic(docs: DataFrame, model: NoisyOr, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents, of the same columns, whose score stays below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(x)[0] < limit for x in texts_of(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
