"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of, written

#: Trusted positives the model is fitted on at most, in the order of a hash of their ids. The unlabelled are all documents.
POSITIVE_ROWS = 15_000
#: Intervals of a feature, of equal numbers of unlabelled documents where values do not tie.
BINS = 16
#: Low bits of a 32-bit float that values are told without: they are told to one part in 1024.
DROPPED_BITS = 13
#: Weight of the squared weights: of 0.003 to 0.1 the best when each half of the learning labels judged the other's model.
DECAY = 0.06
#: The step that ends a fit, the longest step, and the passes after which a fit gives up with a warning.
STILL, LONGEST, PASSES = 1e-3, 2.0, 60

_CLASS = np.zeros(256, dtype=np.int64)  # 0: other ASCII punctuation
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "|*#$%&<>{}[]=_~^\\/@+"]] = 8
_CLASS[:9] = _CLASS[14:32] = 9
CLASSES = 10
FEATURES = CLASSES + 15


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text: shares of byte classes, and of words and lines that are odd or repeated."""
    out = np.zeros(FEATURES)
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    if not words:
        return out
    n = len(words)
    out[:CLASSES] = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    ends = np.frombuffer(bytes(map(_last, words)), np.uint8)
    odd = _CLASS[ends]
    more = [
        np.log1p(n), lengths.mean(), lengths.std(), len(distinct) / n, len(distinct) / n**0.8,
        sum(map(eq, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
        (odd == 8).mean(), (odd == 7).mean(), (odd == 6).mean(),
        (lengths <= 1).mean(), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
    ]
    out[CLASSES:] = more
    return out


def _last(word: bytes) -> int:
    return word[-1]


def codes(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, equal for values that agree in their leading bits."""
    bits = np.asarray(x, dtype=np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> np.uint32(DROPPED_BITS)


_OFFSET = np.arange(FEATURES) * BINS
_SIZE = FEATURES * BINS
_PAIRS = [(i, j) for i in range(FEATURES) for j in range(i + 1, FEATURES)]


def _values(cells: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return theta[_SIZE] + theta[cells + _OFFSET].sum(1)


def moments(cells: np.ndarray, n: np.ndarray, theta: np.ndarray, sign: int = 1) -> np.ndarray:
    """Of softplus(sign * value) over rows that count n times: its sum, its slopes by cell, its curvature by pairs of cells.

    theta: a weight for each cell, and the bias. The sums add up over parts of the rows.
    """
    cells = cells[n > 0].astype(np.int64)
    n = n[n > 0].astype(float)
    z = sign * _values(cells, theta)
    p = _sigmoid(z)
    first, second = sign * n * p, n * p * (1 - p)
    out = [[n.sum(), (n * np.logaddexp(0, z)).sum(), first.sum(), second.sum()]]
    for x in (first, second):
        out += [np.bincount(c, x, BINS) for c in cells.T]
    out += [np.bincount(cells[:, i] * BINS + cells[:, j], second, BINS * BINS) for i, j in _PAIRS]
    return np.concatenate(out)


def _unpacked(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean, gradient and Hessian from the sums of `moments`."""
    slopes, curves, pairs = flat[4 : 4 + _SIZE], flat[4 + _SIZE : 4 + 2 * _SIZE], flat[4 + 2 * _SIZE :]
    hess = np.zeros((_SIZE + 1, _SIZE + 1))
    for (i, j), x in zip(_PAIRS, pairs.reshape(-1, BINS, BINS), strict=True):
        hess[i * BINS : (i + 1) * BINS, j * BINS : (j + 1) * BINS] = x
    hess[:_SIZE, _SIZE] = curves
    hess += hess.T
    hess[np.arange(_SIZE), np.arange(_SIZE)] = curves
    hess[_SIZE, _SIZE] = flat[3]
    total = max(flat[0], 1.0)
    return flat[1] / total, np.append(slopes, flat[2]) / total, hess / total


def ranked(cells: np.ndarray, n: np.ndarray, theta: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the rows, each counted n times, reach 0, 1, 2, ... of the ascending thresholds and no more."""
    return np.bincount(np.searchsorted(at, _values(cells, theta), side="right"), n, len(at) + 1)


#: Sums over the unlabelled: a function of rows (cells, counts) is applied to parts and added up. `side` is one of the
#: halves 0 and 1 of the rows, or None for all.
Sums = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], "int | None"], np.ndarray]


class PUModel:
    """Additive model on binned features, fitted by the non-negative unbiased risk of positive-unlabelled data."""

    def __init__(self) -> None:
        self.prior = 0.5
        self.cuts = np.zeros((FEATURES, BINS - 1), dtype=np.int64)
        self.theta = np.zeros(_SIZE + 1)

    def cells(self, coded: np.ndarray) -> np.ndarray:
        """For each row of codes the numbers of its features' intervals."""
        return np.stack([np.searchsorted(self.cuts[k], coded[:, k], side="left") for k in range(FEATURES)], axis=1).astype(np.uint8)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> None:
        """Fit to feature rows in memory."""
        coded = codes(unlabelled)
        at = -(-np.arange(1, BINS) * len(coded) // BINS) - 1
        self.cuts = np.sort(coded, axis=0)[at].T.astype(np.int64)
        cells = self.cells(coded)
        half = np.arange(len(cells)) % 2
        self.fit_cells(self.cells(codes(positive)), lambda f, side: f(cells, np.ones(len(cells)) if side is None else half == side), prior)

    def fit_cells(self, p: np.ndarray, sums: Sums, prior: float | None = None) -> None:
        """Fit to the cells of positives and to sums over the unlabelled."""
        self.prior = self.estimate_prior(p, sums) if prior is None else prior
        ones = np.ones(len(p))

        def risk(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, bool]:
            # prior * R_p(+) + R_u(-) - prior * R_p(-); for the logistic loss the terms of positives make -prior * value
            value, grad, hess = _unpacked(sums(lambda c, n: moments(c, n, theta), None))
            z = _values(p, theta)
            negative = value - self.prior * np.logaddexp(0, z).mean()
            share = np.bincount((p + _OFFSET).ravel(), minlength=_SIZE) / len(p)
            return value - self.prior * z.mean(), grad - self.prior * np.append(share, 1), hess, negative >= 0

        start = np.zeros(_SIZE + 1)
        start[_SIZE] = np.log(self.prior / (1 - self.prior))
        self.theta = _minimised(risk, start)

    def estimate_prior(self, p: np.ndarray, sums: Sums) -> float:
        """The share of positives among the unlabelled.

        A classifier of positives against unlabelled ranks both. Where no negatives are left at the top, the
        unlabelled are as dense as the positives times the prior; below, denser. So the least ratio of the two
        masses above a threshold bounds the prior from above; thresholds keep three tenths of the positives at least.
        Each half of the data is ranked by the classifier of the other one.
        """
        ratios = []
        for side in (0, 1):
            mine, other = p[side::2], p[1 - side :: 2]

            def contrast(theta: np.ndarray, mine=mine, side=side) -> tuple[float, np.ndarray, np.ndarray, bool]:
                parts = (moments(mine, np.ones(len(mine)), theta, -1), sums(lambda c, n: moments(c, n, theta), side))
                value, grad, hess = (a + b for a, b in zip(*map(_unpacked, parts), strict=True))
                return value, grad, hess, True

            theta = _minimised(contrast, np.zeros(_SIZE + 1))
            top = np.sort(_values(other, theta))
            at = np.quantile(top, np.linspace(0.02, 0.8, 79))
            above_p = 1 - np.searchsorted(top, at) / len(top)
            reached = sums(lambda c, n, theta=theta, at=at: ranked(c, n, theta, at), 1 - side)
            above_u = reached[::-1].cumsum()[::-1][1:] / max(reached.sum(), 1)
            ratios.append((above_u / above_p)[above_p >= 0.3].min())
        return float(np.clip(np.mean(ratios), 0.02, 0.98))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scores_of_codes(codes(x))

    def scores_of_codes(self, coded: np.ndarray) -> np.ndarray:
        return _sigmoid(_values(self.cells(coded), self.theta))


def _minimised(terms: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray, bool]], theta: np.ndarray) -> np.ndarray:
    """Newton steps on a convex function plus DECAY / 2 times the squared weights.

    `terms` gives value, gradient, Hessian and whether a point is allowed. A step to a higher value, or to a point
    that is not allowed (where the risk of the negatives is below zero), is halved.
    """
    ridge = np.append(np.full(_SIZE, DECAY), 1e-9)
    last, best, step = theta, np.inf, np.zeros_like(theta)
    for _ in range(PASSES):
        value, grad, hess, allowed = terms(theta)
        value += (ridge * theta * theta).sum() / 2
        if best < np.inf and (value > best + 1e-12 or not allowed):
            step = step / 2
        else:
            last, best = theta, value
            step = -np.linalg.solve(hess + np.diag(ridge), grad + ridge * theta)
            step *= min(1.0, LONGEST / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < STILL:
            return last
        theta = last + step
    warnings.warn(f"the fit has not settled after {PASSES} passes: last step {np.abs(step).max():.3g}", stacklevel=2)
    return last


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def coded_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, codes): the codes of the features of each whole text, four bytes each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codes(np.array([features(t) for t in texts_of(batch, "text")]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "codes": pa.array([x.tobytes() for x in found], pa.binary())})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, codes binary")


def _cuts(coded: DataFrame) -> np.ndarray:
    """The codes that divide all rows into BINS parts, by feature, from counts of each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _rows(batch.column(0), np.uint32, FEATURES).astype(np.int64) + (np.arange(FEATURES) << 32)
            key, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(key >> 32), "code": pa.array(key & 0xFFFFFFFF), "n": pa.array(n)})

    counts = coded.select("codes").mapInArrow(run, "feature long, code long, n long").groupBy("feature", "code").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("feature")  # at most 2 ** (32 - DROPPED_BITS) rows
    upto = whole.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("feature", "code", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
    parts = counts.selectExpr("feature", "code", f"((upto - n) * {BINS}) div all AS low", f"(upto * {BINS}) div all AS high").where("high > low")
    cuts = np.zeros((FEATURES, BINS - 1), dtype=np.int64)
    for r in parts.collect():  # at most FEATURES * BINS rows
        cuts[r["feature"], r["low"] : min(r["high"], BINS - 1)] = r["code"]
    return cuts


def _cell_table(coded: DataFrame, model: PUModel) -> DataFrame:
    """Rows (cells, n, m): each distinct row of cells, how many documents have it, and how many of them are in half 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.cells(_rows(batch.column(0), np.uint32, FEATURES))
            yield pa.RecordBatch.from_pydict({"cells": pa.array([x.tobytes() for x in found], pa.binary())})

    counted = coded.select("codes").mapInArrow(run, "cells binary").groupBy("cells").agg(F.count("*").alias("n"))
    return counted.selectExpr("cells", "n", "(n + (xxhash64(cells) & 1)) div 2 AS m")


def _sums(table: DataFrame) -> Sums:
    """Sums over a table of cells: each task adds up its rows, and equal places of tasks are added up after an exchange."""

    def sums(f: Callable[[np.ndarray, np.ndarray], np.ndarray], side: int | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                n, m = (batch.column(k).to_numpy() for k in (1, 2))
                part = f(_rows(batch.column(0), np.uint8, FEATURES), n if side is None else m if side == 0 else n - m)
                total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total)
                last = len(total) - 1
                at = at if len(at) and at[-1] == last else np.append(at, last)
                yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "x": pa.array(total[at], pa.float64())})

        found = table.mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
        place = found.column("place").to_numpy()
        out = np.zeros(place.max() + 1)
        out[place] = found.column("x").to_numpy()
        return out

    return sums


def fitted_on(coded: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None, positive_rows: int = POSITIVE_ROWS, prior: float | None = None, unlabelled: DataFrame | None = None) -> PUModel:
    """The model of a written table of `coded_texts`; the unlabelled are all its rows if no other table is given."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")).where("id is not null and y = 1")
    if learn is not None:
        known = known.where(learn)
    known = known.select("id").distinct().orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(13)), "id").limit(positive_rows)
    trusted = coded.join(F.broadcast(known), "id").groupBy("id").agg(F.min("codes").alias("codes"))  # a repeated id counts once
    positive = _rows(trusted.select("codes").toArrow().column(0), np.uint32, FEATURES)
    model = PUModel()
    if len(positive) > 1:
        unlabelled = coded if unlabelled is None else unlabelled
        model.cuts = _cuts(unlabelled)
        table = written(_cell_table(unlabelled, model), "quality-cells")
        model.fit_cells(model.cells(positive), _sums(table), prior)
    return model


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int | None = None, prior: float | None = None) -> PUModel:
    """Learn from documents labelled 1 that `learn` admits, and from all documents whatever their labels.

    Label 0 is never used. Without two positives every text gets the score one half. A repeated id is one positive;
    among the unlabelled each row counts. Intervals, prior and risk come from sums over all rows; only a caller that
    asks for `unlabelled_rows` has them from that many documents, in the order of a hash of their ids.
    """
    unlabelled = coded = written(coded_texts(docs), "quality-codes")
    if unlabelled_rows is not None:
        order = F.xxhash64(F.col("id").cast("string"), F.lit(14))
        some = coded.select("id").where("id is not null").distinct().orderBy(order, "id").limit(unlabelled_rows)
        unlabelled = coded.join(F.broadcast(some), "id", "left_semi")
    return fitted_on(coded, labels, label_col, learn, positive_rows, prior, unlabelled)


def coded_scores(coded: DataFrame, model: PUModel) -> DataFrame:
    """Rows (id, score) of a table of `coded_texts`."""
    shared = coded.sparkSession.sparkContext.broadcast(model)  # FEATURES * BINS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": shared.value.scores_of_codes(_rows(batch.column(1), np.uint32, FEATURES))})

    return coded.mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, model: PUModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), score from 0 to 1. A null or empty text has the features of an empty one. Repeated rows stay."""
    return coded_scores(coded_texts(docs, id_col, text_col), model)
