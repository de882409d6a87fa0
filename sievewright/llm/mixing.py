"""Mixing to target weights: a classifier's soft memberships, and document rates by Newton steps or projected gradients."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, texts_of, word_keys, written

#: Labelled documents the classifier is fitted on at most, in the order of a hash of their ids.
FIT_ROWS = 10_000
#: Words it knows, the most frequent of those documents.
WORDS = 20_000
#: Words that a task counts before it sends the sums on.
HELD_WORDS = 200_000
#: Projected gradient steps at most, and the relative residual at which they end.
STEPS, RESIDUAL = 60, 1e-4
#: Newton passes at most, lengths of a step tried in one, and weight of the rates' distance from 1 beside the targets.
PASSES, LENGTHS, RIDGE = 200, 0.5 ** np.arange(12), 1e-9


class DomainModel:
    """Multinomial naive Bayes over words, with posteriors tempered so that they are calibrated."""

    def __init__(self, domains: list[str], words: list[bytes], counts: np.ndarray, docs: np.ndarray) -> None:
        """counts: by word and domain; docs: labelled documents by domain."""
        self.domains = domains
        self.index = {w: k for k, w in enumerate(words)}
        d = max(1, len(domains))
        share = (counts + 0.5).reshape(-1, d) / (counts + 0.5).reshape(-1, d).sum(0, keepdims=True) if len(words) else np.zeros((0, d))
        #: log-likelihoods by word; the last row is that of unknown words
        self.log_word = np.vstack([np.log(share), np.zeros((1, d))])
        self.log_prior = np.log((docs + 1) / (docs + 1).sum()) if len(domains) else np.zeros(1)
        self.power = 1.0

    def evidence(self, text: str | None) -> tuple[int, np.ndarray]:
        """The words of the text, and the mean log-likelihood by domain of those that are known."""
        words = word_keys(blank_words(text))
        ids = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        known = ids[ids >= 0]
        return len(words), self.log_word[known].sum(0) / max(1, len(known)) * np.sqrt(len(known))

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        """Memberships that sum to 1; evidence grows with the root of the known words, times the fitted power."""
        z = self.log_prior + self.power * evidence
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def calibrate(self, evidence: np.ndarray, label: np.ndarray) -> None:
        """Choose the power with the greatest likelihood of labelled documents that the counts did not see."""
        best = -np.inf
        for power in np.geomspace(0.05, 20, 60):
            self.power = float(power)
            fit = float(np.log(self.posterior(evidence)[np.arange(len(label)), label] + 1e-12).sum())
            if fit > best:
                best, chosen = fit, self.power
        if len(label):
            self.power = chosen


def fitted(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, words: int = WORDS) -> DomainModel:
    """labelled: rows (id, domain). Half of the documents, by a hash, gives the counts, half calibrates.

    Rows with nulls are left out; of an id with several domains the first in the alphabet counts. Without
    labelled rows there is one domain, named unknown.
    """
    key = F.xxhash64(F.col("id").cast("string"), F.lit(19))
    known = labelled.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    known = known.withColumn("key", key).orderBy("key", "id").limit(fit_rows)
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("domain").alias("domain"), F.first("key").alias("key"))
    sample = sample.select("text", "domain", F.pmod("key", F.lit(2)).alias("side"))  # a repeated id counts once
    sample = written(sample, "domain-sample")
    totals = sorted((r["domain"], r["n"]) for r in sample.where("side = 0").groupBy("domain").agg(F.count("*").alias("n")).collect())
    if not totals:
        return DomainModel(["unknown"], [], np.zeros((0, 1)), np.ones(1))
    domains = [d for d, _ in totals]

    def sums(seen: dict[tuple[bytes, str], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([k[0] for k in seen], pa.binary()), "domain": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, str], int] = {}
        for batch in batches:
            for text, domain in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                for w in word_keys(blank_words(text)):
                    seen[w, domain] = seen.get((w, domain), 0) + 1
                if len(seen) > HELD_WORDS:
                    yield sums(seen)
                    seen = {}
        yield sums(seen)

    counts = sample.where("side = 0").mapInArrow(count, "word binary, domain string, n long")
    by_word = counts.groupBy("word", "domain").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("domain", "n")).alias("by"))
    top = by_word.orderBy(F.desc("n"), "word").limit(words).collect()
    place = {d: k for k, d in enumerate(domains)}
    table = np.zeros((len(top), len(domains)))
    for k, r in enumerate(top):
        for x in r["by"]:
            table[k, place[x["domain"]]] = x["n"]
    model = DomainModel(domains, [bytes(r["word"]) for r in top], table, np.array([n for _, n in totals], dtype=float))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(t)[1].tolist() for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"e": pa.array(found, pa.list_(pa.float64())), "domain": batch.column(1)})

    rest = sample.where((F.col("side") == 1) & F.col("domain").isin(domains)).mapInArrow(weigh, "e array<double>, domain string").toArrow()
    if rest.num_rows:
        model.calibrate(np.array(rest.column("e").to_pylist()), np.array([domains.index(d) for d in rest.column("domain").to_pylist()]))
    return model


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, posterior): words of the whole text, and its memberships in the model's order of domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and the domains
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.evidence(t) for t in texts_of(batch, "text")]
            p = m.posterior(np.array([e for _, e in found]).reshape(-1, len(m.log_prior)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_tokens": pa.array([n for n, _ in found], pa.int64()), "posterior": pa.array(p.tolist(), pa.list_(pa.float64()))})

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, n_tokens long, posterior array<double>")


def _replayed(a: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Rates after the steps so far: from 1, each step goes down a document's slope and is cut at 0."""
    rate = np.ones(len(a))
    for s in slopes:
        rate = np.maximum(0.0, rate - a @ s)
    return rate


def mixed(members: DataFrame, targets: np.ndarray, steps: int = STEPS, residual: float = RESIDUAL) -> tuple[DataFrame, list[float]]:
    """members with rate >= 0 such that expected tokens by domain match the targets in least squares.

    Minimises sum over domains of (sum over documents of rate * n_tokens * posterior - target)^2 / scale by
    projected gradient descent from rates of 1. A step needs of the corpus only the domains' totals under the
    present rates. A document's rate follows from the few numbers of the steps so far, so that no rates are
    stored between steps, and a lost executor's part is simply worked out again. Also returns the relative
    residual before each step. A target without any membership can't be met and keeps its residual.
    """
    d = len(targets)
    spark = members.sparkSession
    total = float(max(targets.sum(), 1.0))
    goal = targets / total

    def a_of(batch: pa.RecordBatch) -> np.ndarray:
        p = np.asarray(batch.column("posterior").flatten(), dtype=float).reshape(-1, d)
        return p * (np.asarray(batch.column("n_tokens"), dtype=float) / total)[:, None]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            a = a_of(batch)
            gram += a.T @ a
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(d * d), pa.int32()), "x": gram.ravel()})

    def gathered(run) -> np.ndarray:
        rows = members.select("n_tokens", "posterior").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(max((r["k"] for r in rows), default=-1) + 1)
        for r in rows:
            out[r["k"]] = r["x"]
        return out

    gram = gathered(moments)
    gram = gram.reshape(d, d) if len(gram) == d * d else np.zeros((d, d))
    scale = np.maximum(np.diag(gram), 1e-30)
    top = np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).max() if gram.any() else 1.0
    slopes: list[np.ndarray] = []
    history: list[float] = []
    for _ in range(steps):
        so_far = np.array(slopes).reshape(-1, d)

        def totals(batches: Iterator[pa.RecordBatch], so_far=so_far) -> Iterator[pa.RecordBatch]:
            now = np.zeros(d)
            for batch in batches:
                a = a_of(batch)
                now += a.T @ _replayed(a, so_far)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "x": now})

        now = gathered(totals)
        gap = (now if len(now) == d else np.zeros(d)) - goal
        history.append(float(np.abs(gap).max() / max(goal.max(), 1e-30)))
        if history[-1] <= residual or not gram.any():
            break
        slopes.append(gap / scale / top)
    final = np.array(slopes).reshape(-1, d)
    kind = members.schema["id"].dataType.simpleString()

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("rate", pa.array(_replayed(a_of(batch), final), pa.float64()))

    chosen = members.select("id", "n_tokens", "posterior")
    return chosen.mapInArrow(rates, f"id {kind}, n_tokens long, posterior array<double>, rate double"), history


def matched(members: DataFrame, targets: np.ndarray, passes: int = PASSES, residual: float = RESIDUAL) -> tuple[DataFrame, list[float]]:
    """members with the rates that solve() finds, and the relative residual after each pass."""
    return solve(members, targets, passes, residual)[:2]


def solve(members: DataFrame, targets: np.ndarray, passes: int = PASSES, residual: float = RESIDUAL) -> tuple[DataFrame, list[float], np.ndarray]:
    """members with the rates >= 0 nearest to 1 whose expected tokens by domain match the targets.

    Such rates are max(0, 1 - a y) with one number y per domain, which minimises a convex function; semismooth Newton
    steps find it. A pass over the corpus sums, for several lengths of a step at once, that function, its slopes and
    its curvature by domain. RIDGE makes targets that can't be met end at their least squares. Also returns the
    relative residual after each pass, the last one being that of the rates, and the slope that a rate follows from.
    """
    d = len(targets)
    total = float(max(targets.sum(), 1.0))
    goal = targets / total
    width = 1 + d + d * d

    def a_of(batch: pa.RecordBatch) -> np.ndarray:
        p = np.asarray(batch.column("posterior").flatten(), dtype=float).reshape(-1, d)
        return p * (np.asarray(batch.column("n_tokens"), dtype=float) / total)[:, None]

    def sums(tried: np.ndarray) -> np.ndarray:
        """By row of `tried`: half the squared rates less one half each, tokens by domain, products where rates are positive."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(tried), width))
            for batch in batches:
                a = a_of(batch)
                for k, y in enumerate(tried):
                    rate = np.maximum(0.0, 1.0 - a @ y)
                    on = a[rate > 0]
                    out[k] += np.concatenate(([0.5 * (rate * rate - 1.0).sum()], rate @ a, (on.T @ on).ravel()))
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(out.size), pa.int32()), "x": out.ravel()})

        rows = members.select("n_tokens", "posterior").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(tried) * width)
        for r in rows:
            out[r["k"]] = r["x"]
        return out.reshape(-1, width)

    y = np.zeros(d)
    now = sums(y[None])[0]
    scale = np.maximum(np.diag(now[1 + d :].reshape(d, d)), 1e-30)
    value = lambda x, y: x[0] + goal @ y + 0.5 * RIDGE * (scale * y * y).sum()
    gap = lambda x: float(np.abs(x[1 : 1 + d] - goal).max() / max(goal.max(), 1e-30))
    history = [gap(now)]
    while history[-1] > residual and len(history) < passes and now[1 + d :].any():
        slope = now[1 : 1 + d] - goal - RIDGE * scale * y
        root = np.sqrt(scale)
        curve = now[1 + d :].reshape(d, d) / np.outer(root, root) + RIDGE * np.eye(d)
        step = np.linalg.lstsq(curve, slope / root, rcond=None)[0] / root
        tried = y + LENGTHS[:, None] * step
        found = sums(tried)
        values = np.array([value(x, t) for x, t in zip(found, tried, strict=True)])
        before = value(now, y)
        # where rounding hides the descent, the residual tells
        fit = np.flatnonzero(values <= before + 1e-12 * (abs(now[0]) + abs(goal @ y) + 1.0))
        if not len(fit):
            break
        best = min(fit, key=lambda k: values[k] if values.min() < before - 1e-9 * abs(before) else gap(found[k]))
        y, now = tried[best], found[best]
        history.append(gap(now))
        if np.abs(now[1 : 1 + d] - goal - RIDGE * scale * y).max() <= 1e-9:  # no better rates
            break
    kind = members.schema["id"].dataType.simpleString()
    slope = y / total

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("posterior").flatten(), dtype=float).reshape(-1, d)
            yield batch.append_column("rate", pa.array(_rate(np.asarray(batch.column("n_tokens"), dtype=float), p, slope), pa.float64()))

    chosen = members.select("id", "n_tokens", "posterior")
    return chosen.mapInArrow(rates, f"id {kind}, n_tokens long, posterior array<double>, rate double"), history, slope


def _rate(tokens: np.ndarray, posterior: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - tokens * (posterior @ slope))


def solved(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", budget: float | None = None) -> tuple[DomainModel, DataFrame, list[float], np.ndarray]:
    """The classifier, members with their rates, the residual after each pass, and what a document's rate follows from."""
    model = fitted(docs, labelled)
    members = written(memberships(docs, model, id_col), "memberships")
    tokens = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    share = {d: 1.0 for d in model.domains} if weights is None else weights
    raw = np.array([max(0.0, share.get(d, 0.0)) for d in model.domains])
    targets = raw / max(raw.sum(), 1e-30) * (tokens if budget is None else budget)
    found, history, slope = solve(members, targets)
    if history[-1] > RESIDUAL:
        warnings.warn(f"mixing misses its targets by {history[-1]:.2g} of the largest after {len(history)} passes", stacklevel=3)
    return model, found, history, slope


def _copies(id_: Column) -> Column:
    """The rate rounded up or down by a hash of the id, so that its expectation is the rate."""
    draw = F.pmod(F.xxhash64(id_.cast("string"), F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")


def with_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None) -> DataFrame:
    """The documents with their n_tokens, domain, rate and copies, as mix() gives them; columns of these names give way.

    A document's rate follows from its own memberships and one number per domain, so nothing is joined: null and
    repeated ids keep their rows.
    """
    model, _, _, slope = solved(docs, labelled, weights, id_col, budget)
    shared = docs.sparkSession.sparkContext.broadcast((model, slope))  # bounded by WORDS and the domains
    own = docs.drop("n_tokens", "domain", "rate", "copies")
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slope = shared.value
        for batch in batches:
            found = [m.evidence(t) for t in batch.column(at).to_pylist()]
            n = np.array([x for x, _ in found], dtype=np.int64)
            p = m.posterior(np.array([e for _, e in found]).reshape(-1, len(m.log_prior)))
            more = [pa.array(n), pa.array([m.domains[k] for k in p.argmax(1)], pa.string()), pa.array(_rate(n.astype(float), p, slope), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "n_tokens", "domain", "rate"])

    kinds = T.StructType([*own.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())])
    return own.mapInArrow(run, kinds).withColumn("copies", _copies(F.col(id_col)))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", budget: float | None = None) -> DataFrame:
    """One row per document: id, n_tokens, domain (the likeliest), posterior, rate, copies.

    `weights` are the domains' shares of the `budget` of tokens (default: equal shares of the corpus's tokens);
    labelled domains without a weight get none. copies is the rate rounded up or down by a hash of the id, so that
    its expectation is the rate. A null or empty text has no tokens, its memberships are the labelled shares, and
    its rate stays 1. Targets that are not met to RESIDUAL are told by a warning. Repeated rows stay; rows of the same id and text get the same rate.
    """
    model, found, _, _ = solved(docs, labelled, weights, id_col, budget)
    names = F.array(*[F.lit(d) for d in model.domains])
    return found.select(
        "id", "n_tokens", F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain"), "posterior", "rate",
        _copies(F.col("id")).alias("copies"),
    )
