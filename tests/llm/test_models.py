"""Operators 1, 4, 9, 10 and the pipeline: brute force where there is one, held-out accuracy else."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, mixing, pst, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, x):
    y, x = np.asarray(y), np.asarray(x)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    rank[order] = np.arange(len(x))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


# --- 1: language model ---

def test_word_hashes():
    raw = " The\tend the  é x\x1cy\n".encode().lower()
    tok, starts = pst.word_hashes(raw)
    assert [raw[s:].split()[0] for s in starts] == raw.split() and len(tok) == 5 and tok[0] == tok[2] and len(set(tok.tolist())) == 4
    long_text = " ".join(f"w{k % 977}" for k in range(200_000))
    whole = np.concatenate([t for t, _ in pst.hashed([long_text])])
    known = {w: pst.word_hashes(w)[0][0] for w in {f"w{k}".encode() for k in range(977)}}
    assert len(whole) == 200_001 and whole[-1] == pst.END and all(whole[k] == known[f"w{k % 977}".encode()] for k in range(0, 200_000, 997))


def test_hashed_keeps_texts_apart():
    tok, doc = (np.concatenate(x) for x in zip(*pst.hashed(["a b", None, "", "b"])))
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 3] and (tok == pst.END).tolist() == [False, False, True, True, True, False, True] and tok[1] == tok[5]


def brute_base(rows, held):
    words = {k: [*("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()), None] for k, t in rows}
    c = Counter(w for k, ws in words.items() if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    return {k: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in words.items()}


def test_language_model(spark):
    rng = random.Random(1)
    start = {"en": "the of and to in".split(), "fr": "le la de et un".split()}
    rows = [(0, None), (1, ""), (2, "Only once"), (3, "word " * 50_000)]
    for k in range(4, 900):
        words = start[rng.choice(["en", "fr"])]
        t = []
        for _ in range(rng.randint(1, 60)):
            t += [rng.choice(words), words[0] + str(rng.randint(0, 400))]
        rows.append((k, " ".join(t)))
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, chunk int, part int").repartition(5)
    got = {r["id"]: r for r in pst.score_texts(df, common.in_fold(F.col("doc_id"), 7, 2)).collect()}
    want = brute_base(rows, held)
    for k, x in want.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3] and r["base"] == pytest.approx(x[3], rel=1e-9) and r["held"] == held(k)
    out = [k for k in want if held(k)]
    assert sum(got[k]["score"] for k in out) > sum(got[k]["base"] for k in out) + 0.05 * sum(got[k]["n_tokens"] for k in out)
    assert pst.score_texts(df.limit(0), F.lit(False)).count() == 0
    alone = pst.score_texts(df, F.lit(True)).agg(F.min("score"), F.max("score")).first()
    assert tuple(alone) == (0.0, 0.0)


def test_tree_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after each of several histories."""
    text = " ".join(random.Random(3).choices(["a", "b", "c", "d e", "f g h"], k=4000))
    words = sorted(set(text.split()))
    histories = ["", "a", "d e", "f g", "b f"]
    probes = [(n, f"{h} {w}".strip()) for n, (h, w) in enumerate((h, w) for h in histories for w in [*words, "unseen"])] + [(10_000 + k, h) for k, h in enumerate(histories)]
    df = spark.createDataFrame([(-1, text)] + probes, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in pst.score_texts(df, F.col("doc_id") >= 0).collect()}
    size = len(words) + 1
    for k, h in enumerate(histories):
        # P(text) = P(history) P(word | history) P(end | ...); dividing two texts' ends needs the end's own probability,
        # so sum what follows two words on: P(h w end) over w, plus P(h end), is at most P(h)
        total = sum(10 ** got[k * size + n] for n in range(size)) + 10 ** got[10_000 + k]
        assert 0 < total <= 1 + 1e-9


# --- 4 and 10: classifiers ---

def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select(docs["*"])
    model = toxicity.fitted(docs, labels, learn=~common.in_fold(F.col("id"), 5, 0))
    rows = toxicity.scores(known, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where(common.in_fold(F.col("id"), 5, 0)).select("score", "toxic").collect()
    y, x = [r["toxic"] for r in rows], [r["score"] for r in rows]
    assert auc(y, x) > 0.95 and np.mean([(s >= 0.5) == t for s, t in zip(x, y)]) > 0.95


def test_noisy_or_locates_sentences(spark):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(300):
        s = [" ".join(rng.choices(plain, k=6)) for _ in range(5)]
        if k % 3 == 0:
            s[rng.randrange(5)] += " vileness"
        rows.append((k, ". ".join(s) + "!", "x"))
        labels.append((k, int(k % 3 == 0)))
    rows += [(300, None, "x"), (301, "", "x"), (302, "The é vileness.\n\nFine words", "x"), (302, "The é vileness.\n\nFine words", "x"), (303, "w1 " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    table = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, table)
    got = toxicity.scores(docs, model).collect()
    by_id = {r["id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and all((by_id[k]["score"] >= 0.5) == bool(y) for k, y in labels)
    span = by_id[302]["sentences"][0]
    assert "The é vileness.\n\nFine words"[span["start"] : span["end"]] == "The é vileness" and len(by_id[302]["sentences"]) == 1
    assert by_id[300]["score"] == by_id[301]["score"] < 0.5 and by_id[303]["score"] < 0.5
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, y in labels if not y} | {300, 301, 303}
    blind = toxicity.fitted(docs, table.limit(0))
    assert {r["score"] for r in toxicity.scores(docs, blind).where("id > 299").select(F.round("score", 6).alias("score")).collect() if r["score"] > 0.9} <= {1.0}
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select(docs["*"])
    model = quality.fitted(docs, labels, learn=~common.in_fold(F.col("id"), 3, 1))
    rows = quality.quality_scores(known, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where(common.in_fold(F.col("id"), 3, 1)).select("score", "quality").collect()
    y, x = [r["quality"] for r in rows], [r["score"] for r in rows]
    assert auc(y, x) > 0.98 and np.mean([(s >= 0.5) == t for s, t in zip(x, y)]) > 0.93
    truth = labels.agg(F.avg("quality")).first()[0]
    assert abs(model.prior - truth) < 0.05


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(5)
    good = lambda n: np.c_[rng.normal(0, 1, (n, 2)), np.zeros((n, quality.FEATURES - 2))]
    bad = lambda n: np.c_[rng.normal(4, 1, (n, 2)), np.zeros((n, quality.FEATURES - 2))]
    m = quality.PUModel()
    m.fit(good(3000), np.r_[good(4200), bad(1800)])
    assert abs(m.prior - 0.7) < 0.05 and (m.scores(good(500)) >= 0.5).mean() > 0.9 and (m.scores(bad(500)) < 0.5).mean() > 0.9


def test_quality_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "Fine words stand here."), (2, "Fine words stand here."), (3, "!!! " * 50_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = quality.quality_scores(docs, quality.fitted(docs, spark.createDataFrame([(2, 1), (None, 1)], "doc_id long, quality int"))).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality_scores(docs, quality.fitted(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), quality.PUModel()).count() == 0


def test_quality_of_a_table_is_that_of_its_rows(spark):
    """Cuts, prior and risk of a table in any number of parts against the same fit in memory, and the scores against it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 3 = 0"))  # repeats count
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality")).distinct()
    x = np.array([quality.features(r["text"]) for r in docs.collect()])
    sure = [quality.features(r["text"]) for r in docs.dropDuplicates(["doc_id"]).join(labels.where("quality = 1"), "doc_id").collect()]
    models = [quality.fitted(docs.repartition(n), labels) for n in (1, 7)]
    rows = np.array([m.theta for m in models])
    assert np.allclose(rows[0], rows[1], atol=1e-9) and np.array_equal(models[0].cuts, models[1].cuts)
    plain = quality.PUModel()
    plain.fit(np.array(sure), x, models[0].prior)
    assert np.array_equal(plain.cuts, models[0].cuts)
    given = quality.fitted(docs, labels, prior=models[0].prior)
    assert np.allclose(plain.theta, given.theta, atol=1e-6)
    got = {r["id"]: r["score"] for r in quality.quality_scores(docs.limit(50), given).collect()}
    want = {r["doc_id"]: plain.scores(quality.features(r["text"])[None])[0] for r in docs.limit(50).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_moments_are_slopes_and_curvature():
    rng = np.random.default_rng(8)
    cells, n = rng.integers(0, quality.BINS, (40, quality.FEATURES)).astype(np.uint8), rng.integers(0, 4, 40)
    theta = rng.normal(0, 0.3, quality.FEATURES * quality.BINS + 1)
    for sign in (1, -1):
        value, grad, hess = quality._unpacked(quality.moments(cells, n, theta, sign))
        for k in (0, 17, 200, len(theta) - 1):
            up, down = (quality._unpacked(quality.moments(cells, n, theta + d * (np.arange(len(theta)) == k), sign)) for d in (1e-5, -1e-5))
            assert grad[k] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-8) and np.allclose(hess[k], (up[1] - down[1]) / 2e-5, atol=1e-8)


# --- 9: mixing ---

def test_mixing_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(labels.select(F.col("doc_id").alias("id")), "id")
    got = mixing.mix(docs, labelled, {"en": 0.4, "es": 0.2, "fr": 0.3, "de": 0.1}).collect()
    n = sum(r["n_tokens"] for r in got)
    a = np.array([[r["n_tokens"] * p for p in r["posterior"]] for r in got])
    rates = np.array([r["rate"] for r in got])
    assert (rates >= 0).all() and np.allclose(rates @ a / n, [0.1, 0.4, 0.2, 0.3], atol=2e-3) and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    # the same steps in one place
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([truth[r["id"]] == r["domain"] for r in got]) > 0.95
    copies = np.array([r["copies"] for r in got])
    assert (np.abs(copies - rates) < 1).all() and abs(copies.sum() - rates.sum()) < 4 * np.sqrt(len(rates))


def test_projected_gradient_against_plain_version(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3] * 3, 200)
    tokens = rng.integers(0, 500, 200)
    df = spark.createDataFrame([(k, int(tokens[k]), [float(x) for x in p[k]]) for k in range(200)], "id long, n_tokens long, posterior array<double>").repartition(3)
    targets = tokens.sum() * np.array([0.9, 0.1, 0.0])
    found, history = mixing.mixed(df, targets)
    a = p * tokens[:, None] / targets.sum()
    gram = a.T @ a
    scale = np.diag(gram)
    top = np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).max()
    rate, residuals = np.ones(200), []
    for _ in range(mixing.STEPS):
        gap = rate @ a - targets / targets.sum()
        residuals.append(np.abs(gap).max() / 0.9)
        if residuals[-1] <= mixing.RESIDUAL:
            break
        rate = np.maximum(0, rate - a @ (gap / scale / top))
    assert np.allclose(history, residuals, atol=1e-9) and residuals[-1] < residuals[0] / 5
    assert np.allclose([r["rate"] for r in found.orderBy("id").collect()], rate, atol=1e-9)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(0, None, 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3), (None, "c", 4)], "doc_id long, text string, rate int")
    labelled = spark.createDataFrame([(2, "x"), (2, "y"), (None, "x"), (1, None)], "id long, domain string")
    got = mixing.mix(docs, labelled).collect()
    assert len(got) == 5 and all(r["rate"] >= 0 for r in got) and {r["rate"] for r in got if r["n_tokens"] == 0} == {1.0}
    assert mixing.mix(docs.limit(0), labelled).count() == 0
    assert {r["domain"] for r in mixing.mix(docs, labelled.limit(0)).collect()} == {"unknown"}


# --- pipeline ---

def test_pipeline_against_brute_force(spark, tmp_path):
    """The stages' decisions, one after another, in plain Python where they don't rest on a fitted model."""
    import corpus_pipeline

    from .test_counts_and_spans import brute_hits
    from .test_duplicates import union

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / name)
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        kept[name] = after
        if name == "toxicity":
            model = toxicity.fitted(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if model.score(r["text"])[0] < 0.5}
        if name == "near_duplicates":
            ids = sorted(before)
            words = [before[i]["text"].encode().lower().split() for i in ids]
            sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
            roots = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
            assert set(after) == {ids[r] for r in roots}
        if name == "decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            for i, r in before.items():
                hit, _ = brute_hits(items, r["text"])
                assert (i in after) == (sum(hit) <= 0.5 * len(hit))
                if i in after:
                    assert (after[i]["text"] == r["text"]) == (not any(hit)) and after[i]["n_chars"] == len(after[i]["text"])
        if name == "secrets":
            assert set(after) == set(before) and not any(secret_scan.base_spans(r["text"]) for r in after.values())
        if name == "mixing":
            assert set(after) == set(before) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in after.values()) and all(after[i]["text"] == r["text"] for i, r in before.items())
    run = corpus_pipeline.run(spark, small)
    assert {r["doc_id"]: r["copies"] for r in run.collect()} == {i: r["copies"] for i, r in kept["mixing"].items()}
