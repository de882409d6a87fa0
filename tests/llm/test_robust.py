"""Odd ids, clashing names, long words and repeated labelled rows."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, embed_dedup, mixing, near_text, quality, simhash, toxicity, url_filter

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("dedup", [simhash.dedup, near_text.dedup])
def test_dedup_with_strings_for_ids_and_taken_names(spark, dedup):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([("b", text, 1, 2), ("a", text, 3, 4), ("c", "other words", 5, 6), (None, text, 7, 8)], "doc_id string, text string, kept_id int, __keep int")
    got = dedup(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or "", r["kept_id"]) for r in got.collect()) == [("", 7), ("a", 3), ("c", 5)]


def test_vectors_of_repeated_and_string_ids(spark):
    rows = [(5, [1.0, 2.0]), (5, [-3.0, 1.0]), (7, [2.0, 4.0]), (8, [-6.0, 2.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(str(i), v, 1) for i, v in rows], "vec_id string, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embed_dedup.near_vectors(df).collect())
    assert got == [("5", 1, "5"), ("5", 2, "5"), ("7", 2, "5"), ("8", 1, "5"), ("9", 2, "5")]


def test_mixing_keeps_rows_and_names(spark):
    docs = spark.createDataFrame([(k if k % 5 else None, f"{'alpha' if k % 2 else 'beta'} " * (k % 7), k, "x") for k in range(60)], "doc_id long, text string, __id int, n_tokens string")
    labelled = docs.select(F.col("doc_id").alias("id"), F.when(F.col("__id") % 2 == 1, "word").otherwise("a `tick` domain").alias("domain"))
    got = mixing.with_rates(docs, labelled)
    assert got.columns == ["doc_id", "text", "__id", "n_tokens", "domain", "rate", "copies"] and got.count() == 60
    by = {r["domain"]: r["t"] for r in got.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    assert set(by) == {"word", "a `tick` domain"}
    plain = {r["id"]: r["rate"] for r in mixing.mix(docs, labelled).collect()}
    assert {r["doc_id"]: r["rate"] for r in got.where("doc_id is not null").collect()} == {k: v for k, v in plain.items() if k is not None}


def test_long_words_count(spark):
    """A word of any length tells domains and toxic texts apart."""
    long = "x" * 500
    docs = spark.createDataFrame([(k, f"plain words {long + 'yes' if k % 2 else long + 'no'} here") for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fitted(docs, labels)
    assert model.score(f"plain {long}yes")[0] > 0.5 > model.score(f"plain {long}no")[0]
    labelled = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, "a").otherwise("b").alias("domain"))
    domains = mixing.mix(docs, labelled)
    assert domains.where((F.col("id") % 2 == 1) != (F.col("domain") == "a")).count() == 0


def test_repeated_labelled_ids_are_bounded(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k % 4}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(4)], "doc_id long, toxic int, quality int")
    assert toxicity._sampled(docs, labels, "toxic", 12, None).count() == 4
    assert quality.fitted(docs, labels, positive_rows=3, unlabelled_rows=3) is not None


def test_overlong_urls_are_learned_from(spark):
    path = "q" * 5000
    pages = spark.createDataFrame([(k, f"http://{'a.org' if k % 2 else 'b.com/de'}/{path}{k}") for k in range(200)], "page_id long, url string")
    judged = pages.withColumn("action", F.when(F.col("page_id") % 2 == 1, "allow").otherwise("block"))
    model = url_filter.fitted(judged)
    assert model.models[0].next[b""] and model.ratio(f"http://a.org/{path}".encode()) > model.ratio(f"http://b.com/de/{path}".encode())


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert common.fresh("a", df) == "a__" and common.fresh("b", df) == "b"


@pytest.mark.parametrize("missing", ["zstandard", "corpus_pipeline", "sievewright.llm.pst"])
def test_entry_without_a_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), 'pipeline' in q, 'op1_suffix_tree' in q, len(o))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1] == "False" and (out[2] == "True") == (missing == "corpus_pipeline")


def test_all_labelled_urls_are_learned_from(spark, monkeypatch):
    """Ratios, threshold and verdicts are those of the models of every labelled URL, on whatever chunks and parts."""
    rows = [(k, f"http://{'news' if k % 3 else 'casino'}{k % 7}.{'example.org' if k % 3 else 'biz.com'}/{('en', 'fr', 'de', 'es')[k % 4]}/{k * 7919 % 30_011}") for k in range(24_000)]
    pages = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "ÄÖ\n://x"), *rows[:50]], "page_id long, url string")
    monkeypatch.setattr(url_filter, "CHUNK", 50_000)
    got = url_filter.filter_urls(pages).cache()
    model = url_filter.fitted(url_filter.filter_urls(pages).withColumn("action", F.when(F.col("rule").isNotNull(), F.col("verdict"))))
    assert model.models[0].total[b""][0] > 4000 * 45 and got.count() == len(rows) + 53
    for r in got.collect():
        assert r["threshold"] == pytest.approx(model.threshold, abs=1e-9)
        assert r["log_ratio"] == (0.0 if r["url"] is None else pytest.approx(model.ratio(r["url"].encode()), abs=1e-9))
