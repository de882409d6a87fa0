"""Each pipeline stage, and each registered query, on odd and on empty tables."""

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string, id int, score double, chunk string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [
        (1, "Plain words stand here and there, token = \"aaaaaaaaaaaaaaaa\".", "en", "s", 60, "r", 1, 0.1, "c"), (1, "Plain words stand here and there, token = \"aaaaaaaaaaaaaaaa\".", "en", "s", 60, "r", 1, 0.1, "c"),
        (2, None, None, None, None, None, None, None, None), (3, "", "de", None, 0, None, None, None, None), (None, "an unnamed text", None, "s", 15, None, None, None, None),
        (4, "word " * 40_000, "fr", "s", 200_000, "r", 2, 0.2, "d"), (5, "\x00\t ́😀", "en", "s", 5, "r", 3, 0.3, "e"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, "word word"), (2, "other")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, None, None), (None, "http://a.org/", ""), (2, "x", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, None, 1), (None, [1.0, 2.0], 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, 2.0], None), (5, [2.0, 4.0], 1), (6, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def test_stages(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, d, rows in (("odd", odd, 7), ("empty", empty, 0)):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, spark.read.parquet(f"{d}/documents.parquet"), d)  # each on its own input
            path = str(tmp_path / f"{name}-{stage}")
            out.write.parquet(path)
            got = spark.read.parquet(path)
            assert got.count() <= rows and (k == 4 or got.columns == docs.columns)
            if stage in ("secrets", "mixing"):
                assert got.count() == rows
            if stage == "mixing":
                assert dict(got.dtypes)["rate"] == "double"
        assert corpus_pipeline.run(spark, d).count() <= rows


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_queries(spark, odd, empty, name):
    from sievewright.llm.queries import QUERIES

    query = next(f for k, f in QUERIES.items() if k.startswith(f"{name}_"))
    key = {"op2": "embeddings", "op3": "pages"}.get(name, "documents")
    got = query(spark, odd)
    assert got.count() == spark.read.parquet(f"{odd}/{key}.parquet").count()
    if name == "op2":
        links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
        assert links[5] == links[6] == (1, 5) and links[4] == (0, 4) and links[1] == (0, 1) and links[None] == (0, None)
    if "score" in got.columns and name != "op1":
        assert got.where(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
    assert query(spark, empty).count() == 0
