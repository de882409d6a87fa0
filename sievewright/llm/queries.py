"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts get the model's leak; null labels teach nothing; a repeated labelled id counts once; a tie at one half is toxic."""
    from .common import in_fold
    from .toxicity import fitted, scores

    docs = _table(spark, sf_dir, "documents")
    model = fitted(docs, _table(spark, sf_dir, "labels"), "toxic", learn=~in_fold(F.col("id"), 5, 0))
    found = scores(docs, model)
    return found.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents. Null and empty texts have none; repeated rows stay."""
    from .secret_scan import scan

    found = scan(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. Texts without words have fingerprint zero and link like any other; a null id keeps its row."""
    from .simhash import simhash_components

    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in all documents. Null texts have no words; items without an id, or without words, are left out; repeated items count once."""
    from .decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. Null and empty texts have 0; repeated rows stay; an empty table gives an empty one."""
    from .tokencount import token_counts

    found = token_counts(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents. A null or empty text is one end; null ids are in training; repeated rows each count and stay; an empty table gives an empty one."""
    from .common import in_fold
    from .pst import score_texts

    found = score_texts(_table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 7, 2))
    return found.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score",
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Null, zero and non-finite vectors, and null ids or labels, link with nothing; an id that stands by several vectors has a row for each."""
    from .embed_dedup import near_vectors

    found = near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents; the labelled rows' languages are the domains, in equal shares. Texts without words keep the rate 1; without labelled rows there is one domain, unknown."""
    from .mixing import mix

    docs = _table(spark, sf_dir, "documents")
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id")
    return mix(docs, labelled).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts have the figures of an empty one; only label 1 teaches, a repeated id once; without positives every score is one half."""
    from .common import in_fold, written
    from .quality import coded_scores, coded_texts, fitted_on

    coded = written(coded_texts(_table(spark, sf_dir, "documents")), "quality-codes")
    model = fitted_on(coded, _table(spark, sf_dir, "labels"), "quality", learn=~in_fold(F.col("id"), 3, 1))
    found = coded_scores(coded, model)
    return found.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A null url, or one without ://, has an empty host and path; repeated pages stay; without labelled urls of both kinds the threshold is 0."""
    from .url_filter import filter_urls

    found = filter_urls(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "log_ratio", "threshold")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.x = v.vec_id) AS BIGINT) AS n_links,
  (SELECT min(y) FROM reach WHERE reach.x = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(y) FROM reach WHERE reach.x = v.vec_id) AS kept
FROM v
""",
    "op7_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS size
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT k, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
),
found AS (SELECT k, i, s.size, item FROM spots s JOIN windows USING (win, size)),
hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT k, i, size FROM found)) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN named USING (k)
""",
}
