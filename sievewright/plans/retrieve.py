"""Retrieval over documents within sources and embeddings within labels.

Queries of a search are the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..session import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.ranked(r.bm25_scores(_chunks(spark, sf_dir), _items(spark, sf_dir)), ["scope", "query_id"], 3, positive=True)
    return found.select("scope", "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def bm25_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.scope_stats(_chunks(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.ranked(r.dense_scores(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)), ["scope", "query_id"], 5)
    return found.select("scope", "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def flat_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.global_top_k(_vectors(spark, sf_dir).drop("scope"), _vector_queries(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _fusion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    both = _vectors(spark, sf_dir).join(docs, "chunk_id")
    queries = both.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    keys = ["scope", "query_id"]
    dense = r.ranked(r.dense_scores(both.drop("text"), queries), keys)
    scores = r.bm25_scores(both.select("scope", "chunk_id", "text"), queries.select("scope", "query_id", "text"), same_scope=True)
    return dense, r.ranked(scores.where("chunk_id <> query_id"), keys, positive=True)


def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, lexical = _fusion(spark, sf_dir)
    found = r.reciprocal_rank_fusion(dense, lexical, ["scope", "query_id"], 3)
    return found.select("scope", "query_id", "chunk_id", "dense_rank", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.round("score", 6).alias("score"), "rank")


def rrf_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, lexical = _fusion(spark, sf_dir)
    keys = ["scope", "query_id"]
    fused = r.reciprocal_rank_fusion(dense, lexical, keys, 3)
    top = lambda df, name: df.where("rank = 1").select(*keys, F.col("chunk_id").alias(name))
    joined = top(fused, "f").join(top(dense, "d"), keys, "left").join(top(lexical, "l"), keys, "left")
    return joined.agg(F.count("*").alias("n_queries"), F.count_if(F.col("f").eqNullSafe(F.col("d"))).alias("top1_as_dense"), F.count_if(F.col("f").eqNullSafe(F.col("l"))).alias("top1_as_lexical"))


def retrieval_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    found = r.ranked(r.bm25_scores(chunks, _items(spark, sf_dir)), ["scope", "query_id"], 3, positive=True)
    return r.exposure(found, chunks)


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").where("length(text) > 0").select(F.col("conv_id").alias("scope"), F.col("turn").alias("chunk_id"), F.col("turn").alias("start"), F.length("text").cast("long").alias("length"))
    return r.prefix_budget(chunks, 2000).select("scope", "chunk_id", "length", "used")


def rank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that a faulty source gave: dense ranks with one left out and a score raised in every seventh row."""
    found = r.ranked(r.dense_scores(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)), ["scope", "query_id"], 20)
    faulty = found.where("chunk_id % 11 <> 0").withColumn("score", F.round(F.when(F.col("chunk_id") % 7 == 0, F.col("score") + 5).otherwise(F.col("score")), 6))
    return r.rank_violations(faulty, ["scope", "query_id"]).select("scope", "query_id", "chunk_id", "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_doc_stats, dense_topk, flat_index_topk, rrf_topk, rrf_agreement, retrieval_exposure, prefix_budget, rank_validation)}

FOLD = "replace(lower(text), 'ß', 'ss')"
TOKENS = f"regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}]+(?:[./-][\\p{{L}}\\p{{N}}]+)*')"


def bm25_sql(chunks: str, queries: str, same_scope: bool) -> str:
    on = "USING (scope, term)" if same_scope else "USING (term)"
    scope = "scope, " if same_scope else ""
    return f"""words AS (SELECT scope, chunk_id, {TOKENS} AS w FROM ({chunks})),
stats AS (SELECT scope, count(*) AS n, avg(len(w)) AS al FROM words GROUP BY scope),
terms AS (SELECT DISTINCT {scope}query_id, unnest({TOKENS}) AS term FROM ({queries})),
post AS (SELECT scope, chunk_id, len AS length, term, count(*) AS tf FROM (SELECT scope, chunk_id, len(w) AS len, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL),
scores AS (SELECT scope, query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / al)))) AS score
  FROM post JOIN dfs USING (scope, term) JOIN stats USING (scope) JOIN terms {on} GROUP BY ALL)"""


DOT = "list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE))"
_DENSE = f"dense AS (SELECT v.label AS scope, q.vec_id AS query_id, v.vec_id AS chunk_id, {DOT} AS score FROM embeddings v JOIN embeddings q ON v.label = q.label AND v.vec_id <> q.vec_id AND q.vec_id % 100 = 0)"
_BM25 = "WITH " + bm25_sql("SELECT source AS scope, doc_id AS chunk_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0", False)
_RANK = "row_number() OVER (PARTITION BY scope, query_id ORDER BY round(score, 9) DESC, chunk_id)"
_BOTH = "SELECT label AS scope, doc_id AS chunk_id, text FROM embeddings JOIN documents ON vec_id = doc_id"
_FUSED = "WITH " + bm25_sql(_BOTH, "SELECT label AS scope, doc_id AS query_id, text FROM embeddings JOIN documents ON vec_id = doc_id WHERE doc_id % 100 = 0", True) + f""",
{_DENSE.replace("FROM embeddings v JOIN embeddings q", "FROM (SELECT e.* FROM embeddings e JOIN documents ON vec_id = doc_id) v JOIN (SELECT e.* FROM embeddings e JOIN documents ON vec_id = doc_id) q")},
dr AS (SELECT *, CAST({_RANK} AS INTEGER) AS dense_rank FROM dense),
lr AS (SELECT scope, query_id, chunk_id, CAST({_RANK} AS INTEGER) AS lexical_rank FROM scores WHERE score > 0 AND chunk_id <> query_id),
fused AS (SELECT scope, query_id, chunk_id, dense_rank, lexical_rank, 1.0::DOUBLE / (60 + dense_rank) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS score FROM dr LEFT JOIN lr USING (scope, query_id, chunk_id)),
top AS (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM fused QUALIFY rank <= 3)
"""

ORACLES = {
    "bm25_topk": _BM25 + f" SELECT scope, query_id, chunk_id, round(score, 6) AS score, CAST({_RANK} AS INTEGER) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 3",
    "bm25_doc_stats": f"SELECT source AS scope, count(*) AS n_chunks, round(avg(len({TOKENS})), 6) AS avg_length FROM documents GROUP BY source",
    "dense_topk": f"WITH {_DENSE} SELECT scope, query_id, chunk_id, round(score, 6) AS score, CAST({_RANK} AS INTEGER) AS rank FROM dense QUALIFY rank <= 5",
    "flat_index_topk": f"""SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({DOT}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DOT}, 9) DESC, v.vec_id) AS INTEGER) AS rank
FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id AND q.vec_id % 100 = 0 QUALIFY rank <= 10""",
    "rrf_topk": _FUSED + "SELECT scope, query_id, chunk_id, dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(score, 6) AS score, rank FROM top",
    "rrf_agreement": _FUSED + """SELECT count(*) AS n_queries, count(*) FILTER (t.chunk_id IS NOT DISTINCT FROM d.chunk_id) AS top1_as_dense, count(*) FILTER (t.chunk_id IS NOT DISTINCT FROM l.chunk_id) AS top1_as_lexical
FROM (SELECT * FROM top WHERE rank = 1) t LEFT JOIN (SELECT * FROM dr WHERE dense_rank = 1) d USING (scope, query_id) LEFT JOIN (SELECT * FROM lr WHERE lexical_rank = 1) l USING (scope, query_id)""",
    "retrieval_exposure": _BM25 + f""", picked AS (SELECT scope, query_id, chunk_id FROM scores WHERE score > 0 QUALIFY {_RANK} <= 3),
whole AS (SELECT source AS scope, sum(length(text)) AS sc FROM documents GROUP BY source)
SELECT scope, query_id, count(*) AS n_selected, CAST(sum(length(text)) AS BIGINT) AS selected_chars, CAST(any_value(sc) AS BIGINT) AS scope_chars, round(sum(length(text))::DOUBLE / any_value(sc)::DOUBLE, 6) AS exposure
FROM picked JOIN documents ON chunk_id = doc_id JOIN whole USING (scope) GROUP BY scope, query_id""",
    "prefix_budget": """SELECT conv_id AS scope, turn AS chunk_id, length(text) AS length, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations WHERE length(text) > 0
QUALIFY used <= 2000""",
    "rank_validation": f"""WITH {_DENSE}, r AS (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM dense QUALIFY rank <= 20),
f AS (SELECT scope, query_id, chunk_id, rank, round(CASE WHEN chunk_id % 7 = 0 THEN score + 5 ELSE score END, 6) AS score FROM r WHERE chunk_id % 11 <> 0),
c AS (SELECT *, row_number() OVER w AS expected, lag(score) OVER w AS before FROM f WINDOW w AS (PARTITION BY scope, query_id ORDER BY rank, chunk_id))
SELECT scope, query_id, chunk_id, rank FROM c WHERE rank <> expected OR before < score""",
}
