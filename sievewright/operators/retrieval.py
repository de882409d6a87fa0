"""Scope-local retrieval: BM25, exact vector search, reciprocal-rank fusion, budgets and checks of rankings.

A scope is what a query searches: a patient's notes, a source, a label. Statistics are the scope's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vector import dot

K1, B = 1.2, 0.75
RRF_K = 60


def scope_stats(chunks: DataFrame) -> DataFrame:
    """Rows (scope, n_chunks, avg_length) of chunks (scope, chunk_id, text)."""
    return chunks.select("scope", F.size(tokens(F.col("text"))).alias("length")).groupBy("scope").agg(F.count("*").alias("n_chunks"), F.avg("length").alias("avg_length"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, same_scope: bool = False) -> DataFrame:
    """Rows (scope, query_id, chunk_id, score) of chunks that share a term with the query.

    chunks: scope, chunk_id, text; queries: query_id, text, and with same_scope the one scope it searches. A query's
    terms count once. Postings are cut down to the queries' terms before anything is shuffled, so a chunk's text
    never is; common words cost a row per chunk and query, as their scores need.
    """
    terms = queries.select("query_id", *(["scope"] if same_scope else []), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = chunks.select("scope", "chunk_id", tokens(F.col("text")).alias("words"))
    stats = words.groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_length"))
    postings = words.select("scope", "chunk_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    wanted = terms.select(*(["scope"] if same_scope else []), "term").distinct()
    postings = postings.join(wanted, wanted.columns, "left_semi").groupBy("scope", "chunk_id", "length", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("scope", "term").agg(F.count("*").alias("df"))
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = postings.join(df, ["scope", "term"]).join(stats, "scope").select("scope", "chunk_id", "term", (weight * saturation).alias("part"))
    on = ["scope", "term"] if same_scope else ["term"]
    return scored.join(terms, on).groupBy("scope", "query_id", "chunk_id").agg(F.sum("part").alias("score"))


def ranked(scores: DataFrame, keys: Sequence[str], k: int | None = None, positive: bool = False, ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Ranks from 1 by descending score, to nine digits, then by `ties`; the first k of each group."""
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), *ties)
    rows = scores.where("score > 0") if positive else scores
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (scope, query_id, chunk_id, score): exact inner products of each query with its scope's other vectors.

    vectors: scope, chunk_id, vec; queries: query_id, scope, vec: a stated set of queries against all rows.
    """
    q = queries.select("scope", "query_id", F.col("vec").alias("q"))
    pairs = vectors.join(q, "scope").where(F.col("chunk_id") != F.col("query_id"))
    return pairs.select("scope", "query_id", "chunk_id", dot(F.col("q"), F.col("vec")).alias("score"))


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, keys: Sequence[str], k: int | None = 3, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank) over both rankings. Dense ranks every candidate; a lexical rank may be missing."""
    on = [*keys, "chunk_id"]
    joined = dense.select(*on, F.col("rank").alias("dense_rank")).join(lexical.select(*on, F.col("rank").alias("lexical_rank")), on, "left")
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return ranked(joined.withColumn("score", part("dense_rank") + part("lexical_rank")), keys, k)


def stray_candidates(dense: DataFrame, lexical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lexically ranked chunks that the dense ranking lacks: fusion needs that there are none."""
    return lexical.join(dense, [*keys, "chunk_id"], "left_anti")


def rank_violations(rankings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose ranks are not 1, 2, ... or whose score is above that of the rank before."""
    order = Window.partitionBy(*keys).orderBy("rank", "chunk_id")
    checked = rankings.withColumn("expected", F.row_number().over(order)).withColumn("before", F.lag("score").over(order))
    return checked.where((F.col("rank") != F.col("expected")) | (F.col("before") < F.col("score"))).drop("expected", "before")


def prefix_budget(chunks: DataFrame, limit: int) -> DataFrame:
    """Each scope's longest prefix of whole chunks, by `start`, within `limit` characters; it stops at the first overflow.

    chunks: scope, chunk_id, start, length >= 1. As lengths are positive, running sums only grow.
    """
    so_far = Window.partitionBy("scope").orderBy("start", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum("length").over(so_far)).where(F.col("used") <= limit)


def exposure(rankings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query: selected chunks and characters, and their share of the scope's characters."""
    lengths = chunks.select("scope", "chunk_id", F.length("text").alias("length"))
    whole = lengths.groupBy("scope").agg(F.sum("length").alias("scope_chars"))
    picked = rankings.join(lengths, ["scope", "chunk_id"]).groupBy("scope", "query_id").agg(F.count("*").alias("n_selected"), F.sum("length").alias("selected_chars"))
    return picked.join(whole, "scope").withColumn("exposure", F.round(F.col("selected_chars") / F.col("scope_chars"), 6))


#: Queries of a flat search that are sent to the vectors at once.
QUERY_BLOCK = 1000


def global_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Flat inner-product search: each of a stated set of queries against all vectors.

    Queries go to the vectors in blocks of `block`, so what is broadcast stays that small however many there are;
    each task keeps the best k of a query before anything is shuffled.
    """
    blocks = max(1, -(-queries.count() // block))
    found = None
    for n in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).agg(F.collect_list(F.struct("query_id", "vec")).alias("qs"))
        pairs = vectors.join(F.broadcast(some)).select("chunk_id", "vec", F.explode("qs").alias("q")).where(F.col("chunk_id") != F.col("q.query_id"))
        part = ranked(pairs.select(F.col("q.query_id").alias("query_id"), "chunk_id", dot(F.col("q.vec"), F.col("vec")).alias("score")), ["query_id"], k)
        found = part if found is None else found.unionByName(part)
    return found
