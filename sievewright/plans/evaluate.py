"""Metrics over labelled documents; predictions are lexical rules that both engines express alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as x
from ..operators import policy as p
from ..operators import retrieval as r
from ..session import table

STATUSES = ("present", "absent", "unknown")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that see the text alone, against the label `quality`; junk marks and upper case speak against it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    score = F.round(1.0 / (1.0 + F.size(F.regexp_extract_all(text, F.lit(r"[*&$#%|!]"), F.lit(0)))), 3)
    return docs.join(labels, "doc_id").select(
        "doc_id", "source", "lang", F.when(F.col("quality") == 1, "present").otherwise("absent").alias("gold"),
        F.when(score >= 0.5, "present").when(score >= 0.05, "unknown").when(F.length("text") % 7 == 0, F.lit(None).cast("string")).otherwise("absent").alias("predicted"), score.alias("score"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("double")).otherwise(F.col("n_chars").cast("double")).alias("gold_value"),
        F.when(F.length("text") % 5 == 0, F.lit(None).cast("double")).otherwise(F.round(F.length("text") / 10.0) * 10.0).alias("predicted_value"),
        F.lit("chars").alias("gold_unit"), F.when(F.length("text") % 13 == 0, "bytes").otherwise("chars").alias("predicted_unit"), F.lit(2.0).alias("tolerance"),
    )


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.confusion(_labelled(spark, sf_dir), "gold", "predicted", STATUSES, ("missing",))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    return x.class_metrics(_labelled(spark, sf_dir), "gold", "predicted", STATUSES).select("label", "tp", "fp", "fn", "support", *rounded)


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.class_summary(x.class_metrics(_labelled(spark, sf_dir), "gold", "predicted", STATUSES))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def numeric_value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.numeric_metrics(_labelled(spark, sf_dir), ["lang"])
    return found.select(F.coalesce("lang", F.lit("(all)")).alias("lang"), "n_gold", "n_predicted", "n_valid", "n_invalid_unit", *[F.round(c, 9).alias(c) for c in ("coverage", "mae", "within_of_valid", "within_of_gold")])


def coverage_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("abstained", F.coalesce(F.col("predicted") == "unknown", F.lit(True))).withColumn("correct", F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False)))
    found = x.coverage_risk(rows, "score", "correct", "abstained", abstain_all=True)
    return found.select("threshold", "answered", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    queries = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return r.global_top_k(vectors, queries, 50).select("query_id", F.col("chunk_id").alias("item"), "rank")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query the vectors of its label; one with an id in the same hundred is the better find."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return e.join(q, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item"), F.when(F.floor(F.col("vec_id") / 100) == F.floor(F.col("query_id") / 100), 2).otherwise(1).alias("grade"))


def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.retrieval_metrics(_ranked(spark, sf_dir), _relevant(spark, sf_dir), ["query_id"], 10)
    return found.select("query_id", "n_relevant", *[F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _relevant(spark, sf_dir).where("grade = 2").groupBy("query_id").agg(F.min("item").alias("item"))
    found = x.hit_at_k(_ranked(spark, sf_dir), best, ["query_id"], (1, 5, 50))
    return found.select("n", *[F.round(c, 9).alias(c) for c in found.columns[1:]])


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.when(F.col("text").rlike(r"[*&$#%|]{1}"), "junk").when(F.length("text") < 200, "short").otherwise("fine").alias("a"),
        F.when(F.col("text").rlike(r"[*&$#%|!]{2}"), "junk").when(F.length("text") < 300, "short").otherwise("fine").alias("b"),
    )
    found = x.cohen_kappa(docs, "a", "b")
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def percentile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    nearest = x.nearest_percentiles(docs, ["lang"], "n_chars", {"nearest_50": 0.5, "nearest_95": 0.95})
    others = docs.groupBy("lang").agg(
        *[x.interpolated_percentile("n_chars", q).alias(f"linear_{n}") for n, q in (("50", 0.5), ("75", 0.75))],
        *[x.ceiling_percentile("n_chars", q).cast("long").alias(f"ceiling_{n}") for n, q in (("50", 0.5), ("75", 0.75))],
    )
    return others.join(nearest, "lang")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).groupBy(F.col("source").alias("cluster")).agg(F.count_if(F.col("gold").eqNullSafe(F.col("predicted"))).alias("top"), F.count("*").alias("bottom"))
    found = x.clustered_bootstrap(rows, "top", "bottom", "b1", 200)
    return found.select("n_clusters", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


def error_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    why = p.decision_error(F.col("gold").eqNullSafe(F.col("predicted")), F.col("predicted_value").isNotNull(), F.coalesce(F.col("predicted"), F.lit("unknown")) == "unknown")
    counts = rows.groupBy(why.alias("category")).agg(F.count("*").alias("n"))
    return p.with_zeros(counts, "category", ("correct", "retrieval_failure", "false_abstention", "decision_error"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with evidence: each document cites its id, every 19th by length another one, every 23rd none."""
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    own = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", "lang", (n % 29 != 0).alias("schema_valid"), F.when(n % 23 == 0, F.array().cast("array<string>")).when(n % 19 == 0, F.array(own, F.lit("x"))).otherwise(F.array(own)).alias("cited"), F.array(own).alias("known"),
        (F.col("lang") != "de").alias("needs_evidence"), F.when(n % 17 == 0, "bytes").when(n % 37 != 0, "chars").alias("unit"), F.lit("chars").alias("expected_unit"), (n % 31 != 0).alias("verifier_agrees"),
        F.when(n < 300, "unknown").when(F.col("text").rlike(r"[*&$#%|]"), "absent").otherwise("present").alias("status"), F.floor(n / 100).cast("double").alias("value"),
        F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "present").otherwise("absent").alias("gold_status"), F.lit("chars").alias("gold_unit"), F.floor(F.col("n_chars") / 100).cast("double").alias("gold_value"),
    )


def abstention_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.projected(_predictions(spark, sf_dir))
    return found.select("doc_id", "status", "value", "abstained", F.coalesce("reason", F.lit("")).alias("reason"), F.size("cited").cast("long").alias("n_cited"))


def abstention_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = p.projected(_predictions(spark, sf_dir)).where("reason is not null").groupBy("lang", "reason").agg(F.count("*").alias("n"))
    return p.with_zeros(counts, "reason", p.ABSTENTION, ("lang",))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    right = F.col("status") == F.col("gold_status")
    before = p.operating_point(rows, F.col("status") != "unknown", right).withColumn("stage", F.lit("before"))
    after = p.operating_point(p.projected(rows), F.col("status") != "unknown", right).withColumn("stage", F.lit("after"))
    found = before.unionByName(after)
    return found.select("stage", "n", "answered", "wrong", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"))


def attribution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    counts = rows.select(p.attribution(rows).alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    return p.with_zeros(counts, "category", p.ATTRIBUTION)


QUERIES = {f.__name__: f for f in (
    confusion_matrix, class_metrics, class_summary, numeric_value_metrics, coverage_risk, recall_mrr_ndcg, hit_at_k, kappa, percentile_variants, bootstrap_ci, error_attribution,
    abstention_projection, abstention_reasons, operating_points, attribution_counts,
)}

_ROWS = """l AS (SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + len(regexp_extract_all(text, '[*&$#%|!]'))), 3) AS score FROM documents JOIN labels USING (doc_id)),
r AS (SELECT doc_id, source, lang, CASE WHEN quality = 1 THEN 'present' ELSE 'absent' END AS gold, CASE WHEN score >= 0.5 THEN 'present' WHEN score >= 0.05 THEN 'unknown' WHEN length(text) % 7 = 0 THEN NULL ELSE 'absent' END AS predicted, score,
  CASE WHEN toxic = 1 THEN NULL ELSE n_chars::DOUBLE END AS gold_value, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE round(length(text)::DOUBLE / 10) * 10 END AS predicted_value,
  CASE WHEN length(text) % 13 = 0 THEN 'bytes' ELSE 'chars' END AS predicted_unit FROM l)"""
_CELLS = f"""WITH {_ROWS}, s(label) AS (VALUES ('present'), ('absent'), ('unknown')), p AS (SELECT gold, coalesce(predicted, 'missing') AS predicted FROM r),
c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM p, s GROUP BY label),
m AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)"""
_NUM = """count(gold_value) AS n_gold, count(*) FILTER (gold_value IS NOT NULL AND predicted_value IS NOT NULL) AS n_predicted, count(*) FILTER (valid) AS n_valid, count(*) FILTER (gold_value IS NOT NULL AND predicted_value IS NOT NULL AND NOT valid) AS n_invalid_unit,
  round(n_predicted::DOUBLE / nullif(n_gold, 0), 9) AS coverage, round(avg(abs(predicted_value - gold_value)) FILTER (valid), 9) AS mae,
  round((count(*) FILTER (valid AND abs(predicted_value - gold_value) <= 2))::DOUBLE / nullif(n_valid, 0), 9) AS within_of_valid, round((count(*) FILTER (valid AND abs(predicted_value - gold_value) <= 2))::DOUBLE / nullif(n_gold, 0), 9) AS within_of_gold"""
_DENSE = f"""dense AS (SELECT q.vec_id AS query_id, v.vec_id AS item, {r'list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE))'} AS score FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id AND q.vec_id % 100 = 0),
ranked AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM dense QUALIFY rank <= 50),
rel AS (SELECT q.vec_id AS query_id, e.vec_id AS item, CASE WHEN e.vec_id // 100 = q.vec_id // 100 THEN 2 ELSE 1 END AS grade FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id <> q.vec_id AND q.vec_id % 100 = 0)"""
_PRED = """q AS (SELECT doc_id, lang, length(text) AS n, length(text) % 29 <> 0 AS schema_valid, CASE WHEN length(text) % 23 = 0 THEN 0 WHEN length(text) % 19 = 0 THEN 2 ELSE 1 END AS n_cited, lang <> 'de' AS needs,
  CASE WHEN length(text) % 17 = 0 THEN 'bytes' WHEN length(text) % 37 <> 0 THEN 'chars' END AS unit, length(text) % 31 <> 0 AS agrees,
  CASE WHEN length(text) < 300 THEN 'unknown' WHEN regexp_matches(text, '[*&$#%|]') THEN 'absent' ELSE 'present' END AS status, floor(length(text)::DOUBLE / 100) AS value,
  CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'present' ELSE 'absent' END AS gold_status, floor(n_chars::DOUBLE / 100) AS gold_value FROM documents JOIN labels USING (doc_id)),
w AS (SELECT *, CASE WHEN NOT schema_valid THEN 'invalid_schema' WHEN n_cited = 2 THEN 'unusable_evidence' WHEN needs AND n_cited = 0 AND status <> 'unknown' THEN 'missing_evidence' WHEN unit IS DISTINCT FROM 'chars' THEN 'incompatible_unit' WHEN NOT agrees THEN 'verifier_conflict' WHEN status = 'unknown' THEN 'missing_fact' END AS reason FROM q)"""
_POINT = "count(*) AS n, count(*) FILTER (s <> 'unknown') AS answered, count(*) FILTER (s <> 'unknown' AND s <> gold_status) AS wrong, round(answered::DOUBLE / n, 9) AS coverage, round(wrong::DOUBLE / nullif(answered, 0), 9) AS risk"

ORACLES = {
    "confusion_matrix": f"WITH {_ROWS}, g(gold) AS (VALUES ('present'), ('absent'), ('unknown')), h(predicted) AS (VALUES ('present'), ('absent'), ('unknown'), ('missing')) SELECT g.gold, h.predicted, (SELECT count(*) FROM r WHERE r.gold = g.gold AND coalesce(r.predicted, 'missing') = h.predicted) AS n FROM g, h",
    "class_metrics": _CELLS + " SELECT label, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m",
    "class_summary": _CELLS + " SELECT round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(sum(f1) FILTER (tp + fp + fn > 0) / count(*) FILTER (tp + fp + fn > 0), 9) AS macro_f1, round(avg(f1), 9) AS macro_f1_all FROM m",
    "numeric_value_metrics": f"WITH {_ROWS}, v AS (SELECT *, coalesce(gold_value IS NOT NULL AND predicted_value IS NOT NULL AND predicted_unit = 'chars', false) AS valid FROM r) SELECT lang, {_NUM} FROM v GROUP BY lang UNION ALL SELECT '(all)', {_NUM} FROM v",
    "coverage_risk": f"""WITH {_ROWS}, b AS (SELECT score, count(*) AS n, count(*) FILTER (predicted <> 'unknown') AS a, count(*) FILTER (predicted <> 'unknown' AND predicted <> gold) AS w FROM r GROUP BY score)
SELECT score AS threshold, CAST(sum(a) OVER o AS BIGINT) AS answered, round((sum(a) OVER o)::DOUBLE / (sum(n) OVER ())::DOUBLE, 9) AS coverage, round((sum(w) OVER o)::DOUBLE / nullif((sum(a) OVER o)::DOUBLE, 0), 9) AS risk FROM b WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT NULL, 0, 0.0::DOUBLE, NULL""",
    "recall_mrr_ndcg": f"""WITH {_DENSE}, j AS (SELECT rel.*, rank, row_number() OVER (PARTITION BY rel.query_id ORDER BY grade DESC, rel.item) AS ir FROM rel LEFT JOIN ranked USING (query_id, item))
SELECT query_id, count(*) AS n_relevant, round((count(*) FILTER (rank <= 10))::DOUBLE / count(*), 9) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS reciprocal_rank,
  round(coalesce(sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) / sum((2.0::DOUBLE ** grade - 1) / log2(ir + 1)) FILTER (ir <= 10), 9) AS ndcg FROM j GROUP BY query_id""",
    "hit_at_k": f"WITH {_DENSE}, b AS (SELECT query_id, min(item) AS item FROM rel WHERE grade = 2 GROUP BY query_id) SELECT count(*) AS n, " + ", ".join(f"round((count(*) FILTER (rank <= {k}))::DOUBLE / count(*), 9) AS hit_at_{k}" for k in (1, 5, 50)) + " FROM b LEFT JOIN ranked USING (query_id, item)",
    "kappa": r"""WITH d AS (SELECT CASE WHEN regexp_matches(text, '[*&$#%|]{1}') THEN 'junk' WHEN length(text) < 200 THEN 'short' ELSE 'fine' END AS a, CASE WHEN regexp_matches(text, '[*&$#%|!]{2}') THEN 'junk' WHEN length(text) < 300 THEN 'short' ELSE 'fine' END AS b FROM documents),
t AS (SELECT count(*) AS n, (count(*) FILTER (a = b))::DOUBLE / count(*) AS o FROM d), e AS (SELECT sum(x.n::DOUBLE * y.n) AS c FROM (SELECT a, count(*) AS n FROM d GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM d GROUP BY b) y ON x.a = y.b)
SELECT n, round(o, 9) AS observed, round(c / n / n, 9) AS expected, round((o - c / n / n) / (1 - c / n / n), 9) AS kappa FROM t, e""",
    "percentile_variants": """SELECT lang, quantile_cont(n_chars, 0.5)::DOUBLE AS linear_50, quantile_cont(n_chars, 0.75)::DOUBLE AS linear_75,
  list_sort(list(n_chars))[1 + CAST(round_even((count(*) - 1) * 0.5, 0) AS INTEGER)] AS nearest_50, list_sort(list(n_chars))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS INTEGER)] AS nearest_95,
  list_sort(list(n_chars))[CAST(ceil(count(*) * 0.5) AS INTEGER)] AS ceiling_50, list_sort(list(n_chars))[CAST(ceil(count(*) * 0.75) AS INTEGER)] AS ceiling_75 FROM documents GROUP BY lang""",
    "bootstrap_ci": f"""WITH {_ROWS}, k AS (SELECT source, count(*) FILTER (gold IS NOT DISTINCT FROM predicted) AS t, count(*) AS b, row_number() OVER (ORDER BY source) - 1 AS o FROM r GROUP BY source), z AS (SELECT count(*) AS size FROM k),
d AS (SELECT rep, ('0x' || substr(md5('b1|' || rep || '|' || slot), 1, 8))::BIGINT % size AS o FROM z, (SELECT unnest(range(1, 201)) AS rep), (SELECT unnest(range(1, (SELECT size FROM z) + 1)) AS slot)),
v AS (SELECT rep, sum(t)::DOUBLE / sum(b)::DOUBLE AS v FROM d JOIN k USING (o) GROUP BY rep)
SELECT (SELECT size FROM z) AS n_clusters, (SELECT round(sum(t)::DOUBLE / sum(b)::DOUBLE, 9) FROM k) AS estimate, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM v""",
    "error_attribution": f"""WITH {_ROWS}, c AS (SELECT CASE WHEN gold IS NOT DISTINCT FROM predicted THEN 'correct' WHEN predicted_value IS NULL THEN 'retrieval_failure' WHEN coalesce(predicted, 'unknown') = 'unknown' THEN 'false_abstention' ELSE 'decision_error' END AS category FROM r),
d(category) AS (VALUES ('correct'), ('retrieval_failure'), ('false_abstention'), ('decision_error')) SELECT category, (SELECT count(*) FROM c WHERE c.category = d.category) AS n FROM d""",
    "abstention_projection": f"WITH {_PRED} SELECT doc_id, CASE WHEN reason IS NULL THEN status ELSE 'unknown' END AS status, CASE WHEN reason IS NULL THEN value END AS value, reason IS NOT NULL AS abstained, coalesce(reason, '') AS reason, CAST(CASE WHEN reason = 'unusable_evidence' THEN 0 ELSE n_cited END AS BIGINT) AS n_cited FROM w",
    "abstention_reasons": f"WITH {_PRED}, d(reason) AS (VALUES " + ", ".join(f"('{k}')" for k in p.ABSTENTION) + "), l AS (SELECT DISTINCT lang FROM w WHERE reason IS NOT NULL) SELECT lang, reason, (SELECT count(*) FROM w WHERE w.reason = d.reason AND w.lang = l.lang) AS n FROM l, d",
    "operating_points": f"WITH {_PRED} SELECT 'before' AS stage, {_POINT} FROM (SELECT status AS s, gold_status FROM w) UNION ALL SELECT 'after', {_POINT} FROM (SELECT CASE WHEN reason IS NULL THEN status ELSE 'unknown' END AS s, gold_status FROM w)",
    "attribution_counts": f"""WITH {_PRED}, c AS (SELECT CASE WHEN status <> 'unknown' AND (n_cited = 2 OR (n_cited = 0 AND needs)) THEN 'unsupported' WHEN unit IS DISTINCT FROM 'chars' THEN 'unit' WHEN gold_status <> 'unknown' AND status = 'unknown' THEN 'abstention_on_known'
  WHEN gold_status = 'present' AND status = 'present' AND gold_value IS DISTINCT FROM value THEN 'numeric_value' WHEN gold_status <> status THEN 'status'
  WHEN (CASE WHEN gold_status = 'unknown' THEN value IS NOT NULL ELSE gold_value IS DISTINCT FROM value END) THEN 'other' END AS category FROM q), d(category) AS (VALUES """ + ", ".join(f"('{k}')" for k in p.ATTRIBUTION) + ") SELECT category, (SELECT count(*) FROM c WHERE c.category = d.category) AS n FROM d",
}
