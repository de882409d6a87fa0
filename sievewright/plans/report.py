"""Reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as r
from ..operators import sampling as s
from ..session import table
from .texts import NUMBERS_SQL


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON answer per document: every 7th length is broken off, every 5th lacks a question, every 3rd has a bad status."""
    n = F.length("text")
    body = F.concat(
        F.lit('{"assessments":[{"question_id":"q1","fact_status":"'), F.when(n % 3 == 0, "maybe").otherwise("present"), F.lit('","value":'), F.col("n_chars").cast("string"), F.lit('}'),
        F.when(n % 5 == 0, "").otherwise(',{"question_id":"q2","fact_status":"unknown"}'), F.lit("]}"),
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("output_id"), F.when(n % 7 == 0, F.substring(body, 1, 40)).otherwise(body).alias("content"))


def model_output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.model_output_rows(_outputs(spark, sf_dir), ("q1", "q2"))
    return found.select("output_id", "question_id", "status", F.coalesce("value", F.lit(-1.0)).alias("value"), "abstained", F.coalesce("reason", F.lit("")).alias("reason"))


def numeric_occurrence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 2 (or the length, in every third document) stands among a document's numbers; two mock retrievers."""
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    values = docs.select(F.col("doc_id").alias("key"), F.when(n % 4 == 0, "boolean").otherwise("numeric").alias("kind"), F.when(n % 9 == 0, "unknown").otherwise("present").alias("status"), F.when(n % 3 == 0, n.cast("double")).otherwise(2.0).alias("value"))
    texts = docs.select(F.col("doc_id").alias("key"), F.lit(0).alias("chunk_id"), F.substring("text", 1, 400).alias("text")).unionByName(docs.select(F.col("doc_id").alias("key"), F.lit(1).alias("chunk_id"), F.expr("substring(text, 401)").alias("text")))
    ranks = texts.select("key", "chunk_id", F.lit("head_first").alias("retriever"), (F.col("chunk_id") + 1).alias("rank")).unionByName(texts.select("key", "chunk_id", F.lit("tail_first").alias("retriever"), (2 - F.col("chunk_id")).alias("rank")))
    found = r.numeric_occurrence(values, texts, ranks, protocol_value=0.0)
    return found.select("retriever", "n_boolean", "n_numeric_unknown", "n_protocol_value", "n_full_context_absent", "evaluable", "at_1", "at_3", F.round("rate_1", 9).alias("rate_1"), F.round("rate_3", 9).alias("rate_3"))


def semantic_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = s.holdout(table(spark, sf_dir, "embeddings"), "vec_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1")
    return r.scan_summary(members, 1000, 10, exhaustive=True).withColumn("problem", F.coalesce("problem", F.lit("")))


def pilot_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    junk = F.col("text").rlike(r"[*&$#%|]")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("unit_id"), F.when(junk, "no").otherwise("yes").alias("a_decision"), F.when(junk | (n % 10 == 0), "no").otherwise("yes").alias("b_decision"), (n % 3).alias("a_grade"), (F.col("n_chars") % 3).alias("b_grade"),
        F.array("source", "lang").alias("a_evidence"), F.when(n % 8 == 0, F.array("lang")).otherwise(F.array("lang", "source", "lang")).alias("b_evidence"), (n % 60).cast("double").alias("minutes"),
    )
    found = r.pilot_summary(docs)
    return found.select(*[F.round(c, 9).alias(c) if "agreement" in c or "rate" in c else F.col(c) for c in found.columns])


def wide_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass flags over a wide table of users, with empty cells where a user has no such event."""
    sums = table(spark, sf_dir, "events").where("value > 100").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.max("value"), 2))
    flags = sums.select("user_id", "view", "click", *[F.when(F.col(c).isNotNull(), (F.col(c) > 150).cast("int")).alias(c) for c in ("error", "purchase", "signup")])
    return flags.select("user_id", r.all_flags([r.yes("purchase"), r.no("error")], [r.yes("signup")]).alias("crit1"), r.all_flags([r.bounded("view", most=180.0, missing=True)], [r.yes("error")]).alias("crit2"), r.all_flags([r.bounded("view", least=110.0), r.bounded("click", most=200.0)], []).alias("crit3"))


def capacity_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "region").agg(F.count("*").alias("annotators")).select("annotators", F.lit(40.0).alias("hours"), F.lit(0.2).alias("reserve"), F.lit(2).alias("annotations_per_unit"), F.lit(6.5).alias("minutes_per_annotation"), F.lit(0.25).alias("dispute_rate"), F.lit(8.0).alias("minutes_per_dispute"))
    return r.capacity_designs(given, 4, 12, 60)


def neighbour_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("junk", F.size(F.regexp_extract_all("text", F.lit(r"[*&$#%|!]"), F.lit(0))))
    return r.neighbour_information(rows, {"length": "n_chars", "junk": "junk", "id": "doc_id"}, "quality")


QUERIES = {f.__name__: f for f in (model_output_parse, numeric_occurrence_report, semantic_scan_summary, pilot_agreement, wide_flags, capacity_plan, neighbour_mi)}

_NUM = f"list_filter({NUMBERS_SQL}, lambda d: d IS NOT NULL)"
_PLACE = "(('0x' || substr(sha256('split-1|' || vec_id), 1, 8))::BIGINT::DOUBLE / 4294967296)"

ORACLES = {
    "model_output_parse": """WITH o AS (SELECT doc_id, n_chars, CASE WHEN length(text) % 7 = 0 THEN 'invalid_json' WHEN length(text) % 3 = 0 THEN 'invalid_schema' WHEN length(text) % 5 = 0 THEN 'incomplete' ELSE '' END AS reason FROM documents)
SELECT doc_id AS output_id, q AS question_id, CASE WHEN reason = '' AND q = 'q1' THEN 'present' ELSE 'unknown' END AS status, CASE WHEN reason = '' AND q = 'q1' THEN n_chars::DOUBLE ELSE -1.0::DOUBLE END AS value, NOT (reason = '' AND q = 'q1') AS abstained, reason FROM o, (VALUES ('q1'), ('q2')) v(q)""",
    "numeric_occurrence_report": f"""WITH c AS (SELECT doc_id, 0 AS k, substring(text, 1, 400) AS text FROM documents UNION ALL SELECT doc_id, 1, substring(text, 401) FROM documents),
v AS (SELECT doc_id, length(text) % 4 = 0 AS b, length(text) % 9 = 0 AS u, CASE WHEN length(text) % 3 = 0 THEN length(text)::DOUBLE ELSE 2.0::DOUBLE END AS value FROM documents),
h AS (SELECT doc_id, k, list_contains({_NUM}, value::DECIMAL(38,10)) AS hit FROM c JOIN v USING (doc_id)), f AS (SELECT doc_id, bool_or(hit) AS any_, bool_or(hit) FILTER (k = 0) AS h0, bool_or(hit) FILTER (k = 1) AS h1 FROM h GROUP BY doc_id),
e AS (SELECT *, CASE WHEN b THEN 'b' WHEN u THEN 'u' WHEN value = 0 THEN 'p' WHEN NOT any_ THEN 'a' ELSE '' END AS x FROM v JOIN f USING (doc_id))
SELECT retriever, count(*) FILTER (x = 'b') AS n_boolean, count(*) FILTER (x = 'u') AS n_numeric_unknown, count(*) FILTER (x = 'p') AS n_protocol_value, count(*) FILTER (x = 'a') AS n_full_context_absent, count(*) FILTER (x = '') AS evaluable,
  count(*) FILTER (x = '' AND CASE WHEN retriever = 'head_first' THEN h0 ELSE h1 END) AS at_1, count(*) FILTER (x = '') AS at_3, round(at_1::DOUBLE / evaluable, 9) AS rate_1, round(at_3::DOUBLE / evaluable, 9) AS rate_3 FROM e, (VALUES ('head_first'), ('tail_first')) r(retriever) GROUP BY retriever""",
    "semantic_scan_summary": f"""WITH m AS (SELECT CASE WHEN {_PLACE} < 0.7::DOUBLE THEN 'a' WHEN {_PLACE} < 0.85::DOUBLE THEN 'b' ELSE 'c' END AS split FROM embeddings), s AS (SELECT split, count(*) AS n FROM m GROUP BY split), x AS (SELECT CAST(sum(a.n * b.n) AS BIGINT) AS e FROM s a JOIN s b ON a.split < b.split)
SELECT e AS expected_pairs, 1000::BIGINT AS evaluated_pairs, 10::BIGINT AS retained_pairs, CASE WHEN 1000 > e THEN 'evaluated_exceeds_possible' WHEN e <> 1000 THEN 'exhaustive_incomplete' ELSE '' END AS problem FROM x""",
    "pilot_agreement": """WITH d AS (SELECT regexp_matches(text, '[*&$#%|]') AS j, length(text) AS n, n_chars FROM documents), x AS (SELECT (j OR n % 10 <> 0) AS dec, n % 3 = n_chars % 3 AS gr, n % 8 <> 0 AS ev, (n % 60)::DOUBLE AS m FROM d)
SELECT count(*) AS n_units, round((count(*) FILTER (dec))::DOUBLE / count(*), 9) AS decision_agreement, round((count(*) FILTER (gr))::DOUBLE / count(*), 9) AS grade_agreement, round((count(*) FILTER (ev))::DOUBLE / count(*), 9) AS evidence_agreement, round((count(*) FILTER (NOT (dec AND gr AND ev)))::DOUBLE / count(*), 9) AS dispute_rate,
  list_sort(list(m))[CAST(ceil(count(*) * 0.5) AS INTEGER)] AS median_minutes, list_sort(list(m))[CAST(ceil(count(*) * 0.75) AS INTEGER)] AS p75_minutes FROM x""",
    "wide_flags": """WITH s AS (SELECT user_id, """ + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 2) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + """ FROM events WHERE value > 100 GROUP BY user_id)
SELECT user_id, coalesce(purchase > 150, false) AND coalesce(error <= 150, false) AND NOT coalesce(signup > 150, false) AS crit1, coalesce(view <= 180, true) AND NOT coalesce(error > 150, false) AS crit2, coalesce(view >= 110, false) AND coalesce(click <= 200, false) AS crit3 FROM s""",
    "capacity_plan": "WITH x AS (SELECT CAST(floor(count(*) * 40.0::DOUBLE * 60 * (1 - 0.2::DOUBLE) / (2 * 6.5::DOUBLE + 0.25::DOUBLE * 8)) AS BIGINT) AS u FROM region) SELECT u AS max_units, CAST(g AS INTEGER) AS groups, u // g AS members, g * (u // g) AS units, u // g >= 60 AS feasible FROM x, (SELECT unnest(range(4, 13)) AS g)",
}
