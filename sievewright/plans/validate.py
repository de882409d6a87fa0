"""Validators over artifacts made of the driver's tables, with faults planted by arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as g
from ..operators import reports
from ..operators import validators as v
from ..session import table

STATUSES = ("present", "absent", "unknown")


def prediction_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select("doc_id")
    made = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select("doc_id")
    return v.stray_predictions(gold, made.unionByName(made.where("doc_id % 20 = 0")), ["doc_id"])


def selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    passed = F.col("p_size") <= 20
    hashed = F.sha2(F.concat(F.lit("m|7|"), F.col("p_partkey")), 256)
    rows = part.select(
        F.col("p_partkey").alias("record_id"), passed.alias("filter_passed"), F.when(passed & (F.col("p_partkey") % 41 != 0) | (F.col("p_partkey") % 43 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("size"))).alias("reasons"),
        F.when(F.col("p_partkey") % 37 == 0, F.lit("0")).when(passed, hashed).alias("sampling_hash"), (F.col("p_partkey") % 10 == 0).alias("selected"),
    )
    return v.selection_violations(rows, "m", "7", 15)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("question"), F.when(n % 5 == 0, "unknown").when(n % 2 == 0, "present").otherwise("absent").alias("status"), F.when((n % 5 != 0) & (n % 2 == 0), F.col("n_chars")).alias("value"))
    found = g.question_profile(rows, "question", "status", "value", STATUSES).withColumnRenamed("greatest", "most")
    k = F.length("question")
    return found.select(
        "question", F.when(F.col("question").endswith("en"), "boolean").otherwise("numeric").alias("kind"), (F.col("n") + F.when(k % 4 == 0, 1).otherwise(0)).alias("n"), *[f"n_{s}" for s in STATUSES],
        (F.col("unknown_rate") + F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("unknown_rate"), F.when(~F.col("question").endswith("en"), F.col("n_present")).alias("n_values"),
        F.when(~F.col("question").endswith("fr"), F.col("least")).alias("least"), F.col("most").alias("greatest"),
    )


def quality_report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir)
    catalog = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("question"), F.when(F.col("lang") == "en", "boolean").otherwise("numeric").alias("kind")).distinct()
    return v.profile_violations(found.where("not question like '%es'"), STATUSES, catalog)


def reservation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("doc_id")
    parts = keys.where("doc_id % 50 <> 3").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "calibration").otherwise("fit").alias("part")).unionByName(keys.where("doc_id % 45 = 0").select("doc_id", F.lit("fit").alias("part")))
    return v.reservation_violations(parts, keys, "doc_id", 12, "reserve-1")


def adjudication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    units = docs.select(F.col("doc_id").alias("unit_id"))
    one = docs.select(F.col("doc_id").alias("unit_id"), F.lit("a").alias("annotator"), F.lit("eligible").alias("decision"), F.lit(2).alias("grade"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence"))
    other = docs.where("doc_id % 31 <> 0").select(F.col("doc_id").alias("unit_id"), F.lit("b").alias("annotator"), F.when(F.col("n") % 4 == 0, "unknown").otherwise("eligible").alias("decision"), F.lit(2).alias("grade"), F.when(F.col("n") % 6 == 0, F.array(F.lit("e1"))).otherwise(F.array(F.lit("e2"), F.lit("e1"))).alias("evidence"))
    said = F.array_compact(F.array(F.when(F.col("n") % 4 == 0, "decision"), F.when(F.col("n") % 12 == 0, "evidence")))
    made = docs.where("doc_id % 29 <> 0").select(F.col("doc_id").alias("unit_id"), said.alias("disagreements"), F.when(F.size(said) > 0, "resolved").otherwise("agreed_without_dispute").alias("resolution"), (F.col("n") % 8).cast("double").alias("minutes"), F.when(F.col("doc_id") % 17 != 0, "eligible").alias("decision"), F.lit(1).alias("grade"))
    return v.adjudication_violations(units, one.unionByName(other), made)


def input_plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    known = talk.where("turn < 6").select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("evidence_id"))
    plan = talk.groupBy(F.col("conv_id").alias("entity_id")).agg(F.max("turn").alias("last")).select("entity_id", F.lit("q").alias("question_id"), F.when(F.col("entity_id") % 7 == 0, F.array().cast("array<bigint>")).when(F.col("entity_id") % 5 == 0, F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("evidence_ids"))
    return v.input_plan_violations(plan.unionByName(plan.where("entity_id % 11 = 0")), known)


def capacity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = spark.createDataFrame([(3, 40.0, 0.1, 2, 12.0, 0.2, 20.0)], "annotators int, hours double, reserve double, annotations_per_unit int, minutes_per_annotation double, dispute_rate double, minutes_per_dispute double")
    due = reports.capacity_designs(budget, 2, 12, 20)
    found = due.where("groups <> 5").withColumn("units", F.col("units") + F.when(F.col("groups") == 7, 1).otherwise(0))
    return v.recomputed_violations(found, due, ["groups"])


def public_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.concat(F.lit("docs/"), n.cast("string"), F.when(n % 5 == 0, ".CSV").when(n % 7 == 0, "").when(n % 11 == 0, ".bin").otherwise(".md"))
    text = F.concat("text", F.when(n % 13 == 0, "\nhadm_id: 1234567").when(n % 17 == 0, "\nnote 12345-DS-7").otherwise(""))
    files = table(spark, sf_dir, "documents").select(name.alias("path"), F.length("text").alias("size"), text.alias("text"))
    return v.public_file_problems(files, ("7",), most_bytes=15_000, marker="the")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (n % 3 == 0).alias("right"), F.when(F.col("lang") != "de", F.abs(n - F.col("n_chars")) + n % 10).alias("error"), F.when(n % 4 == 0, "unknown").otherwise("present").alias("status"))


def question_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.question_means(_judged(spark, sf_dir), "lang", F.col("right"), F.col("error"))
    return found.select("n_questions", "n_with_error", *[F.round(c, 9).alias(c) for c in ("micro_correct", "micro_error", "macro_correct", "macro_error")])


def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.label_tokens(_judged(spark, sf_dir), "source", "lang", "status", "status")


def hidden_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return v.hidden_cells(g.suppressed(counts, ["lang"], "source", "n", 5), ["lang"])


def group_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.group_content_hash(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = v.candidate_label(F.when(F.col("doc_id") % 9 != 0, F.col("quality")), F.col("toxic"))
    return table(spark, sf_dir, "labels").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def selected_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").where("length(text) > 0").select(F.col("conv_id").alias("scope"), F.col("turn").alias("chunk_id"), F.col("turn").alias("start"), F.length("text").cast("long").alias("length"))
    found = v.selected_input(chunks, "full").withColumn("policy", F.lit("full")).unionByName(v.selected_input(chunks, "prefix", 700).withColumn("policy", F.lit("prefix")))
    return found.groupBy("policy", "scope").agg(F.count("*").alias("n"), F.max("used").alias("used"))


QUERIES = {f.__name__: f for f in (
    prediction_strays, selection_audit, quality_report_violations, reservation_violations, adjudication_violations, input_plan_violations, capacity_violations, public_files, question_means, label_tokens, hidden_cells, group_content_hash,
    candidate_labels, selected_input,
)}


def _problems(rows: str, key: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({key} AS VARCHAR) AS key, '{name}' AS problem FROM {rows} WHERE {broken}" for name, broken in checks.items())


_JUDGED = "j AS (SELECT doc_id, source, lang, length(text) % 3 = 0 AS ok, CASE WHEN lang <> 'de' THEN abs(length(text) - n_chars) + length(text) % 10 END AS err, CASE WHEN length(text) % 4 = 0 THEN 'unknown' ELSE 'present' END AS status FROM documents)"
_TALK = "SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE length(text) > 0"

ORACLES = {
    "prediction_strays": """SELECT CAST(doc_id AS VARCHAR) AS key, 'outside_gold' AS problem FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 20 = 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'repeated' FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 20 = 0""",
    "selection_audit": """WITH r AS (SELECT p_partkey AS id, p_size <= 20 AS ok, NOT ((p_size <= 20 AND p_partkey % 41 <> 0) OR p_partkey % 43 = 0) AS reasoned, sha256('m|7|' || p_partkey) AS due_hash, CASE WHEN p_partkey % 37 = 0 THEN '0' WHEN p_size <= 20 THEN due_hash END AS h, p_partkey % 10 = 0 AS sel FROM part),
t AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok ORDER BY h, id) <= 15 AS due FROM r) """ + _problems("t", "id", {"wrong_hash": "ok AND h <> due_hash", "hash_of_excluded": "NOT ok AND h IS NOT NULL", "reasons_of_passed": "ok AND reasoned", "excluded_without_reason": "NOT ok AND NOT reasoned", "not_the_selection": "sel <> due"}) + " UNION ALL SELECT 'all', 'target_missed' FROM (SELECT count(*) FILTER (sel) AS n FROM t) WHERE n <> 15",
    "quality_report_violations": """WITH d AS (SELECT source || '-' || lang AS q, lang, CASE WHEN length(text) % 5 = 0 THEN 'unknown' WHEN length(text) % 2 = 0 THEN 'present' ELSE 'absent' END AS s, n_chars FROM documents),
p AS (SELECT q, any_value(lang) AS lang, count(*) AS n, count(*) FILTER (s = 'present') AS np, count(*) FILTER (s = 'unknown') AS nu, min(n_chars) FILTER (s = 'present') AS lo, max(n_chars) FILTER (s = 'present') AS hi FROM d GROUP BY q),
f AS (SELECT *, lang = 'en' AS flag, n + CASE WHEN length(q) % 4 = 0 THEN 1 ELSE 0 END AS said, length(q) % 5 = 0 AS off FROM p WHERE NOT q LIKE '%es') """
    + _problems("f", "q", {"counts": "said <> n", "rate": "abs(round(nu::DOUBLE / n::DOUBLE, 6) + CASE WHEN off THEN 0.5 ELSE 0 END - nu::DOUBLE / said::DOUBLE) > 1e-6", "range": "NOT flag AND np > 0 AND lang = 'fr'", "range_of_boolean": "flag AND lo IS NOT NULL"}) + " UNION ALL SELECT DISTINCT q, 'missing_question' FROM d WHERE q LIKE '%es'",
    "reservation_violations": """WITH k AS (SELECT doc_id AS id, doc_id % 50 <> 3 AS there, doc_id % 9 = 0 AS res, row_number() OVER (ORDER BY sha256('reserve-1|' || doc_id)) <= 12 AS due FROM documents), c AS (SELECT *, there OR id % 45 = 0 AS covered, there AND res AS got, there AND res AND id % 45 = 0 AS two FROM k) """
    + _problems("c", "id", {"in_both_parts": "two", "not_covered": "NOT covered", "other_selection": "covered AND got <> due"}) + " UNION ALL SELECT 'all', 'reserved_count' FROM (SELECT count(*) FILTER (got) AS n FROM c) WHERE n <> 12",
    "adjudication_violations": """WITH u AS (SELECT doc_id AS id, length(text) AS n, doc_id % 31 <> 0 AS two, doc_id % 29 <> 0 AS there FROM documents), x AS (SELECT *, two AND n % 4 = 0 AS dd, two AND n % 6 = 0 AS ed, n % 4 = 0 AS sd, n % 12 = 0 AS se FROM u), y AS (SELECT *, dd OR ed AS dispute, sd OR se AS said FROM x) """
    + _problems("y", "id", {"not_two_annotators": "NOT two", "not_covered": "NOT there", "disagreements": "there AND (dd <> sd OR ed <> se)", "agreed_disputed": "there AND dispute AND NOT said", "disputed_agreed": "there AND NOT dispute AND said", "no_time": "there AND dispute AND n % 8 = 0", "no_judgment": "there AND id % 17 = 0"}),
    "input_plan_violations": """WITH p AS (SELECT conv_id AS id, max(turn) AS l FROM conversations GROUP BY conv_id), k AS (SELECT conv_id AS id, turn AS t FROM conversations WHERE turn < 6), s AS (SELECT id, unnest(CASE WHEN id % 7 = 0 THEN []::BIGINT[] WHEN id % 5 = 0 THEN [0, 0]::BIGINT[] ELSE [0, l]::BIGINT[] END) AS t FROM p),
r AS (SELECT id, l FROM p UNION ALL SELECT id, l FROM p WHERE id % 11 = 0)
SELECT DISTINCT id || '/q' AS key, 'foreign_chunk' AS problem FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = s.id AND k.t = s.t) UNION ALL SELECT id || '/q', 'repeated_row' FROM p WHERE id % 11 = 0 UNION ALL SELECT id || '/q', 'no_chunk' FROM r WHERE id % 7 = 0
UNION ALL SELECT id || '/q', 'repeated_chunk' FROM r WHERE id % 7 <> 0 AND (id % 5 = 0 OR l = 0)""",
    "capacity_violations": "SELECT * FROM (VALUES ('5', 'missing'), ('7', 'other_values')) v(key, problem)",
    "public_files": """WITH f AS (SELECT doc_id AS id, 'docs/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.CSV' WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN '.bin' ELSE '.md' END AS path, length(text) AS n, text, doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 <> 0) AS t FROM documents) """
    + _problems("f", "path", {"forbidden_type": "id % 5 = 0", "forbidden_name": "path = 'docs/7'", "too_large": "n > 15000", "no_marker": "t AND NOT contains(lower(text || CASE WHEN id % 13 = 0 THEN 'hadm_id' WHEN id % 17 = 0 THEN 'note' ELSE '' END), 'the')", "numeric_identifier": "t AND id % 13 = 0", "note_identifier": "t AND id % 13 <> 0 AND id % 17 = 0"}),
    "question_means": f"WITH {_JUDGED}, e AS (SELECT lang, avg(ok::INT) AS c, avg(err) AS e FROM j GROUP BY lang) SELECT (SELECT count(*) FROM e) AS n_questions, (SELECT count(e) FROM e) AS n_with_error, round(avg(ok::INT), 9) AS micro_correct, round(avg(err), 9) AS micro_error, (SELECT round(avg(c), 9) FROM e) AS macro_correct, (SELECT round(avg(e), 9) FROM e) AS macro_error FROM j",
    "label_tokens": f"WITH {_JUDGED} SELECT source, lang || '|' || k || '=' || status AS token, count(*) AS n FROM j, (VALUES ('fact'), ('source')) v(k) GROUP BY ALL",
    "hidden_cells": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, n < 5 AS small, sum((n < 5)::INT) OVER (PARTITION BY lang) AS k, row_number() OVER (PARTITION BY lang ORDER BY n < 5, n, source) AS turn FROM c)
SELECT lang, count(*) AS n_cells, count(*) FILTER (small OR (k = 1 AND turn = 1 AND NOT small)) AS n_hidden FROM p GROUP BY lang""",
    "group_content_hash": "SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text), ',' ORDER BY turn, sha256(text))) AS content_sha256 FROM conversations GROUP BY conv_id",
    "candidate_labels": "SELECT CASE WHEN doc_id % 9 <> 0 AND quality = 1 THEN 'ideal' WHEN toxic = 1 THEN 'semi-ideal' ELSE 'non-ideal' END AS label, count(*) AS n FROM labels GROUP BY ALL",
    "selected_input": f"WITH t AS ({_TALK}) SELECT 'full' AS policy, conv_id AS scope, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM t GROUP BY conv_id UNION ALL SELECT 'prefix', conv_id, count(*), CAST(max(used) AS BIGINT) FROM t WHERE used <= 700 GROUP BY conv_id",
}
