"""Eligibility matching over the events table: users are patients, events are dated typed facts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logic import Expr, all_of, any_of, atom, negated
from ..operators import matching as m
from ..session import table

INDEX = "2024-01-20"

ATOMS = [
    m.Atom("buy_large", "purchase", ">=", 120.0, unit="std"),
    m.Atom("buy_recent", "purchase", ">", 20.0, unit="std", window_days=7, window_direction="past"),
    m.Atom("err_low", "error", "<", 250.0, unit="std", selection="all"),
    m.Atom("view_last", "view", ">=", 40.0, unit="std", selection="latest"),
    m.Atom("click_any", "click", "<=", 5.0, unit="std", window_days=10, window_direction="past"),
    m.Atom("signup_soon", "signup", ">", 60.0, unit="std", window_days=5, window_direction="future"),
    m.Atom("error_last", "error", ">", 100.0, unit="std", selection="latest", window_days=3, window_direction="past"),
]
TRIALS = [
    m.Trial("t1", (m.Criterion("t1_a", "inclusion", any_of(atom("buy_large"), atom("buy_recent")), hard=True, weight=2.0), m.Criterion("t1_b", "exclusion", negated(atom("err_low"))), m.Criterion("t1_c", "inclusion", atom("view_last"), weight=0.5))),
    m.Trial("t2", (m.Criterion("t2_a", "inclusion", all_of(atom("click_any"), negated(atom("error_last"))), hard=True), m.Criterion("t2_b", "inclusion", atom("signup_soon"), weight=3.0))),
    m.Trial("t3", (m.Criterion("t3_a", "exclusion", any_of(atom("error_last"), atom("view_last")), weight=1.5), m.Criterion("t3_b", "inclusion", atom("buy_recent"), hard=True))),
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient_id"), F.col("event_id").alias("fact_id"), F.col("event_type").alias("field"), F.lit("number").alias("value_type"), F.col("value").alias("num"),
        F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("date").alias("day"),
        F.when(F.col("event_id") % 11 == 0, "alt").otherwise("std").alias("unit"), F.to_date("ts").alias("observed_at"), F.array(F.concat(F.lit("e"), F.col("event_id"))).alias("evidence_ids"),
    )


def _index():
    return F.lit(INDEX).cast("date")


def match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.match(facts(spark, sf_dir), ATOMS, TRIALS, _index())
    return found.select("patient_id", "trial_id", "decision", "score", "coverage", "atomic_coverage", "abstained", F.concat_ws(",", "abstention_reasons").alias("reasons"), "rank")


def atom_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.atom_decisions(m.patient_atoms(facts(spark, sf_dir), ATOMS, _index()), ATOMS)
    return found.select("patient_id", "condition_id", F.coalesce(F.col("truth").cast("string"), F.lit("unknown")).alias("truth"), "n_fit", "n_future", F.coalesce("issue", F.lit("")).alias("issue"))


def criterion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.criterion_decisions(m.patient_atoms(facts(spark, sf_dir), ATOMS, _index()), ATOMS, TRIALS)
    return found.select("patient_id", "trial_id", "criterion_id", "decision", F.col("n_resolved").cast("long").alias("n_resolved"))


def latest_fact_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.latest_facts(facts(spark, sf_dir), _index()).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd"))


def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.cited_evidence(facts(spark, sf_dir), ATOMS, _index())
    return found.select("patient_id", "condition_id", F.concat_ws(",", "evidence").alias("evidence"))


def unit_mismatch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.atom_decisions(m.patient_atoms(facts(spark, sf_dir), ATOMS, _index()), ATOMS)
    return found.groupBy("condition_id").agg(F.count_if(F.coalesce(F.col("issue").contains("unit_mismatch"), F.lit(False))).alias("n_mismatch"), F.count_if(F.col("truth").isNull()).alias("n_unknown"), F.count("*").alias("n"))


def future_fact_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.atom_decisions(m.patient_atoms(facts(spark, sf_dir), ATOMS, _index()), ATOMS)
    return found.where("issue = 'future_fact_excluded'").select("patient_id", "condition_id", "n_future")


def model_fact_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select(
        "patient_id", "fact_id", "field", F.when(F.col("num") < 2, "unknown").otherwise("present").alias("status"),
        F.when(F.col("fact_id") % 13 == 0, F.array().cast("array<string>")).when(F.col("fact_id") % 17 == 0, F.array(F.lit("nowhere"))).otherwise(F.array(F.concat(F.lit("d"), F.to_date("observed_at")))).alias("evidence_ids"),
    )
    known = facts(spark, sf_dir).groupBy("patient_id").agg(F.collect_set(F.concat(F.lit("d"), F.col("observed_at"))).alias("evidence_ids"))
    found = m.mapped_model_facts(rows, known, "purchase")
    return found.groupBy("field", "mapping").agg(F.count("*").alias("n"))


def _json(tree: Expr) -> dict:
    if tree.op != "atom":
        return {"expression_type": tree.op, "children": [_json(p) for p in tree.parts]}
    a = next(a for a in ATOMS if a.condition_id == tree.atom)
    window = {"days": a.window_days, "direction": a.window_direction} if a.window_days else None
    return {"expression_type": "atom", "atom": {"condition_id": a.condition_id, "field": a.field, "operator": a.op, "fact_selection": a.selection, "expected": {"value_type": a.value_type, "value": a.expected, "unit": a.unit}, "time_window": window}}


def compiled_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a table of JSON expressions, and an index date of its own for each patient: three days before the last fact."""
    rows = [(t.trial_id, c.criterion_id, c.kind, c.hard, c.weight, json.dumps(_json(c.tree))) for t in TRIALS for c in t.criteria]
    criteria = spark.createDataFrame(rows, "trial_id string, criterion_id string, criterion_type string, hard boolean, weight double, expression string")
    own = facts(spark, sf_dir)
    patients = own.groupBy("patient_id").agg(F.date_sub(F.max("observed_at"), 3).alias("index_date"))
    found = m.match_tables(own, criteria, patients)
    return found.select("patient_id", "trial_id", "decision", "score", "coverage", "atomic_coverage", "abstained", F.concat_ws(",", "abstention_reasons").alias("reasons"), "rank")


def model_fact_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single facts as a model gave them, held against `a purchase of 120 or more`."""
    rows = facts(spark, sf_dir).withColumn("status", F.when(F.col("num") < 2, "unknown").otherwise("present"))
    known = facts(spark, sf_dir).where("fact_id % 5 <> 0").groupBy("patient_id").agg(F.collect_set(F.concat(F.lit("e"), F.col("fact_id"))).alias("evidence_ids"))
    found = m.verified_model_facts(rows, known, m.Criterion("c", "exclusion", atom("buy_large")), ATOMS, _index())
    return found.select("fact_id", "mapping", "decision")


QUERIES = {f.__name__: f for f in (compiled_match, model_fact_decisions, match_rank, atom_decisions, criterion_decisions, latest_fact_asof, evidence_trace, unit_mismatch_issues, future_fact_excluded, model_fact_mapping)}


def _sql_atoms() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"('{a.condition_id}', '{a.field}', '{a.op}', {float(a.expected)}::DOUBLE, {text(a.unit)}, '{a.selection}', {a.window_days or 'NULL'}::INTEGER, {text(a.window_direction)})" for a in ATOMS)
    return f"atoms(condition_id, field, op, expected, unit, selection, days, direction) AS (VALUES {rows})"


_BASE = f"""
WITH {_sql_atoms()},
facts AS (SELECT user_id AS patient_id, event_id AS fact_id, event_type AS field, value AS num, CASE WHEN event_id % 11 = 0 THEN 'alt' ELSE 'std' END AS unit, CAST(ts AS DATE) AS observed FROM events),
patients AS (SELECT DISTINCT patient_id FROM facts),
grid AS (SELECT * FROM patients, atoms),
pairs AS (
  SELECT g.patient_id, g.condition_id, g.selection, f.fact_id, f.observed,
    CASE WHEN f.unit <> g.unit THEN 'unit_mismatch' END AS why,
    CASE WHEN f.unit <> g.unit THEN NULL WHEN g.op = '>=' THEN f.num >= g.expected WHEN g.op = '>' THEN f.num > g.expected WHEN g.op = '<=' THEN f.num <= g.expected WHEN g.op = '<' THEN f.num < g.expected END AS outcome,
    CASE WHEN g.days IS NULL THEN f.observed <= DATE '{INDEX}' WHEN g.direction = 'past' THEN f.observed BETWEEN DATE '{INDEX}' - g.days AND DATE '{INDEX}' ELSE f.observed BETWEEN DATE '{INDEX}' AND DATE '{INDEX}' + g.days END AS fit,
    f.observed > DATE '{INDEX}' AS future
  FROM grid g LEFT JOIN facts f ON f.patient_id = g.patient_id AND f.field = g.field
),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id, condition_id ORDER BY (CASE WHEN fit THEN 0 ELSE 1 END), observed DESC, fact_id) AS newest FROM pairs
),
summed AS (
  SELECT patient_id, condition_id, selection, count(*) FILTER (fit) AS n_fit, count(*) FILTER (future) AS n_future,
    coalesce(bool_or(outcome) FILTER (fit AND (selection <> 'latest' OR newest = 1)), false) AS any_true,
    coalesce(bool_or(NOT outcome) FILTER (fit AND (selection <> 'latest' OR newest = 1)), false) AS any_false,
    count(why) FILTER (fit AND (selection <> 'latest' OR newest = 1)) AS n_bad
  FROM chosen GROUP BY ALL
),
decided AS (
  SELECT *, CASE WHEN selection = 'all' THEN CASE WHEN any_false THEN false WHEN any_true AND n_bad = 0 THEN true END
    ELSE CASE WHEN any_true THEN true WHEN any_false AND n_bad = 0 THEN false END END AS truth,
    CASE WHEN n_fit = 0 AND n_future > 0 THEN 'future_fact_excluded' WHEN n_fit = 0 THEN 'no_usable_fact' WHEN n_bad > 0 THEN 'unit_mismatch' ELSE '' END AS issue
  FROM summed
),
wide AS (SELECT patient_id, {", ".join(f"bool_or(truth) FILTER (condition_id = '{a.condition_id}') AS {a.condition_id}" for a in ATOMS)} FROM decided GROUP BY patient_id),
criteria AS (
  SELECT patient_id, 't1' AS trial_id, 't1_a' AS criterion_id, 'in' AS kind, (buy_large OR buy_recent) AS v, true AS hard, 2.0::DOUBLE AS weight, 2 AS n_atoms, (buy_large IS NOT NULL)::INT + (buy_recent IS NOT NULL)::INT AS n_resolved FROM wide
  UNION ALL SELECT patient_id, 't1', 't1_b', 'ex', NOT err_low, false, 1.0, 1, (err_low IS NOT NULL)::INT FROM wide
  UNION ALL SELECT patient_id, 't1', 't1_c', 'in', view_last, false, 0.5, 1, (view_last IS NOT NULL)::INT FROM wide
  UNION ALL SELECT patient_id, 't2', 't2_a', 'in', click_any AND NOT error_last, true, 1.0, 2, (click_any IS NOT NULL)::INT + (error_last IS NOT NULL)::INT FROM wide
  UNION ALL SELECT patient_id, 't2', 't2_b', 'in', signup_soon, false, 3.0, 1, (signup_soon IS NOT NULL)::INT FROM wide
  UNION ALL SELECT patient_id, 't3', 't3_a', 'ex', error_last OR view_last, false, 1.5, 2, (view_last IS NOT NULL)::INT + (error_last IS NOT NULL)::INT FROM wide
  UNION ALL SELECT patient_id, 't3', 't3_b', 'in', buy_recent, true, 1.0, 1, (buy_recent IS NOT NULL)::INT FROM wide
),
judged AS (SELECT *, CASE WHEN v IS NULL THEN 'unknown' WHEN v = (kind = 'in') THEN 'eligible' ELSE 'ineligible' END AS decision FROM criteria)
"""

ORACLES = {
    "match_rank": _BASE + """, totals AS (
  SELECT patient_id, trial_id, bool_or(hard AND decision = 'ineligible') AS hf, bool_or(hard AND decision = 'unknown') AS hu, bool_and(decision = 'unknown') AS au,
    sum(weight) AS total, coalesce(sum(weight) FILTER (decision <> 'unknown'), 0) AS known, coalesce(sum(weight) FILTER (decision = 'eligible'), 0) AS met, sum(n_atoms) AS na, sum(n_resolved) AS nr,
    string_agg('hard_unknown:' || criterion_id, ',' ORDER BY criterion_id) FILTER (hard AND decision = 'unknown') AS why
  FROM judged GROUP BY ALL
), scored AS (
  SELECT patient_id, trial_id, CASE WHEN hf THEN 'ineligible' WHEN hu OR au THEN 'unknown' ELSE 'eligible' END AS decision, CASE WHEN known > 0 THEN round(met / known, 6) END AS score,
    round(known / total, 6) AS coverage, round(nr / na, 6) AS atomic_coverage, why FROM totals
)
SELECT patient_id, trial_id, decision, score, coverage, atomic_coverage, decision = 'unknown' AS abstained, CASE WHEN decision <> 'unknown' THEN '' ELSE coalesce(why, 'nothing_resolved') END AS reasons,
  CAST(row_number() OVER (PARTITION BY patient_id ORDER BY CASE decision WHEN 'eligible' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END DESC, coalesce(score, -1) DESC, coverage DESC, atomic_coverage DESC, trial_id) AS INTEGER) AS rank
FROM scored""",
    "atom_decisions": _BASE + "SELECT patient_id, condition_id, coalesce(truth::VARCHAR, 'unknown') AS truth, n_fit, n_future, issue FROM decided",
    "criterion_decisions": _BASE + "SELECT patient_id, trial_id, criterion_id, decision, CAST(n_resolved AS BIGINT) AS n_resolved FROM judged",
    "latest_fact_asof": f"""SELECT user_id AS patient_id, event_type AS field, event_id AS fact_id, value AS num, CASE WHEN event_id % 11 = 0 THEN 'alt' ELSE 'std' END AS unit, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS observed_at
FROM events WHERE CAST(ts AS DATE) <= DATE '{INDEX}' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) = 1""",
    "evidence_trace": _BASE + "SELECT patient_id, condition_id, string_agg('e' || fact_id, ',' ORDER BY fact_id) AS evidence FROM chosen WHERE fit AND (selection <> 'latest' OR newest = 1) GROUP BY ALL",
    "unit_mismatch_issues": _BASE + "SELECT condition_id, count(*) FILTER (issue = 'unit_mismatch') AS n_mismatch, count(*) FILTER (truth IS NULL) AS n_unknown, count(*) AS n FROM decided GROUP BY ALL",
    "future_fact_excluded": _BASE + "SELECT patient_id, condition_id, n_future FROM decided WHERE issue = 'future_fact_excluded'",
    "model_fact_decisions": """WITH m AS (SELECT event_id AS fact_id, value, event_id % 11 = 0 AS alt, CASE WHEN event_type <> 'purchase' THEN 'field_mismatch' WHEN value < 2 THEN 'model_unknown' WHEN event_id % 5 = 0 THEN 'unknown_evidence' ELSE 'mapped' END AS mapping FROM events)
SELECT fact_id, mapping, CASE WHEN mapping <> 'mapped' OR alt THEN 'unknown' WHEN value >= 120 THEN 'ineligible' ELSE 'eligible' END AS decision FROM m""",
    "model_fact_mapping": """SELECT event_type AS field, CASE WHEN event_type <> 'purchase' THEN 'field_mismatch' WHEN value < 2 THEN 'model_unknown' WHEN event_id % 13 = 0 THEN 'missing_evidence' WHEN event_id % 17 = 0 THEN 'unknown_evidence' ELSE 'mapped' END AS mapping, count(*) AS n
FROM events GROUP BY ALL""",
}
ORACLES["compiled_match"] = ORACLES["match_rank"].replace(f"DATE '{INDEX}'", "g.idx").replace("SELECT DISTINCT patient_id FROM facts", "SELECT patient_id, max(observed) - 3 AS idx FROM facts GROUP BY patient_id")
