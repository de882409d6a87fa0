"""Row classifiers of a frozen precedence: error attribution, abstention, source answers, training-row policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import first_reason

ABSTENTION = ("invalid_schema", "unusable_evidence", "missing_evidence", "incompatible_unit", "verifier_conflict", "missing_fact")
ATTRIBUTION = ("unsupported", "unit", "abstention_on_known", "numeric_value", "status", "other")


def decision_error(correct: Column, relevant_found: Column, abstained: Column) -> Column:
    """Where a wrong decision comes from: retrieval first, then needless abstention, then the decision itself."""
    return first_reason({"correct": correct, "retrieval_failure": ~relevant_found, "false_abstention": abstained}, "decision_error")


def abstention_reason(rows: DataFrame) -> Column:
    """The first reason to abstain, or null.

    rows: schema_valid, cited, known (arrays of evidence ids), needs_evidence, unit, expected_unit, verifier_agrees, status.
    """
    stray = F.size(F.array_except("cited", "known")) > 0
    return first_reason({
        "invalid_schema": ~F.col("schema_valid"), "unusable_evidence": stray, "missing_evidence": F.col("needs_evidence") & (F.size("cited") == 0) & (F.col("status") != "unknown"),
        "incompatible_unit": ~F.col("unit").eqNullSafe(F.col("expected_unit")), "verifier_conflict": ~F.col("verifier_agrees"), "missing_fact": F.col("status") == "unknown",
    })


def projected(rows: DataFrame) -> DataFrame:
    """Predictions after the policy: with a reason the status is unknown and the value gone; unusable evidence is not
    cited. A column trace_ids gets the reason's rule, once."""
    out = rows.withColumn("reason", abstention_reason(rows))
    gone = F.col("reason").isNotNull()
    if "trace_ids" in rows.columns:
        rule = F.array(F.concat(F.lit("deterministic_abstention."), F.col("reason")))
        out = out.withColumn("trace_ids", F.when(gone, F.array_union(F.coalesce("trace_ids", F.array().cast("array<string>")), rule)).otherwise(F.col("trace_ids")))
    return out.withColumns({
        "status": F.when(gone, "unknown").otherwise(F.col("status")), "value": F.when(~gone, F.col("value")), "abstained": gone,
        "cited": F.when(F.col("reason") == "unusable_evidence", F.array().cast("array<string>")).otherwise(F.col("cited")),
    })


def operating_point(rows: DataFrame, answered: Column, correct: Column) -> DataFrame:
    """Answered and wrong rows, coverage and risk (null if nothing is answered)."""
    n = F.count_if(answered)
    wrong = F.count_if(answered & ~correct)
    return rows.agg(F.count("*").alias("n"), n.alias("answered"), wrong.alias("wrong"), F.try_divide(n, F.count("*")).alias("coverage"), F.try_divide(wrong, n).alias("risk"))


def typed_exact(rows: DataFrame) -> Column:
    """Status, unit and value all as in gold; a value beside an unknown status is wrong."""
    value = F.when(F.col("gold_status") == "unknown", F.col("value").isNull()).otherwise(F.col("gold_value").eqNullSafe(F.col("value")))
    return F.coalesce((F.col("gold_status") == F.col("status")) & F.col("gold_unit").eqNullSafe(F.col("unit")) & value, F.lit(False))


def attribution(rows: DataFrame) -> Column:
    """The first category that a row falls into; null for a right one. rows: gold_* and predicted columns, cited, known,
    and, where they are there, numeric (all rows are, by default) and needs_evidence (all do).

    A known answer has to cite, and only what is the patient's, even if it is right. Numbers are compared where both
    statuses are present.
    """
    known = F.col("status") != "unknown"
    needs = F.col("needs_evidence") if "needs_evidence" in rows.columns else F.lit(True)
    numeric = F.col("numeric") if "numeric" in rows.columns else F.lit(True)
    stray = (F.size(F.array_except("cited", "known")) > 0) | (needs & (F.size("cited") == 0))
    both = (F.col("gold_status") == "present") & (F.col("status") == "present")
    return first_reason({
        "unsupported": known & stray, "unit": ~F.col("gold_unit").eqNullSafe(F.col("unit")), "abstention_on_known": ~known & (F.col("gold_status") != "unknown"),
        "numeric_value": numeric & both & ~F.col("gold_value").eqNullSafe(F.col("value")), "status": F.col("gold_status") != F.col("status"), "other": ~typed_exact(rows),
    })


def with_zeros(counts: DataFrame, name: str, domain: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by a category with rows for categories that don't occur, by key if there are any."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(k,) for k in domain], f"{name} string")
    if keys:
        every = counts.select(*keys).distinct().join(F.broadcast(every))
    return every.join(counts, [*keys, name], "left").na.fill(0, ["n"])


def source_status(answer: Column, not_specified: Column) -> Column:
    """answered, not_specified, or source_anomaly where both or neither holds."""
    has = F.coalesce(F.trim(answer) != "", F.lit(False))
    return F.when(has & ~not_specified, "answered").when(~has & not_specified, "not_specified").otherwise("source_anomaly")


def parsed_answer(kind: Column, answer: Column) -> Column:
    """A source answer as (status, value): yes/no or a number; what can't be parsed is unknown with a reason."""
    number = answer.try_cast("double")
    low = F.lower(F.trim(answer))
    status = F.when(kind == "numeric", F.when(number.isNotNull(), "present").otherwise("unknown")).otherwise(F.when(low.isin("yes", "1", "true"), "present").when(low.isin("no", "0", "false"), "absent").otherwise("unknown"))
    return F.struct(status.alias("status"), F.when(kind == "numeric", number).alias("value"), F.when(status == "unknown", F.when(F.coalesce(low == "", F.lit(True)), "empty_answer").otherwise("unparsable_answer")).alias("reason"))


def training_bucket(status: Column, is_default: Column, cited: Column) -> Column:
    """What a row is used for: unknown rows as abstentions, default-absent ones apart, uncited ones excluded, else silver."""
    return first_reason({"unknown": status == "unknown", "default_absent": is_default, "excluded_uncited": F.size(cited) == 0, "silver_present": status == "present"}, "silver_absent")
