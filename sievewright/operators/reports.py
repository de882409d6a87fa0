"""Reports over finished runs, and the contracts of what comes from outside: model output, wide source tables, plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import first_reason, ratio
from ..functions.text import has_number

MODEL_OUTPUT = "struct<assessments:array<struct<question_id:string,fact_status:string,value:double,unit:string,evidence_ids:array<string>>>>"
STATUSES = ("present", "absent", "unknown")


def model_output_rows(outputs: DataFrame, questions: Sequence[str]) -> DataFrame:
    """One row per output and question of JSON texts (output_id, content).

    An output that is no JSON of the schema, has a status that doesn't exist, a value without `present`, or does not
    cover each question exactly once is invalid as a whole: all its questions abstain, with the reason.
    """
    parsed = F.from_json("content", MODEL_OUTPUT, {"mode": "PERMISSIVE"})
    rows = outputs.select("output_id", parsed["assessments"].alias("a"))
    ids = F.transform("a", lambda x: x["question_id"])
    wanted = F.array(*[F.lit(q) for q in sorted(questions)])
    reason = first_reason({
        "invalid_json": F.col("a").isNull(),
        "invalid_schema": F.exists("a", lambda x: x.isNull() | x["question_id"].isNull() | ~F.coalesce(x["fact_status"].isin(*STATUSES), F.lit(False)) | ((x["fact_status"] != "present") & x["value"].isNotNull())),
        "incomplete": ~F.array_sort(ids).eqNullSafe(wanted),
    })
    rows = rows.withColumn("reason", reason).withColumn("question_id", F.explode(wanted))
    own = F.get(F.filter("a", lambda x: x["question_id"] == F.col("question_id")), F.lit(0))
    good = F.col("reason").isNull()
    return rows.select("output_id", "question_id", F.when(good, own["fact_status"]).otherwise("unknown").alias("status"), F.when(good, own["value"]).alias("value"), (~good | (own["fact_status"] == "unknown")).alias("abstained"), "reason")


def numeric_occurrence(values: DataFrame, texts: DataFrame, rankings: DataFrame, protocol_value: float | None = None, cutoffs: Sequence[int] = (1, 3)) -> DataFrame:
    """How often a gold number stands in what retrieval picked.

    values: key, kind, status, value; texts: key, chunk_id, text (all a key's chunks); rankings: key, retriever,
    chunk_id, rank. Rows are left out in this order: boolean, numeric_unknown, protocol_value, full_context_absent.
    One row per retriever: left out by reason, evaluable rows, and for each cutoff the count and the rate.
    """
    whole = texts.join(values.select("key", "value"), "key").groupBy("key").agg(F.bool_or(has_number(F.col("text"), F.col("value"))).alias("in_full"))
    why = first_reason({
        "boolean": F.col("kind") != "numeric", "numeric_unknown": (F.col("status") != "present") | F.col("value").isNull(), "protocol_value": F.col("value") == F.lit(protocol_value).cast("double"), "full_context_absent": ~F.coalesce("in_full", F.lit(False)),
    })
    rows = values.join(whole, "key", "left").withColumn("excluded", why)
    left_out = rows.agg(*[F.count_if(F.col("excluded") == k).alias(f"n_{k}") for k in ("boolean", "numeric_unknown", "protocol_value", "full_context_absent")], F.count_if(F.col("excluded").isNull()).alias("evaluable"))
    picked = rows.where("excluded is null").select("key", "value").join(rankings, "key").join(texts, ["key", "chunk_id"])
    first = picked.where(has_number(F.col("text"), F.col("value"))).groupBy("retriever", "key").agg(F.min("rank").alias("rank"))
    retrievers = rankings.select("retriever").distinct()
    found = retrievers.join(first, "retriever", "left").groupBy("retriever").agg(*[F.count_if(F.col("rank") <= k).alias(f"at_{k}") for k in cutoffs])
    out = found.join(F.broadcast(left_out))
    return out.select("*", *[ratio(F.col(f"at_{k}"), F.col("evaluable")).alias(f"rate_{k}") for k in cutoffs])


def scan_summary(members: DataFrame, evaluated: int, retained: int, exhaustive: bool, recall: float | None = None) -> DataFrame:
    """Holds a similarity scan's claims against its split: how many pairs cross the split, and what is wrong, if anything."""
    sizes = members.groupBy("split").agg(F.count("*").cast("double").alias("n"))
    expected = sizes.agg(((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("expected_pairs"))
    problem = first_reason({
        "evaluated_exceeds_possible": F.lit(evaluated) > F.col("expected_pairs"), "retained_exceeds_evaluated": F.lit(retained > evaluated), "exhaustive_incomplete": F.lit(exhaustive) & (F.lit(evaluated) != F.col("expected_pairs")),
        "exhaustive_with_recall": F.lit(exhaustive and recall is not None), "recall_not_measured": F.lit(not exhaustive and recall is None),
    })
    return expected.select("expected_pairs", F.lit(evaluated).cast("long").alias("evaluated_pairs"), F.lit(retained).cast("long").alias("retained_pairs"), problem.alias("problem"))


def pilot_summary(judged: DataFrame) -> DataFrame:
    """Of doubly annotated units (unit_id, a_decision, b_decision, a_grade, b_grade, a_evidence, b_evidence, minutes):
    agreement rates, the dispute rate, median and 75th percentile of the minutes (values that occur)."""
    evidence = F.array_sort(F.array_distinct("a_evidence")).eqNullSafe(F.array_sort(F.array_distinct("b_evidence")))
    decision, grade = F.col("a_decision").eqNullSafe(F.col("b_decision")), F.col("a_grade").eqNullSafe(F.col("b_grade"))
    share = lambda c: ratio(F.count_if(c), F.count("*"))
    return judged.agg(
        F.count("*").alias("n_units"), share(decision).alias("decision_agreement"), share(grade).alias("grade_agreement"), share(evidence).alias("evidence_agreement"), share(~(decision & grade & evidence)).alias("dispute_rate"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY minutes)").cast("double").alias("median_minutes"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY minutes)").cast("double").alias("p75_minutes"),
    )


def disagreements(decision: Column, grade: Column, evidence: Column) -> Column:
    """Sorted names of what two annotators differ in."""
    return F.array_sort(F.array_compact(F.array(F.when(decision, "decision"), F.when(grade, "relevance_grade"), F.when(evidence, "evidence"))))


def yes(c: str) -> Column:
    """A flag that is set; an empty one is not."""
    return F.coalesce(F.col(c) == 1, F.lit(False))


def no(c: str) -> Column:
    return F.coalesce(F.col(c) == 0, F.lit(False))


def all_flags(include: Sequence[Column], exclude: Sequence[Column]) -> Column:
    """All of the first and none of the second, over conditions that are never null."""
    out = F.lit(True)
    for c in include:
        out = out & c
    for c in exclude:
        out = out & ~c
    return out


def bounded(c: str, least: float | None = None, most: float | None = None, missing: bool = False) -> Column:
    """Whether a measure lies within its bounds; what counts where it is missing is a parameter."""
    fit = F.lit(True)
    if least is not None:
        fit = fit & (F.col(c) >= least)
    if most is not None:
        fit = fit & (F.col(c) <= most)
    return F.coalesce(fit, F.lit(missing))


def capacity_designs(assumptions: DataFrame, least_groups: int, most_groups: int, least_members: int) -> DataFrame:
    """Designs that a budget of person-time allows.

    assumptions: annotators, hours, reserve, annotations_per_unit, minutes_per_annotation, dispute_rate,
    minutes_per_dispute. A unit is a group and a member; groups are tried one by one.
    """
    usable = F.col("annotators") * F.col("hours") * 60.0 * (1 - F.col("reserve"))
    cost = F.col("annotations_per_unit") * F.col("minutes_per_annotation") + F.col("dispute_rate") * F.col("minutes_per_dispute")
    rows = assumptions.select("*", F.floor(usable / cost).cast("long").alias("max_units"), F.explode(F.sequence(F.lit(least_groups), F.lit(most_groups))).alias("groups"))
    rows = rows.withColumn("members", F.floor(F.col("max_units") / F.col("groups")).cast("long"))
    return rows.select("max_units", "groups", "members", (F.col("groups") * F.col("members")).alias("units"), (F.col("members") >= least_members).alias("feasible"))


def run_mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, columns) of two runs' provenance that differ, by null-safe comparison, or that one run lacks."""
    a, b = left.select(key, F.struct(*columns).alias("a")), right.select(key, F.struct(*columns).alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    why = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("only_one_run"))).otherwise(differ)
    return a.join(b, key, "full_outer").select(key, why.alias("differs")).where("size(differs) > 0")


def neighbour_information(rows: DataFrame, features: Mapping[str, str], label: str, k: int = 3, least: int = 5, seed: int = 0) -> DataFrame:
    """Mutual information (nats) of each numeric feature with a discrete label by nearest neighbours (Ross, 2014).

    Rows without the feature or the label are left out; a feature with fewer than `least` rows, or constant, has
    null. One feature's values are worked on in one task, sorted: this is for profiling tables of bounded size.
    """
    names = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("x")) for n, c in features.items()])
    long = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.inline(names)).where("x is not null")

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        name = pdf["feature"].iloc[0]
        if len(x) < least or np.ptp(x) == 0:
            return pd.DataFrame({"feature": [name], "n": [len(x)], "mi": [None]})
        x = x / x.std() + np.random.default_rng(seed).standard_normal(len(x)) * 1e-10
        whole = np.sort(x)
        parts = []
        for value in np.unique(y):
            own = np.sort(x[y == value])
            if len(own) < 2:
                continue
            near = min(k, len(own) - 1)
            # the nearest ones of a sorted value are within `near` places of it
            wide = np.concatenate((np.full(near, -np.inf), own, np.full(near, np.inf)))
            away = np.abs(np.lib.stride_tricks.sliding_window_view(wide, 2 * near + 1) - own[:, None])
            reach = np.partition(away, near, axis=1)[:, near]
            around = np.searchsorted(whole, own + reach, "left") - np.searchsorted(whole, own - reach, "right")
            parts.append((len(own), near, np.maximum(around, 1)))
        n = sum(p[0] for p in parts)
        if not n:
            return pd.DataFrame({"feature": [name], "n": [len(x)], "mi": [None]})
        mean = lambda f: sum(f(*p) for p in parts) / n
        mi = _digamma(n) + mean(lambda size, near, _: size * _digamma(near)) - mean(lambda size, *_: size * _digamma(size)) - mean(lambda _s, _n, around: sum(_digamma(a) for a in around))
        return pd.DataFrame({"feature": [name], "n": [len(x)], "mi": [max(0.0, float(mi))]})

    return long.groupBy("feature").applyInPandas(estimate, "feature string, n long, mi double")


def _digamma(n: float) -> float:
    total = 0.0
    while n < 10:
        total -= 1 / n
        n += 1
    return total + float(np.log(n)) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)
