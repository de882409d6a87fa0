"""Validators: what is wrong with a finished artifact, recomputed from its own rows, as rows (key, problem).

An artifact without violations gives no rows. Each check is a condition on a row or on sums that are joined to it; none
gathers rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_hash
from ..functions.logic import reasons


def violations(rows: DataFrame, key: Column, checks: Mapping[str, Column]) -> DataFrame:
    """A row (key, problem) for each check that a row fails; a check that can't be told (null) has failed."""
    failed = {name: F.coalesce(broken, F.lit(True)) for name, broken in checks.items()}
    return rows.select(key.cast("string").alias("key"), F.explode(reasons(failed)).alias("problem"))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stray_predictions(gold: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions of what is not in gold, and repeated ones: both fail an evaluation."""
    key = F.concat_ws("/", *keys)
    outside = predictions.join(gold.select(*keys), list(keys), "left_anti").select(key.alias("key"), F.lit("outside_gold").alias("problem"))
    again = predictions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(key.alias("key"), F.lit("repeated").alias("problem"))
    return outside.unionByName(again)


def selection_violations(records: DataFrame, method: str, seed: str, target: int) -> DataFrame:
    """Of a filtered and sampled selection (record_id, filter_passed, reasons, sampling_hash, selected).

    The hash must be that of method, seed and id; those selected must be the first `target` by hash and id among the
    records that passed; a record has reasons if and only if it was excluded, and only then no hash.
    """
    right = rank_hash(f"{method}|{seed}", F.col("record_id"))
    passed = records.where("filter_passed").orderBy("sampling_hash", "record_id").limit(target).select("record_id", F.lit(True).alias("due"))
    rows = records.join(passed, "record_id", "left").withColumn("due", F.coalesce("due", F.lit(False)))
    none = F.size("reasons") == 0
    row = violations(rows, F.col("record_id"), {
        "wrong_hash": F.col("filter_passed") & ~F.col("sampling_hash").eqNullSafe(right), "hash_of_excluded": ~F.col("filter_passed") & F.col("sampling_hash").isNotNull(),
        "reasons_of_passed": F.col("filter_passed") & ~none, "excluded_without_reason": ~F.col("filter_passed") & none, "not_the_selection": F.col("selected") != F.col("due"),
    })
    count = violations(records.agg(F.count_if("selected").alias("n")), F.lit("all"), {"target_missed": F.col("n") != target})
    return row.unionByName(count)


def profile_violations(profile: DataFrame, statuses: Sequence[str], questions: DataFrame) -> DataFrame:
    """Of a quality report (question, kind, n, n_<status>, unknown_rate, n_values, least, greatest) against its catalog
    (question, kind): each question once, counts that add up, the rate, and a range for numbers alone."""
    total = reduce(lambda a, b: a + b, [F.col(f"n_{s}") for s in statuses])
    numeric = F.col("kind") == "numeric"
    both = profile.join(questions.select("question", F.col("kind").alias("due_kind")), "question", "left")
    row = violations(both, F.col("question"), {
        "unknown_question": F.col("due_kind").isNull(), "other_kind": F.col("due_kind").isNotNull() & (F.col("kind") != F.col("due_kind")), "counts": total != F.col("n"),
        "rate": F.abs(F.col("unknown_rate") - F.col("n_unknown") / F.col("n")) > 1e-6, "value_count": numeric & ~F.col("n_values").eqNullSafe(F.col("n_present")),
        "range": numeric & (F.col("n_present") > 0) & F.coalesce(F.col("least") > F.col("greatest"), F.lit(True)), "range_of_boolean": ~numeric & (F.col("n_values").isNotNull() | F.col("least").isNotNull()),
    })
    lacking = questions.join(profile, "question", "left_anti").select(F.col("question").cast("string").alias("key"), F.lit("missing_question").alias("problem"))
    again = profile.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").select(F.col("question").cast("string").alias("key"), F.lit("repeated_question").alias("problem"))
    return _all([row, lacking, again])


def reservation_violations(parts: DataFrame, source: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Of a reservation (key, part: fit or calibration) against the keys it was drawn from: no key in both parts, all keys
    covered and none besides, `n` reserved, and those the first ones by hash."""
    by_key = parts.groupBy(key).agg(F.count_distinct("part").alias("parts"), F.bool_or(F.col("part") == "calibration").alias("reserved"))
    due = source.select(key).distinct().withColumn("h", rank_hash(seed, F.col(key))).orderBy("h", key).limit(n).select(key, F.lit(True).alias("due"))
    rows = by_key.join(source.select(key).distinct().withColumn("known", F.lit(True)), key, "full_outer").join(due, key, "left")
    row = violations(rows, F.col(key), {
        "in_both_parts": F.coalesce(F.col("parts") > 1, F.lit(False)), "not_covered": F.col("parts").isNull(), "not_of_the_source": F.col("known").isNull(),
        "other_selection": F.col("parts").isNotNull() & (F.coalesce("reserved", F.lit(False)) != F.coalesce("due", F.lit(False))),
    })
    return row.unionByName(violations(by_key.agg(F.count_if("reserved").alias("n")), F.lit("all"), {"reserved_count": F.col("n") != n}))


RESOLUTIONS = ("agreed_without_dispute", "resolved", "unresolved")


def adjudication_violations(units: DataFrame, annotations: DataFrame, adjudicated: DataFrame, completed: bool = True) -> DataFrame:
    """Of an adjudication of doubly annotated units.

    units: unit_id; annotations: unit_id, annotator, decision, grade, evidence; adjudicated: unit_id, disagreements
    (sorted names), resolution, minutes, decision, grade. Each unit has two annotations and is covered once; its
    disagreements are those of the annotations; a dispute is resolved in positive time, others are marked as agreed.
    """
    evidence = F.array_sort(F.array_distinct("evidence"))
    kinds = annotations.groupBy("unit_id").agg(F.count_distinct("annotator").alias("annotators"), *[F.count_distinct(F.coalesce(c.cast("string"), F.lit(""))).alias(n) for n, c in (("d", F.col("decision")), ("g", F.col("grade")), ("e", F.to_json(F.struct(evidence.alias("e")))))])
    due = F.array_sort(F.array_compact(F.array(F.when(F.col("d") > 1, "decision"), F.when(F.col("g") > 1, "relevance_grade"), F.when(F.col("e") > 1, "evidence"))))
    kinds = kinds.select("unit_id", "annotators", due.alias("due"))
    copies = adjudicated.withColumn("copies", F.count("*").over(Window.partitionBy("unit_id")))
    rows = units.select("unit_id").join(kinds, "unit_id", "left").join(copies.select("unit_id", "copies", F.array_sort("disagreements").alias("said"), "resolution", "minutes", "decision", "grade"), "unit_id", "left").dropDuplicates(["unit_id"])
    there, dispute = F.col("copies").isNotNull(), F.size("due") > 0
    row = violations(rows, F.col("unit_id"), {
        "not_two_annotators": ~F.col("annotators").eqNullSafe(F.lit(2)), "not_covered": ~there, "repeated": there & (F.col("copies") > 1), "disagreements": there & ~F.col("said").eqNullSafe(F.col("due")),
        "resolution": there & ~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False)), "unresolved": F.lit(completed) & there & F.col("resolution").eqNullSafe(F.lit("unresolved")),
        "agreed_disputed": there & F.coalesce(dispute, F.lit(False)) & F.col("resolution").eqNullSafe(F.lit("agreed_without_dispute")),
        "disputed_agreed": there & ~F.coalesce(dispute, F.lit(False)) & ~F.col("resolution").eqNullSafe(F.lit("agreed_without_dispute")),
        "no_time": F.lit(completed) & there & F.coalesce(dispute, F.lit(False)) & ~F.coalesce(F.col("minutes") > 0, F.lit(False)),
        "no_judgment": F.lit(completed) & there & (F.col("decision").isNull() | ~F.coalesce(F.col("grade").between(0, 3), F.lit(False))),
    })
    besides = adjudicated.join(units, "unit_id", "left_anti").select(F.col("unit_id").cast("string").alias("key"), F.lit("unknown_unit").alias("problem"))
    return row.unionByName(besides)


def input_plan_violations(plan: DataFrame, known: DataFrame) -> DataFrame:
    """Of a training plan (entity_id, question_id, evidence_ids) against the evidence there is (entity_id, evidence_id):
    each row once, at least one chunk, each chunk once and one of the entity's own."""
    key = F.concat_ws("/", "entity_id", "question_id")
    shown = plan.select("entity_id", "question_id", F.explode("evidence_ids").alias("evidence_id"))
    foreign = shown.join(known, ["entity_id", "evidence_id"], "left_anti").select(key.alias("key"), F.lit("foreign_chunk").alias("problem")).distinct()
    again = plan.groupBy("entity_id", "question_id").agg(F.count("*").alias("n")).where("n > 1").select(key.alias("key"), F.lit("repeated_row").alias("problem"))
    row = violations(plan, key, {"no_chunk": F.coalesce(F.size("evidence_ids") < 1, F.lit(True)), "repeated_chunk": F.coalesce(F.size(F.array_distinct("evidence_ids")) != F.size("evidence_ids"), F.lit(False))})
    return _all([foreign, again, row])


def recomputed_violations(found: DataFrame, due: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a table that can be worked out again: rows that are missing, besides, or other than the recomputed ones."""
    values = [c for c in due.columns if c not in keys]
    a = found.select(*keys, F.struct(*values).alias("found"))
    b = due.select(*keys, F.struct(*values).alias("due"))
    why = F.when(F.col("found").isNull(), "missing").when(F.col("due").isNull(), "besides").when(~F.col("found").eqNullSafe(F.col("due")), "other_values")
    return a.join(b, list(keys), "full_outer").select(F.concat_ws("/", *keys).alias("key"), why.alias("problem")).where("problem is not null")


# What must not be published, by suffix, by name and by pattern, and what is read as text.
FORBIDDEN_SUFFIXES = (".csv", ".jsonl", ".parquet", ".gz", ".zip", ".pkl", ".npy", ".faiss")
TEXT_SUFFIXES = ("", ".json", ".jsonl", ".md", ".py", ".sh", ".toml", ".txt", ".yaml", ".yml")
PUBLIC_PATTERNS = {
    "numeric_identifier": r"(?i)\b(?:hadm_id|subject_id)[\"']?\s*[,=:]\s*[\"']?[0-9]{5,}\b",
    "note_identifier": r"\b[0-9]+-[A-Z]{2}-[0-9]+\b",
}
MOST_BYTES = 1_000_000


def public_file_problems(files: DataFrame, forbidden_names: Sequence[str] = (), suffixes: Sequence[str] = FORBIDDEN_SUFFIXES, most_bytes: int = MOST_BYTES, marker: str | None = None) -> DataFrame:
    """Why files (path, size, text) can't be published: their type, name or size, and, where the type is a text's,
    identifiers in it and a missing `marker`."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    is_text = suffix.isin(*TEXT_SUFFIXES)
    found = {"forbidden_type": suffix.isin(*suffixes), "forbidden_name": name.isin(*forbidden_names) if forbidden_names else F.lit(False), "too_large": F.col("size") > most_bytes}
    if marker:
        found["no_marker"] = is_text & ~F.lower("text").contains(marker.lower())
    found |= {k: is_text & F.coalesce(F.col("text").rlike(p), F.lit(False)) for k, p in PUBLIC_PATTERNS.items()}
    return violations(files, F.col("path"), {k: F.coalesce(c, F.lit(False)) for k, c in found.items()})


# --- small operators beside the validators ---

def question_means(rows: DataFrame, question: str, correct: Column, error: Column) -> DataFrame:
    """Over all rows, and as the mean over questions of each question's own figure: the share of correct rows and the mean
    error. A question without an error has no part in that mean."""
    overall = rows.agg(F.avg(correct.cast("double")).alias("micro_correct"), F.avg(error).alias("micro_error"))
    each = rows.groupBy(question).agg(F.avg(correct.cast("double")).alias("c"), F.avg(error).alias("e"))
    macro = each.agg(F.count("*").alias("n_questions"), F.avg("c").alias("macro_correct"), F.count("e").alias("n_with_error"), F.avg("e").alias("macro_error"))
    return overall.join(F.broadcast(macro))


def label_tokens(rows: DataFrame, entity: str, question: str, status: str, source: str) -> DataFrame:
    """Each entity's multiset of label tokens, as (entity, token, n): what a balanced split weighs."""
    tokens = F.array(*[F.concat(F.col(question).cast("string"), F.lit(f"|{name}="), F.col(c).cast("string")) for name, c in (("fact", status), ("source", source))])
    return rows.select(entity, F.explode(tokens).alias("token")).groupBy(entity, "token").agg(F.count("*").alias("n"))


def hidden_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many cells of a suppressed table are hidden, of how many."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count_if("hidden").alias("n_hidden"))


def group_content_hash(rows: DataFrame, group: str, start: str, text: str) -> DataFrame:
    """A hash of each group's texts in the order of their places. Texts are hashed one by one, so a group brings its
    places and digests together and not its texts."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), F.sha2(text, 256).alias("h"))))
    joined = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["at"].cast("string"), p["h"])), ",")
    return rows.groupBy(group).agg(F.sha2(joined, 256).alias("content_sha256"))


def candidate_label(ideal: Column, semi: Column) -> Column:
    """ideal, semi-ideal or non-ideal, by two flags."""
    return F.when(F.coalesce(ideal == 1, F.lit(False)), "ideal").when(F.coalesce(semi == 1, F.lit(False)), "semi-ideal").otherwise("non-ideal")


def selected_input(chunks: DataFrame, policy: str, limit: int | None = None) -> DataFrame:
    """The chunks that a model is shown: `full`, or the longest `prefix` of whole chunks within `limit` characters."""
    from .retrieval import prefix_budget

    if policy == "full":
        return chunks.withColumn("used", F.sum("length").over(Window.partitionBy("scope").orderBy("start", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)))
    if policy == "prefix" and limit and limit > 0:
        return prefix_budget(chunks, limit)
    raise ValueError(f"no policy {policy} with limit {limit}")


@dataclass(frozen=True)
class StudyFilter:
    """What studies a benchmark may hold; lists come out without repetitions and sorted, bounds as dates."""

    study_types: tuple[str, ...]
    statuses: tuple[str, ...]
    first_posted_from: date | str
    first_posted_to: date | str

    def __post_init__(self) -> None:
        if not self.study_types or not self.statuses:
            raise ValueError("a study type and a status are needed")
        for name in ("study_types", "statuses"):
            object.__setattr__(self, name, tuple(sorted(set(getattr(self, name)))))
        for name in ("first_posted_from", "first_posted_to"):
            object.__setattr__(self, name, date.fromisoformat(str(getattr(self, name))))
        if self.first_posted_from > self.first_posted_to:
            raise ValueError("the first bound is after the last")

    def reasons(self) -> dict[str, Column]:
        """Why a study (study_type, status, first_posted, text) is left out, for governance.failing_reasons."""
        posted = F.col("first_posted")
        return {
            "study_type": ~F.coalesce(F.col("study_type").isin(*self.study_types), F.lit(False)), "status": ~F.coalesce(F.col("status").isin(*self.statuses), F.lit(False)),
            "first_posted": ~F.coalesce(posted.between(F.lit(self.first_posted_from), F.lit(self.first_posted_to)), F.lit(False)), "no_eligibility_text": F.coalesce(F.trim("text") == "", F.lit(True)),
        }
