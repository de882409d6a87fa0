"""Facts against criteria: three-valued atoms, criterion trees, weighted matches and their ranking.

Rule sets are small and known when a query is planned, so they are compiled into columns: all atoms of all trials
are conditional aggregates of one pass over the facts, grouped by patient. There is no join of facts with rules and
no patient x trial grid before the rows are that small.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import OPERATORS, ORDERED, Expr, truth_sql

#: Facts: patient_id, fact_id, field, value_type, num, flag (boolean), str, day (date), unit, observed_at, evidence_ids.
VALUE_COLUMNS = {"number": "num", "boolean": "flag", "string": "str", "date": "day"}


@dataclass(frozen=True)
class Atom:
    condition_id: str
    field: str
    op: str
    expected: object
    value_type: str = "number"
    unit: str | None = None
    selection: str = "any"
    window_days: int | None = None
    window_direction: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS or self.selection not in ("any", "all", "latest") or self.value_type not in VALUE_COLUMNS:
            raise ValueError(f"bad atom {self.condition_id}")
        if (self.window_days is None) != (self.window_direction is None) or (self.window_days or 1) < 1:
            raise ValueError("a window has positive days and a direction")


@dataclass(frozen=True)
class Criterion:
    criterion_id: str
    kind: str
    tree: Expr
    hard: bool = False
    weight: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in ("inclusion", "exclusion") or self.weight <= 0:
            raise ValueError(f"bad criterion {self.criterion_id}")

    def conditions(self) -> list[str]:
        found, open_ = [], [self.tree]
        while open_:
            e = open_.pop(0)
            if e.atom:
                found.append(e.atom)
            open_ = [*e.parts, *open_]
        return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Trial:
    trial_id: str
    criteria: tuple[Criterion, ...]

    def __post_init__(self) -> None:
        ids = [c.criterion_id for c in self.criteria]
        if not ids or len(set(ids)) != len(ids):
            raise ValueError("criteria of a trial are one at least and distinct")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(condition_id: str) -> str:
    return "`" + condition_id.replace("`", "``") + "`"


def _expected(atom: Atom) -> str:
    kind = {"number": "DOUBLE", "boolean": "BOOLEAN", "string": "STRING", "date": "DATE"}[atom.value_type]
    return f"CAST({_text(str(atom.expected))} AS {kind})"


def _fact_sql(atom: Atom) -> str:
    """What one fact says on an atom: whether it is of its field and within its window, why it can't be compared, and
    the outcome. Built as SQL text: a rule set is hundreds of expressions, and each column object is a call to the JVM."""
    days, at = atom.window_days, "observed_at"
    if days is None:
        window = f"({at} IS NULL OR {at} <= __index)"
    elif atom.window_direction == "past":
        window = f"{at} BETWEEN date_sub(__index, {days}) AND __index"
    else:
        window = f"{at} BETWEEN __index AND date_add(__index, {days})"
    unit = f"WHEN NOT (unit <=> {'NULL' if atom.unit is None else _text(atom.unit)}) THEN 'unit_mismatch' " if atom.value_type == "number" else ""
    order = "WHEN true THEN 'operator_mismatch' " if atom.value_type not in ORDERED and atom.op not in ("==", "!=") else ""
    why = f"CASE WHEN value_type <> '{atom.value_type}' THEN 'type_mismatch' {unit}{order}END"
    return f"named_struct('own', field = {_text(atom.field)}, 'fit', field = {_text(atom.field)} AND coalesce({window}, false), 'why', {why}, 'outcome', CASE WHEN ({why}) IS NULL THEN {VALUE_COLUMNS[atom.value_type]} {atom.op} {_expected(atom)} END) AS {_name(atom.condition_id)}"


def _gather_sql(atom: Atom) -> str:
    """The aggregate of an atom over a patient's facts, as one struct."""
    c = _name(atom.condition_id)
    future = f"count_if({c}.own AND observed_at > __index)"
    if atom.selection == "latest":
        # of facts observed on one day the first one by id counts, whatever an id's type
        last = f"min_by({c}, CASE WHEN {c}.fit AND observed_at IS NOT NULL THEN struct(-unix_date(observed_at), fact_id) END)"
        parts = (f"count_if({c}.fit AND observed_at IS NOT NULL)", f"coalesce({last}.outcome, false)", f"coalesce(NOT {last}.outcome, false)", f"array_compact(array({last}.why))")
    else:
        fits = lambda x: f"coalesce(bool_or(CASE WHEN {c}.fit THEN {x} END), false)"
        parts = (f"count_if({c}.fit)", fits(f"{c}.outcome"), fits(f"NOT {c}.outcome"), f"array_sort(collect_set(CASE WHEN {c}.fit THEN {c}.why END))")
    names = ("n_fit", "any_true", "any_false", "issues")
    return f"named_struct('n_window', count_if({c}.fit), {', '.join(f'{n!r}, {x}' for n, x in zip(names, parts, strict=True))}, 'n_future', {future}) AS {c}"


def _truth_sql(atom: Atom) -> str:
    """ANY and LATEST: one true fact suffices, false needs that none is incompatible. ALL: one false fact suffices."""
    c = _name(atom.condition_id)
    if atom.selection == "all":
        return f"CASE WHEN {c}.any_false THEN false WHEN {c}.any_true AND size({c}.issues) = 0 THEN true END"
    return f"CASE WHEN {c}.any_true THEN true WHEN {c}.any_false AND size({c}.issues) = 0 THEN false END"


def _issue_sql(atom: Atom) -> str:
    """Why a value is missing or partial; null if nothing is wrong."""
    c = _name(atom.condition_id)
    return f"CASE WHEN {c}.n_window = 0 AND {c}.n_future > 0 THEN 'future_fact_excluded' WHEN {c}.n_window = 0 THEN 'no_usable_fact' WHEN {c}.n_fit = 0 THEN 'latest_requires_date' WHEN size({c}.issues) > 0 THEN concat_ws('+', {c}.issues) END"


def patient_atoms(facts: DataFrame, atoms: list[Atom], index: Column, patients: DataFrame | None = None) -> DataFrame:
    """One row per patient, one struct per atom. Patients without facts come from `patients`, if given."""
    said = facts.withColumn("__index", index).selectExpr("patient_id", "fact_id", "observed_at", "__index", *[_fact_sql(a) for a in atoms])
    found = said.groupBy("patient_id").agg(*[F.expr(_gather_sql(a)) for a in atoms])
    if patients is None:
        return found
    empty = "named_struct('n_window', 0L, 'n_fit', 0L, 'any_true', false, 'any_false', false, 'issues', CAST(array() AS ARRAY<STRING>), 'n_future', 0L)"
    filled = patients.select("patient_id").distinct().join(found, "patient_id", "left")
    return filled.selectExpr("patient_id", *[f"coalesce({_name(a.condition_id)}, {empty}) AS {_name(a.condition_id)}" for a in atoms])


def atom_decisions(gathered: DataFrame, atoms: list[Atom]) -> DataFrame:
    """Rows (patient_id, condition_id, truth, n_fit, n_future, issue)."""
    rows = ", ".join(f"named_struct('condition_id', {_text(a.condition_id)}, 'truth', {_truth_sql(a)}, 'n_fit', {_name(a.condition_id)}.n_fit, 'n_future', {_name(a.condition_id)}.n_future, 'issue', {_issue_sql(a)})" for a in atoms)
    return gathered.selectExpr("patient_id", f"inline(array({rows}))")


def criterion_decisions(gathered: DataFrame, atoms: list[Atom], trials: list[Trial]) -> DataFrame:
    """Rows (patient_id, trial_id, criterion_id, decision, hard, weight, n_atoms, n_resolved, issues)."""
    flat = gathered.selectExpr("patient_id", *[f"{_truth_sql(a)} AS {_name('t ' + a.condition_id)}" for a in atoms], *[f"{_issue_sql(a)} AS {_name('i ' + a.condition_id)}" for a in atoms])
    truths = {a.condition_id: _name("t " + a.condition_id) for a in atoms}
    rows = []
    for t in trials:
        for c in t.criteria:
            own = c.conditions()
            value = truth_sql(c.tree, truths)
            met = value if c.kind == "inclusion" else f"(NOT {value})"
            decided = f"CASE WHEN {met} IS NULL THEN 'unknown' WHEN {met} THEN 'eligible' ELSE 'ineligible' END"
            resolved = " + ".join(f"CAST({truths[k]} IS NOT NULL AS INT)" for k in own)
            issues = ", ".join(f"concat({_text(k + ': ')}, {_name('i ' + k)})" for k in own)
            rows.append(f"named_struct('trial_id', {_text(t.trial_id)}, 'criterion_id', {_text(c.criterion_id)}, 'decision', {decided}, 'hard', {str(c.hard).lower()}, 'weight', {float(c.weight)}D, 'n_atoms', {len(own)}, 'n_resolved', {resolved}, 'issues', array_distinct(array_compact(array({issues}))))")
    return flat.selectExpr("patient_id", f"inline(array({', '.join(rows)}))")


def matches(decisions: DataFrame) -> DataFrame:
    """One row per patient and trial: decision, weighted score over known criteria, coverage, atomic coverage."""
    known = F.col("decision") != "unknown"
    weight = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    out = decisions.groupBy("patient_id", "trial_id").agg(
        F.bool_or(F.col("hard") & (F.col("decision") == "ineligible")).alias("hard_fail"), F.bool_or(F.col("hard") & ~known).alias("hard_unknown"), F.bool_and(~known).alias("all_unknown"),
        F.sum("weight").alias("total"), weight(known).alias("known"), weight(F.col("decision") == "eligible").alias("met"),
        F.sum("n_atoms").alias("n_atoms"), F.sum("n_resolved").alias("n_resolved"),
        F.array_sort(F.collect_list(F.when(F.col("hard") & ~known, F.concat(F.lit("hard_unknown:"), F.col("criterion_id"))))).alias("abstention_reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"),
    )
    overall = F.when(F.col("hard_fail"), "ineligible").when(F.col("hard_unknown") | F.col("all_unknown"), "unknown").otherwise("eligible")
    reasons = F.when(overall != "unknown", F.array().cast("array<string>")).when(F.size("abstention_reasons") > 0, F.col("abstention_reasons")).otherwise(F.array(F.lit("nothing_resolved")))
    return out.select(
        "patient_id", "trial_id", overall.alias("decision"), F.when(F.col("known") > 0, F.round(F.col("met") / F.col("known"), 6)).alias("score"),
        F.round(F.col("known") / F.col("total"), 6).alias("coverage"), F.round(F.col("n_resolved") / F.col("n_atoms"), 6).alias("atomic_coverage"), (overall == "unknown").alias("abstained"), reasons.alias("abstention_reasons"), "issues",
    )


def ranked(found: DataFrame) -> DataFrame:
    """A patient's trials in order: decision, score (none is -1), coverage, atomic coverage, then the trial's id."""
    priority = F.when(F.col("decision") == "eligible", 2).when(F.col("decision") == "unknown", 1).otherwise(0)
    order = Window.partitionBy("patient_id").orderBy(priority.desc(), F.coalesce("score", F.lit(-1.0)).desc(), F.desc("coverage"), F.desc("atomic_coverage"), "trial_id")
    return found.withColumn("rank", F.row_number().over(order))


def match(facts: DataFrame, atoms: list[Atom], trials: list[Trial], index: Column, patients: DataFrame | None = None) -> DataFrame:
    """The whole chain: facts to ranked matches."""
    return ranked(matches(criterion_decisions(patient_atoms(facts, atoms, index, patients), atoms, trials)))


def compiled(criteria: DataFrame) -> tuple[list[Atom], list[Trial]]:
    """Atoms and trials of a table of criteria: trial_id, criterion_id, criterion_type, hard, weight, expression (JSON).

    An expression is {expression_type: atom, atom: {...}} or {expression_type: all | any | not, children: [...]}. Rules
    are small beside the facts, so they come to the driver. An atom's name is its condition's id, with the criterion's
    before it where two criteria use one id for different conditions.
    """
    atoms: dict[str, Atom] = {}

    def tree(node: dict, place: str) -> Expr:
        kind = node["expression_type"]
        if kind != "atom":
            return Expr(kind, tuple(tree(child, place) for child in node["children"]))
        raw, window = node["atom"], node["atom"].get("time_window") or {}
        if window.get("relative_to", "index_date") != "index_date":
            raise ValueError(f"window of {raw['condition_id']} is relative to {window['relative_to']}")
        value = raw["expected"]
        own = Atom(raw["condition_id"], raw["field"], raw["operator"], value["value"], value["value_type"], value.get("unit"), raw["fact_selection"], window.get("days"), window.get("direction"))
        if atoms.setdefault(own.condition_id, own) != own:
            own = replace(own, condition_id=f"{place}/{own.condition_id}")
            if atoms.setdefault(own.condition_id, own) != own:
                raise ValueError(f"{own.condition_id} stands for two conditions")
        return Expr("atom", atom=own.condition_id)

    found: dict[str, list[Criterion]] = {}
    for r in criteria.orderBy("trial_id", "criterion_id").collect():
        expression = tree(json.loads(r["expression"]), f"{r['trial_id']}/{r['criterion_id']}")
        found.setdefault(r["trial_id"], []).append(Criterion(r["criterion_id"], r["criterion_type"], expression, bool(r["hard"]), float(r["weight"])))
    return list(atoms.values()), [Trial(k, tuple(c)) for k, c in found.items()]


def match_tables(facts: DataFrame, criteria: DataFrame, patients: DataFrame) -> DataFrame:
    """From a fixture's tables to ranked matches; each patient's facts are held against that patient's index_date."""
    atoms, trials = compiled(criteria)
    dated = facts.drop("index_date").join(patients.select("patient_id", "index_date"), "patient_id")
    return match(dated, atoms, trials, F.col("index_date"), patients)


def latest_facts(facts: DataFrame, index: Column) -> DataFrame:
    """As-of lookup: for each patient and field the last fact not after the index date, the first by id on ties."""
    best = F.min_by(F.struct("fact_id", "num", "unit", "observed_at"), F.struct(-F.unix_date("observed_at"), "fact_id"))
    rows = facts.where(F.col("observed_at") <= index).groupBy("patient_id", "field").agg(best.alias("f"))
    return rows.select("patient_id", "field", F.col("f.fact_id").alias("fact_id"), F.col("f.num").alias("num"), F.col("f.unit").alias("unit"), F.col("f.observed_at").alias("observed_at"))


def cited_evidence(facts: DataFrame, atoms: list[Atom], index: Column) -> DataFrame:
    """Rows (patient_id, condition_id, evidence): what the facts that an atom rests on cite, incompatible ones too, each
    once, in the order of the facts' ids: of ANY and ALL the in-window facts, of LATEST the one fact that counts."""
    said = facts.withColumn("__index", index).selectExpr("patient_id", "fact_id", "observed_at", "evidence_ids", *[_fact_sql(a) for a in atoms])
    fitting = ", ".join(f"CASE WHEN {_name(a.condition_id)}.fit THEN {_text(a.condition_id)} END" for a in atoms)
    cited = said.selectExpr("patient_id", "fact_id", "observed_at", "evidence_ids", f"explode(array_compact(array({fitting}))) AS condition_id")
    of_latest = F.col("condition_id").isin(*[a.condition_id for a in atoms if a.selection == "latest"] or [""])
    last = F.min_by(F.struct("fact_id", "evidence_ids"), F.struct(-F.unix_date("observed_at"), "fact_id"))
    latest = cited.where(of_latest & F.col("observed_at").isNotNull()).groupBy("patient_id", "condition_id").agg(last.alias("f"))
    cited = cited.where(~of_latest).select("patient_id", "condition_id", "fact_id", "evidence_ids").unionByName(latest.select("patient_id", "condition_id", "f.fact_id", "f.evidence_ids"))
    first = cited.select("patient_id", "condition_id", "fact_id", F.posexplode("evidence_ids").alias("pos", "evidence")).groupBy("patient_id", "condition_id", "evidence").agg(F.min(F.struct("fact_id", "pos")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "evidence")))
    return first.groupBy("patient_id", "condition_id").agg(F.transform(ordered, lambda x: x["evidence"]).alias("evidence"))


def mapped_model_facts(model_facts: DataFrame, known: DataFrame, field: str) -> DataFrame:
    """A model's facts held against a criterion's field and a patient's known evidence: the first reason not to use one.

    model_facts: patient_id, field, status, evidence_ids; known: patient_id, evidence_ids.
    """
    rows = model_facts.join(known.withColumnRenamed("evidence_ids", "known_ids"), "patient_id", "left")
    mapping = (
        F.when(F.col("field") != field, "field_mismatch").when(F.col("status") == "unknown", "model_unknown")
        .when(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0, "missing_evidence")
        .when(F.size(F.array_except("evidence_ids", F.coalesce("known_ids", F.array().cast("array<string>")))) > 0, "unknown_evidence").otherwise("mapped")
    )
    return rows.withColumn("mapping", mapping).drop("known_ids")


def verified_model_facts(model_facts: DataFrame, known: DataFrame, criterion: Criterion, atoms: list[Atom], index: Column) -> DataFrame:
    """Rows (fact_id, mapping, decision) of a model's facts held against one criterion, each on its own.

    model_facts: patient_id, fact_id, and the columns of a fact, with status; known: patient_id, evidence_ids. What can't
    be mapped decides nothing (unknown); a mapped fact is judged as the only fact of its patient, dated on the index date.
    """
    used = {a.condition_id: a for a in atoms if a.condition_id in criterion.conditions()}
    fields = sorted({a.field for a in used.values()})
    rows = mapped_model_facts(model_facts.withColumn("__field", F.col("field")).withColumn("field", F.when(F.col("field").isin(*fields), F.lit("used")).otherwise(F.lit("other"))), known, "used")
    rows = rows.withColumn("field", F.col("__field")).drop("__field")
    alone = rows.where("mapping = 'mapped'").withColumn("patient_id", F.col("fact_id")).withColumn("observed_at", index)
    trial = Trial("model", (criterion,))
    decided = criterion_decisions(patient_atoms(alone, list(used.values()), index), list(used.values()), [trial]).select(F.col("patient_id").alias("fact_id"), "decision")
    return rows.select("patient_id", "fact_id", "mapping").join(decided, "fact_id", "left").withColumn("decision", F.coalesce("decision", F.lit("unknown")))
