"""Nested JSON inputs with explicit schemas: matching fixtures and registry studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logic import reasons

_VALUE = "struct<value_type:string,number:double,boolean:boolean,string:string,date:date,unit:string>"
_SPAN = "struct<start:int,end:int>"
PATIENTS = f"array<struct<patient_id:string,index_date:date,evidence:array<struct<evidence_id:string,source_id:string,text:string>>,facts:array<struct<fact_id:string,field:string,value:{_VALUE},evidence_ids:array<string>,observed_at:date>>>>"
TRIALS = f"array<struct<trial_id:string,title:string,criteria:array<struct<criterion_id:string,criterion_type:string,description:string,hard:boolean,weight:double,expression:string,atoms:array<struct<condition_id:string,field:string,operator:string,expected:{_VALUE},fact_selection:string,time_window:struct<days:int,direction:string>,span:{_SPAN}>>>>>>"
GOLD = "array<struct<patient_id:string,trial_id:string,decision:string,relevance_grade:int>>"
FIXTURE = f"dataset_id string, schema_version string, patients {PATIENTS}, trials {TRIALS}, gold_trials {GOLD}"

STUDY = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,studyFirstPostDateStruct:struct<date:string,type:string>,lastUpdatePostDateStruct:struct<date:string>>,"
    "designModule:struct<studyType:string>,eligibilityModule:struct<eligibilityCriteria:string,healthyVolunteers:boolean,sex:string,minimumAge:string,maximumAge:string,stdAges:array<string>>>, derivedSection struct<miscInfoModule:struct<versionHolder:string>>"
)


def read_fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Flat tables of a nested fixture file: patients, evidence, facts, trials, criteria, atoms, gold_trials.

    A record that does not fit the schema fails the read. Missing hardness and weight are false and 1.
    """
    doc = spark.read.schema(FIXTURE).option("mode", "FAILFAST").json(path, multiLine=True)
    patients = doc.select(F.explode("patients").alias("p"))
    facts = patients.select(F.col("p.patient_id").alias("patient_id"), F.explode("p.facts").alias("f"))
    trials = doc.select(F.explode("trials").alias("t"))
    criteria = trials.select(F.col("t.trial_id").alias("trial_id"), F.explode("t.criteria").alias("c"))
    value = lambda c, k: F.col(f"{c}.{k}")
    return {
        "patients": patients.select("p.patient_id", "p.index_date"),
        "evidence": patients.select("p.patient_id", F.inline("p.evidence")),
        "facts": facts.select(
            "patient_id", "f.fact_id", "f.field", value("f.value", "value_type").alias("value_type"), value("f.value", "number").alias("num"), value("f.value", "boolean").alias("flag"), value("f.value", "string").alias("str"),
            value("f.value", "date").alias("day"), value("f.value", "unit").alias("unit"), "f.observed_at", "f.evidence_ids"),
        "trials": trials.select("t.trial_id", "t.title"),
        "criteria": criteria.select("trial_id", "c.criterion_id", "c.criterion_type", "c.description", F.coalesce("c.hard", F.lit(False)).alias("hard"), F.coalesce("c.weight", F.lit(1.0)).alias("weight"), "c.expression"),
        "atoms": criteria.select("trial_id", F.col("c.criterion_id").alias("criterion_id"), F.explode("c.atoms").alias("a")).select("trial_id", "criterion_id", "a.*"),
        "gold_trials": doc.select(F.inline("gold_trials")),
    }


# The field names of a nested matching fixture. A typed value's `value` is read as text, an expression as JSON.
_TYPED = "struct<value_type:string,value:string,unit:string>"
NESTED = (
    "schema_version string, patients array<struct<patient_id:string,index_date:date,evidence:array<struct<evidence_id:string,source_id:string,text:string>>,"
    f"facts:array<struct<fact_id:string,field:string,value:{_TYPED},evidence_ids:array<string>,observed_at:date>>>>, "
    "trials array<struct<trial_id:string,title:string,criteria:array<struct<criterion_id:string,criterion_type:string,description:string,hard:boolean,weight:double,expression:string>>>>"
)


def read_nested_fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """patients, evidence, facts (with their patient's index_date) and criteria of a fixture with nested expressions.

    Facts have the columns that matching takes; criteria keep their expression as JSON for matching.compiled().
    """
    doc = spark.read.schema(NESTED).option("mode", "FAILFAST").json(path, multiLine=True)
    patients = doc.select(F.explode("patients").alias("p"))
    facts = patients.select("p.patient_id", "p.index_date", F.inline("p.facts"))
    of = lambda kind, cast: F.when(F.col("value.value_type") == kind, F.col("value.value").cast(cast))
    trials = doc.select(F.explode("trials").alias("t")).select("t.trial_id", F.inline("t.criteria"))
    return {
        "patients": patients.select("p.patient_id", "p.index_date"),
        "evidence": patients.select("p.patient_id", F.inline("p.evidence")),
        "facts": facts.select("patient_id", "index_date", "fact_id", "field", F.col("value.value_type").alias("value_type"), of("number", "double").alias("num"), of("boolean", "boolean").alias("flag"), of("string", "string").alias("str"), of("date", "date").alias("day"), F.col("value.unit").alias("unit"), "observed_at", "evidence_ids"),
        "criteria": trials.select("trial_id", "criterion_id", "criterion_type", F.coalesce("hard", F.lit(False)).alias("hard"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "expression"),
    }


def fixture_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (problem, key): facts without evidence or with another patient's, repeated ids, bad weights, gold off the grid."""
    facts, evidence, criteria = tables["facts"], tables["evidence"], tables["criteria"]
    cited = facts.select("patient_id", "fact_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    problem = lambda df, name, *keys: df.select(F.lit(name).alias("problem"), F.concat_ws("/", *keys).alias("key"))
    grid = tables["patients"].select("patient_id").join(F.broadcast(tables["trials"].select("trial_id")))
    gold = tables["gold_trials"].select("patient_id", "trial_id")
    found = [
        problem(cited.where("evidence_id is null"), "fact_without_evidence", "patient_id", "fact_id"),
        problem(cited.where("evidence_id is not null").join(evidence, ["patient_id", "evidence_id"], "left_anti"), "foreign_evidence", "patient_id", "fact_id", "evidence_id"),
        problem(facts.groupBy("patient_id", "fact_id").count().where("count > 1"), "repeated_fact", "patient_id", "fact_id"),
        problem(criteria.groupBy("trial_id", "criterion_id").count().where("count > 1"), "repeated_criterion", "trial_id", "criterion_id"),
        problem(criteria.where("weight <= 0"), "weight_not_positive", "trial_id", "criterion_id"),
        problem(grid.join(gold, ["patient_id", "trial_id"], "left_anti"), "gold_missing", "patient_id", "trial_id"),
        problem(gold.join(grid, ["patient_id", "trial_id"], "left_anti"), "gold_outside", "patient_id", "trial_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def read_studies(spark: SparkSession, path: str, search_page: bool = False) -> DataFrame:
    """Registry studies, one file each, or pages of a search (a `studies` array)."""
    if search_page:
        page = spark.read.schema(f"studies array<struct<{STUDY.replace('protocolSection struct', 'protocolSection:struct').replace('derivedSection struct', 'derivedSection:struct')}>>, nextPageToken string").option("mode", "FAILFAST").json(path, multiLine=True)
        return page.select(F.inline("studies"))
    return spark.read.schema(STUDY).option("mode", "FAILFAST").json(path, multiLine=True)


def normalized_studies(studies: DataFrame) -> DataFrame:
    """Flat protocols (protocol_id, title, status, study_type, first_posted, version, text) with error codes."""
    p = F.col("protocolSection")
    posted = p["statusModule"]["studyFirstPostDateStruct"]["date"]
    text = p["eligibilityModule"]["eligibilityCriteria"]
    errors = reasons({"missing_id": F.coalesce(~p["identificationModule"]["nctId"].rlike("^NCT[0-9]{8}$"), F.lit(True)), "missing_eligibility": F.coalesce(F.trim(text) == "", F.lit(True)), "bad_date": posted.isNotNull() & posted.try_cast("date").isNull()})
    return studies.select(
        p["identificationModule"]["nctId"].alias("protocol_id"), p["identificationModule"]["briefTitle"].alias("title"), p["statusModule"]["overallStatus"].alias("status"), p["designModule"]["studyType"].alias("study_type"),
        posted.try_cast("date").alias("first_posted"), F.col("derivedSection")["miscInfoModule"]["versionHolder"].alias("version"), text.alias("text"), errors.alias("errors"),
    )
