import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import reports
from sievewright.sources.paged import PagedStudies


def test_model_output(spark):
    good = {"assessments": [{"question_id": "q2", "fact_status": "unknown"}, {"question_id": "q1", "fact_status": "present", "value": 3}]}
    texts = {1: json.dumps(good), 2: "{", 3: json.dumps({"assessments": good["assessments"][:1]}), 4: json.dumps({"assessments": [{"question_id": "q1", "fact_status": "absent", "value": 1}, good["assessments"][0]]}), 5: None}
    rows = reports.model_output_rows(spark.createDataFrame(list(texts.items()), "output_id int, content string"), ("q1", "q2")).collect()
    got = {(r["output_id"], r["question_id"]): (r["status"], r["value"], r["reason"]) for r in rows}
    assert got[(1, "q1")] == ("present", 3.0, None) and got[(1, "q2")] == ("unknown", None, None)
    assert [got[(k, "q1")][2] for k in (2, 3, 4, 5)] == ["invalid_json", "incomplete", "invalid_schema", "invalid_json"]


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(PagedStudies)

    def land(**pages):
        for p in tmp_path.glob("*.json"):
            p.unlink()
        for name, page in pages.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(page))

    version = {"apiVersion": "2", "dataTimestamp": "t"}
    read = lambda **o: spark.read.format("paged_studies").options(path=str(tmp_path), **o).load()
    land(version=version, version_after=version, first={"studies": [{"id": 1}, {"id": 2}], "nextPageToken": "b"}, b={"studies": [{"id": 3}]})
    assert [(r["position"], r["page"]) for r in read().orderBy("position").collect()] == [(0, 0), (1, 0), (2, 1)]
    assert read(max_studies=2).count() == 2
    land(version=version, first={"studies": [], "nextPageToken": "b"}, b={"studies": [], "nextPageToken": "b"})
    with pytest.raises(Exception, match="repeated cursor"):
        read().count()
    land(version=version, version_after={"apiVersion": "3"}, first={"studies": []})
    with pytest.raises(Exception, match="changed"):
        read().count()


def test_neighbour_information(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 10 + F.rand(1)).alias("told"), F.rand(2).alias("noise"), F.lit(1.0).alias("same"))
    got = {r["feature"]: r["mi"] for r in reports.neighbour_information(rows, {"told": "told", "noise": "noise", "same": "same"}, "y").collect()}
    assert got["told"] == pytest.approx(0.693, abs=0.05) and got["noise"] < 0.12 and got["same"] is None


def test_run_mismatches(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "z", 1), (3, "q", 1)], "k int, v string, w int")
    assert {(r["k"], tuple(r["differs"])) for r in reports.run_mismatches(a, b, "k", ["v", "w"]).collect()} == {(2, ("v",)), (3, ("only_one_run",))}


def test_capacity(spark):
    given = spark.createDataFrame([(2, 10.0, 0.0, 2, 5.0, 0.5, 4.0)], "annotators int, hours double, reserve double, annotations_per_unit int, minutes_per_annotation double, dispute_rate double, minutes_per_dispute double")
    rows = reports.capacity_designs(given, 2, 3, 40).orderBy("groups").collect()
    assert [(r["max_units"], r["members"], r["units"], r["feasible"]) for r in rows] == [(100, 50, 100, True), (100, 33, 99, False)]
