import json
import struct

import pytest
from pyspark.sql import functions as F

from sievewright.operators import matching
from sievewright.sources import files, fixtures
from sievewright.streaming import windows


def test_fixture(spark, tmp_path):
    doc = {
        "dataset_id": "d", "schema_version": "1",
        "patients": [{"patient_id": "p", "index_date": "2024-01-20", "evidence": [{"evidence_id": "e1", "source_id": "s", "text": "x"}], "facts": [
            {"fact_id": "f1", "field": "age", "value": {"value_type": "number", "number": 5, "unit": "y"}, "evidence_ids": ["e1"], "observed_at": "2024-01-01"},
            {"fact_id": "f2", "field": "age", "value": {"value_type": "number", "number": 6}, "evidence_ids": ["e9"]}]}],
        "trials": [{"trial_id": "t", "title": "T", "criteria": [{"criterion_id": "c", "criterion_type": "inclusion", "description": "", "atoms": [{"condition_id": "a", "field": "age", "operator": ">", "expected": {"value_type": "number", "number": 3}, "fact_selection": "any"}]}]}],
        "gold_trials": [],
    }
    (tmp_path / "f.json").write_text(json.dumps(doc))
    tables = fixtures.read_fixture(spark, str(tmp_path / "f.json"))
    assert tables["criteria"].first()["weight"] == 1.0 and tables["facts"].count() == 2
    assert {(r["problem"], r["key"]) for r in fixtures.fixture_violations(tables).collect()} == {("foreign_evidence", "p/f2/e9"), ("gold_missing", "p/t")}


def test_studies(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "T"}, "statusModule": {"studyFirstPostDateStruct": {"date": "2020-02-30"}}, "eligibilityModule": {"eligibilityCriteria": " "}}}
    (tmp_path / "s.json").write_text(json.dumps({"studies": [study]}))
    row = fixtures.normalized_studies(fixtures.read_studies(spark, str(tmp_path / "s.json"), search_page=True)).first()
    assert row["protocol_id"] == "NCT00000001" and row["errors"] == ["missing_eligibility", "bad_date"]


def test_csv(spark, tmp_path):
    head = "text,note_id,hadm_id,criterion,question_type,question,answer,not_specified\n"
    (tmp_path / "n.csv").write_text("﻿" + head + '"two\nlines, ""x""",1,2,c,yes,q,a,0\n')
    assert files.read_notes_csv(spark, str(tmp_path / "n.csv")).first()["text"] == 'two\nlines, "x"'
    (tmp_path / "m.csv").write_text("text,note\nx,1\n")
    with pytest.raises(ValueError):
        files.read_notes_csv(spark, str(tmp_path / "m.csv"))


def test_vectors_and_snapshot(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.bin").write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    rows = files.read_float32(spark, str(tmp_path / "v"), 2)
    assert [list(r["vec"]) for r in rows.orderBy("row").collect()] == [[1, 2], [3, 4]]
    assert rows.orderBy("row").select(files.packed_float32(F.col("vec")).alias("b")).first()["b"] == struct.pack("<2f", 1, 2)
    sums = files.file_checksums(spark, str(tmp_path / "v"))
    assert sums.count() == 1 and files.checksum_violations(sums, spark.createDataFrame([("b.bin", "0")], "name string, sha256 string")).count() == 2
    out = str(tmp_path / "snap")
    files.write_snapshot({"rows": rows.drop("path")}, out)
    assert files.read_snapshot(spark, out, ["rows"])["rows"].count() == 2
    with pytest.raises(Exception):
        files.write_new(rows, f"{out}/rows")


def test_streams_agree_with_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"))
    q = windows.to_parquet(windows.tumbling(stream, "6 hours", watermark="30 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    done = spark.read.schema("start timestamp, end timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out"))
    table = windows.tumbling(events, "6 hours")
    assert done.join(table, ["start", "end", "event_type", "n"], "left_anti").count() == 0
    q = windows.upsert(windows.running_latest(windows.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "latest"), ("user_id",), str(tmp_path / "ck2"))
    q.awaitTermination()
    last = sorted((tmp_path / "latest").glob("v*"), key=lambda p: int(p.name[1:]))[-1]
    want = events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    assert spark.read.parquet(str(last)).select("user_id", "value").exceptAll(want).count() == 0


def test_nested_fixture_to_matches(spark, tmp_path):
    value = lambda x, kind="number", unit="u": {"value_type": kind, "value": x, "unit": unit}
    leaf = lambda k, field, op, x, **kw: {"expression_type": "atom", "atom": {"condition_id": k, "field": field, "operator": op, "expected": x, "fact_selection": "any", **kw}}
    either = {"expression_type": "any", "children": [leaf("c1", "f", ">=", value(5)), {"expression_type": "not", "children": [leaf("c2", "g", "==", value(True, "boolean", None))]}]}
    recent = leaf("c1", "f", ">", value(1), time_window={"days": 10, "direction": "past"})  # the same id for another condition
    doc = {
        "schema_version": "1",
        "patients": [
            {"patient_id": "p", "index_date": "2024-01-20", "evidence": [], "facts": [{"fact_id": "x", "field": "f", "value": value(7), "evidence_ids": ["e"], "observed_at": "2024-01-15"}, {"fact_id": "y", "field": "g", "value": value(True, "boolean", None), "evidence_ids": ["e"]}]},
            {"patient_id": "q", "index_date": "2024-03-20", "evidence": [], "facts": [{"fact_id": "x", "field": "f", "value": value(7), "evidence_ids": ["e"], "observed_at": "2024-01-15"}]},
            {"patient_id": "r", "index_date": "2024-03-20", "evidence": [], "facts": []},
        ],
        "trials": [{"trial_id": "t", "title": "T", "criteria": [{"criterion_id": "a", "criterion_type": "inclusion", "description": "", "hard": True, "expression": either}, {"criterion_id": "b", "criterion_type": "inclusion", "description": "", "expression": recent}]}],
    }
    (tmp_path / "n.json").write_text(json.dumps(doc))
    tables = fixtures.read_nested_fixture(spark, str(tmp_path / "n.json"))
    got = {r["patient_id"]: (r["decision"], r["score"], r["coverage"]) for r in matching.match_tables(tables["facts"], tables["criteria"], tables["patients"]).collect()}
    assert got == {"p": ("eligible", 1.0, 1.0), "q": ("eligible", 1.0, 0.5), "r": ("unknown", None, 0.0)}
