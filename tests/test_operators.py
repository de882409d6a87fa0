import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievewright.functions.logic import atom
from sievewright.operators import extraction, governance, matching, metrics, policy, relational, retrieval, sampling

INDEX = dt.date(2024, 1, 20)
FACTS = "patient_id string, fact_id long, field string, value_type string, num double, flag boolean, str string, day date, unit string, observed_at date, evidence_ids array<string>"


def fact(patient, k, field, num=None, unit="u", at="2024-01-10", flag=None):
    return (patient, k, field, "number" if num is not None else "boolean", num, flag, None, None, unit if num is not None else None, at and dt.date.fromisoformat(at), [f"e{k}"])


def truth(spark, facts, **kw):
    a = matching.Atom("c", "f", kw.pop("op", ">"), kw.pop("expected", 5.0), unit="u", **kw)
    df = spark.createDataFrame(facts, FACTS)
    row = matching.atom_decisions(matching.patient_atoms(df, [a], F.lit(INDEX), spark.createDataFrame([("p",)], "patient_id string")), [a]).first()
    return row["truth"], row["issue"]


def test_atoms(spark):
    assert truth(spark, [fact("p", 1, "f", 9.0), fact("p", 2, "f", 1.0)]) == (True, None)
    assert truth(spark, [fact("p", 1, "f", 1.0), fact("p", 2, "f", 9.0, unit="v")]) == (None, "unit_mismatch")
    assert truth(spark, [fact("p", 1, "f", 9.0), fact("p", 2, "f", 1.0, unit="v")]) == (True, "unit_mismatch")
    assert truth(spark, [fact("p", 1, "f", 9.0), fact("p", 2, "f", 1.0)], selection="all") == (False, None)
    assert truth(spark, [fact("p", 1, "f", 9.0), fact("p", 2, "f", 9.0, unit="v")], selection="all") == (None, "unit_mismatch")
    assert truth(spark, [fact("p", 1, "f", flag=True)]) == (None, "type_mismatch")
    assert truth(spark, [fact("p", 1, "g", 9.0)]) == (None, "no_usable_fact")
    assert truth(spark, []) == (None, "no_usable_fact")


def test_time(spark):
    assert truth(spark, [fact("p", 1, "f", 9.0, at="2024-02-01")]) == (None, "future_fact_excluded")
    assert truth(spark, [fact("p", 1, "f", 9.0, at="2024-01-25")], window_days=10, window_direction="future") == (True, None)
    assert truth(spark, [fact("p", 1, "f", 9.0, at=None)]) == (True, None)
    assert truth(spark, [fact("p", 1, "f", 9.0, at=None)], window_days=99, window_direction="past")[0] is None
    assert truth(spark, [fact("p", 1, "f", 9.0, at="2024-01-01"), fact("p", 2, "f", 1.0, at="2024-01-09")], selection="latest") == (False, None)
    assert truth(spark, [fact("p", 1, "f", 9.0, at=None)], selection="latest") == (None, "latest_requires_date")


def test_soft_failure_and_missing_hard(spark):
    atoms = [matching.Atom(k, k, ">", 5.0, unit="u") for k in "abc"]
    trial = matching.Trial("t", tuple(matching.Criterion(k, "inclusion", atom(k), hard=k == "c") for k in "abc"))
    df = spark.createDataFrame([fact("p", 1, "a", 9.0), fact("p", 2, "b", 1.0), fact("p", 3, "c", 9.0), fact("q", 4, "a", 9.0)], FACTS)
    rows = {r["patient_id"]: r for r in matching.match(df, atoms, [trial], F.lit(INDEX)).collect()}
    assert (rows["p"]["decision"], rows["p"]["score"], rows["p"]["coverage"]) == ("eligible", pytest.approx(2 / 3, abs=1e-6), 1.0)
    assert (rows["q"]["decision"], rows["q"]["abstained"], rows["q"]["abstention_reasons"]) == ("unknown", True, ["hard_unknown:c"])


def test_bm25(spark):
    chunks = spark.createDataFrame([("s", 1, "alpha beta"), ("s", 2, "beta beta gamma"), ("s", 3, "delta"), ("r", 4, "alpha")], "scope string, chunk_id int, text string")
    q = spark.createDataFrame([(0, "alpha alpha"), (1, "omega")], "query_id int, text string")
    got = retrieval.ranked(retrieval.bm25_scores(chunks, q), ["scope", "query_id"]).collect()
    assert {(r["scope"], r["query_id"], r["chunk_id"]) for r in got} == {("s", 0, 1), ("r", 0, 4)}


def test_rrf(spark):
    dense = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank int")
    lexical = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    got = retrieval.reciprocal_rank_fusion(dense, lexical, ["query_id"]).orderBy("rank").collect()
    assert sorted(r["chunk_id"] for r in got) == ["a", "b", "c"] and got[2]["chunk_id"] == "c" and got[2]["lexical_rank"] is None
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert retrieval.stray_candidates(dense, lexical, ["query_id"]).count() == 0


def test_prefix_budget_stops(spark):
    chunks = spark.createDataFrame([("s", 1, 0, 5), ("s", 2, 5, 10), ("s", 3, 15, 1)], "scope string, chunk_id int, start int, length int")
    assert [r["chunk_id"] for r in retrieval.prefix_budget(chunks, 7).collect()] == [1]


def test_classes(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "c")], "g string, p string")
    s = metrics.class_summary(metrics.class_metrics(rows, "g", "p", ("a", "b", "c"))).first()
    assert s["accuracy"] == pytest.approx(2 / 3) and s["micro_f1"] == pytest.approx(2 / 3) and s["macro_f1"] == pytest.approx(5 / 9)
    assert metrics.confusion(rows, "g", "p", ("a", "b", "c")).count() == 9


def test_coverage_risk(spark):
    rows = spark.createDataFrame([(0.9, True, False), (0.6, False, False), (0.2, True, True)], "s double, c boolean, a boolean")
    got = [(r["coverage"], r["risk"]) for r in metrics.coverage_risk(rows, "s", "c", "a").orderBy(F.desc("threshold")).collect()]
    assert got == [(pytest.approx(1 / 3), 0.0), (pytest.approx(2 / 3), 0.5), (pytest.approx(2 / 3), 0.5)]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("r", "y", 1)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "y", 1), ("r", "y", 1)], "query string, item string, grade int")
    got = metrics.retrieval_metrics(ranked, relevant, ["query"], 2)
    assert got.agg(F.avg("reciprocal_rank")).first()[0] == 0.75 and got.agg(F.avg("recall")).first()[0] == 1.0


def test_bootstrap_and_kappa(spark):
    clusters = spark.createDataFrame([("a", 5, 5), ("b", 0, 5)], "cluster string, t int, b int")
    r = metrics.clustered_bootstrap(clusters, "t", "b", "seed", 200).first()
    assert (r["estimate"], r["low"], r["high"], r["n_clusters"]) == (0.5, 0.0, 1.0, 2)
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert metrics.cohen_kappa(same, "a", "b").first()["kappa"] == 1.0


def test_suppression(spark):
    counts = spark.createDataFrame([("g", "a", 2), ("g", "b", 9), ("g", "c", 7), ("g", "d", 0), ("h", "a", 1), ("h", "b", 1), ("k", "a", 3)], "g string, name string, n int")
    got = {(r["g"], r["name"]): (r["n"], r["hidden"], r["exposed"]) for r in governance.suppressed(counts, ["g"], "name", "n", 5).collect()}
    assert got[("g", "a")] == (None, True, False) and got[("g", "c")] == (None, True, False) and got[("g", "b")] == (9, False, False) and got[("g", "d")] == (0, False, False)
    assert got[("h", "a")][1] and got[("k", "a")] == (None, True, True)


def test_leakage_and_spans(spark):
    members = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (3, "b", "z")], "entity_id int, split string, content string")
    assert {(r["kind"], r["key"]) for r in governance.split_leakage(members).collect()} == {("entity", "3"), ("content", "x")}
    spans = spark.createDataFrame([("k", 0, 5), ("k", 6, 9), ("k", 8, 8)], "key string, start int, end int")
    assert sorted(r["violations"] for r in governance.span_violations(spans, "key").collect()) == [["empty", "overlap"], ["gap"]]


def test_sampling(spark):
    rows = spark.createDataFrame([(k,) for k in range(100)], "k int")
    a = {r["k"] for r in sampling.hash_sample(rows, "k", 10, "s").collect()}
    b = {r["k"] for r in sampling.hash_sample(rows.orderBy(F.desc("k")), "k", 10, "s").collect()}
    assert a == b and len(a) == 10
    seats = sampling.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double"), "k", "w", 10)
    assert sorted(r["seats"] for r in seats.collect()) == [3, 3, 4]
    tokens = spark.createDataFrame([(g, 1, t, 1) for g, t in (("g1", "x"), ("g2", "x"), ("g3", "y"), ("g4", "y"))], "group string, size int, token string, n int")
    got = sampling.assign_groups(tokens, {"train": 0.5, "test": 0.5})
    assert sorted((got[g], t) for g, t in (("g1", "x"), ("g2", "x"), ("g3", "y"), ("g4", "y"))) == [("test", "x"), ("test", "y"), ("train", "x"), ("train", "y")]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in sampling.components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[102] == 100


def test_policies(spark):
    rows = spark.createDataFrame([(True, ["a"], ["a"], True, "u", "u", True, "present", 1.0), (True, ["b"], ["a"], True, "u", "u", True, "present", 1.0), (False, [], ["a"], True, "u", "u", False, "present", 1.0)],
                                 "schema_valid boolean, cited array<string>, known array<string>, needs_evidence boolean, unit string, expected_unit string, verifier_agrees boolean, status string, value double")
    got = [(r["status"], r["reason"], r["cited"]) for r in policy.projected(rows).collect()]
    assert got == [("present", None, ["a"]), ("unknown", "unusable_evidence", []), ("unknown", "invalid_schema", [])]
    parsed = spark.createDataFrame([("yes", "No"), ("numeric", "3.5"), ("numeric", "x"), ("yes", "")], "k string, a string").select(policy.parsed_answer(F.col("k"), F.col("a")).alias("p")).collect()
    assert [tuple(r["p"]) for r in parsed] == [("absent", None, None), ("present", 3.5, None), ("unknown", None, "unparsable_answer"), ("unknown", None, "empty_answer")]


def test_protocols(spark):
    text = "Key Inclusion Criteria:\r\nsome words\r\n- first \\<5\r\n  and more\r\n- second\r\n\r\nExclusion Criteria\r\nplain one\r\nplain one\r\n"
    df = spark.createDataFrame([("p", text), ("q", "no headings here")], "protocol_id string, text string")
    rows = extraction.protocol_criteria(df).orderBy("protocol_id", "position").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("inclusion", "first <5 and more"), ("inclusion", "second"), ("exclusion", "plain one"), ("exclusion", "plain one"), (None, None)]
    assert rows[3]["criterion_id"] == rows[2]["criterion_id"] + "-2" and rows[4]["error"] == "ambiguous_polarity"


def test_lexical(spark):
    rules = (extraction.LexicalRule("bleed", ("bleeding",), negations=(r"\bno\b",), uncertain=(r"\bpossible\b",)),)
    chunks = spark.createDataFrame([("p", 1, "Had bleeding. No bleeding now."), ("q", 2, "No bleeding."), ("r", 3, "Possible bleeding."), ("s", 4, "Nothing.")], "scope string, chunk_id long, text string")
    got = {r["scope"]: (r["status"], r["reason"]) for r in extraction.lexical_findings(extraction.lexical_mentions(chunks, rules), chunks, rules).collect()}
    assert got == {"p": ("unknown", "conflicting"), "q": ("absent", None), "r": ("unknown", "ambiguous"), "s": ("unknown", "not_mentioned")}


def test_joins(spark):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 1.0, 2), ("b", 1.0, 3)], "k string, at double, id int")
    right = spark.createDataFrame([("a", 2.0, 10, 7.0), ("a", 5.0, 11, 8.0)], "k string, at double, id int, v double")
    got = {r["id"]: r["asof_value"] for r in relational.as_of_join(left, right, ["k"], "at", "v", "id").collect()}
    assert got == {1: 8.0, 2: None, 3: None}
    spans = spark.createDataFrame([("a", 0.0, 5.0, "s"), ("a", 5.0, 30.0, "t"), ("a", 4.0, 4.0, "u")], "k string, lo double, hi double, name string")
    assert {(r["id"], r["name"]) for r in relational.range_join(left, spans, "at", "lo", "hi", 10.0, ["k"]).collect()} == {(1, "t"), (2, "s")}


def test_latest_by_text_ids_and_its_evidence(spark):
    atoms = [matching.Atom("a", "f", ">", 5.0, unit="u", selection="latest")]
    rows = [fact("p", "f2", "f", 9.0, at="2024-01-05"), fact("p", "f1", "f", 1.0, at="2024-01-09"), fact("p", "f3", "f", 7.0, at="2024-01-09")]
    df = spark.createDataFrame(rows, FACTS.replace("fact_id long", "fact_id string"))
    got = matching.atom_decisions(matching.patient_atoms(df, atoms, F.lit(INDEX)), atoms).first()
    assert got["truth"] is False
    assert [r["evidence"] for r in matching.cited_evidence(df, atoms, F.lit(INDEX)).collect()] == [rows[1][-1]]
    assert matching.latest_facts(df, F.lit(INDEX)).first()["fact_id"] == "f1"


def test_attribution_gates(spark):
    columns = "gold_status string, status string, gold_unit string, unit string, gold_value double, value double, cited array<string>, known array<string>"
    rows = [
        (("present", "present", "u", "u", 1.0, 1.0, ["x"], ["a"]), "unsupported"), (("present", "present", "u", "u", 1.0, 1.0, [], ["a"]), "unsupported"), (("present", "unknown", "u", "u", 1.0, None, ["x"], ["a"]), "abstention_on_known"),
        (("present", "present", "u", None, 1.0, 1.0, ["a"], ["a"]), "unit"), (("present", "present", "u", "u", 1.0, 2.0, ["a"], ["a"]), "numeric_value"), (("absent", "present", "u", "u", None, 2.0, ["a"], ["a"]), "status"),
        (("unknown", "unknown", "u", "u", None, 3.0, [], ["a"]), "other"), (("present", "present", "u", "u", 1.0, 1.0, ["a"], ["a"]), None),
    ]
    df = spark.createDataFrame([r for r, _ in rows], columns)
    assert [r["c"] for r in df.select(policy.attribution(df).alias("c")).collect()] == [c for _, c in rows]


def test_abstention_traces(spark):
    row = (True, ["a"], ["a"], True, None, "u", True, "present", 1.0, ["t"])
    df = spark.createDataFrame([row], "schema_valid boolean, cited array<string>, known array<string>, needs_evidence boolean, unit string, expected_unit string, verifier_agrees boolean, status string, value double, trace_ids array<string>")
    got = policy.projected(df).first()
    assert (got["reason"], got["trace_ids"]) == ("incompatible_unit", ["t", "deterministic_abstention.incompatible_unit"])


def test_lexical_contexts(spark):
    rules = (extraction.LexicalRule("bleed", ("bleeding", "hemorrhage"), negations=(r"\bno\b",), uncertain=(r"\bpossible\b",), required_context="gastric"),)
    far = "x" * 120
    texts = ["Gastric bleeding is absent.", f"possible {far} gastric bleeding", "bleeding " + far + " gastric", "No gastric bleeding but gastric " + "y" * 90 + " hemorrhage"]
    chunks = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "scope string, chunk_id long, text string")
    rows = extraction.lexical_mentions(chunks, rules).orderBy("chunk_id", "alias").collect()
    assert [(r["chunk_id"], r["alias"], r["polarity"]) for r in rows] == [(0, 1, "negative"), (1, 1, "positive"), (2, 1, "ambiguous"), (3, 1, "negative"), (3, 2, "positive")]
    assert all(r["sentence"][r["start"] : r["end"]].lower() in ("bleeding", "hemorrhage") for r in rows)


def test_coverage_risk_at_given_thresholds(spark):
    rows = spark.createDataFrame([(0.9, True, False), (0.6, False, False), (0.2, True, True)], "s double, c boolean, a boolean")
    got = [tuple(r) for r in metrics.coverage_risk(rows, "s", "c", "a", [0.5, 0.95, 0.5], abstain_all=True).orderBy(F.col("threshold").desc_nulls_first()).collect()]
    assert got == [(None, 0, 0.0, None), (0.95, 0, 0.0, None), (0.5, 2, pytest.approx(2 / 3), 0.5)]
    with pytest.raises(ValueError):
        metrics.coverage_risk(rows, "s", "c", "a", [1.5])


def test_ordinals_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = {r["k"]: r["n"] for r in metrics.numbered(rows, "k", "n").collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))
