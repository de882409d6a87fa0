import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from sievewright.functions import hashing, logic, text, vector


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Step 7a: v2.1/beta, Rock-n-Roll!") == ["step", "7a", "v2.1/beta", "rock-n-roll"]
    assert one(spark, text.tokens(F.col("t")), t="Größe") == ["grösse".replace("ö", "ö")]


def test_segments(spark):
    assert one(spark, text.segments(F.col("t")), t="A b.  C d;e\n\n  F!\tG ") == ["A b.", "C d;e", "F!", "G"]
    assert one(spark, text.segments(F.col("t")), t=" \n ") == []


def test_numeric_tokens(spark):
    found = one(spark, text.numeric_tokens(F.col("t")), t="x 1,234.5 (7) v2 3.0.1 -4, 9%")
    assert [float(x) for x in found] == [1234.5, 7, -4, 9]
    more = one(spark, text.numeric_tokens(F.col("t")), t="bp 120/80, .5 mg, 5-10, ends 2. x_3 1,2345 (+6)")
    assert [float(x) for x in more] == [120, 80, 0.5, 5, 10, 1, 2345, 6]
    assert one(spark, text.has_number(F.col("t"), F.lit("7.0")), t="at 7 now")
    assert not one(spark, text.has_number(F.col("t"), F.lit("7")), t="at 77 or 7a")


def test_mentions(spark):
    assert one(spark, text.mentions(F.col("t"), ["lvef"]), t="LVEF 60 and 58 % LVEF") == [60.0, 58.0]
    assert one(spark, text.clamped(F.lit(60.0), 55.0)) == 55.0


@pytest.mark.parametrize("path,good", [("a/b.json", True), ("/a", False), ("../a", False), ("a\\b", False), ("a//b", False), ("a/./b", False), ("c:x", False)])
def test_paths(spark, path, good):
    assert one(spark, text.safe_path(F.col("p")), p=path) is good


def test_note_chunks(spark):
    note = "a" * 30 + "\n\n" + "b" * 30 + " " + "c" * 60 + " " * 50
    spans = one(spark, text.note_chunks(F.col("t"), 40), t=note)
    assert [note[s["start"] : s["end"]] for s in spans] == ["a" * 30 + "\n\n", "b" * 30 + " ", "c" * 40, "c" * 20 + " " * 20]
    assert one(spark, text.trimmed_span(F.col("t"), F.lit(5)), t="  ab ").asDict() == {"start": 7, "end": 9}


def test_hmac_and_ids(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, hashing.hmac_sha256(key, F.col("m")), m="hello") == hmac.new(key, b"hello", hashlib.sha256).hexdigest()
    assert one(spark, hashing.short_id(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\0b").hexdigest()[:16]


def test_kleene(spark):
    tree = logic.all_of(logic.atom("a"), logic.any_of(logic.atom("b"), logic.negated(logic.atom("c"))))
    rows = spark.createDataFrame([(True, None, False), (True, None, True), (False, None, None), (None, True, None)], "a boolean, b boolean, c boolean")
    got = [r["x"] for r in rows.select(logic.truth(tree, {k: F.col(k) for k in "abc"}).alias("x")).collect()]
    assert got == [True, None, False, None]
    with pytest.raises(ValueError):
        logic.Expr("not", ())


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vector.norm(a)) == 5.0
    assert one(spark, vector.normalized(F.array(F.lit(0.0)))) is None
    assert one(spark, vector.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, vector.kl_divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))) == 0.0
