"""Near pairs over all vectors, whatever their labels."""

import numpy as np

from sievewright.operators import sampling


def test_pairs_across_labels(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 4))
    v[7] = v[90]
    rows = [(k, k % 5, "ab"[k % 2], [float(x) for x in v[k]]) for k in range(120)] + [(500, 1, "a", None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, split string, embedding array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = {(a, b): u[a] @ u[b] for a in range(120) for b in range(a + 1, 120) if u[a] @ u[b] >= 0.8}
    got = sampling.cosine_pairs(df, "vec_id", "embedding", None, 0.8).collect()
    assert len(got) == len(near) and all(abs(near[r["left_id"], r["right_id"]] - r["similarity"]) < 1e-9 for r in got)
    assert any(a % 5 != b % 5 for a, b in near)
    sides = sampling.cosine_pairs(df, "vec_id", "embedding", None, 0.8, "split").collect()
    assert {(r["left_id"], r["right_id"]) for r in sides} == {(a, b) for a, b in near if a % 2 != b % 2}
    blocked = sampling.cosine_pairs(df, "vec_id", "embedding", "label", 0.8).collect()
    assert {(r["left_id"], r["right_id"]) for r in blocked} == {(a, b) for a, b in near if a % 5 == b % 5}


def test_pair_of_two_labels_in_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = sampling.cosine_pairs(vectors, "vec_id", "embedding", None, 0.6).collect()
    assert [(r["left_id"], r["right_id"], round(r["similarity"], 5)) for r in got] == [(425, 1198, 0.60086)]
