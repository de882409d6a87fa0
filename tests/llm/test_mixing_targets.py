"""Rates meet targets that can be met, however hard; a target that can't be met is reported."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import mixing


def hard(rng, n, shares, soft, long):
    p = np.eye(len(shares))[rng.choice(len(shares), n, p=shares)] * (1 - soft) + soft * rng.dirichlet(np.ones(len(shares)), n)
    tokens = rng.integers(20, 500, n)
    tokens[:long] *= 500
    return p, tokens


@pytest.mark.parametrize("shares, soft, long", [((0.7, 0.2, 0.09, 0.01), 0.1, 20), ((0.7, 0.2, 0.09, 0.01), 0.0, 20), ((0.7, 0.2, 0.09, 0.01), 0.4, 0)])
def test_hard_targets(spark, shares, soft, long):
    p, tokens = hard(np.random.default_rng(8), 20_000, shares, soft, long)
    df = spark.createDataFrame([(k, int(t), x) for k, (t, x) in enumerate(zip(tokens, p.tolist()))], "id long, n_tokens long, posterior array<double>").repartition(3).cache()
    targets = np.full(4, tokens.sum() / 4)
    found, history = mixing.matched(df, targets)
    rate = np.array([r["rate"] for r in found.orderBy("id").collect()])
    got = (rate * tokens) @ p / targets - 1
    print("residuals", history, "steepest", mixing.mixed(df, targets, steps=1)[1])
    assert (rate >= 0).all() and np.abs(got).max() <= 1.001e-4 and history[-1] <= mixing.RESIDUAL and len(history) < 60


def test_unmet_targets_are_reported(spark):
    docs = spark.createDataFrame([(k, f"a{k % 3} b") for k in range(20)], "doc_id long, text string")
    labelled = docs.select(F.col("doc_id").alias("id"), F.lit("x").alias("domain"))
    with pytest.warns(UserWarning, match="misses its targets"):
        mixing.mix(docs, labelled, {"x": -1.0}, budget=1e3).collect()
