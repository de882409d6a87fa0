"""Evaluation: retrieval metrics, classification, numeric values, coverage and risk, agreement, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.logic import ratio
from ..session import checkpointed


def confusion(rows: DataFrame, gold: str, predicted: str, labels: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Dense counts over labels x (labels and extra predicted values), with zeros. A missing prediction is `missing`."""
    spark = rows.sparkSession
    domain = spark.createDataFrame([(g, p) for g in labels for p in [*labels, *extra]], "gold string, predicted string")
    counts = rows.groupBy(F.col(gold).alias("gold"), F.coalesce(predicted, F.lit("missing")).alias("predicted")).agg(F.count("*").alias("n"))
    return domain.join(counts, ["gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(rows: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Per label: precision, recall, F1, support; empty denominators give 0. One pass over the rows.

    A missing prediction counts against recall alone.
    """
    g, p = F.col(gold), F.coalesce(predicted, F.lit("missing"))
    sums = rows.agg(*[F.struct(F.count_if((g == x) & (p == x)).alias("tp"), F.count_if((g != x) & (p == x)).alias("fp"), F.count_if((g == x) & (p != x)).alias("fn")).alias(f"_{k}") for k, x in enumerate(labels)])
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{k}.tp").alias("tp"), F.col(f"_{k}.fp").alias("fp"), F.col(f"_{k}.fn").alias("fn")) for k, x in enumerate(labels)])
    out = sums.select(F.inline(each))
    return out.select(
        "label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0).alias("f1"),
    )


def class_summary(metrics: DataFrame) -> DataFrame:
    """Accuracy, micro-F1, macro-F1 over active labels (seen in gold or predicted) and over all labels."""
    active = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return metrics.agg(
        ratio(tp, F.sum("support"), 0.0).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("micro_f1"),
        ratio(F.sum(F.when(active, F.col("f1")).otherwise(0.0)), F.count_if(active), 0.0).alias("macro_f1"), F.avg("f1").alias("macro_f1_all"),
    )


def numeric_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows: gold_value, gold_unit, predicted_value, predicted_unit, tolerance; gold_value null where there is none.

    Coverage and tolerance accuracy are over rows with a gold value, mean absolute error over valid pairs: a
    prediction is there and its unit is the gold one. With keys also the overall row, by grouping sets.
    """
    has = F.col("gold_value").isNotNull()
    there = has & F.col("predicted_value").isNotNull()
    valid = there & F.col("gold_unit").eqNullSafe(F.col("predicted_unit"))
    error = F.abs(F.col("predicted_value") - F.col("gold_value"))
    close = valid & (error <= F.col("tolerance"))
    aggs = [
        F.count_if(has).alias("n_gold"), F.count_if(there).alias("n_predicted"), F.count_if(valid).alias("n_valid"), F.count_if(there & ~valid).alias("n_invalid_unit"),
        ratio(F.count_if(there), F.count_if(has)).alias("coverage"), F.avg(F.when(valid, error)).alias("mae"),
        ratio(F.count_if(close), F.count_if(valid)).alias("within_of_valid"), ratio(F.count_if(close), F.count_if(has)).alias("within_of_gold"),
    ]
    return rows.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*aggs) if keys else rows.agg(*aggs)


def coverage_risk(rows: DataFrame, score: str, correct: str, abstained: str, thresholds: Sequence[float] | None = None, abstain_all: bool = False) -> DataFrame:
    """For each threshold from the top: answered rows at or above it, their share of all (coverage) and the wrong ones
    among them (risk, null if none is answered). Thresholds are the distinct scores, those of abstained rows too, or
    the given ones, each once and from 0 to 1; `abstain_all` puts a point without a threshold first, where nothing is answered."""
    answered = ~F.col(abstained)
    by_score = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(answered).alias("a"), F.count_if(answered & ~F.col(correct)).alias("w"))
    if thresholds is not None:
        if any(not 0 <= t <= 1 for t in thresholds):
            raise ValueError("thresholds are from 0 to 1")
        steps = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
        reached = F.when(F.col("threshold") >= 0, F.filter(steps, lambda t: t <= F.col("threshold")))
        last = by_score.select(F.get(reached, F.size(reached) - 1).alias("threshold"), "n", "a", "w")
        empty = rows.sparkSession.range(1).select(F.explode(steps).alias("threshold"), *[F.lit(0).cast("long").alias(c) for c in "naw"])
        by_score = last.unionByName(empty).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in "naw"])
    by_score = checkpointed(by_score)
    total = by_score.agg(F.sum("n").alias("total"))
    sums = running_sums(by_score.where("threshold is not null"), "threshold", {"answered": "a", "wrong": "w"})
    points = sums.join(F.broadcast(total)).select("threshold", "answered", ratio(F.col("answered"), F.col("total")).alias("coverage"), ratio(F.col("wrong"), F.col("answered")).alias("risk"))
    if abstain_all:
        none = total.select(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("answered"), F.lit(0.0).alias("coverage"), F.lit(None).cast("double").alias("risk")).where("total is not null")
        points = none.unionByName(points.withColumn("threshold", F.col("threshold").cast("double")))
    return points


def _placed(rows: DataFrame, order: Column) -> DataFrame:
    """rows dealt over partitions by ranges of `order`, with their partition (__part) and place in it (__place)."""
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    return checkpointed(dealt).withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def _before(placed: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """What the partitions before each one sum up to: a row per partition."""
    parts = placed.groupBy("__part").agg(*[c.alias(name) for name, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums])


def running_sums(rows: DataFrame, order: str, columns: Mapping[str, str]) -> DataFrame:
    """`order` (distinct values, from the top) with running sums of columns, named by `columns`: no task holds more than
    a range of the rows; ranges' totals are a row per partition."""
    placed = _placed(rows, F.col(order).desc())
    down = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select(order, "__part", *[F.sum(c).over(down).alias(name) for name, c in columns.items()])
    before = _before(placed, {f"__{name}": F.sum(c) for name, c in columns.items()})
    return own.join(F.broadcast(before), "__part").select(order, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in columns])


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their ordinals from 0 by `order`."""
    placed = _placed(rows, F.col(order).asc())
    before = _before(placed, {"__rows": F.count("*")})
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__rows") + F.col("__place")).drop("__rows", "__part", "__place")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Per query of `relevant` (keys, item, grade > 0): recall@k, reciprocal rank and nDCG@k of `ranked` (keys, item, rank)."""
    hits = relevant.where("grade > 0").join(ranked.select(*keys, "item", "rank"), [*keys, "item"], "left")
    ideal = Window.partitionBy(*keys).orderBy(F.desc("grade"), "item")
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(rank + 1)
    rows = hits.withColumn("ideal_rank", F.row_number().over(ideal))
    found = F.coalesce(F.col("rank") <= k, F.lit(False))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_relevant"), F.count_if(found).alias("n_found"), F.min("rank").alias("first"),
        F.sum(F.when(found, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal_rank") <= k, gain(F.col("ideal_rank"))).otherwise(0.0)).alias("idcg"),
    )
    return out.select(*keys, "n_relevant", ratio(F.col("n_found"), F.col("n_relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), ratio(F.col("dcg"), F.col("idcg"), 0.0).alias("ndcg"))


def hit_at_k(ranked: DataFrame, expected: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Shares of `expected` (keys, item) whose item is among the first k."""
    rows = expected.join(ranked.select(*keys, "item", "rank"), [*keys, "item"], "left")
    return rows.agg(F.count("*").alias("n"), *[ratio(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"hit_at_{k}") for k in ks])


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and chance agreement of two annotators, and kappa: 1 if both always give one same label."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    out = total.join(F.broadcast(chance)).select("n", ratio(F.col("agreed"), F.col("n")).alias("observed"), (F.col("c") / F.col("n") / F.col("n")).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, F.lit(1.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def interpolated_percentile(value: str | Column, p: float) -> Column:
    """Linear between neighbours."""
    return F.percentile(value, p)


def nearest_percentiles(rows: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per group the values at round((n - 1) * p) of the sorted ones, halves to the even neighbour.

    From counts by distinct value and their running sums, so that no group's values are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*keys)
    sums = counts.withColumn("upto", F.sum("n").over(part.orderBy(value))).withColumn("total", F.sum("n").over(part))
    return sums.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(p)), F.col(value))).alias(name) for name, p in ps.items()])


def ceiling_percentile(value: str, p: float) -> Column:
    """The value at ceil(p * n) - 1 of the sorted ones."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def clustered_bootstrap(clusters: DataFrame, statistic_top: str, statistic_bottom: str, seed: str, replicates: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) when whole clusters are drawn with replacement.

    clusters: cluster, and the two sums; one row each, so a replicate costs draws of clusters and no copies of
    rows. A draw is a hash of seed, replicate and slot, alike in every run.
    """
    clusters = checkpointed(clusters)
    size = clusters.count()
    slots = clusters.sparkSession.range(replicates * size).select((F.floor(F.col("id") / F.lit(max(1, size))) + 1).alias("replicate"), (F.col("id") % F.lit(max(1, size)) + 1).alias("slot"))
    times = slots.select("replicate", draw(seed, F.lit(size), F.col("replicate"), F.col("slot")).alias("ordinal")).groupBy("replicate", "ordinal").agg(F.count("*").alias("times"))
    sums = times.join(numbered(clusters, "cluster", "ordinal"), "ordinal").groupBy("replicate").agg(F.sum(F.col("times") * F.col(statistic_top)).alias("t"), F.sum(F.col("times") * F.col(statistic_bottom)).alias("b"))
    values = sums.select(ratio(F.col("t"), F.col("b")).alias("value"))
    whole = clusters.agg(ratio(F.sum(statistic_top), F.sum(statistic_bottom)).alias("estimate"), F.count("*").alias("n_clusters"))
    return whole.join(F.broadcast(values.agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"))))
