"""Wide and grouped shapes: pivots, cross tables, cubes, range and as-of joins, extremes, information measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(rows: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with the first non-null value; the names are given, so no job looks for them."""
    return rows.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def long(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(list(keys), list(columns), name, value)


def crosstab(rows: DataFrame, left: str, right: str, names: Sequence[str]) -> DataFrame:
    return rows.groupBy(left).pivot(right, list(names)).agg(F.count(F.lit(1))).na.fill(0)


def extremes(rows: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """Per group the items of the best and the worst score, the smaller item on ties, as labelled rows."""
    best = F.min_by(item, F.struct(-F.col(score), F.col(item)))
    worst = F.min_by(item, F.struct(F.col(score), F.col(item)))
    sums = rows.groupBy(*keys).agg(best.alias("best"), F.max(score).alias("best_score"), worst.alias("worst"), F.min(score).alias("worst_score"))
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("item"), F.col(f"{n}_score").alias("score")) for n in ("best", "worst")])
    return sums.select(*keys, F.inline(each))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points within [start, end) of spans. Both sides are cut into buckets of `width`, and a span is copied to each
    bucket it reaches, so that the join is an equi-join on buckets with the range as a residual."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = points.withColumn("__b", bucket(at))
    right = spans.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    return left.join(right, ["__b", *keys]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """Each left row with the last right value at or before it. Both are put in one order and the value is carried
    forward, so nothing is multiplied. Both have the columns keys, at, tie; on equal times right rows come first."""
    one = left.select(*keys, at, tie, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    two = right.select(*keys, at, F.col(tie), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    order = Window.partitionBy(*keys).orderBy(at, "__side", tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = one.unionByName(two).withColumn("asof_value", F.last("__v", ignorenulls=True).over(order))
    return carried.where("__side = 1").select(*keys, at, tie, "asof_value")


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Of two discrete columns, in nats, from their joint counts; rows with a null in either are left out."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    na, nb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(na, "a").join(nb, "b").join(F.broadcast(total))
    return joined.agg(F.sum("n").cast("long").alias("n"), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(every).cast("double") / (F.count("*").over(every) * F.col("n")))


def information_bottleneck(kl: Column, loss: Column, beta: float) -> Column:
    return kl - F.lit(beta) * loss
