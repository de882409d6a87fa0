"""Data governance: profiles, completeness, disclosure control, leakage, audits of filters, spans and readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import reasons


def question_profile(rows: DataFrame, question: str, status: str, value: str, statuses: Sequence[str]) -> DataFrame:
    """Per question: rows, a count per status (with zeros), the rate of unknowns, least and greatest value."""
    unknown = F.count_if(F.col(status) == "unknown")
    return rows.groupBy(question).agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses], F.round(unknown / F.count("*"), 6).alias("unknown_rate"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def grid_totals(rows: DataFrame, entity: str, question: str) -> DataFrame:
    """Entities, questions, the size of their grid, missing and repeated pairs, complete entities, least and most rows."""
    by_pair = rows.groupBy(entity, question).agg(F.count("*").alias("n"))
    by_entity = by_pair.groupBy(entity).agg(F.count("*").alias("pairs"), F.sum("n").alias("rows"))
    sums = by_entity.agg(F.count("*").alias("entities"), F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows"), F.min("rows").alias("least_rows"), F.max("rows").alias("most_rows"))
    questions = by_pair.agg(F.count_distinct(question).alias("questions"))
    complete = by_entity.join(F.broadcast(questions)).agg(F.count_if(F.col("pairs") == F.col("questions")).alias("complete_entities"))
    out = sums.join(F.broadcast(questions)).join(F.broadcast(complete))
    size = F.col("entities") * F.col("questions")
    return out.select("entities", "questions", size.alias("grid"), (size - F.col("pairs")).alias("missing"), (F.col("rows") - F.col("pairs")).alias("repeated"), "complete_entities", "least_rows", "most_rows")


def missing_pairs(rows: DataFrame, entity: str, question: str, domain: DataFrame) -> DataFrame:
    """Pairs of the full grid that have no row. `domain` holds the questions, which are few."""
    grid = rows.select(entity).distinct().join(F.broadcast(domain.select(question).distinct()))
    return grid.join(rows, [entity, question], "left_anti")


def suppressed(counts: DataFrame, group: Sequence[str], name: str, n: str, least: int) -> DataFrame:
    """Small-cell suppression in additive groups: counts from 1 to least - 1 are hidden; where that hides exactly one
    cell, the smallest other positive one is hidden as well (ties by name), so that it can't be had by subtraction.
    `exposed` marks groups whose only hidden cell has no positive neighbour."""
    part = Window.partitionBy(*group)
    small = (F.col(n) > 0) & (F.col(n) < least)
    rows = counts.withColumn("primary", small).withColumn("n_primary", F.sum(small.cast("int")).over(part))
    other = (F.col(n) > 0) & ~F.col("primary")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(other.desc(), n, name))).withColumn("others", F.sum(other.cast("int")).over(part))
    second = (F.col("n_primary") == 1) & other & (F.col("turn") == 1)
    hidden = F.col("primary") | second
    return rows.select(*group, name, F.when(~hidden, F.col(n)).alias(n), hidden.alias("hidden"), ((F.col("n_primary") == 1) & (F.col("others") == 0)).alias("exposed"))


def failing_reasons(rows: DataFrame, policy: Mapping[str, Column]) -> DataFrame:
    """Every reason of the policy that a row fails for, in the policy's order."""
    return rows.withColumn("reasons", reasons(policy))


def reason_histogram(rows: DataFrame, name: str = "reasons") -> DataFrame:
    return rows.select(F.explode(name).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def span_violations(spans: DataFrame, key: str, start: str = "start", end: str = "end", limit: int | None = None) -> DataFrame:
    """Spans that are empty, too long, overlap the one before or leave a gap after it. They are ordered by start."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    why = reasons({"empty": F.col(end) <= F.col(start), "too_long": (F.col(end) - F.col(start)) > (limit or 1 << 30), "overlap": before > F.col(start), "gap": before < F.col(start)})
    return spans.withColumn("violations", why).where("size(violations) > 0")


def split_leakage(members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Problems of a split: members (entity_id, split, content), pairs (left_id, right_id) of near-duplicates.

    An entity in several splits, equal content in several splits, and near-duplicates on both sides of a border.
    """
    several = lambda key, kind: members.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("rows")).where("splits > 1").select(F.lit(kind).alias("kind"), "key", "rows")
    out = several("entity_id", "entity").unionByName(several("content", "content"))
    if pairs is not None:
        side = lambda s: members.select(F.col("entity_id").alias(f"{s}_id"), F.col("split").alias(f"{s}_split"))
        crossing = pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_split <> right_split")
        out = out.unionByName(crossing.select(F.lit("near_duplicate").alias("kind"), F.concat_ws("|", F.col("left_id").cast("string"), F.col("right_id").cast("string")).alias("key"), F.lit(2).cast("long").alias("rows")))
    return out


def readiness_gaps(counts: DataFrame, needs: Mapping[str, int]) -> DataFrame:
    """One row of counts against least values: the ordered list of those that fall short, and whether none does."""
    gaps = F.array_compact(F.array(*[F.when(F.col(k) < v, F.concat(F.lit(f"{k}: "), F.col(k).cast("string"), F.lit(f" of {v}"))) for k, v in needs.items()]))
    return counts.select(gaps.alias("gaps")).withColumn("ready", F.size("gaps") == 0)


def checks(rows: DataFrame, conditions: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """For named checks (evaluable, passes): rows that are evaluable, pass, fail and can't be evaluated."""
    sums = rows.agg(*[F.struct(F.count_if(e).alias("evaluable"), F.count_if(e & p).alias("passed"), F.count_if(e & ~p).alias("failed"), F.count_if(~e).alias("not_evaluable")).alias(k) for k, (e, p) in conditions.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), *[F.col(f"{k}.{c}").alias(c) for c in ("evaluable", "passed", "failed", "not_evaluable")]) for k in conditions])))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def drift(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Definitions that were added, removed or changed between two versions, by null-safe comparison."""
    a, b = old.select(key, F.struct(*columns).alias("a")), new.select(key, F.struct(*columns).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")
