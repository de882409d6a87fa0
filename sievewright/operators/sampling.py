"""Hash-ranked samples, holdouts, apportionment, balanced group splits, pools of vectors, near pairs and components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_hash
from ..functions.vector import normalized
from ..session import checkpointed


#: Vectors of a block that are compared in one group with as many others.
TILE_ROWS = 1500


def hash_sample(rows: DataFrame, key: str, n: int, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """The n rows (of each stratum) whose hashes come first: the same ones in whatever order the rows come.

    Without strata this is a sort with a limit, so each partition sends n rows at most.
    """
    ranked = rows.withColumn("sample_hash", rank_hash(seed, F.col(key)))
    if not strata:
        return ranked.orderBy("sample_hash", key).limit(n)
    order = Window.partitionBy(*strata).orderBy("sample_hash", key)
    return ranked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).drop("turn")


def holdout(rows: DataFrame, key: str, shares: Mapping[str, float], seed: str) -> DataFrame:
    """Rows with a split by the place of their key's hash in [0, 1): no sort and no shuffle, and a key keeps its split."""
    place = F.conv(F.substring(rank_hash(seed, F.col(key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    chain, edge = F.lit(list(shares)[-1]), sum(shares.values())
    for name, share in reversed(list(shares.items())[:-1]):
        edge = sum(list(shares.values())[: list(shares).index(name) + 1])
        chain = F.when(place < edge, F.lit(name)).otherwise(chain)
    return rows.withColumn("split", chain)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Whole seats in proportion to weights that sum to `total`: floors first, then one each by the largest remainder."""
    everything = Window.partitionBy()
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(everything)
    rows = weights.withColumn("exact", exact).withColumn("floor", F.floor("exact").cast("long"))
    rows = rows.withColumn("turn", F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("floor"), 9).desc(), key))).withColumn("spare", F.lit(total) - F.sum("floor").over(everything))
    return rows.select(key, weight, (F.col("floor") + (F.col("turn") <= F.col("spare")).cast("long")).alias("seats"))


def balance_report(rows: DataFrame, question: str, split: str, token: str) -> DataFrame:
    """Per question and split, and per question over all splits (split is null): rows, positives, prevalence."""
    sums = rows.groupingSets([[F.col(question), F.col(split)], [F.col(question)]], F.col(question), F.col(split)).agg(F.count("*").alias("n"), F.count_if(F.col(token)).alias("positives"), F.grouping(split).alias("overall"))
    return sums.withColumn("prevalence", F.round(F.col("positives") / F.col("n"), 6))


def prevalence_deviation(report: DataFrame, question: str) -> DataFrame:
    """Per question the mean and the greatest distance of a split's prevalence from the overall one, and empty splits."""
    whole = report.where("overall = 1").select(question, F.col("prevalence").alias("whole"))
    away = F.abs(F.col("prevalence") - F.col("whole"))
    return report.where("overall = 0").join(whole, question).groupBy(question).agg(F.round(F.avg(away), 6).alias("mean_deviation"), F.round(F.max(away), 6).alias("max_deviation"), F.count_if(F.col("positives") == 0).alias("zero_splits"))


def reserved(rows: DataFrame, key: str, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """A calibration reservation of n keys, and the rest."""
    taken = hash_sample(rows.select(key).distinct(), key, n, seed).select(key)
    return rows.join(taken, key, "left_semi"), rows.join(taken, key, "left_anti")


def pooled(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean of a group's length-one vectors, scaled to length one; vectors that can't be scaled are left out."""
    parts = vectors.select(group, F.posexplode(normalized(F.col(vec))).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    return rows.select(group, normalized(F.col("mean")).alias("pooled"))


def cosine_pairs(vectors: DataFrame, key: str, vec: str, block: str | None, threshold: float, split: str | None = None) -> DataFrame:
    """Pairs (left_id, right_id, similarity) of one block whose cosine is `threshold` or more; with `split` only those
    on different sides. A block is the unit within which pairs count, such as a label; without one all vectors are compared.

    A block's vectors are dealt by a hash to tiles of about TILE_ROWS, and each pair of tiles is a group of its own and
    one product of matrices: a hot block is as many tasks as it has pairs of tiles, and no group grows with it.
    """
    side = F.col(split).cast("string") if split else F.lit(None).cast("string")
    unit = vectors.select(F.col(key).alias("id"), (F.col(block) if block else F.lit(0)).alias("block"), side.alias("side"), normalized(F.col(vec)).alias("u")).where("u is not null and id is not null and block is not null")
    sizes = unit.groupBy("block").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias("tiles"))
    placed = unit.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("id", "block", "side", "u", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile")
    kind = vectors.schema[key].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        sizes = np.asarray(group.column("u").combine_chunks().value_lengths())
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            some = group.take(pa.array(at))
            u = np.asarray(some.column("u").combine_chunks().flatten(), dtype=float).reshape(len(at), dim)
            tile = some.column("tile").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
            value = np.clip(u[a] @ u[b].T, -1.0, 1.0)
            i, j = np.nonzero(value >= threshold)
            if low == high:
                i, j = i[i < j], j[i < j]
            x = value[i, j]
            i, j = a[i], b[j]
            if split:
                names = np.array(some.column("side").to_pylist(), dtype=object)
                on = np.array([p is not None and q is not None and p != q for p, q in zip(names[i], names[j], strict=True)], dtype=bool)
                i, j, x = i[on], j[on], x[on]
            found.append((at[i], at[j], x))
        i, j, x = (np.concatenate(p) for p in zip(*found, strict=True))
        ids = group.column("id")
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(x)], names=["a", "b", "similarity"])

    pairs = dealt.groupBy("block", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}, similarity double").where("a <> b")
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity")


def merged_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs from several scans as one set, whichever way round; `consistent` tells whether their similarities agree."""
    rows = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")
    return rows.groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_scans"), (F.max("similarity") - F.min("similarity") <= 1e-12).alias("consistent"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): the least node each node of `edges` (u, v) is connected with.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node's neighbours move to its least one, so a
    component becomes a star in O(log^2 n) rounds. Minima are found with partial sums on each task; rounds are
    checkpointed to the cluster's shared folder. Edges with a null end are left out, a node's edge to itself stays a node.
    """
    whole = edges.select("u", "v").where("u is not null and v is not null")
    own = whole.where("u = v").select("u").distinct()
    turned = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = checkpointed(turned(whole))
    before = state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = turned(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(turned(small.unionByName(least.select("u", F.col("m").alias("v")))))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = own.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(roots).unionByName(alone.join(stars.unionByName(roots), "node", "left_anti"))


def pair_cost(observed: Column, target: Column, total: Column) -> Column:
    """Cost of a token's count in a split: squared distance over the total, and 25 for a token that is absent."""
    return F.pow(observed - target, 2) / total + F.when(observed == 0, 25.0).otherwise(0.0)


def assign_groups(tokens: DataFrame, shares: Mapping[str, float], rounds: int = 1000) -> dict[str, str]:
    """A split for each group: greedy by size and rarity, then swaps of equally large groups while one lowers the cost.

    tokens: group, size, token, n; one row per group and token. Sequential by nature, it runs on the driver, on
    counts by group and never on rows.
    """
    rows = tokens.orderBy("group", "token").collect()
    groups = sorted({r["group"] for r in rows})
    kinds = sorted({r["token"] for r in rows})
    at = {g: k for k, g in enumerate(groups)}
    counts, size = np.zeros((len(groups), len(kinds))), np.zeros(len(groups), dtype=np.int64)
    for r in rows:
        counts[at[r["group"]], kinds.index(r["token"])] += r["n"]
        size[at[r["group"]]] = r["size"]
    names = list(shares)
    share = np.array([shares[s] for s in names]) / sum(shares.values())
    total = counts.sum(0)
    target, room = np.outer(share, total), np.ceil(share * size.sum()).astype(int)
    held, load = np.zeros((len(names), len(kinds))), np.zeros(len(names), dtype=np.int64)

    def cost(h: np.ndarray, s: int) -> float:
        return float(((h - target[s]) ** 2 / np.maximum(total, 1)).sum() + 25.0 * (h[total > 0] == 0).sum())

    rarity = (counts / np.maximum(total, 1)).sum(1)
    place = np.zeros(len(groups), dtype=int)
    for g in sorted(range(len(groups)), key=lambda k: (-size[k], -rarity[k], groups[k])):
        fits = [s for s in range(len(names)) if load[s] + size[g] <= room[s]] or list(range(len(names)))
        place[g] = min(fits, key=lambda s: (cost(held[s] + counts[g], s) - cost(held[s], s), load[s] - room[s], s))
        held[place[g]] += counts[g]
        load[place[g]] += size[g]
    for _ in range(rounds):
        best, swap = -1e-9, None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                s, t = place[a], place[b]
                if s == t or size[a] != size[b]:
                    continue
                d = counts[b] - counts[a]
                gain = cost(held[s] + d, s) + cost(held[t] - d, t) - cost(held[s], s) - cost(held[t], t)
                if gain < best:
                    best, swap = gain, (a, b)
        if swap is None:
            break
        a, b = swap
        d = counts[b] - counts[a]
        held[place[a]] += d
        held[place[b]] -= d
        place[a], place[b] = place[b], place[a]
    return {g: names[place[k]] for k, g in enumerate(groups)}
