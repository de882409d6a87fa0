"""Comparing the members of each bucket with one another, however large a bucket is.

A bucket of more than `rows` members is split by a hash of its members into blocks; each pair of blocks is a
group of its own. So no task holds more than two blocks of a bucket, and every pair of members still meets
exactly once. Buckets of one member are dropped before anything is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, written

GROUP = ["bucket", "low", "high"]


def blocked(members: DataFrame, member: str, rows: int, payload: DataFrame | None = None, weight: tuple[str, int] | None = None) -> DataFrame:
    """members: a column `bucket` (long) and a column `member` that is distinct in a bucket.

    Adds (low, high), the pair of blocks a copy of the row takes part in, and `block`, the row's own block.
    Columns of `payload` are joined by `member` last, so that wide rows are dealt out once. With `weight`, a column and how
    much of it a block may hold, blocks of light members may have more than `rows`.
    """
    size = F.count("*") if weight is None else F.least(F.count("*"), F.greatest(F.lit(1), F.sum(weight[0]) * F.lit(rows / weight[1])))
    counts = members.groupBy("bucket").agg(F.count("*").alias("members"), size.alias("size")).where("members > 1").drop("members")
    return _dealt(members.join(counts, "bucket"), member, rows, payload)


def split(members: DataFrame, member: str, rows: int) -> DataFrame:
    """As blocked(), for tables in which nearly all buckets are shared: only the larger ones are looked up, and rows move once."""
    large = written(members.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > rows), "large-buckets")
    return _dealt(members.join(large, "bucket", "left").fillna(1, ["size"]), member, rows, None)


def _dealt(sized: DataFrame, member: str, rows: int, payload: DataFrame | None) -> DataFrame:
    sized = sized.withColumn("blocks", F.ceil(F.col("size") / F.lit(float(rows))).cast("int"))
    block = F.pmod(F.xxhash64(member, F.lit(17)), F.col("blocks").cast("long")).cast("int")
    dealt = sized.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.drop("size", "blocks", "other")
    if payload is not None:
        dealt = dealt.join(payload, member)
    return dealt.repartition(shuffle_parts(sized.sparkSession), *GROUP).sortWithinPartitions(*GROUP)


def whole_groups(batches: Iterator[pa.RecordBatch], hold: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by GROUP: tables that hold whole groups, and the number of each row's group."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < hold:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        group = _numbered(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut), group[:cut]
        rest = table.slice(cut).combine_chunks()
        kept, n = rest.to_batches(), 0
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, _numbered(table)


def _numbered(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    for name in GROUP:
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def meeting(group: np.ndarray, table: pa.Table, step: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call step(i, j) with the row numbers of pairs that meet, many at a time, each pair once.

    Within a group all pairs of rows meet if the group is a block with itself, else those of different blocks.
    """
    low, high, block = (table.column(x).to_numpy() for x in ("low", "high", "block"))
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(len(group))
    d = 1
    while len(rows):
        rows = rows[rows + d < ends[rows]]
        if len(rows):
            i, j = rows, rows + d
            mixed = low[i] != high[i]
            if mixed.any():
                fit = ~mixed | (block[i] != block[j])
                i, j = i[fit], j[fit]
            if len(i):
                step(i, j)
        d += 1
