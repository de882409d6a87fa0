"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming distances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, meeting, whole_groups
from .common import arrays, blank_words, fresh, min_labels, pieces, texts_of, written
from .graph import components

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Members of a bucket compared in one group; more are split into blocks.
BLOCK_ROWS = 2048
#: Mean members of a bucket that the number of bit blocks aims at.
BUCKET_ROWS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    parts = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(BITS, dtype=np.int64)
    for some in pieces(parts, 1 << 15):
        set_bits += np.unpackbits(np.frombuffer(b"".join(some), np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_bits * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp): the fingerprint of every whole text, as a signed long. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield arrays(id=batch.column(0), fp=pa.array(fps, pa.int64()))

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def bit_blocks(n: int, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Masks such that two numbers that differ in `distance` bits or fewer are equal under one of them at least.

    The 64 bits are cut into r blocks; at most `distance` of them differ, so r - distance are equal. The masks
    are all the choices of r - distance blocks. r is the least for which random numbers share few buckets.
    """
    wanted = math.log2(max(2.0, n / bucket_rows))
    r = distance + 1
    while (BITS // r) * (r - distance) < wanted and r < 12:
        r += 1
    cuts = [BITS * k // r for k in range(r + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, r - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """From distinct fingerprints `fp`, n of them: edges (u, v) that connect all that links of up to `distance` bits do.

    Every pair in a shared bucket is verified; of a group's links only a spanning forest is returned, so the
    rows stay in proportion to the fingerprints even where thousands link with one another.
    """
    masks = bit_blocks(n, distance)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])
    members = fps.select("fp", F.explode(keys).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches):
            fp = table.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def step(i: np.ndarray, j: np.ndarray, bits=bits, found=found) -> None:
                near = np.bitwise_count(bits[i] ^ bits[j]) <= distance
                if near.any():
                    found.append((i[near], j[near]))

            meeting(group, table, step)
            if found:
                label = min_labels(len(fp), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                child = np.flatnonzero(label != np.arange(len(fp)))
                yield arrays(u=fp[child], v=fp[label[child]])

    return blocked(members, "fp", BLOCK_ROWS).mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id reachable over links of up to `distance` bits.

    Equal fingerprints are gathered first, so exact copies cost one row in the comparison however many they are.
    Null and blank texts have fingerprint 0 and link like any other. A null id keeps its row; it stands for no
    component while another id does. Repeated ids keep their rows. An empty table gives an empty table.
    """
    table = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(table.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    edges = fingerprint_links(distinct.select("fp"), distinct.count(), distance)
    roots = components(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return table.join(of_fp, "fp").select("id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; all columns as they were.

    Rows that repeat an id are reduced to one row for it as well. Rows whose id is null are all kept.
    """
    name = fresh("kept_id", docs)
    keep = simhash_components(docs, id_col, text_col, distance).where("id = component_id").select(F.col("id").alias(name)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col(name), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
