"""Near copies by the Jaccard similarity of word shingles: SimHash proposes pairs, exact similarities decide.

A text has a SimHash fingerprint of its set of shingles, of as many 64-bit numbers as the least similarity takes. Texts
with equal bits in one of its blocks meet; those that meet with few differing bits in two numbers more are proposed. A text
is proposed in many buckets, but compared in one group: that of all texts that proposals connect. There parities of the
sets rule out most pairs, and the sets themselves are compared among the texts that the rest connects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, meeting, split, whole_groups
from .common import arrays, blank_words, fresh, min_labels, pieces, texts_of, written
from .graph import components

#: Words of a shingle; a text of fewer words is one shingle.
SHINGLE = 5
#: Least Jaccard similarity of near copies.
SIMILARITY = 0.8
#: Bits of a block, and blocks, for tables of up to so many texts: a pair of large sets at 0.8 differs in 0.152 of its bits
#: (the angle of cosine 8/9) and shares a block with probability 1 - (1 - 0.848^16)^120 = 0.9998; of 21 bits, with 276, alike.
LAYOUTS = ((1 << 24, 16, 120), (1 << 62, 21, 276))
#: Longs of the bits that decide whether a pair that met is compared exactly, and their differing bits at most: 19.4 on
#: average at 0.8, with a deviation of 4.1; 64 and 5.7 for unlike texts.
CHECK_LONGS, DISTANCE = 2, 40
#: Members of a block of a bucket when fingerprints meet.
MEETING_ROWS = 2048
#: Bits of the parities that rule out similarity without comparing sets; members of a block when parities meet.
PARITY, ALIKE_ROWS = 1024, 4096
#: Members of a group whose sets are compared at once, or more of them if they have no more than so many shingles; larger
#: groups are split into blocks. Rows read at once, since they hold whole sets.
BLOCK_ROWS, BLOCK_SHINGLES, HOLD = 256, 1 << 20, 512
#: Pairs held before they are reduced to those that connect something.
PAIRS = 1 << 18
SEED = 42

_FACTOR = np.random.default_rng(6).integers(0, 1 << 63, CHECK_LONGS + 92, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; of no words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_ = xxhash.xxh64_intdigest
    found = [hash_(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _longs(bits: int, blocks: int) -> int:
    return -(-blocks // (64 // bits))


def fingerprint(shingles: np.ndarray, longs: int) -> np.ndarray:
    """SimHash of a set: a bit is 1 if it is set in over half the shingles' hashes; CHECK_LONGS and then `longs` more."""
    factor = _FACTOR[: CHECK_LONGS + longs]
    total = np.zeros(64 * len(factor), dtype=np.int64)
    for some in pieces(shingles, 255):
        total += np.unpackbits(_mixed(some[:, None] * factor).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles)).view(np.uint64)


def small_sets(shingles: np.ndarray) -> list[int]:
    """Of 4 or 5 shingles, the subsets of 4: sets of 4 and 5 reach 0.8, with more differing bits than larger ones."""
    if len(shingles) not in (4, 5):
        return []
    some = [shingles] if len(shingles) == 4 else [np.delete(shingles, k) for k in range(5)]
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in some], dtype=np.uint64).view(np.int64).tolist()


def bands(shingles: np.ndarray, bits: int = LAYOUTS[0][1], blocks: int = LAYOUTS[0][2]) -> list[int]:
    """The buckets of a set: its blocks of equal bits, and its small sets; of no shingles none."""
    if not len(shingles):
        return []
    x = fingerprint(shingles, _longs(bits, blocks))[CHECK_LONGS:].tolist()
    per = 64 // bits
    return [(k << 32) | (x[k // per] >> (bits * (k % per)) & ((1 << bits) - 1)) for k in range(blocks)] + small_sets(shingles)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of PARITY places: sets differ by at least as many shingles as bits."""
    return np.packbits((np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).view(np.uint64)


def _key(words: list[bytes]) -> int:
    x = xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)
    return x - (1 << 64) if x >> 63 else x


def _fingerprinted(docs: DataFrame, longs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, small, odd, size = [], [], [], [], []
            for x in texts_of(batch):  # one text's words at a time
                words = blank_words(x)
                shingles = shingle_set(words)
                keys.append(_key(words))
                found.append(fingerprint(shingles, longs).view(np.int64) if len(shingles) else None)
                small.append(small_sets(shingles))
                odd.append(parities(shingles).tobytes())
                size.append(len(shingles))
            yield arrays(
                id=batch.column(0), key=pa.array(keys, pa.int64()), fp=pa.array(found, pa.list_(pa.int64())), small=pa.array(small, pa.list_(pa.int64())),
                odd=pa.array(odd, pa.binary()), shingles=pa.array(size, pa.int64()),
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, fp array<long>, small array<long>, odd binary, shingles long")


def _members(distinct: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Rows (key, bucket, c0, c1): the buckets of each fingerprint, as bands() has them, with the bits that decide."""
    per = 64 // bits
    check = [F.col("fp")[k].alias(f"c{k}") for k in range(CHECK_LONGS)]
    each = distinct.where("fp is not null").select("key", *check, F.posexplode(F.slice("fp", CHECK_LONGS + 1, _longs(bits, blocks))).alias("at", "x"))
    own = [F.shiftrightunsigned("x", bits * j).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.shiftleft((F.col("at") * per + j).cast("long"), 32)) for j in range(per)]
    blocked_bits = each.select("key", *[f"c{k}" for k in range(CHECK_LONGS)], F.explode(F.array(*own)).alias("bucket")).where(F.shiftright("bucket", 32) < blocks)
    return blocked_bits.unionByName(distinct.where("fp is not null").select("key", *check, F.explode("small").alias("bucket")))


def _connected(dealt: DataFrame, rule: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Rows (bucket, key, first, size): the texts of a group that pairs which fit the rule connect; equal groups once.

    first is the smallest key among them, size their number; bucket is made of their keys. rule(table) gives what tells
    of row numbers i, j which pairs fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches):
            fits, label = rule(table), np.arange(table.num_rows)
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def reduced(label=label, found=found) -> None:
                label[:] = min_labels(len(label), *(np.concatenate(x) for x in zip(*found, (label, np.arange(len(label))), strict=True)))
                found.clear()

            def step(i: np.ndarray, j: np.ndarray, fits=fits, label=label, found=found, reduced=reduced) -> None:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                near = fits(i, j)
                if near.any():
                    found.append((i[near], j[near]))
                    if sum(len(x) for x, _ in found) > PAIRS:
                        reduced()

            meeting(group, table, step)
            reduced()
            rows = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            if len(rows):
                rows = rows[np.argsort(label[rows], kind="stable")]
                new = np.flatnonzero(np.diff(label[rows], prepend=-1))
                key = table.column("key").to_numpy()[rows]
                size = np.diff(new, append=len(rows))
                told = _mixed(np.add.reduceat(_mixed(key.view(np.uint64) * _FACTOR[0]), new) + size.astype(np.uint64))
                first = np.minimum.reduceat(key, new)
                yield arrays(bucket=np.repeat(told, size).view(np.int64), key=key, first=np.repeat(first, size), size=np.repeat(size, size))

    return dealt.mapInArrow(run, "bucket long, key long, first long, size long").dropDuplicates(["bucket", "key"])


def _proposed(members: DataFrame) -> DataFrame:
    """Rows (bucket, key, first, size): groups of texts that are connected by few differing bits in a bucket."""

    def rule(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        bits = [table.column(f"c{k}").to_numpy().view(np.uint64) for k in range(CHECK_LONGS)]
        return lambda i, j: sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in bits) <= DISTANCE

    return _connected(split(members, "key", MEETING_ROWS), rule)


def _fit(size: np.ndarray, odd: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of row numbers which pairs of sets may be similar by their sizes and parities; none that is is ruled out."""
    most = (1 - least) / (1 + least)

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
        i, j = i[out], j[out]
        out[out] = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= most * (size[i] + size[j]) + 1e-6
        return out

    return fits


def _alike(groups: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Rows (bucket, key): of each group the texts that are connected by pairs which sizes and parities do not rule out."""

    def rule(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        return _fit(table.column("shingles").to_numpy(), odd, least)

    return _connected(blocked(groups, "key", ALIKE_ROWS, distinct.select("key", "odd", "shingles")), rule).select("bucket", "key")


def _roots(proposed: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (key, root): the texts that proposals connect, whichever bucket they are of.

    Each text's smallest `first` comes first, and only edges between what those leave apart are followed on.
    """
    some = written(components(near.select(F.col("key").alias("u"), F.col("first").alias("v"))), "near-text-roots")

    def over(df: DataFrame, name: str, roots: DataFrame) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(name), F.col("root").alias("at")), name, "left").withColumn(name, F.coalesce("at", name)).drop("at")

    apart = over(over(proposed.select("key", "first").where("key <> first").distinct(), "key", some).distinct(), "first", some).where("key <> first").distinct()
    return over(over(near.select("key", F.col("key").alias("root")), "root", some), "root", components(apart, "key", "first"))


def _groups(proposed: DataFrame) -> DataFrame:
    """Rows (bucket, key): groups in which every proposed pair is; a text is in one, that of all it is connected with.

    Where such a group is so wide that its blocks would be more rows than those of the proposed groups, it is those instead.
    """
    blocks = F.ceil(F.col("size") / F.lit(float(ALIKE_ROWS)))
    near = written(proposed.groupBy("key").agg(F.min("first").alias("first"), F.sum(blocks).alias("cost")), "near-text-near")
    rooted = written(near.select("key", "cost").join(_roots(proposed, near), "key"), "near-text-rooted")
    wide = rooted.groupBy("root").agg(F.count("*").alias("size"), F.sum("cost").alias("cost")).where(F.col("size") * blocks > F.col("cost")).select("root")
    apart = proposed.join(rooted.join(wide, "root", "left_semi").select("key"), "key", "left_semi").select("bucket", "key")
    return rooted.join(wide, "root", "left_anti").select(F.col("root").alias("bucket"), "key").unionByName(apart)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(texts_of(batch), HOLD):
                keys, found = [], []
                for x in texts:
                    words = blank_words(x)
                    keys.append(_key(words))
                    found.append(shingle_set(words).tobytes())
                yield arrays(key=pa.array(keys, pa.int64()), shingles=pa.array(found, pa.binary()))

    return docs.select("text").mapInArrow(run, "key long, shingles binary").dropDuplicates(["key"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that connect all that similar pairs of a bucket do: of each group's links a spanning forest.

    members: rows (bucket, key, n), n being the shingles of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, HOLD):
            key = table.column("key").to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            fits = _fit(np.array([len(x) for x in held]), np.array([parities(x) for x in held]), least)
            root = np.arange(len(key))
            found: list[tuple[int, int]] = []

            def step(i: np.ndarray, j: np.ndarray, held=held, fits=fits, root=root, found=found) -> None:
                apart = root[i] != root[j]  # pairs that are connected already need no comparison
                i, j = i[apart], j[apart]
                fit = fits(i, j)
                for a, b in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                    if root[a] != root[b] and similarity(held[a], held[b]) >= least:
                        root[root == root[b]] = root[a]
                        found.append((a, b))

            meeting(group, table, step)
            if found:
                u, v = (np.array(x) for x in zip(*found, strict=True))
                yield arrays(u=key[u], v=key[v])

    return blocked(members, "key", BLOCK_ROWS, sets, ("n", BLOCK_SHINGLES)).mapInArrow(run, "u long, v long")


def near_text_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (id, component_id): component_id is the smallest id reachable over pairs of `least` similarity or more.

    Texts of equal words are gathered first, so exact copies cost one row in the comparison. Groups of the same
    members are compared once. Texts without words are copies of one another. Rows with a null id are left out.
    """
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = chosen.count()
    bits, blocks = next((bits, blocks) for most, bits, blocks in LAYOUTS if n <= most)
    table = written(_fingerprinted(chosen, _longs(bits, blocks)), "near-text")
    distinct = table.groupBy("key").agg(F.min("id").alias("first_id"), F.first("fp").alias("fp"), F.first("small").alias("small"), F.first("odd").alias("odd"), F.first("shingles").alias("shingles"))
    distinct = written(distinct, "near-text-distinct")
    groups = _groups(written(_proposed(_members(distinct, bits, blocks)), "near-text-members"))
    groups = written(_alike(written(groups, "near-text-groups"), distinct, least), "near-text-alike")
    wanted = groups.select("key").distinct().join(distinct.select("key", F.col("first_id").alias("id")), "key").select("id").distinct()
    sized = groups.join(distinct.select("key", F.col("shingles").alias("n")), "key")
    edges = _links(sized, _sets(chosen.join(wanted, "id", "left_semi")), least)
    named = distinct.select("key", "first_id").join(components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return table.select("id", "key").join(named.select("key", "root").join(smallest, "root").select("key", "component_id"), "key").select("id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; all columns as they were.

    Rows that repeat an id are reduced to one row for it as well. Rows whose id is null are all kept.
    """
    name = fresh("kept_id", docs)
    keep = near_text_components(docs, id_col, text_col, least).where("id = component_id").select(F.col("id").alias(name)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col(name), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
