"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, meeting, whole_groups
from .common import min_labels, written
from .graph import components

THRESHOLD = 0.93
SEED = 20_240
#: A pair at the threshold shares no bucket with at most this probability; closer pairs with less.
MISS = 1e-6
#: Standard deviations of the estimate within which a pair is recomputed: exp(-5.5^2 / 2) < 3e-7.
WIDTH = 5.5
#: Bits to which the unquantised side of an estimate is rounded, at random.
PLANES = 4
BUCKET_ROWS = 24
BLOCK_ROWS = 1024


class Codes:
    """The rotations, bucket keys and estimates for vectors of one dimension; the same on every executor."""

    def __init__(self, dim: int, key_bits: int, tables: int) -> None:
        self.dim, self.key_bits, self.tables = dim, key_bits, tables
        self.words = -(-dim // 64)
        rng = np.random.default_rng([SEED, dim])
        self.turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-key_bits * tables // dim)))]

    def encode(self, unit: np.ndarray) -> dict[str, np.ndarray]:
        """For rows of unit length: signs of all rotations, and of the first its planes and factors."""
        turned = unit @ self.turns[0].T
        signs = np.concatenate([turned > 0, *[(unit @ t.T) > 0 for t in self.turns[1:]]], axis=1)
        low, high = turned.min(1), turned.max(1)
        step = np.maximum((high - low) / (2**PLANES - 1), 1e-12)
        rng = np.random.default_rng(SEED)
        level = np.floor((turned - low[:, None]) / step[:, None] + rng.random(turned.shape[1])).clip(0, 2**PLANES - 1).astype(np.uint8)
        planes = np.stack([self._packed((level >> b) & 1) for b in range(PLANES)], axis=1)
        return {
            "signs": np.packbits(signs, axis=1), "code": self._packed(turned > 0), "planes": planes,
            "factor": np.abs(turned).sum(1) / math.sqrt(self.dim), "low": low, "step": step, "levels": level.sum(1, dtype=np.int64),
        }

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), dtype=np.uint8)
        wide[:, : self.dim] = bits
        return np.packbits(wide, axis=1).view(np.uint64)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """Bucket keys of each table, from packed signs."""
        bits = np.unpackbits(signs, axis=1)[:, : self.key_bits * self.tables].reshape(len(signs), self.tables, self.key_bits)
        return bits @ (1 << np.arange(self.key_bits, dtype=np.int64))

    def estimate(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products of rows i and j, and the standard deviations that bound them.

        The sign code of i, scaled by its stored factor (its inner product with the vector itself), meets the
        rounded rotation of j; both inner products are sums of counted bits.
        """
        code, planes = x["code"][i], x["planes"][j]
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        met = sum((np.bitwise_count(code & planes[:, b]).sum(1, dtype=np.int64) << b) for b in range(PLANES))
        step, low = x["step"][j], x["low"][j]
        product = (2 * (step * met + low * ones) - step * x["levels"][j] - low * self.dim) / math.sqrt(self.dim)
        factor = x["factor"][i]
        spread = np.sqrt(np.maximum(0.0, 1 - factor**2) / max(1, self.dim - 1)) + step / 2
        return product / factor, spread / factor


def tables_for(threshold: float, rows: int, miss: float = MISS) -> tuple[int, int]:
    """(bits of a bucket key, tables) for labels of up to `rows` vectors: buckets stay small, misses rare."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(2, min(30, round(math.log2(max(4.0, rows / BUCKET_ROWS)))))
    hit = same**bits
    return bits, 1 if hit > 1 - 1e-12 else math.ceil(math.log(miss) / math.log1p(-hit))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def usable(vec: str, label: str):
    """Not null, no null or non-finite component, not all zero, and with a label."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id.

    Vectors link if labels and lengths are equal and the cosine in double precision is `threshold` or more. Equal
    vectors are gathered first and count as often as they occur. Others meet in buckets of sign bits of random
    rotations; the estimate from the codes rejects a pair when its upper confidence bound stays below the
    threshold, and every other pair is computed exactly, so no link is false and each pair at the threshold is
    missed with a probability of about 1e-6. Rows that are not usable link with nothing and are their own
    component; rows with a null id link with nothing and have no component. An id that stands by several vectors has
    a row for each, with that vector's links. Equal vectors are told by two 64-bit hashes.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.col("id").isNotNull() & usable("vec", "label")
    hashes = {f"h{k}": F.xxhash64(F.lit(k), F.col("vec")) for k in (1, 2)}
    valid = rows.where(fine).withColumns(hashes)
    nodes = valid.groupBy("label", "h1", "h2").agg(F.first("vec").alias("key"), F.min("id").alias("first_id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label", F.size("key").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    plans = {r["dim"]: tables_for(threshold, r["n"]) for r in largest}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {dim: Codes(dim, *plan) for dim, plan in plans.items()}
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(lengths):
                some = batch.filter(pa.array(lengths == dim))
                unit = _matrix(some.column(2))
                unit = unit / np.abs(unit).max(1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                x, c = codes[int(dim)].encode(unit), codes[int(dim)]
                flat = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "rep": some.column(0), "copies": some.column(1), "label": some.column(3), "unit": flat(unit), "signs": flat(x["signs"]),
                    "code": flat(x["code"]), "planes": flat(x["planes"].reshape(len(unit), -1)), "factor": x["factor"], "vlow": x["low"], "step": x["step"],
                    "levels": x["levels"], "keys": pa.array(c.keys(x["signs"]).tolist(), pa.list_(pa.int64())), "dim": pa.array(np.full(len(unit), dim, np.int32)),
                })

    kind = rows.schema["label"].dataType.simpleString()
    coded = nodes.select("rep", "copies", F.col("key").alias("vec"), "label").mapInArrow(
        encode,
        f"rep long, copies long, label {kind}, unit binary, signs binary, code binary, planes binary, factor double, vlow double, step double, levels long, keys array<long>, dim int",
    )
    coded = written(coded.withColumn("node", F.xxhash64("rep", "label", "unit")), "codes")
    members = coded.select("node", "label", "dim", F.posexplode("keys").alias("tab", "k")).select("node", F.xxhash64("label", "dim", "tab", "k").alias("bucket"), "tab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {dim: Codes(dim, *plan) for dim, plan in plans.items()}
        for table, group in whole_groups(batches, 4096):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                yield from _linked(codes[int(dim)], table.take(pa.array(at)), group[at], threshold)

    payload = coded.select("node", "rep", "copies", "unit", "signs", "code", "planes", "factor", "vlow", "step", "levels", "dim")
    found = blocked(members, "node", BLOCK_ROWS, payload).mapInArrow(compare, "rep long, root long, n long")
    found = written(found, "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    of_rep = nodes.select("rep", "label", "h1", "h2", "first_id", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = of_rep.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_rep = of_rep.join(smallest, "root").select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = valid.select("id", "label", "h1", "h2").join(of_rep, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    return linked.unionByName(rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def _linked(codes: Codes, table: pa.Table, group: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of one table's groups: for each vector in one its linked copies, and a node it is connected with.

    A pair that meets in several buckets is counted in the first table in which its keys agree.
    """
    raw = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)
    unit = raw("unit", np.float64)
    x = {"code": raw("code", np.uint64), "planes": raw("planes", np.uint64).reshape(table.num_rows, PLANES, codes.words)}
    x |= {"low": table.column("vlow").to_numpy()} | {k: table.column(k).to_numpy() for k in ("factor", "step", "levels")}
    keys, tab = codes.keys(raw("signs", np.uint8)), table.column("tab").to_numpy()
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    links = np.zeros(len(rep), dtype=np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def step(i: np.ndarray, j: np.ndarray) -> None:
        value, spread = codes.estimate(x, i, j)
        open_ = value + WIDTH * spread >= threshold
        i, j = i[open_], j[open_]
        if not len(i):
            return
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[near], j[near]
        if len(i):
            edges.append((i, j))
            first = (keys[i] == keys[j]).argmax(1) == tab[i]
            np.add.at(links, i[first], copies[j[first]])
            np.add.at(links, j[first], copies[i[first]])

    meeting(group, table, step)
    if edges:
        label = min_labels(len(rep), np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges]))
        out = np.flatnonzero((label != np.arange(len(rep))) | (links > 0))
        yield pa.RecordBatch.from_pydict({"rep": rep[out], "root": rep[label[out]], "n": links[out]})
