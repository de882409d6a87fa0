"""Operators 2 and 6 against brute force, with hot groups."""

import numpy as np
import xxhash

from sievewright.llm import blocks, embed_dedup, simhash
from sievewright.llm.common import min_labels
from sievewright.llm.graph import components


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocab, 120)) for _ in range(12)]
    texts = [None, "", " \t\n", "One", "one", "two words", "ÉA b\x0bc d"]
    for t in base:
        texts += [t] * int(rng.integers(1, 12))
        for _ in range(15):
            w = t.split()
            w[int(rng.integers(120))] = "changed"
            texts.append(" ".join(w))
    texts.append("long " * 60000)
    fps = [brute_fingerprint(t) for t in texts]
    want = union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, fp string, id int").repartition(3)
    rows = {r["id"]: r for r in simhash.simhash_components(df).collect()}
    assert [rows[k]["fp"] & (2**64 - 1) for k in range(len(texts))] == fps
    assert [rows[k]["component_id"] for k in range(len(texts))] == want
    kept = simhash.dedup(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "q r s t u")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["component_id"]) for r in simhash.simhash_components(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r["doc_id"] or 0 for r in simhash.dedup(df).collect()) == [0, 1, 3]


def test_masks_are_complete():
    rng = np.random.default_rng(2)
    for n in (0, 100, 10**6, 10**9, 10**12):
        masks = simhash.bit_blocks(n)
        for _ in range(200):
            bits = rng.choice(64, 3, replace=False)
            flip = sum(1 << int(b) for b in bits)
            assert any(flip & m == 0 for m in masks)


def test_blocks_meet_once(spark, monkeypatch):
    """A bucket of many members is split, and each pair of members still meets exactly once."""
    members = spark.createDataFrame([(7, k) for k in range(53)] + [(8, 1), (8, 2), (9, 5)], "bucket long, m long")
    import pyarrow as pa

    def run(batches):
        for table, group in blocks.whole_groups(batches, 16):
            m = table.column("m").to_numpy()
            found = []
            blocks.meeting(group, table, lambda i, j: found.extend(zip(np.minimum(m[i], m[j]).tolist(), np.maximum(m[i], m[j]).tolist())))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    got = sorted((r["a"], r["b"]) for r in blocks.blocked(members, "m", 10).mapInArrow(run, "a long, b long").collect())
    assert got == sorted([(a, b) for a in range(53) for b in range(a + 1, 53)] + [(1, 2)])


def test_components_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1200)) and len(got) == 261
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert min_labels(4, np.array([3, 1]), np.array([2, 3])).tolist() == [0, 1, 1, 1]


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in range(3):
        centres = rng.standard_normal((40, 24))
        for c in centres:
            for _ in range(int(rng.integers(1, 5))):
                v = c + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.35])
                rows.append([float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])] + [label])
    rows = [(k, r[:-1], r[-1]) for k, r in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, rows[0][1], None), (n + 4, [None] + rows[0][1][1:], 0), (n + 5, rows[0][1][:5], 0)]
    rows += [(n + 6 + k, rows[0][1], rows[0][2]) for k in range(40)]
    m = len(rows)
    usable = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    pairs = []
    for a in range(m):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    pairs.append((a, b))
    want = union(m, pairs)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
    got = {r["id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert [got[k]["component_id"] for k in range(m)] == want
    assert [got[k]["n_links"] for k in range(m)] == [sum(k in p for p in pairs) for k in range(m)]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    for dim in (64, 100):
        codes = embed_dedup.Codes(dim, 4, 2)
        v = rng.standard_normal((400, dim))
        v[200:] = v[:200] + rng.standard_normal((200, dim)) * 0.6
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        x = codes.encode(v)
        i, j = np.arange(200), np.arange(200, 400)
        value, spread = codes.estimate(x, i, j)
        error = value - (v[i] * v[j]).sum(1)
        assert abs(error.mean()) < 0.03 and (np.abs(error) <= embed_dedup.WIDTH * spread).all() and error.std() < spread.mean() * 1.5
