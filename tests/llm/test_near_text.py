"""The pipeline's near-duplicate stage against brute force."""

import numpy as np

from sievewright.llm import near_text

from .test_duplicates import union


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"new{rng.integers(1 << 30)}"
    return out


def test_stage_keeps_no_near_copies(spark, monkeypatch):
    """Near copies of every similarity above the bar go, those below it stay, through small blocks too."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "One", "one", "a b c d e f", "A b c d e  f"]
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, e)) for e in (1, 4, 6, 9, 20)[: 2 + k % 4]]
    hot = [f"h{x}" for x in range(200)]
    texts += [" ".join(edited(rng, hot, 1)) for _ in range(60)]
    sets = [brute_set(t) for t in texts]
    want = sorted(set(union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for rows in (near_text.BLOCK_ROWS, 7):
        monkeypatch.setattr(near_text, "BLOCK_ROWS", rows)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == want


def test_band_recall():
    """Pairs just above the bar share a band; measured on random texts with scattered edits."""
    rng = np.random.default_rng(5)
    met = n = 0
    while n < 300:
        base = [f"w{x}".encode() for x in rng.integers(0, 5000, 300)]
        a, b = (near_text.shingle_set(x) for x in (base, [x if isinstance(x, bytes) else x.encode() for x in edited(rng, base, 7)]))
        if 0.8 <= near_text.similarity(a, b) <= 0.83:
            n += 1
            met += bool(set(near_text.bands(a)) & set(near_text.bands(b)))
    assert met >= 297


def test_simhash_proposes(spark):
    """Fingerprints are majorities of the shingles' hashes, and their blocks are the buckets, in both layouts."""
    shingles = near_text.shingle_set([b"w%d" % k for k in range(60)])
    hashes = [near_text._mixed(shingles * f) for f in near_text._FACTOR[:4]]
    bits = [[sum(int(x) >> b & 1 for x in h) * 2 > len(shingles) for b in range(64)] for h in hashes]
    got = [[bool(int(x) >> b & 1) for b in range(64)] for x in near_text.fingerprint(shingles, 2)]
    assert got == bits
    small = near_text.shingle_set([b"s%d" % k for k in range(9)])
    for _, size, blocks in near_text.LAYOUTS:
        longs = near_text._longs(size, blocks)
        rows = [(k, near_text.fingerprint(x, longs).view(np.int64).tolist(), near_text.small_sets(x)) for k, x in enumerate((shingles, small))]
        members = near_text._members(spark.createDataFrame(rows, "key long, fp array<long>, small array<long>"), size, blocks)
        found = [sorted(r["bucket"] for r in members.where(f"key = {k}").collect()) for k in (0, 1)]
        assert found == [sorted(near_text.bands(x, size, blocks)) for x in (shingles, small)] and list(map(len, found)) == [blocks, blocks + 5]


def test_short_texts_and_wide_blocks(spark, monkeypatch):
    """Texts of 8 and 9 words at the bar meet by their common shingles; small blocks of buckets and 21 bits lose nothing."""
    texts = [" ".join(f"{k}w{j}" for j in range(n)) for k in range(150) for n in (8, 9)] + [" ".join(f"h{x}" for x in range(60)) + f" e{k}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [2 * k for k in range(150)] + [300]
    monkeypatch.setattr(near_text, "MEETING_ROWS", 7)
    for layouts in (near_text.LAYOUTS, near_text.LAYOUTS[1:]):
        monkeypatch.setattr(near_text, "LAYOUTS", layouts)
        assert sorted(r["doc_id"] for r in near_text.dedup(df).collect()) == want


def test_rows_of_a_large_group(spark, monkeypatch):
    """Each of many near copies is compared in one group, whatever number of buckets proposes it; some are too far apart."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    seen, links = [], near_text._links
    monkeypatch.setattr(near_text, "_links", lambda members, *rest: (seen.append(members.count()), links(members, *rest))[1])
    for n in (60, 240):
        texts = [" ".join(edited(rng, base, 1 + k % 8)) for k in range(n)]
        sets = [brute_set(t) for t in texts]
        want = sorted(set(union(n, [(a, b) for a in range(n) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r["doc_id"] for r in near_text.dedup(df).collect()) == want and 1 < len(want) < n
        assert seen.pop() <= n


def test_groups_of_proposals(spark, monkeypatch):
    """A text is in one group; a chain so long that its blocks would be more rows stays in the buckets that propose it."""
    star = [(100 + b, k, 1000, 20) for b in range(30) for k in range(1000, 1020)]
    chain = [(k, k + d, k, 2) for k in range(50) for d in (0, 1)]
    ties = [(200, 3000, 3000, 2), (200, 3001, 3000, 2), (201, 3001, 3001, 2), (201, 3002, 3001, 2), (202, 2999, 2999, 2), (202, 3002, 2999, 2)]
    monkeypatch.setattr(near_text, "ALIKE_ROWS", 4)
    found = near_text._groups(spark.createDataFrame(star + chain + ties, "bucket long, key long, first long, size long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["bucket"], []).append(r["key"])
    assert sorted(map(sorted, groups.values())) == sorted([list(range(1000, 1020)), [2999, 3000, 3001, 3002], *([k, k + 1] for k in range(50))])


def test_small_blocks_of_every_step(spark, monkeypatch):
    """However little is held or compared at once, no link is lost."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = [" ".join(edited(rng, base, 1 + k % 6)) for k in range(60)] + [" ".join(edited(rng, base[:40], 1)) for _ in range(8)]
    sets = [brute_set(t) for t in texts]
    want = sorted(set(union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])))
    for name, few in (("MEETING_ROWS", 9), ("ALIKE_ROWS", 7), ("BLOCK_ROWS", 5), ("BLOCK_SHINGLES", 1000), ("PAIRS", 3)):
        monkeypatch.setattr(near_text, name, few)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_text.dedup(df).collect()) == want


def test_parities_rule_out_no_similar_sets():
    rng = np.random.default_rng(10)
    for size in (1, 5, 40, 300, 5000):
        pool = rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.uint64)
        for _ in range(30):
            a, b = (np.unique(rng.choice(pool[: size + 1 + size * k // 8], size, replace=False)) for k in rng.integers(0, 8, 2))
            fits = near_text._fit(np.array([len(a), len(b)]), np.array([near_text.parities(a), near_text.parities(b)]), 0.8)
            assert near_text.similarity(a, b) < 0.8 or fits(np.array([0]), np.array([1]))[0]
