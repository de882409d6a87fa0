"""Language-model scoring with a probabilistic suffix tree over words.

A context of up to `depth` words is a state if the corpus has it at least `least` times and what follows it diverges
from what follows its suffix (the context without its first word): the sum over its occurrences of the logarithm of
the ratio of the two probabilities of what follows, each occurrence left out of the counts that judge it, reaches
`bar` nats. So states are told by counts and divergence, not by a share of the corpus; they grow with it. A token's
probability comes from the longest state that is a suffix of what stands before it, smoothed by the next shorter one:
(n + strength * p) / (N + strength), down to the unigrams, which are smoothed by adding one.

How it runs. (1) The texts become chunks of about CHUNK tokens: hashes of distinct words and each token's number among
them. They are written once, bucketed by chunk, so that no later step moves them. (2) Each chunk sends its distinct
words and pairs of words with their training counts to buckets of their hashes; a bucket adds up all chunks' counts and
answers each chunk with totals, in the order asked. (3) For each further word of context, chunks ask for the followers
of those contexts alone that occur often enough, together with the suffix's probability, which they know by now; the
bucket of a context sees all its followers and decides on the state. Contexts that are too frequent for one bucket are
dealt by follower, and their gains added up over buckets. (4) Each chunk scores its texts with the answers.

Nothing that grows with the corpus reaches the driver or is broadcast but the states among contexts of more than a
HOT_SHARE of all tokens, at most 1 / HOT_SHARE of each length. Sums are of whole numbers, so the results do not depend
on how the input is cut into tasks. A repeated run after a lost executor sends the same rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, shuffle_parts, texts_of, written

#: Words of the longest contexts.
DEPTH = 3
#: Training occurrences that a context needs.
LEAST = 2
#: Nats by which a context's own counts must beat its suffix's on what follows it.
BAR = 1.0
#: Occurrences that the shorter context's probability counts as.
STRENGTH = 16.0
#: Tokens of a chunk (a longer text is a chunk of its own); bytes hashed at once.
CHUNK, BLOCK = 1_500_000, 1 << 18
#: A context with more occurrences, and more than this share of all tokens, is dealt over the buckets by follower.
HOT, HOT_SHARE = 1 << 16, 1e-6
BUCKETS_PER_PARTITION = 8
#: Words of so many bytes and more are hashed by XXH3, shorter ones together by a polynomial.
LONG_WORD = 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_CUT = np.uint64(8)  # keys of pairs and contexts have 56 bits
_FOLLOWER = np.uint64((1 << 32) - 1)
_FIXED = 65536.0  # gains are whole numbers of 1 / _FIXED nats
_FINE = 1024.0  # logarithms of suffixes' probabilities travel as whole numbers of 1 / _FINE nats

_rng = np.random.default_rng(64)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


# --- words ---

def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * BLOCK, 1 << int(n).bit_length())
    if size not in _POWER:
        _POWER.clear()
        _POWER[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWER[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


END = mix(np.array([0x5EED], dtype=np.uint64))[0]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space, and where they start.

    Words under LONG_WORD bytes: a polynomial modulo 2^64 with a random number for each byte value, all words of the
    text at once. Such polynomials are weak on long words (Thue-Morse sequences of 1,024 bytes collide in any base),
    so those get XXH3. Two different words share a hash with a probability of about 2^-64.
    """
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_BLANK[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    out = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return out, starts


def _blocks(raw: bytes) -> Iterator[bytes]:
    """Parts of a text of about BLOCK bytes, cut at white space."""
    at = 0
    while len(raw) - at > 2 * BLOCK:
        cut = at + BLOCK
        while cut < len(raw) and not _BLANK[raw[cut]]:
            cut += 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def hashed(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time: the hashes of all their words, END after each text, and each one's text by number.

    Texts never continue from one yield to the next, so whoever reads on needs no state between them.
    """
    some: list[bytes] = []
    first = size = 0
    for k, text in enumerate([*texts, None]):
        raw = text.encode("utf-8", "replace").lower() if text else b""
        if some and (k == len(texts) or size + len(raw) > BLOCK):
            yield _hashed(some, first)
            some, first, size = [], k, 0
        some.append(raw)
        size += len(raw) + 1


def _hashed(raws: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    if len(raws) == 1 and len(raws[0]) > 2 * BLOCK:
        tok = np.concatenate([*(word_hashes(x)[0] for x in _blocks(raws[0])), [END]])
        return tok, np.full(len(tok), first)
    tok, starts = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(x) + 1 for x in raws])
    doc = np.searchsorted(ends, starts, side="right")
    at = np.searchsorted(doc, np.arange(len(raws)), side="right")
    return np.insert(tok, at, END), np.insert(doc, at, np.arange(len(raws))) + first


# --- numbers on the wire ---

def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of equal weight, compressed."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def _packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _packed_signed(x: np.ndarray) -> bytes:
    x = x.astype(np.int64)
    return packed(((x << 1) ^ (x >> 63)).view(np.uint64))


def _unpacked_signed(data: bytes) -> np.ndarray:
    x = unpacked(data)
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, an index of each, and for each key the number of its distinct one."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), dtype=np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], back


def gains(n: np.ndarray, total: np.ndarray, p: np.ndarray, strength: float) -> np.ndarray:
    """What n occurrences of a follower gain on the suffix's probability p, each left out of the n and the total."""
    n = n.astype(np.float64)
    gain = n * np.log((n - 1 + strength * p) / ((total - 1 + strength) * p))
    return np.rint(gain * _FIXED).astype(np.int64)


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"x": pa.list_(pa.binary()), "chunk": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in columns.items()})


# --- chunks ---

def _chunks(docs: DataFrame, parts: int, tokens: int) -> DataFrame:
    """A row for each chunk: ids, which of its texts are held out, their lengths, words, and the number of each token."""

    def row(seq: int, ids: list[pa.Array], held: list[np.ndarray], toks: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
        tok = np.concatenate(toks)
        sizes = np.concatenate(lengths)
        sink = pa.BufferOutputStream()
        table = pa.table([pa.chunked_array(ids)], names=["id"])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        words, _, back = distinct(tok)
        order = np.argsort(-np.bincount(back, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        x = [sink.getvalue().to_pybytes(), np.packbits(np.concatenate(held)).tobytes(), packed(sizes), packed(words[order]), packed(rank[back])]
        return _rows(chunk=[(TaskContext.get().partitionId() << 32) + seq], x=[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, seq = ([], [], [], []), 0, 0
        for batch in batches:
            ids, held = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "held"))
            held = held.to_numpy(zero_copy_only=False).astype(bool)
            for tok, doc in hashed(texts_of(batch)):
                low, high = doc[0], doc[-1] + 1
                for part, x in zip(parts, (ids.slice(low, high - low), held[low:high], tok, np.bincount(doc - low, minlength=high - low)), strict=True):
                    part.append(x)
                n += len(tok)
                if n >= tokens:
                    yield row(seq, *parts)
                    parts, n, seq = ([], [], [], []), 0, seq + 1
        if n:
            yield row(seq, *parts)

    return bucketed(docs.select("id", "held", "text").mapInArrow(run, "chunk long, x array<binary>"), "chunk", parts)


@dataclass(frozen=True)
class Model:
    """Parameters, and what is known of all training tokens: their number, that of distinct ones, frequent states."""

    depth: int
    least: int
    bar: float
    strength: float
    shift: int  # a bucket is a 64-bit hash's bits from here on
    tokens: int = 0
    words: int = 0
    many: int = 0  # occurrences from which a context is dealt by follower
    hot: dict[int, np.ndarray] | None = None


class Chunk:
    """A chunk's tokens with what the answers so far tell: cnt[k] is the count of the k + 1 tokens that end at each."""

    def __init__(self, x: list[bytes], model: Model):
        self.model = model
        self.ids = pa.ipc.open_stream(x[0]).read_all().column(0)
        sizes, self.words, seq = unpacked(x[2]).astype(np.int64), unpacked(x[3]), unpacked(x[4]).astype(np.int32)
        self.held = _bits(x[1], len(sizes))
        self.sizes, self.seq, self.tok = sizes, seq, self.words[seq]
        self.train = np.repeat(~self.held, sizes)
        self.at = (np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.before = np.concatenate((seq[-1:], seq[:-1]))  # a text's end stands before a text's start
        self.grams = [self.tok]
        self.cnt: list[np.ndarray] = []
        self.states: list[np.ndarray] = []  # for each length of context: whether each token's is a state
        self.order = np.argsort(self.words)
        self.pairs, self.pair_first, self.pair_back = distinct(self.gram(1) >> _CUT)

    def gram(self, k: int) -> np.ndarray:
        """Hashes of the k + 1 tokens that end at each token."""
        while len(self.grams) <= k:
            last = np.concatenate((self.grams[-1][:1] if len(self.grams) > 1 else [END], self.grams[-1][:-1]))
            self.grams.append(mix(mix(last + _M1) * _M2 + self.tok))
        return self.grams[k]

    def occurs(self, k: int) -> np.ndarray:
        """How often the context of k words before each token occurs; 0 where the text has not as many."""
        total = np.concatenate((self.cnt[k - 1][-1:], self.cnt[k - 1][:-1]))
        total[self.at < k - 1] = 0
        return total

    def first_request(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        n_words = np.bincount(self.seq[self.train], minlength=len(self.words))[self.order]
        n_pairs = np.bincount(self.pair_back[self.train], minlength=len(self.pairs))
        return [(self.words[self.order], [n_words]), (self.pairs << _CUT, [n_pairs])]

    def first_answer(self, rows: list[list[bytes]]) -> None:
        total = np.empty(len(self.words), dtype=np.int64)
        total[self.order] = _joined(rows, 0)
        pairs = _joined(rows, 1)
        own = np.concatenate([_bits(r[2], struct.unpack_from("<Q", r[1])[0]) for r in rows])
        self.totals = total
        self.cnt = [total[self.seq], pairs[self.pair_back]]
        i = self.pair_first[own]
        some = self.cnt[1][i] > 0
        i = i[some]
        self.gain = np.zeros(len(self.words), dtype=np.int64)
        gain = gains(self.cnt[1][i], total[self.before[i]], self.cnt[0][i] / max(1, self.model.tokens), self.model.strength)
        np.add.at(self.gain, self.before[i], gain)
        self.context = self.order[total[self.order] >= self.model.least]

    def asked(self, k: int) -> tuple:
        """Which tokens' contexts of k words occur often enough, and their distinct ones with what follows."""
        total = self.occurs(k)
        at = np.flatnonzero(total >= self.model.least)
        keys, first, back = distinct(self.gram(k)[at])
        first = at[first]
        n = np.bincount(back[self.train[at]], minlength=len(keys))
        context = np.concatenate(([np.uint64(0)], self.gram(k - 1)[:-1]))[first] >> _CUT
        hot = total[first] >= self.model.many
        rare = np.flatnonzero(~hot)
        rare = rare[np.argsort(context[rare], kind="stable")]
        return at, keys, first, back, n, context, np.flatnonzero(hot), rare, total

    def request(self, k: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Hashes to deal by, and what is dealt: contexts of one word with gains (once), followers of k words."""
        nothing = np.zeros(0, dtype=np.uint64)
        out = [(nothing, [np.zeros(0, dtype=np.int64)])] * (k != 2) or [(self.words[self.context], [self.gain[self.context]])]
        if k > self.model.depth:
            return [*out, (nothing, [nothing] * 3), (nothing, [nothing] * 4)]
        _, keys, first, _, n, context, hot, rare, total = self.asked(k)
        of_suffix, suffix = self.cnt[k - 1][first], self.occurs(k - 1)[first]
        log = np.where(n > 0, np.rint(np.log(np.maximum(of_suffix, 1) / np.maximum(suffix, 1)) * _FINE), 0).astype(np.int64)
        follower = mix(self.tok[first]) & _FOLLOWER
        return [*out, (context[rare] << _CUT, [follower[rare], n[rare], log[rare]]), (keys[hot], [context[hot], n[hot], log[hot], total[first[hot]]])]

    def answer(self, k: int, rows: list[list[bytes]]) -> None:
        if k == 2:
            kept = np.zeros(len(self.words), dtype=bool)
            kept[self.context] = np.concatenate([_bits(r[0], struct.unpack("<Q", r[1])[0]) for r in rows] or [np.zeros(0, dtype=bool)])
            self.states.append(kept[self.before])
        if k > self.model.depth:
            return
        at, keys, _, back, _, context, hot, rare, _ = self.asked(k)
        total, kept = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        total[rare], total[hot] = _joined(rows, 2), _joined(rows, 4)
        kept[rare] = np.concatenate([_bits(r[3], struct.unpack_from("<Q", r[2])[0]) for r in rows] or [np.zeros(0, dtype=bool)])
        if self.model.hot and k in self.model.hot:
            kept[hot] = np.isin(context[hot], self.model.hot[k])
        cnt, state = np.zeros(len(self.tok), dtype=np.int64), np.zeros(len(self.tok), dtype=bool)
        cnt[at], state[at] = total[back], kept[back]
        self.cnt.append(cnt)
        self.states.append(state)

    def scores(self) -> pa.Table:
        model, c = self.model, self.cnt[0]
        p = (c + 1.0) / (model.tokens + model.words + 1.0)
        base = np.log10(p)
        for k, state in enumerate(self.states[: model.depth], 1):
            on = np.flatnonzero(state)
            p[on] = (self.cnt[k][on] + model.strength * p[on]) / (self.occurs(k)[on] + model.strength)
        first = np.cumsum(self.sizes) - self.sizes
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
        return pa.table([self.ids, pa.array(self.held), pa.array(self.sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=NAMES)


NAMES = ["id", "held", "n_tokens", "n_known", "base", "score"]


def _joined(rows: list[list[bytes]], k: int) -> np.ndarray:
    return np.concatenate([unpacked(r[k]).astype(np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)])


# --- requests and answers ---

def _dealt(chunk: int, sides: list[tuple[np.ndarray, list[np.ndarray]]], shift: int) -> Iterator[tuple[int, list[bytes]]]:
    """A chunk's request cut by bucket. A side's keys are in order; equal ones (a context's followers) stay together."""
    buckets = 1 << (64 - shift)
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(shift) if buckets > 1 else np.zeros(0, dtype=np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])) for keys, _ in sides]
    for b in range(buckets):
        if any(cut[b] < cut[b + 1] for cut in cuts):
            out = []
            for (keys, values), cut in zip(sides, cuts, strict=True):
                at = slice(cut[b], cut[b + 1])
                out.append(_packed_sorted(keys[at]))
                out += [_packed_signed(v[at]) if v.dtype == np.int64 else packed(v[at]) for v in values]
            yield b, out


def _by_bucket(requests: DataFrame) -> DataFrame:
    return requests.repartition(shuffle_parts(requests.sparkSession), "bucket").sortWithinPartitions("bucket")


def _answered(requests: DataFrame, level: int, reply, done=None) -> DataFrame:
    """Apply reply(rows of a bucket) -> (answers to each row, a further row's data or None), and done() at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            answers, more = reply([r for _, r in rows])
            for (chunk, _), x in zip(rows, answers, strict=True):
                yield _rows(level=[level], bucket=[bucket], chunk=[chunk], x=[x])
            if more is not None:
                yield _rows(level=[-level], bucket=[bucket], chunk=[0], x=[more])

        for batch in batches:
            buckets, chunks, data = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "chunk", "x"))
            for i, b in enumerate(buckets.to_pylist()):
                if b != bucket and rows:
                    yield from flush()
                    rows = []
                bucket = b
                rows.append((chunks[i].as_py(), data[i].as_py()))
        if rows:
            yield from flush()

    return written(_by_bucket(requests).mapInArrow(run, "level int, bucket int, chunk long, x array<binary>"), "answers")


def _first_reply(rows: list[list[bytes]]) -> tuple[list[list[bytes]], list[bytes]]:
    """Totals of words and pairs; each pair is named once as the own one of a chunk. Further: tokens, distinct words."""
    sides = []
    for k in (0, 2):
        keys = [_unpacked_sorted(r[k]) for r in rows]
        counts = np.concatenate([_unpacked_signed(r[k + 1]) for r in rows])
        known, first, back = distinct(np.concatenate(keys))
        total = np.bincount(back, counts, len(known)).astype(np.int64)
        own = np.zeros(len(back), dtype=bool)
        own[first] = True
        sides.append((total, total[back], own, np.cumsum([0, *map(len, keys)])))
    (words, w, _, we), (_, p, own, pe) = sides
    out = [[packed(w[we[k] : we[k + 1]]), packed(p[pe[k] : pe[k + 1]]), np.packbits(own[pe[k] : pe[k + 1]]).tobytes()] for k in range(len(rows))]
    return out, [struct.pack("<QQ", int(words.sum()), int((words > 0).sum()))]


def _reply(model: Model):
    """Totals of followers and whether their contexts are states; further: what frequent contexts gain here."""

    def joined(rows: list[list[bytes]], k: int, read=unpacked) -> np.ndarray:
        return np.concatenate([read(r[k]) for r in rows])

    def reply(rows: list[list[bytes]]) -> tuple[list[list[bytes]], list[bytes] | None]:
        ends = [np.cumsum([0, *(struct.unpack_from("<Q", r[k])[0] for r in rows)]) for k in (0, 2, 6)]
        known, _, back = distinct(joined(rows, 0, _unpacked_sorted))
        gain = np.zeros(len(known), dtype=np.int64)
        np.add.at(gain, back, joined(rows, 1, _unpacked_signed))
        one = (gain >= model.bar * _FIXED)[back]
        # contexts whose followers are all here
        contexts, _, context = distinct(joined(rows, 2, _unpacked_sorted))
        pair, first, back = distinct((context.astype(np.uint64) << np.uint64(32)) | joined(rows, 3))
        total = np.bincount(back, joined(rows, 4, _unpacked_signed), len(pair)).astype(np.int64)
        log = np.zeros(len(pair), dtype=np.int64)
        np.minimum.at(log, back, joined(rows, 5, _unpacked_signed))  # 0 where a chunk has the pair in held-out texts alone
        of = context[first]
        occurs = np.bincount(of, total, len(contexts))
        some = total > 0
        gain = np.zeros(len(contexts), dtype=np.int64)
        np.add.at(gain, of[some], gains(total[some], occurs[of[some]], np.exp(log[some] / _FINE), model.strength))
        state, rare = (gain >= model.bar * _FIXED)[context], total[back]
        # frequent contexts: some of their followers
        pair, first, back = distinct(joined(rows, 6, _unpacked_sorted))
        total = np.bincount(back, joined(rows, 8, _unpacked_signed), len(pair)).astype(np.int64)
        log = np.zeros(len(pair), dtype=np.int64)
        np.minimum.at(log, back, joined(rows, 9, _unpacked_signed))
        some = total > 0
        of, _, owner = distinct(joined(rows, 7)[first][some])
        gain = np.zeros(len(of), dtype=np.int64)
        np.add.at(gain, owner, gains(total[some], joined(rows, 10, _unpacked_signed)[first][some], np.exp(log[some] / _FINE), model.strength))
        out, hot = [], total[back]
        for k in range(len(rows)):
            a, b, c = (slice(e[k], e[k + 1]) for e in ends)
            out.append([np.packbits(one[a]).tobytes(), struct.pack("<Q", ends[0][k + 1] - ends[0][k]), packed(rare[b]), np.packbits(state[b]).tobytes(), packed(hot[c])])
        return out, [packed(of), _packed_signed(gain)] if len(of) else None

    return reply


def _hot_states(answers: DataFrame, level: int, bar: float) -> np.ndarray:
    """The states among contexts that were dealt by follower; at most 1 / HOT_SHARE contexts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"k": unpacked(x[0]).astype(np.int64), "gain": _unpacked_signed(x[1])})

    sums = answers.where(F.col("level") == -level).select("x").mapInArrow(run, "k long, gain long").groupBy("k").agg(F.sum("gain").alias("gain"))
    return np.sort(sums.where(F.col("gain") >= F.lit(bar * _FIXED)).select("k").toArrow().column("k").to_numpy().view(np.uint64))


def _with_answers(chunks: DataFrame, answers: list[DataFrame], model: Model, act, schema: str) -> DataFrame:
    """Apply act(chunk number, Chunk that knows the answers) -> table to each chunk."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # at most 1 / HOT_SHARE numbers for each length
    levels = len(answers)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.column("x")[0].as_py(), shared.value)
        order = np.lexsort((right.column("bucket").to_numpy(), right.column("level").to_numpy()))
        rows: dict[int, list[list[bytes]]] = {}
        for i in order.tolist():
            rows.setdefault(right.column("level")[i].as_py(), []).append(right.column("x")[i].as_py())
        for level in range(1, levels + 1):
            own = rows.get(level, [])
            chunk.first_answer(own) if level == 1 else chunk.answer(level, own)
        return act(left.column("chunk")[0].as_py(), chunk)

    right = answers[0]
    for more in answers[1:]:
        right = right.unionByName(more)
    return chunks.groupBy("chunk").cogroup(right.where("level > 0").groupBy("chunk")).applyInArrow(run, schema)


REQUEST = "bucket int, chunk long, x array<binary>"


def _first_requests(chunks: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                for b, x in _dealt(number, Chunk(batch.column(1)[i].as_py(), model).first_request(), model.shift):
                    yield _rows(bucket=[b], chunk=[number], x=[x])

    return chunks.select("chunk", "x").mapInArrow(run, REQUEST)


def _requests(chunks: DataFrame, answers: list[DataFrame], model: Model, level: int) -> DataFrame:
    def act(number: int, chunk: Chunk) -> pa.Table:
        found = list(_dealt(number, chunk.request(level), model.shift))
        return pa.Table.from_batches([_rows(bucket=[b for b, _ in found], chunk=[number] * len(found), x=[x for _, x in found])])

    return _with_answers(chunks, answers, model, act, REQUEST)


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, bar: float = BAR, strength: float = STRENGTH) -> DataFrame:
    """Rows (id, held, n_tokens, n_known, train_tokens, base, score), log10 of the whole texts' probabilities.

    Learns from the texts where `held` is false. base: unigrams with one added; score: the suffix tree. A null or
    empty text is its end alone. Without training texts all probabilities are 1. Repeated rows count and stay, null ids
    too. Counts of words are exact; pairs and longer sequences are told by 56-bit hashes.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    buckets = 1 << (BUCKETS_PER_PARTITION * parts - 1).bit_length()
    model = Model(max(1, depth), max(2, least), bar, strength, 64 - (buckets - 1).bit_length())
    chunks = _chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held")), parts, CHUNK)
    answers = [_answered(_first_requests(chunks, model), 1, _first_reply)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [struct.unpack("<QQ", x[0]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([s[0] for s in sums], pa.int64()), "b": pa.array([s[1] for s in sums], pa.int64())})

    tokens, words = answers[0].where("level = -1").select("x").mapInArrow(seen, "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    model = Model(**vars(model) | {"tokens": tokens or 0, "words": words or 0, "many": max(HOT, int(HOT_SHARE * (tokens or 0))), "hot": {}})
    for level in range(2, max(2, model.depth) + 1):
        answers.append(_answered(_requests(chunks, answers, model, level), level, _reply(model)))
        model = Model(**vars(model) | {"hot": model.hot | {level: _hot_states(answers[-1], level, bar)}})
    kind = docs.schema[id_col].dataType.simpleString()
    found = _with_answers(chunks, answers, model, lambda number, chunk: chunk.scores(), f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double")
    return found.select("id", "held", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base", "score")
