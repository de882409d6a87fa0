"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

WINDOW = 10
#: Words of test items that one automaton holds; a larger benchmark is cut into several, used one after another.
SHARD_WORDS = 100_000
#: A document that test items cover by more than this share of its words is dropped, not cut.
MAX_COVERAGE = 0.5

_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bench_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences; each state knows the items whose windows end there.

    A window is `window` consecutive words of an item; an item of fewer words is a window as a whole.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._grow(last, w)
        #: by state: windows that end there, as (length, items)
        self.ends: dict[int, dict[int, set[str]]] = {}
        for item, word_ids in coded:
            size = min(window, len(word_ids))
            for state, matched in self._walk(word_ids):
                if matched >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(item)
        self.shortest = min((size for x in self.ends.values() for size in x), default=0)
        #: by state: the windows among all its suffixes, longest first
        self.windows: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((size, frozenset(x)) for size, x in sorted(self.ends.get(state, {}).items(), reverse=True))
            self.windows[state] = own + self.windows[self.link[state]]

    def _grow(self, last: int, w: int) -> int:
        """Append w after the state `last`; the state of the longest string that ends there."""
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]))
        self.link[copy] = self.link[to]
        self.link[to] = copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _walk(self, word_ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest match that ends with it."""
        state = matched = 0
        for w in word_ids:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            yield state, matched

    def scan(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> int:
        """Mark in `hit` the words inside windows, add the items to `items`; the longest match of any length.

        Only runs of words that the items know, as long as the shortest window, can hold one.
        """
        longest = 0
        if len(words) < self.shortest or not self.shortest:
            return longest
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        starts, ends = edge[::2], edge[1::2]
        wide = ends - starts >= self.shortest
        for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            for at, (state, matched) in enumerate(self._walk(ids[a:b].tolist()), a + 1):
                if matched < self.shortest:
                    continue
                longest = max(longest, matched)
                fitting = [x for x in self.windows[state] if x[0] <= matched]
                if fitting:
                    hit[at - fitting[0][0] : at] = True
                    for _, found in fitting:
                        items |= found
        return longest


class Scanner:
    """All shards of a benchmark, as broadcasts of bounded size; a worker holds one automaton at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> None:
        spark = benchmark.sparkSession
        items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
        # a word has one byte and one separator at least, so this bounds the words
        size = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
        self.shards = max(1, -int(-size // (shard_words * 2)))
        self.parts = []
        for k in range(self.shards):
            rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.shards)) == k).collect()
            self.parts.append(spark.sparkContext.broadcast(ItemAutomaton([(r["item"], bench_words(r["text"])) for r in rows], window)))

    def scan_all(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str], int]]:
        """For each text: words, hit mask by word, items, longest match."""
        words = [bench_words(x) for x in texts]
        found = [[len(w), np.zeros(len(w), dtype=bool), set(), 0] for w in words]
        for part in self.parts:
            automaton = part.value
            for w, x in zip(words, found, strict=True):
                x[3] = max(x[3], automaton.scan(w, x[1], x[2]))
            if len(self.parts) > 1 and hasattr(part, "_value"):
                del part._value  # read again from the worker's disk when needed
        return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted as strings), longest_match in words.

    A null or wordless text has no words and no hits. Items that are null, wordless or without an id never
    match; items that repeat an id count once. Repeated documents keep their rows.
    """
    scanner = Scanner(benchmark, window=window, shard_words=shard_words)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scanner.scan_all(texts_of(batch))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0),
                "n_words": pa.array([x[0] for x in found], pa.int64()),
                "n_hit": pa.array([int(x[1].sum()) for x in found], pa.int64()),
                "items": pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                "longest_match": pa.array([x[3] for x in found], pa.int64()),
            })

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind.simpleString()}, n_words long, n_hit long, items array<string>, longest_match long")


def without_spans(text: str, hit: np.ndarray) -> str:
    """The text without the runs of hit words, each from its first to its last character."""
    out, at, open_from, last_end = [], 0, -1, 0
    for k, m in enumerate(_WORD.finditer(text)):
        if hit[k]:
            if open_from < 0:
                open_from = m.start()
            last_end = m.end()
        elif open_from >= 0:
            out.append(text[at:open_from])
            at, open_from = last_end, -1
    if open_from >= 0:
        out.append(text[at:open_from])
        at = last_end
    out.append(text[at:])
    return "".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents, of the same columns, without spans of `window` words or more that test items hold.

    A span is cut from the text (and `length_col`, if there is one, counted anew); a document whose words lie
    in such spans by more than `max_coverage` is dropped. Other documents, null texts too, stay as they are.
    """
    scanner = Scanner(benchmark, window=window)
    counted = length_col if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            found = scanner.scan_all(texts)
            keep = pa.array([x[1].sum() <= max_coverage * x[0] for x in found], pa.bool_())
            if any(x[1].any() for x in found):
                texts = [without_spans(t, x[1]) if x[1].any() else t for t, x in zip(texts, found, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if counted:
                    k = batch.schema.get_field_index(counted)
                    changed = pa.array([bool(x[1].any()) for x in found])
                    lengths = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type)
                    batch = batch.set_column(k, batch.schema.field(k), pc.if_else(changed, lengths, batch.column(k)))
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
