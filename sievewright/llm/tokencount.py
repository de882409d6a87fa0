"""Exact token counts of byte-level BPE at every prefix of a text, by dynamic programming."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Pieces whose counts a worker keeps; beyond it the memory starts anew. It changes no result.
KEPT_PIECES = 500_000

# The pattern by which byte-level BPE vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The white space of the pattern, without the control characters 1C-1F that Python adds to it.
_SPACE = r"[\t-\r \x85\xa0  -     　]"
_NOT_SPACE = "[^" + _SPACE[1:]
_ANY = regex.compile(PATTERN.replace(r"[^\s", "[^" + _SPACE[1:-1]).replace(r"\S", _NOT_SPACE).replace(r"\s", _SPACE))
#: For texts of ASCII, Latin letters and common dashes and quotes alone; there it cuts as _ANY does, at twice the speed.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ‐-‧]")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Memo(dict):
    """A dict that works out what it lacks; past `kept` entries it starts anew."""

    def __init__(self, work: Callable, kept: int) -> None:
        super().__init__()
        self.work, self.kept = work, kept

    def __missing__(self, key: object) -> object:
        if len(self) >= self.kept:
            self.clear()
        found = self[key] = self.work(key)
        return found


class PrefixCounter:
    """Counts of one vocabulary file (a .json of the tokenizers library with byte-level BPE)."""

    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        alphabet = byte_alphabet()
        as_bytes = lambda x: bytes(alphabet[c] for c in x)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        self.tokens = {as_bytes(x) for x in model["vocab"] if x not in added or all(c in alphabet for c in x)}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        #: each token's last merge: its left part, its right part and the rank
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        if len(self.made) != len(self.rank):
            raise ValueError("two merges make the same token")
        self.longest = max(map(len, self.tokens))
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self._fits = _Memo(self._fit, kept)
        self._whole = _Memo(lambda token: self.merged(token) == [token], kept)
        self._edges = _Memo(self._edge, kept)
        self._counts = _Memo(self._count, kept)

    def merged(self, word: bytes) -> list[bytes]:
        """BPE of a short string by its definition: the best-ranked pair is merged until none is left."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            k, out = 0, []
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _edge(self, key: tuple[bytes, bool]) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's right or left edge while it is merged, and the rank that ends each."""
        part, right = key
        found, end = [], len(self.rank)
        while True:
            found.append((part, end))
            if part not in self.made:
                return found
            end = self.made[part][2]
            part = self.made[part][right]

    def _fit(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens side by side stay as they are.

        They don't if two parts that meet at the border have a merge that comes before the one that ends either;
        of equal merges the one further left comes first.
        """
        rank, none = self.rank.get, len(self.rank)
        ends = self._edges[pair[1], False]
        for a, a_end in self._edges[pair[0], True]:
            for b, b_end in ends:
                r = rank((a, b), none)
                if r < a_end and r <= b_end and r < none:
                    return False
        return True

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the piece's prefixes of 0, 1, ... bytes.

        A prefix's encoding is its last token after the encoding of what stands before that token. The last
        token is the one that stays whole and fits the last token before it; there is exactly one.
        """
        counts, last = [0], [b""]
        tokens, whole, fits, longest = self.tokens, self._whole, self._fits, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = piece[start:end]
                if token in tokens and whole[token] and (not start or fits[last[start], token]):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def _count(self, piece: str) -> int:
        raw = piece.encode("utf-8", "replace")
        if raw in self.tokens and self._whole[raw]:
            return 1
        return self.piece_counts(raw)[-1]

    def _total(self, part: str) -> int:
        found = (_ANY if _BEYOND.search(part) else _LATIN).findall(part)
        return sum(map(self._counts.__getitem__, found))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings, and which parts are one."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; special strings in it are one token each. Null has none."""
        return sum(1 if special else self._total(part) for part, special in self.segments(text or ""))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., as if each prefix were encoded on its own.

        Pieces before the one a prefix ends in are those of the whole text, except that white space at the end
        of a prefix is one piece, and that a clitic such as 're may not be complete yet.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        done = at = 0
        for part, special in self.segments(text):
            before = done
            if special:
                # short of its end, the special string is ordinary text after the part before it
                start, base = (back_at, back_done) if at and not back_special else (at, before)
                for k in range(1, len(part)):
                    out[at + k] = base + self._total(text[start : at + k])
                done = before + 1
                out[at + len(part)] = done
            else:
                k, space_from, space_base = 0, -1, 0
                for piece in (_ANY if _BEYOND.search(part) else _LATIN).findall(part):
                    raw = piece.encode("utf-8", "replace")
                    counts, size = self.piece_counts(raw), 0
                    blank = piece.isspace()
                    for n, c in enumerate(piece, 1):
                        size += len(c.encode("utf-8", "replace"))
                        if n < len(piece) and piece[0] == "'" and piece[1].isalpha():
                            out[at + k + n] = done + self._total(piece[:n])
                        elif space_from >= 0 and piece[:n].isspace():
                            out[at + k + n] = space_base + self._total(part[space_from : k + n])
                        else:
                            out[at + k + n] = done + counts[size]
                    space_from, space_base = (k, done) if blank and space_from < 0 else (space_from, space_base) if blank else (-1, 0)
                    done += counts[-1]
                    k += len(piece)
                back_at, back_done = at, before
            back_special = special
            at += len(part)
        return out

    def truncate(self, text: str, limit: int) -> str:
        """The longest prefix of at most `limit` tokens."""
        return text[: int(np.flatnonzero(self.prefix_counts(text) <= limit)[-1])]


_OPEN: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of this process for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens) of all whole texts; a null text has neither bytes nor tokens.

    `vocabulary` is a file that every executor has at the same path, or finds by name in public_tokenizers.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(located(vocabulary))
        for batch in batches:
            texts = texts_of(batch)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0),
                "n_bytes": pa.array([len(x.encode("utf-8", "replace")) if x else 0 for x in texts], pa.int64()),
                "n_tokens": pa.array([counts.count(x) for x in texts], pa.int64()),
            })

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")


def truncated(docs: DataFrame, vocabulary: str, limit: int, text_col: str = "text") -> DataFrame:
    """The documents with each text cut to its longest prefix of at most `limit` tokens; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(located(vocabulary))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [x if x is None or len(x.encode("utf-8", "replace")) <= limit else counts.truncate(x, limit) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def located(vocabulary: str) -> str:
    """A path as it is; a bare file name in the installed vocabulary package."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))
