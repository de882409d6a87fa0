"""Text functions as columns: tokens, segments, numbers, cues, chunks and scans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters and digits, joined by single dots, slashes or hyphens. Java's and RE2's classes agree on it.
TOKEN = r"[\p{L}\p{N}]+(?:[./-][\p{L}\p{N}]+)*"
# Fixed value: what a number as a token of its own is.
NUMERIC_TOKEN = r"(?<![A-Za-z0-9_.])[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?![A-Za-z0-9_.])"
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"


def folded(text: Column) -> Column:
    """Case folding for the languages at hand: lower case, and sharp s as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def segments(text: Column) -> Column:
    """Sentences: cut at line ends and after . ! ? ; before white space; blank ones are left out."""
    cut = F.split(F.regexp_replace(text, r"([.!?;])[ \t\n\r\f\x0B]+", "$1\n"), r"\n+")
    return F.filter(F.transform(cut, squeezed), lambda s: s != "")


def any_cue(text: Column, cues: Iterable[str]) -> Column:
    """Whether one of the patterns occurs, in any case."""
    return text.rlike("(?i)(?:" + "|".join(cues) + ")")


def match_spans(text: Column, pattern: str) -> Column:
    """Where a pattern's matches stand, as structs (start, end) of characters, in any case."""
    pattern = f"(?i)(?:{pattern})"
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def span(x: Column, k: Column) -> Column:
        start = length(F.slice(between, F.lit(1), k + 1)) + length(F.slice(found, F.lit(1), k))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"))

    return F.transform(found, span)


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The characters from `before` ahead of a span to `after` behind it."""
    first = F.greatest(start - F.lit(before), F.lit(0))
    return F.substring(text, first + 1, F.least(end + F.lit(after), F.length(text)) - first)


def numbers(text: Column) -> Column:
    """Numbers as doubles, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def numeric_tokens(text: Column) -> Column:
    """Numbers that are tokens of their own, as decimals: no letter, digit, underscore or dot stands beside one; a sign
    counts if no such character is before it, and a number may begin with its point."""
    found = F.regexp_extract_all(text, F.lit(NUMERIC_TOKEN), F.lit(0))
    values = F.transform(found, lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))
    return F.filter(values, lambda d: d.isNotNull())


def has_number(text: Column, value: Column) -> Column:
    """Whether the value occurs as a numeric token, by exact decimal equality."""
    return F.exists(numeric_tokens(text), lambda x: x == value.cast("decimal(38,10)"))


def mentions(text: Column, aliases: Iterable[str], reach: int = 20) -> Column:
    """Numbers that follow or precede one of the aliases within `reach` characters without another digit between."""
    names = "(?:" + "|".join(aliases) + ")"
    after = F.regexp_extract_all(text, F.lit(rf"(?i){names}[^0-9\n]{{0,{reach}}}({NUMBER})"), F.lit(1))
    before = F.regexp_extract_all(text, F.lit(rf"(?i)({NUMBER})[^0-9\n]{{0,{reach}}}{names}"), F.lit(1))
    return F.transform(F.concat(after, before), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def clamped(value: Column, least: float) -> Column:
    """A value of at least `least` counts as that: such findings are reported as a bound."""
    return F.when(value >= least, F.lit(least)).otherwise(value)


def unescaped(text: Column) -> Column:
    """A criterion's text with \\< and \\> unescaped and white space squeezed."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"\\<", "<"), r"\\>", ">"))


def trimmed_span(text: Column, start: Column) -> Column:
    """The span of the text without white space at its ends, which begins at `start`."""
    lead = F.length(text) - F.length(F.ltrim(text))
    return F.struct((start + lead).alias("start"), (start + lead + F.length(F.trim(text))).alias("end"))


def first_category(text: Column, categories: dict[str, Iterable[str]], otherwise: str) -> Column:
    """The first category of which a keyword occurs in the lower-cased text."""
    low = F.lower(text)
    chain = F.lit(otherwise)
    for name, words in reversed(categories.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        chain = F.when(hit, F.lit(name)).otherwise(chain)
    return chain


def stride_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Overlapping chunks of a fixed stride, as (start, text) structs; the last one may be shorter."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - F.lit(size)) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.substring(text, k * step + 1, F.lit(size)).alias("text")))


def _note_spans(text: str, limit: int) -> list[dict[str, int]]:
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + limit)
        if end < len(text):
            cut = max(text.rfind(mark, at + limit // 2, end) for mark in ("\n", " "))
            if cut > at:
                end = cut + (2 if text.startswith("\n\n", cut) else 1)
        if text[at:end].strip():
            found.append({"start": at, "end": end})
        at = end
    return found


def note_chunks(text: Column, limit: int = 1200) -> Column:
    """Spans of a note's chunks: each as long as fits, cut after the last space or line end in the second half of the
    limit (both line ends of a blank line go with the chunk), else hard; a chunk of white space only is dropped.

    Where a chunk starts depends on the one before, so this is an Arrow function and not an expression.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [] if t is None else _note_spans(t, limit))

    return cut(text)


# Identifiers that must not appear in public data.
IDENTIFIERS = {
    "card": r"(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"(?:^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?:[^0-9.]|$)",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}


def identifier_findings(text: Column, size_limit: int | None = None) -> Column:
    """Names of the identifier patterns that occur, in the alphabet's order, then `too_large` beyond the limit."""
    found = [F.when(text.rlike(p), F.lit(name)) for name, p in sorted(IDENTIFIERS.items())]
    if size_limit is not None:
        found.append(F.when(F.length(text) > size_limit, F.lit("too_large")))
    return F.array_compact(F.array(*found))


def safe_path(path: Column) -> Column:
    """A relative path without empty, dot or dot-dot parts and without backslashes."""
    return ~(path.rlike(r"^/|\\|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)"))
