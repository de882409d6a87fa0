"""Facts from text: lexical findings with negation and uncertainty, numeric findings, protocol criteria, messages."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import short_id
from ..functions.text import any_cue, around, match_spans, mentions, segments, squeezed, unescaped


@dataclass(frozen=True)
class LexicalRule:
    name: str
    aliases: tuple[str, ...]
    negations: tuple[str, ...] = ()
    uncertain: tuple[str, ...] = ()
    required_context: str | None = None
    default_absent: bool = False


# Fixed value: what makes a mention absent when it follows.
ABSENT_AFTER = r"\b(?:is|was|are|were)?\s*absent\b"
#: Characters around a mention in which uncertainty and required context are looked for, before it in which a negation
#: is, and behind it in which ABSENT_AFTER is.
CONTEXT, PREFIX, SUFFIX = 100, 80, 30


def lexical_mentions(chunks: DataFrame, rules: Iterable[LexicalRule]) -> DataFrame:
    """Rows (scope, chunk_id, sentence, rule, alias, start, end, polarity): each match of each alias in a sentence.

    chunks: scope, chunk_id, text. ambiguous: an uncertainty cue stands within CONTEXT characters, or a required context
    does not; negative: a negation within PREFIX characters before, or "absent" within SUFFIX behind; else positive.
    """
    s, found = F.col("sentence"), []

    def judged(rule: LexicalRule, number: int, alias: str) -> Column:
        def one(m: Column) -> Column:
            near = around(s, m["start"], m["end"], CONTEXT, CONTEXT)
            unsure = any_cue(near, rule.uncertain) if rule.uncertain else F.lit(False)
            if rule.required_context:
                unsure = unsure | ~any_cue(near, [rule.required_context])
            negative = any_cue(around(s, m["end"], m["end"], 0, SUFFIX), [ABSENT_AFTER])
            if rule.negations:
                negative = negative | any_cue(around(s, m["start"], m["start"], PREFIX, 0), rule.negations)
            polarity = F.when(unsure, "ambiguous").when(negative, "negative").otherwise("positive")
            return F.struct(F.lit(rule.name).alias("rule"), F.lit(number).alias("alias"), m["start"].alias("start"), m["end"].alias("end"), polarity.alias("polarity"))

        return F.transform(match_spans(s, alias), one)

    for rule in rules:
        found += [judged(rule, k, alias) for k, alias in enumerate(rule.aliases, 1)]
    rows = chunks.select("scope", "chunk_id", F.explode(segments(F.col("text"))).alias("sentence"))
    return rows.select("scope", "chunk_id", "sentence", F.inline(F.concat(*found)))


def evidence_links(mentioned: DataFrame, *names: str) -> DataFrame:
    """Which chunks bear on what: one row per scope, name and chunk."""
    return mentioned.select("scope", *names, "chunk_id").distinct()


def lexical_findings(mentioned: DataFrame, scopes: DataFrame, rules: Iterable[LexicalRule]) -> DataFrame:
    """One row per scope and rule: present, absent or unknown, why, and how many chunks bear on it, with the first one.

    Positive and negative mentions together are a conflict; ambiguous ones decide only where nothing else was found, and
    then keep a default from applying. The chunks themselves are evidence_links(), since a scope may have any number.
    """
    pos, neg = F.col("polarity") == "positive", F.col("polarity") == "negative"
    by_chunk = mentioned.groupBy("scope", "rule", "chunk_id").agg(F.bool_or(pos).alias("pos"), F.bool_or(neg).alias("neg"))
    sums = by_chunk.groupBy("scope", "rule").agg(F.bool_or("pos").alias("pos"), F.bool_or("neg").alias("neg"), F.count("*").alias("n_evidence"), F.min("chunk_id").alias("first_evidence"))
    domain = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.default_absent).alias("default_absent")) for r in rules])
    grid = scopes.select("scope").distinct().select("scope", F.inline(domain)).join(sums, ["scope", "rule"], "left")
    both, pos, neg = F.col("pos") & F.col("neg"), F.coalesce("pos", F.lit(False)), F.coalesce("neg", F.lit(False))
    there = F.col("n_evidence").isNotNull()
    status = F.when(pos & neg, "unknown").when(pos, "present").when(neg, "absent").when(there, "unknown").when(F.col("default_absent"), "absent").otherwise("unknown")
    reason = F.when(both, "conflicting").when(pos | neg, F.lit(None).cast("string")).when(there, "ambiguous").when(F.col("default_absent"), "default").otherwise("not_mentioned")
    return grid.select("scope", "rule", status.alias("status"), reason.alias("reason"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "first_evidence")


def numeric_mentions(chunks: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (scope, chunk_id, name, value): each number beside an alias."""
    every = F.array(*[F.struct(F.lit(name).alias("name"), mentions(F.col("text"), words).alias("values")) for name, words in aliases.items()])
    return chunks.select("scope", "chunk_id", F.inline(every)).select("scope", "chunk_id", "name", F.explode("values").alias("value"))


def numeric_findings(chunks: DataFrame, aliases: dict[str, tuple[str, ...]], largest: bool = True) -> DataFrame:
    """Per scope and name the largest (or smallest) number beside an alias, how many there are, how many chunks hold it,
    and the first of those."""
    best = F.max if largest else F.min
    by_chunk = numeric_mentions(chunks, aliases).groupBy("scope", "name", "chunk_id").agg(best("value").alias("value"), F.count("*").alias("n"))
    # per value first, so that a scope's chunks are gathered nowhere
    by_value = by_chunk.groupBy("scope", "name", "value").agg(F.sum("n").alias("n"), F.count("*").alias("n_evidence"), F.min("chunk_id").alias("first_evidence"))
    pick = F.max_by if largest else F.min_by
    found = by_value.groupBy("scope", "name").agg(best("value").alias("value"), F.sum("n").alias("n_mentions"), pick(F.struct("n_evidence", "first_evidence"), "value").alias("e"))
    return found.select("scope", "name", "value", "n_mentions", "e.n_evidence", "e.first_evidence")


INCLUSION, EXCLUSION = r"^\W*(?:key\s+)?inclusion\s+criteria\W*$", r"^\W*(?:key\s+)?exclusion\s+criteria\W*$"
BULLET = r"^\s*(?:[-*•]|[0-9]+[.)])\s+"


def protocol_criteria(protocols: DataFrame) -> DataFrame:
    """Rows (protocol_id, kind, position, text, criterion_id, error) of eligibility texts (protocol_id, text).

    Headings give the polarity. Where a section has bullets, lines before the first one are dropped and lines after
    a bullet continue it; without bullets each line is an item. A text without headings has one row with an error.
    Ids of equal texts of a protocol get a number from 2 on.
    """
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("raw"), F.when(x.rlike(f"(?i){INCLUSION}"), "inclusion").when(x.rlike(f"(?i){EXCLUSION}"), "exclusion").alias("heading"), x.rlike(BULLET).alias("bullet")))
    # one pass carries the section, whether it has bullets, and the item under way
    empty = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(False).alias("bullets"), F.array().cast("array<struct<kind:string,text:string>>").alias("items"))

    def step(state: Column, x: Column) -> Column:
        text = unescaped(F.regexp_replace(x["raw"], BULLET, ""))
        blank = text == ""
        item = F.array(F.struct(state["kind"].alias("kind"), text.alias("text")))
        last = F.element_at(state["items"], -1)
        longer = F.concat(F.slice(state["items"], 1, F.size(state["items"]) - 1), F.array(F.struct(last["kind"].alias("kind"), F.concat(last["text"], F.lit(" "), text).alias("text"))))
        own = F.filter(state["items"], lambda i: ~i["kind"].eqNullSafe(state["kind"]))
        items = (
            F.when(x["heading"].isNotNull() | blank | state["kind"].isNull(), state["items"])
            .when(x["bullet"] & ~state["bullets"], F.concat(own, item)).when(x["bullet"], F.concat(state["items"], item)).when(state["bullets"], longer).otherwise(F.concat(state["items"], item))
        )
        kind = F.coalesce(x["heading"], state["kind"])
        bullets = F.when(x["heading"].isNotNull(), F.lit(False)).otherwise(state["bullets"] | (x["bullet"] & state["kind"].isNotNull()))
        return F.struct(kind.alias("kind"), bullets.alias("bullets"), items.alias("items"))

    items = F.aggregate(marked, empty, step)["items"]
    rows = protocols.select("protocol_id", F.posexplode_outer(items).alias("position", "item")).select("protocol_id", "position", F.col("item.kind").alias("kind"), F.col("item.text").alias("text"))
    base = short_id(F.col("protocol_id").cast("string"), F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit("")))
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("protocol_id", "base").orderBy("position"))
    rows = rows.withColumn("base", base).withColumn("again", again)
    return rows.select("protocol_id", "kind", "position", "text", F.when(F.col("again") > 1, F.concat_ws("-", "base", F.col("again").cast("string"))).otherwise(F.col("base")).alias("criterion_id"), F.when(F.col("text").isNull(), "ambiguous_polarity").alias("error"))


def html_sections(pages: DataFrame, html: str = "html") -> DataFrame:
    """Headings and list items of pages as (page_id, kind, text), tags removed, white space squeezed."""
    def inner(tag: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(found, lambda x: F.struct(F.lit(tag).alias("kind"), squeezed(F.regexp_replace(x, "<[^>]*>", " ")).alias("text")))

    parts = F.concat(*[inner(t) for t in ("h1", "h2", "li")])
    return pages.select("page_id", F.inline(parts)).where("text <> ''")


def chat_messages(turns: DataFrame) -> DataFrame:
    """One JSON array of {role, content} per conversation, in the order of the turns, and whether the roles alternate."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t"))
    body = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    spoken = F.filter(F.transform("t", lambda x: x["role"]), lambda r: r != "system")
    swapped = F.zip_with(F.slice(spoken, 1, F.greatest(F.size(spoken) - 1, F.lit(0))), F.slice(spoken, 2, F.greatest(F.size(spoken) - 1, F.lit(0))), lambda a, b: a != b)
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.forall(swapped, lambda x: x).alias("alternates"), body.alias("messages"))
