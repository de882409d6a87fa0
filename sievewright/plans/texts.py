"""Text functions and extraction over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extraction as e
from ..session import table

RULES = (
    e.LexicalRule("license", ("licen[sc]ed?", "copyright"), negations=(r"\bno\b", r"\bnot\b"), uncertain=(r"\bmay\b", r"\bperhaps\b")),
    e.LexicalRule("apache", ("apache",), required_context="version"),
    e.LexicalRule("secret", ("token", "password", "secret"), negations=(r"\bwithout\b",), default_absent=True),
)
CATEGORIES = {"secret": ("token =", "password"), "license": ("licen", "copyright"), "table": (" | ",), "junk": ("***", "$$$", "!!")}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", t.segments(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join("s", "\n")).alias("digest"))


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", F.explode(t.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_distinct"), F.max(F.length("token")).cast("long").alias("longest"))


def lexical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")
    found = e.lexical_findings(e.lexical_mentions(chunks, RULES), chunks, RULES)
    return found.select("scope", "rule", "status", F.coalesce("reason", F.lit("")).alias("reason"), "n_evidence", F.coalesce("first_evidence", F.lit(-1)).alias("first_evidence"))


def lexical_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their places and polarities, as counts and sums per document and rule."""
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")
    found = e.lexical_mentions(chunks, RULES)
    return found.groupBy(F.col("chunk_id").alias("doc_id"), "rule", "alias", "polarity").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"), F.sum("end").cast("long").alias("ends"))


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")
    return e.evidence_links(e.lexical_mentions(chunks, RULES), "rule")


def numeric_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")
    names = {"version": ("version",), "phone": (r"\+1 \(",)}
    most, least = e.numeric_findings(chunks, names), e.numeric_findings(chunks, names, largest=False)
    joined = most.select("scope", "name", F.col("value").alias("largest"), "n_mentions", "n_evidence").join(least.select("scope", "name", F.col("value").alias("smallest")), ["scope", "name"])
    return joined.select("scope", "name", "largest", t.clamped(F.col("largest"), 500.0).alias("clamped"), "smallest", "n_mentions", "n_evidence")


def numeric_token_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", t.numeric_tokens(F.col("text")).alias("n"), t.has_number(F.col("text"), F.lit("2")).alias("has_two"))
    return rows.where("size(n) > 0").select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_max("n").cast("double").alias("largest"), "has_two")


def phi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _docs(spark, sf_dir).select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text").unionByName(
        table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("table"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"))
    found = both.select("table", "id", "part", t.identifier_findings(F.col("text"), 20_000).alias("f"))
    return found.where("size(f) > 0").select("table", "id", "part", F.concat_ws(",", "f").alias("findings"))


def chunk_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", t.first_category(F.col("text"), CATEGORIES, "prose").alias("category"))
    return rows.groupBy("lang", "category").agg(F.count("*").alias("n"))


def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(t.segments(F.col("text"))).alias("at", "sentence"))
    low = F.lower("sentence")
    return rows.where((F.length("sentence") >= 5) & (low.contains("licen") | low.contains("token") | low.contains("version"))).select("doc_id", F.col("at").cast("long").alias("at"), "sentence")


def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.inline(t.stride_chunks(F.col("text"))))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.md5("text").alias("digest"))


def note_chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(t.note_chunks(F.col("text"))).alias("position", "span"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.html_sections(table(spark, sf_dir, "pages"))
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("first"))


def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.chat_messages(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", "alternates", F.get_json_object("messages", "$[0].role").alias("first_role"), F.get_json_object("messages", "$[0].content").alias("first_text"))


QUERIES = {f.__name__: f for f in (
    sentence_segments, token_profile, lexical_flags, lexical_mentions, evidence_links, numeric_minmax, numeric_token_occurrence, phi_scan, chunk_type, keyword_candidates, overlap_chunks, note_chunk_spans, html_sections, sft_messages,
)}

_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+(?:[./-][\\p{L}\\p{N}]+)*')"
_SEG = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])[ \t\n\r\f\x0B]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda s: s <> '')"
_S = f"s AS (SELECT doc_id, source, unnest({_SEG}) AS s FROM documents)"


def _mention(r: e.LexicalRule, number: int, alias: str) -> str:
    """Matches of an alias in sentences: pieces between matches and the matches give their places."""
    cue = lambda column, cues: f"regexp_matches({column}, '(?i)(?:{'|'.join(cues)})')"
    unsure = cue("near", r.uncertain) if r.uncertain else "false"
    if r.required_context:
        unsure += f" OR NOT {cue('near', [r.required_context])}"
    negative = f"{cue('behind', [e.ABSENT_AFTER])} OR " + (cue("ahead", r.negations) if r.negations else "false")
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""SELECT source, doc_id, '{r.name}' AS rule, {number} AS alias, st, en, CASE WHEN {unsure} THEN 'ambiguous' WHEN {negative} THEN 'negative' ELSE 'positive' END AS pol FROM (
  SELECT *, substring(s, greatest(st - 100, 0) + 1, en + 100 - greatest(st - 100, 0)) AS near, substring(s, greatest(st - 80, 0) + 1, st - greatest(st - 80, 0)) AS ahead, substring(s, en + 1, 30) AS behind FROM (
  SELECT *, CAST({size('p[1:i]')} + {size('f[1:i - 1]')} AS BIGINT) AS st, st + length(f[i]) AS en FROM (
  SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT source, doc_id, s, string_split_regex(s, '(?i)(?:{alias})') AS p, regexp_extract_all(s, '(?i)(?:{alias})') AS f FROM s))))"""


_MENTIONS = " UNION ALL ".join(_mention(r, k, a) for r in RULES for k, a in enumerate(r.aliases, 1))


def _near(name: str, alias: str) -> str:
    number = "[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?"
    return (f"SELECT source, doc_id, '{name}' AS name, unnest(list_concat(regexp_extract_all(text, '(?i)(?:{alias})[^0-9\\n]{{0,20}}({number})', 1), regexp_extract_all(text, '(?i)({number})[^0-9\\n]{{0,20}}(?:{alias})', 1))) AS v FROM documents")


# RE2 looks neither ahead nor behind: signs after a token's character become blanks, and what parts tokens is doubled, so
# that each of two numbers beside it has one of its own.
_PARTED = r"regexp_replace(regexp_replace(text, '([A-Za-z0-9_.])[-+]', '\1 ', 'g'), '([^A-Za-z0-9_.+-])', '\1\1', 'g')"
NUMBERS_SQL = rf"""list_transform(regexp_extract_all({_PARTED}, '(?:^|[^A-Za-z0-9_.])([-+]?(?:[0-9]{{1,3}}(?:,,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+))(?:$|[^A-Za-z0-9_.])', 1), lambda p: try_cast(replace(p, ',', '') AS DECIMAL(38,10)))"""

ORACLES = {
    "sentence_segments": f"SELECT doc_id, len(x) AS n, x[1] AS first, CAST(coalesce(list_max(list_transform(x, lambda s: length(s))), 0) AS BIGINT) AS longest, md5(coalesce(array_to_string(x, chr(10)), '')) AS digest FROM (SELECT doc_id, {_SEG} AS x FROM documents)",
    "token_profile": f"SELECT lang, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct, CAST(max(length(t)) AS BIGINT) AS longest FROM (SELECT lang, unnest({_TOKENS}) AS t FROM documents) GROUP BY lang",
    "lexical_flags": f"""WITH {_S}, m AS ({_MENTIONS}), g AS (SELECT DISTINCT source, rule, d FROM documents, (VALUES {", ".join(f"('{r.name}', {str(r.default_absent).lower()})" for r in RULES)}) v(rule, d)),
a AS (SELECT source, rule, bool_or(pol = 'positive') AS pos, bool_or(pol = 'negative') AS neg, count(DISTINCT doc_id) AS n, min(doc_id) AS f FROM m GROUP BY ALL)
SELECT g.source AS scope, g.rule, CASE WHEN pos AND neg THEN 'unknown' WHEN pos THEN 'present' WHEN neg THEN 'absent' WHEN n > 0 THEN 'unknown' WHEN d THEN 'absent' ELSE 'unknown' END AS status,
  CASE WHEN pos AND neg THEN 'conflicting' WHEN pos OR neg THEN '' WHEN n > 0 THEN 'ambiguous' WHEN d THEN 'default' ELSE 'not_mentioned' END AS reason,
  CAST(coalesce(n, 0) AS BIGINT) AS n_evidence, coalesce(f, -1) AS first_evidence FROM g LEFT JOIN a ON a.source = g.source AND a.rule = g.rule""",
    "lexical_mentions": f'WITH {_S}, m AS ({_MENTIONS}) SELECT doc_id, rule, alias, pol AS polarity, count(*) AS n, CAST(sum(st) AS BIGINT) AS starts, CAST(sum(en) AS BIGINT) AS ends FROM m GROUP BY ALL',
    "evidence_links": f"WITH {_S}, m AS ({_MENTIONS}) SELECT DISTINCT source AS scope, rule, doc_id AS chunk_id FROM m",
    "numeric_minmax": f"""WITH v AS (SELECT source, doc_id, name, replace(v, ',', '')::DOUBLE AS v FROM ({_near("version", "version")} UNION ALL {_near("phone", chr(92) + "+1 " + chr(92) + "(")})), x AS (SELECT *, max(v) OVER (PARTITION BY source, name) AS big FROM v)
SELECT source AS scope, name, max(v) AS largest, CASE WHEN max(v) >= 500 THEN 500.0::DOUBLE ELSE max(v) END AS clamped, min(v) AS smallest, count(*) AS n_mentions, count(DISTINCT doc_id) FILTER (v = big) AS n_evidence FROM x GROUP BY source, name""",
    "numeric_token_occurrence": f"WITH n AS (SELECT doc_id, list_filter({NUMBERS_SQL}, lambda d: d IS NOT NULL) AS n FROM documents) SELECT doc_id, len(n) AS n_numbers, list_max(n)::DOUBLE AS largest, list_contains(n, 2.0::DECIMAL(38,10)) AS has_two FROM n WHERE len(n) > 0",
    "phi_scan": "WITH b AS (SELECT 'documents' AS \"table\", doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations), f AS (SELECT \"table\", id, part, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{name}' END" for name, p in sorted(t.IDENTIFIERS.items())) + ", CASE WHEN length(text) > 20000 THEN 'too_large' END], lambda x: x IS NOT NULL) AS f FROM b) SELECT \"table\", id, part, array_to_string(f, ',') AS findings FROM f WHERE len(f) > 0",
    "chunk_type": "SELECT lang, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{name}'" for name, words in CATEGORIES.items()) + " ELSE 'prose' END AS category, count(*) AS n FROM documents GROUP BY ALL",
    "keyword_candidates": f"WITH x AS (SELECT doc_id, {_SEG} AS x FROM documents), u AS (SELECT doc_id, unnest(range(len(x)::BIGINT)) AS at, unnest(x) AS sentence FROM x) SELECT * FROM u WHERE length(sentence) >= 5 AND (contains(lower(sentence), 'licen') OR contains(lower(sentence), 'token') OR contains(lower(sentence), 'version'))",
    "overlap_chunks": "SELECT doc_id, k * 900 AS start, md5(substring(text, k * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1)) AS k FROM documents)",
    "note_chunk_spans": """WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0::BIGINT AS a, 0::BIGINT AS b FROM documents
  UNION ALL
  SELECT doc_id, text, n, b, CASE WHEN b + 1200 >= n THEN n WHEN k = 0 THEN b + 1200 WHEN substring(text, b + 1201 - k, 2) = chr(10) || chr(10) THEN b + 1202 - k ELSE b + 1201 - k END
  FROM (SELECT *, instr(translate(reverse(substring(text, b + 601, 600)), chr(10), ' '), ' ') AS k FROM c) WHERE b < n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS position, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM c WHERE b > 0 AND regexp_matches(substring(text, a + 1, b - a), '\\S')""",
    "html_sections": r"""WITH p AS (SELECT page_id, t AS kind, unnest(regexp_extract_all(html, '(?s)<' || t || '(?:\s[^>]*)?>(.*?)</' || t || '>', 1)) AS x FROM pages, (VALUES ('h1'), ('h2'), ('li')) v(t)),
q AS (SELECT page_id, kind, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM p) SELECT page_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(text) AS first FROM q WHERE text <> '' GROUP BY ALL""",
    "sft_messages": """WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations WHERE role <> 'system')
SELECT conv_id, count(*) AS n_turns, NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.role = s.b) AS alternates, arg_min(role, turn) AS first_role, arg_min(text, turn) AS first_text FROM conversations c GROUP BY conv_id""",
}
