"""Governance, sampling and splitting over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import short_id
from ..operators import governance as g
from ..operators import sampling as s
from ..session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 5, "unknown").when(F.col("value") < 40, "absent").otherwise("present")
    return table(spark, sf_dir, "events").withColumn("status", status)


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.question_profile(_events(spark, sf_dir), "event_type", "status", "value", ("present", "absent", "unknown"))


def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return g.grid_totals(rows, "user_id", "day")


def grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 60").select("user_id", "event_type")
    found = g.missing_pairs(rows, "user_id", "event_type", rows)
    return found.groupBy("event_type").agg(F.count("*").alias("n_missing"))


def small_cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("n_chars") > 20000, "huge").when(F.col("n_chars") > 8000, "long").when(F.col("n_chars") < 60, "tiny").otherwise("usual")
    counts = table(spark, sf_dir, "documents").groupBy("source", band.alias("band")).agg(F.count("*").alias("n"))
    return g.suppressed(counts, ["source"], "band", "n", 4).withColumn("n", F.coalesce("n", F.lit(-1)))


def _policy():
    text = F.col("text")
    return {"language": ~F.col("lang").isin("en", "de"), "too_short": F.length(text) < 200, "too_long": F.length(text) > 10000, "junk": text.rlike(r"[*&$#%|]"), "late_source": F.col("source") > "src5"}


def filter_audit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.failing_reasons(table(spark, sf_dir, "documents"), _policy())
    return found.select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reason_histogram(g.failing_reasons(table(spark, sf_dir, "documents"), _policy()))


def audited_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter all, then a hash sample of what passes; flow counts beside it."""
    rows = g.failing_reasons(table(spark, sf_dir, "documents"), _policy())
    eligible = rows.where("size(reasons) = 0").select("doc_id")
    picked = s.hash_sample(eligible, "doc_id", 25, "select-1")
    flow = rows.agg(F.count("*").alias("n_all"), F.count_if(F.size("reasons") == 0).alias("n_eligible"))
    return picked.select("doc_id", "sample_hash").join(F.broadcast(flow))


def span_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of turns within conversations; every ninth length is off by one."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    spans = turns.withColumn("end", end).select("conv_id", (F.col("end") - F.col("n")).alias("start"), (F.col("end") + (F.col("n") % 9 == 0).cast("long")).alias("end"))
    found = g.span_violations(spans, "conv_id", limit=1500)
    return found.select("conv_id", "start", "end", F.concat_ws(",", "violations").alias("violations"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.sha2("text", 256).alias("content"))
    return s.holdout(docs, "entity_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("all", F.col("label"))
    pairs = s.cosine_pairs(vectors, "vec_id", "embedding", "label", 0.35)
    return g.split_leakage(_members(spark, sf_dir), pairs)


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("entity_id", "split")


def readiness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("low_quality"))
    found = g.readiness_gaps(counts, {"labelled": 300, "toxic": 10**9, "low_quality": 10**9})
    return found.select(F.concat_ws("; ", "gaps").alias("gaps"), "ready")


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    labelled = F.col("quality").isNotNull()
    return g.checks(rows, {"length_kept": (F.col("n_chars").isNotNull(), F.col("n_chars") == F.length("text")), "clean_is_good": (labelled & ~F.col("text").rlike(r"[*&$#%|]"), F.coalesce(F.col("quality") == 1, F.lit(False))), "short_is_not_toxic": (labelled & (F.length("text") < 500), F.coalesce(F.col("toxic") == 0, F.lit(False)))})


def definition_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_brand", "p_size")
    new = table(spark, sf_dir, "part").where("p_size < 45").select("p_partkey", "p_brand", F.when(F.col("p_retailprice") > 1000, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return g.drift(old, new, "p_partkey", ["p_brand", "p_size"]).groupBy("change").agg(F.count("*").alias("n"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", short_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("record_id"), F.sha2("text", 256).alias("content_sha256"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return s.hash_sample(docs, "doc_id", 5, "sample-1", ["lang"]).select("doc_id", "lang", "sample_hash")


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    return s.largest_remainder(counts, "c_mktsegment", "n", 101)


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "entity_id")
    rows = s.holdout(docs, "entity_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1").withColumn("positive", F.col("quality") == 1)
    return s.balance_report(rows, "lang", "split", "positive")


def prevalence_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir).select("lang", F.coalesce("split", F.lit("(all)")).alias("split"), "n", "positives", "prevalence")


def prevalence_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.prevalence_deviation(_balance(spark, sf_dir), "lang")


def calibration_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _members(spark, sf_dir).where("split = 'train'").select("entity_id")
    taken, rest = s.reserved(train, "entity_id", 30, "calibrate-1")
    return taken.withColumn("part", F.lit("calibration")).unionByName(rest.withColumn("part", F.lit("fit")))


def vector_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", F.posexplode("pooled").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.35)
    return found.withColumn("similarity", F.round("similarity", 6))


def cross_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = s.holdout(table(spark, sf_dir, "embeddings"), "vec_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1")
    found = s.cosine_pairs(vectors, "vec_id", "embedding", "label", 0.35, "split")
    return found.withColumn("similarity", F.round("similarity", 6))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors and documents of equal text, as one graph of ids."""
    near = s.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.8).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    same = docs.join(first, "h").where("doc_id <> u").select("u", F.col("doc_id").alias("v"))
    return s.components(near.unionByName(same))


QUERIES = {f.__name__: f for f in (
    quality_profile, grid_completeness, grid_gaps, small_cell_suppression, filter_audit_reasons, reason_histogram, audited_selection, span_contiguity, split_leakage, holdout_split, readiness_gaps, audit_checks,
    definition_drift, identifiers, hash_sample, largest_remainder, prevalence_balance, prevalence_deviation, calibration_reserve, vector_pooling, cosine_pairs, cross_split_pairs, components,
)}

_POLICY = "list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END, CASE WHEN length(text) < 200 THEN 'too_short' END, CASE WHEN length(text) > 10000 THEN 'too_long' END, CASE WHEN regexp_matches(text, '[*&$#%|]') THEN 'junk' END, CASE WHEN source > 'src5' THEN 'late_source' END], lambda x: x IS NOT NULL)"


def _split(key: str, table_: str) -> str:
    place = f"(('0x' || substr(sha256('split-1|' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296)"
    return f"(SELECT *, CASE WHEN {place} < 0.7::DOUBLE THEN 'train' WHEN {place} < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM {table_})"


_PAIRS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.e, b.e) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"""
_BAL = f"b AS (SELECT lang, split, quality FROM {_split('doc_id', 'documents')} JOIN labels USING (doc_id))"

ORACLES = {
    "quality_profile": "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 40) AS n_present, count(*) FILTER (value >= 5 AND value < 40) AS n_absent, count(*) FILTER (value < 5) AS n_unknown, round((count(*) FILTER (value < 5))::DOUBLE / count(*), 6) AS unknown_rate, min(value) AS least, max(value) AS greatest FROM events GROUP BY event_type",
    "grid_completeness": """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, count(*) AS pairs, sum(n) AS r FROM p GROUP BY user_id), q AS (SELECT count(DISTINCT day) AS questions FROM p)
SELECT count(*) AS entities, any_value(questions) AS questions, count(*) * any_value(questions) AS grid, CAST(count(*) * any_value(questions) - sum(pairs) AS BIGINT) AS missing, CAST(sum(r) - sum(pairs) AS BIGINT) AS repeated, count(*) FILTER (pairs = questions) AS complete_entities, CAST(min(r) AS BIGINT) AS least_rows, CAST(max(r) AS BIGINT) AS most_rows FROM u, q""",
    "grid_gaps": "WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60) SELECT event_type, count(*) AS n_missing FROM (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM r) u, (SELECT DISTINCT event_type FROM r) t EXCEPT SELECT * FROM r) GROUP BY event_type",
    "small_cell_suppression": """WITH c AS (SELECT source, CASE WHEN n_chars > 20000 THEN 'huge' WHEN n_chars > 8000 THEN 'long' WHEN n_chars < 60 THEN 'tiny' ELSE 'usual' END AS band, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT *, n < 4 AS prim, count(*) FILTER (n < 4) OVER (PARTITION BY source) AS np, count(*) FILTER (n >= 4) OVER (PARTITION BY source) AS no FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY prim, n, band) AS turn FROM p)
SELECT source, band, CASE WHEN NOT (prim OR (np = 1 AND NOT prim AND turn = 1)) THEN n ELSE -1 END AS n, prim OR (np = 1 AND NOT prim AND turn = 1) AS hidden, np = 1 AND no = 0 AS exposed FROM r""",
    "filter_audit_reasons": f"SELECT doc_id, array_to_string({_POLICY}, ',') AS reasons FROM documents",
    "reason_histogram": f"SELECT reason, count(*) AS n FROM (SELECT unnest({_POLICY}) AS reason FROM documents) GROUP BY reason",
    "audited_selection": f"WITH r AS (SELECT doc_id, len({_POLICY}) AS n FROM documents), f AS (SELECT count(*) AS n_all, count(*) FILTER (n = 0) AS n_eligible FROM r) SELECT doc_id, sha256('select-1|' || doc_id) AS sample_hash, n_all, n_eligible FROM r, f WHERE n = 0 ORDER BY sample_hash LIMIT 25",
    "span_contiguity": """WITH e AS (SELECT conv_id, length(text) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations), s AS (SELECT conv_id, e - n AS start, e + CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END AS "end" FROM e),
b AS (SELECT *, lag("end") OVER (PARTITION BY conv_id ORDER BY start, "end") AS before FROM s), v AS (SELECT conv_id, start, "end", array_to_string(list_filter([CASE WHEN "end" <= start THEN 'empty' END, CASE WHEN "end" - start > 1500 THEN 'too_long' END, CASE WHEN before > start THEN 'overlap' END, CASE WHEN before < start THEN 'gap' END], lambda x: x IS NOT NULL), ',') AS violations FROM b)
SELECT * FROM v WHERE violations <> ''""",
    "split_leakage": f"""WITH m AS (SELECT doc_id, split, sha256(text) AS content FROM {_split('doc_id', 'documents')}), {_PAIRS}
SELECT 'entity' AS kind, doc_id::VARCHAR AS key, count(*) AS rows FROM m GROUP BY doc_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'content', content, count(*) FROM m GROUP BY content HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'near_duplicate', left_id || '|' || right_id, 2 FROM p JOIN m a ON a.doc_id = left_id JOIN m b ON b.doc_id = right_id WHERE similarity >= 0.35 AND a.split <> b.split""",
    "holdout_split": f"SELECT doc_id AS entity_id, split FROM {_split('doc_id', 'documents')}",
    "readiness_gaps": """WITH c AS (SELECT count(*) AS l, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (quality = 0) AS q FROM labels), g AS (SELECT list_filter([CASE WHEN l < 300 THEN 'labelled: ' || l || ' of 300' END, CASE WHEN t < 1000000000 THEN 'toxic: ' || t || ' of 1000000000' END, CASE WHEN q < 1000000000 THEN 'low_quality: ' || q || ' of 1000000000' END], lambda x: x IS NOT NULL) AS g FROM c)
SELECT array_to_string(g, '; ') AS gaps, len(g) = 0 AS ready FROM g""",
    "audit_checks": """WITH r AS (SELECT d.*, quality, toxic, NOT regexp_matches(text, '[*&$#%|]') AS clean FROM documents d LEFT JOIN labels USING (doc_id)), x AS (
  SELECT 'length_kept' AS "check", n_chars IS NOT NULL AS e, n_chars = length(text) AS p FROM r UNION ALL SELECT 'clean_is_good', quality IS NOT NULL AND clean, coalesce(quality = 1, false) FROM r UNION ALL SELECT 'short_is_not_toxic', quality IS NOT NULL AND length(text) < 500, coalesce(toxic = 0, false) FROM r)
SELECT "check", count(*) FILTER (e) AS evaluable, count(*) FILTER (e AND p) AS passed, count(*) FILTER (e AND NOT p) AS failed, count(*) FILTER (NOT e) AS not_evaluable FROM x GROUP BY "check" """,
    "definition_drift": "WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 5), n AS (SELECT p_partkey, p_brand, CASE WHEN p_retailprice > 1000 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size < 45), j AS (SELECT CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_brand IS DISTINCT FROM n.p_brand OR o.p_size IS DISTINCT FROM n.p_size THEN 'changed' END AS change FROM o FULL JOIN n ON o.p_partkey = n.p_partkey) SELECT change, count(*) AS n FROM j WHERE change IS NOT NULL GROUP BY change",
    "identifiers": "SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || doc_id), 1, 16) AS record_id, sha256(text) AS content_sha256 FROM documents",
    "hash_sample": "SELECT doc_id, lang, sha256('sample-1|' || doc_id) AS sample_hash FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('sample-1|' || doc_id)) <= 5",
    "largest_remainder": """WITH c AS (SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1), e AS (SELECT *, 101.0::DOUBLE * n / (sum(n) OVER ()) AS x FROM c), f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, c_mktsegment) AS turn FROM e)
SELECT c_mktsegment, n, CAST(fl + CASE WHEN turn <= 101 - (sum(fl) OVER ()) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f""",
    "prevalence_balance": f"WITH {_BAL} SELECT lang, coalesce(split, '(all)') AS split, count(*) AS n, count(*) FILTER (quality = 1) AS positives, round((count(*) FILTER (quality = 1))::DOUBLE / count(*), 6) AS prevalence FROM b GROUP BY GROUPING SETS ((lang, split), (lang))",
    "prevalence_deviation": f"""WITH {_BAL}, s AS (SELECT lang, split, count(*) FILTER (quality = 1) AS p, round((count(*) FILTER (quality = 1))::DOUBLE / count(*), 6) AS v FROM b GROUP BY ALL), w AS (SELECT lang, round((count(*) FILTER (quality = 1))::DOUBLE / count(*), 6) AS w FROM b GROUP BY ALL)
SELECT lang, round(avg(abs(v - w)), 6) AS mean_deviation, round(max(abs(v - w)), 6) AS max_deviation, count(*) FILTER (p = 0) AS zero_splits FROM s JOIN w USING (lang) GROUP BY lang""",
    "calibration_reserve": f"SELECT doc_id AS entity_id, CASE WHEN row_number() OVER (ORDER BY sha256('calibrate-1|' || doc_id)) <= 30 THEN 'calibration' ELSE 'fit' END AS part FROM {_split('doc_id', 'documents')} WHERE split = 'train'",
    "vector_pooling": """WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT label, e, sqrt(list_inner_product(e, e)) AS n FROM u), x AS (SELECT label, unnest(range(len(e)::BIGINT)) AS pos, unnest(list_transform(e, lambda v: v / n)) AS v FROM n), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY ALL)
SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 9) AS x FROM m""",
    "cosine_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.35",
    "cross_split_pairs": f"WITH {_PAIRS}, s AS (SELECT vec_id, split FROM {_split('vec_id', 'embeddings')}) SELECT left_id, right_id, round(similarity, 6) AS similarity FROM p JOIN s a ON a.vec_id = left_id JOIN s b ON b.vec_id = right_id WHERE similarity >= 0.35 AND a.split <> b.split",
    "components": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT left_id AS x, right_id AS y FROM p WHERE similarity >= 0.8 UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM documents), s AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r AS (SELECT x, x AS y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x) SELECT x AS node, min(y) AS root FROM r GROUP BY x""",
}
