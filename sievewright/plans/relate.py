"""Relational breadth over the star schema, and event-time windows as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as v
from ..operators import policy as p
from ..operators import relational as r
from ..session import table
from ..streaming import windows as w

TYPES = ("click", "error", "purchase", "signup", "view")


def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("total"))
    return r.wide(sums, ["user_id"], "event_type", "total", TYPES).na.fill(0.0)


def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.long(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"], "measure", "value")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ("de", "en", "es", "fr"))


def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", 0.5).alias("median"))


def rollup_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return sums.select(F.coalesce("n_name", F.lit("(all)")).alias("n_name"), F.coalesce("c_mktsegment", F.lit("(all)")).alias("c_mktsegment"), "n", "balance")


def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return sums.select(F.coalesce("o_orderstatus", F.lit("(all)")).alias("o_orderstatus"), F.coalesce("o_orderpriority", F.lit("(all)")).alias("o_orderpriority"), "n", "mean_price")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(paid), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("mean_discount"), F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; region, nation and the filtered suppliers are small enough for the planner to send around."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, n: df.withColumn("op", F.lit(n))
    found = named(c.intersect(s), "intersect").unionByName(named(c.subtract(s), "except")).unionByName(named(c.union(s).distinct(), "union")).unionByName(named(c.intersectAll(s), "intersect_all")).unionByName(named(c.exceptAll(s), "except_all"))
    return found.groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    on = F.col("c_custkey") == F.col("o_custkey")
    with_, without = c.join(o, on, "left_semi").withColumn("kind", F.lit("with")), c.join(o, on, "left_anti").withColumn("kind", F.lit("without"))
    return with_.unionByName(without).groupBy("kind", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after an error of the same user."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    purchases = e.where("event_type = 'purchase'").select("user_id", "event_id", "s")
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("s").alias("start"), (F.col("s") + 3600).alias("end"))
    return r.range_join(purchases, errors, "s", "start", "end", 3600.0, ["user_id"]).select("user_id", "event_id", "error_id")


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = r.as_of_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "value", "event_id")
    return found.select("user_id", "event_id", F.coalesce("asof_value", F.lit(-1.0)).alias("asof_value"))


def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.sum(value).over(order.rowsBetween(-2, 0)), 4).alias("last_three"), F.round(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total_so_far"),
        F.coalesce(F.lag("event_type").over(order), F.lit("")).alias("before"), F.ntile(4).over(order).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind_rank"),
    )


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy((k % 10).cast("long").alias("digit")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(k).cast("long").alias("largest"))


def best_worst_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.extremes(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id")


def discrete_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("junk", F.col("text").rlike(r"[*&$#%|]"))
    return r.mutual_information(rows, "junk", "quality").select("n", F.round("mi", 9).alias("mi"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.class_weights(table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 9))


def bottleneck_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of neighbouring vectors' softmaxes less their distance, best and worst by label."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", v.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    before = F.lag("p").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = e.withColumn("q", before).where("q is not null")
    score = r.information_bottleneck(v.kl_divergence(F.col("p"), F.col("q")), 1 - v.cosine(F.col("p"), F.col("q")), 0.5)
    found = r.extremes(rows.withColumn("score", F.round(score, 9)), ["label"], "score", "vec_id")
    return found.select("label", "kind", F.col("item").alias("vec_id"), "score")


def training_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cited = F.when(F.length("text") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    status = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "present").otherwise("absent")
    counts = rows.select("lang", p.training_bucket(status, F.col("source") == "src0", cited).alias("bucket")).rollup("lang", "bucket").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("lang", F.lit("(all)")).alias("lang"), F.coalesce("bucket", F.lit("(all)")).alias("bucket"), "n")


def _windowed(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = w.tumbling(table(spark, sf_dir, "events"), "6 hours")
    return _windowed(found).withColumn("total", F.round("total", 4))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(w.sliding(table(spark, sf_dir, "events"), "12 hours", "6 hours"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = w.sessions(table(spark, sf_dir, "events"), "4 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    pivot_wide, unpivot_long, crosstab, grouped_summary, rollup_balance, cube_orders, pricing_summary, nation_revenue, set_ops, semi_anti, range_join, asof_join, window_frames, json_props, best_worst_by_group,
    discrete_mi, class_weights, bottleneck_scores, training_buckets, tumbling_counts, sliding_counts, session_counts,
)}

_SOFT = "list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))"
ORACLES = {
    "pivot_wide": "SELECT user_id, " + ", ".join(f"coalesce(round(sum(value) FILTER (event_type = '{t}'), 2), 0) AS {t}" for t in TYPES) + " FROM events GROUP BY user_id",
    "unpivot_long": "SELECT p_partkey, 'size' AS measure, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    "crosstab": "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source",
    "grouped_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type",
    "rollup_balance": "SELECT coalesce(n_name, '(all)') AS n_name, coalesce(c_mktsegment, '(all)') AS c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
    "cube_orders": "SELECT coalesce(o_orderstatus, '(all)') AS o_orderstatus, coalesce(o_orderpriority, '(all)') AS o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL",
    "nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "set_ops": "WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier), a AS (SELECT 'intersect' AS op, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'union', k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect_all', k FROM (SELECT k FROM c INTERSECT ALL SELECT k FROM s) UNION ALL SELECT 'except_all', k FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)) SELECT op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM a GROUP BY op",
    "semi_anti": "WITH x AS (SELECT *, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'with' ELSE 'without' END AS kind FROM customer) SELECT kind, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM x GROUP BY ALL",
    "range_join": "SELECT p.user_id, p.event_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND p.ts >= e.ts AND p.ts < e.ts + INTERVAL 1 HOUR",
    "asof_join": "SELECT p.user_id, p.event_id, coalesce(v.value, -1) AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "window_frames": "SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total_so_far, coalesce(lag(event_type) OVER w, '') AS before, CAST(ntile(4) OVER w AS INTEGER) AS quarter, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS kind_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "json_props": "WITH e AS (SELECT value, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT k % 10 AS digit, count(*) AS n, round(sum(value), 4) AS total, max(k) AS largest FROM e GROUP BY 1",
    "best_worst_by_group": "SELECT user_id, 'best' AS kind, event_id AS item, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 UNION ALL SELECT user_id, 'worst', event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1",
    "discrete_mi": "WITH r AS (SELECT regexp_matches(text, '[*&$#%|]') AS a, quality AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM r GROUP BY ALL), m AS (SELECT *, (sum(n) OVER (PARTITION BY a))::DOUBLE AS na, (sum(n) OVER (PARTITION BY b))::DOUBLE AS nb, (sum(n) OVER ())::DOUBLE AS t FROM c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n / t * ln(n * t / (na * nb))), 9) AS mi FROM m",
    "class_weights": "SELECT quality, count(*) AS n, round((sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight FROM labels GROUP BY quality",
    "bottleneck_scores": f"""WITH s AS (SELECT label, vec_id, {_SOFT} AS e FROM embeddings), p AS (SELECT label, vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s), q AS (SELECT *, lag(p) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM p),
z AS (SELECT label, vec_id, round(list_sum(list_transform(list_zip(p, q), lambda x: x[1] * ln(x[1] / greatest(x[2], 1e-12)))) - 0.5::DOUBLE * (1 - list_cosine_similarity(p, q)), 9) AS score FROM q WHERE q IS NOT NULL)
SELECT label, 'best' AS kind, vec_id, score FROM z QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1 UNION ALL SELECT label, 'worst', vec_id, score FROM z QUALIFY row_number() OVER (PARTITION BY label ORDER BY score, vec_id) = 1""",
    "training_buckets": "WITH r AS (SELECT lang, CASE WHEN toxic = 1 THEN 'unknown' WHEN source = 'src0' THEN 'default_absent' WHEN length(text) % 6 = 0 THEN 'excluded_uncited' WHEN quality = 1 THEN 'silver_present' ELSE 'silver_absent' END AS bucket FROM documents JOIN labels USING (doc_id)) SELECT coalesce(lang, '(all)') AS lang, coalesce(bucket, '(all)') AS bucket, count(*) AS n FROM r GROUP BY ROLLUP (lang, bucket)",
    "tumbling_counts": "WITH b AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY s, event_type",
    "sliding_counts": "WITH b AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS s FROM events, (VALUES (0), (1)) v(k)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, count(*) AS n, max(value) AS most FROM b GROUP BY s, event_type",
    "session_counts": "WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k",
}
