"""Aggregation, ranking and set queries. Events stand for pauses: event_type is the cause, value the milliseconds, user_id the thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators.ordered import nearest_rank, running_total, value_slices
from heapstone.operators.ranking import counts_in_order, dominant, first_wins, ratio, top_rows
from heapstone.operators.ranking import ranked_share as ranked
from heapstone.plans.base import EVENTS, cents, events, query, table


@query(f"""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max_value, count(*) AS n,
 sum(cents)::BIGINT / 100.0::DOUBLE AS total FROM {EVENTS} WHERE value > 0 GROUP BY event_type""")
def pause_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of positive pauses by cause, with count, total and maximum."""
    pauses = events(spark, sf_dir).where("value > 0")
    ranks = nearest_rank(pauses, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    sums = pauses.groupBy("event_type").agg(F.max("value").alias("max_value"), F.count("*").alias("n"), (F.sum("cents") / F.lit(100.0)).alias("total"))
    return ranks.join(sums, "event_type")


@query(f"""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {EVENTS})
 WHERE r = ceil(0.95::DOUBLE * n)""")
def percentile_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event at the nearest-rank 95th percentile of each cause."""
    rows = events(spark, sf_dir).select("event_type", "event_id", "value", F.lit(1).alias("one"))
    numbered = running_total(rows, ["event_type"], ["value", "event_id"], "one", "r", value_slices(rows, "value"))
    totals = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    return numbered.join(totals, "event_type").where(F.col("r") == F.ceil(0.95 * F.col("n"))).select("event_type", "event_id", "value")


@query(f"""SELECT user_id, count(*) AS n, sum(cents)::BIGINT AS total_cents, max(value) AS max_value, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS causes
 FROM {EVENTS} GROUP BY user_id""")
def cause_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, totals and maxima by thread."""
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("cents").alias("total_cents"), F.max("value").alias("max_value"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("causes")
    )


@query("""SELECT l_suppkey, l_returnflag, amount FROM (
 SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY amount DESC, seen, l_returnflag) AS r FROM (
  SELECT l_suppkey, l_returnflag, count(*) AS amount, min(l_orderkey * 8 + l_linenumber) AS seen FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def dominant_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent return flag of each supplier; ties go to the one seen first."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seen"))
    return dominant(lines, ["l_suppkey"], "l_returnflag", F.lit(1).cast("long"), "seen")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount >= 0.085) AS high, count(*) FILTER (l_discount >= 0.095) AS near_capacity,
 coalesce(sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_discount >= 0.085), 0)::BIGINT AS high_cents, max(l_quantity) FILTER (l_discount >= 0.095) AS peak_quantity FROM lineitem GROUP BY l_returnflag""")
def conditional_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and sums in one pass: retained (0.085 and up) and near capacity (0.095 and up)."""
    high, near = F.col("l_discount") >= 0.085, F.col("l_discount") >= 0.095
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_quantity", cents("l_extendedprice").alias("c"))
    return lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(high).alias("high"), F.count_if(near).alias("near_capacity"), F.coalesce(F.sum(F.when(high, F.col("c"))), F.lit(0)).alias("high_cents"), F.max(F.when(near, F.col("l_quantity"))).alias("peak_quantity")
    )


@query(f"""SELECT user_id, n, n / (SELECT count(*) FROM events)::DOUBLE AS share, true AS more_available FROM (SELECT user_id, count(*) AS n FROM {EVENTS} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10)""")
def ranked_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten busiest threads, their share, and whether more exist."""
    return ranked(events(spark, sf_dir), "user_id", 10)


@query("""WITH t AS (SELECT l_partkey, count(*) AS n, sum(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY 1)
 SELECT l_partkey, n, n / (SELECT sum(n) FROM t)::DOUBLE AS share, total, total / (SELECT sum(total) FROM t)::DOUBLE AS total_share, (SELECT count(*) FROM t) > 8 AS more_available FROM t ORDER BY n DESC, total DESC, l_partkey LIMIT 8""")
def ranked_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by count, then quantity, with both shares: the eight largest."""
    return ranked(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), "l_partkey", 8, "l_quantity")


@query("""SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE p_retailprice > 0) > 10 AS more_available FROM part WHERE p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def topk_with_more_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest positive sizes, and whether there are more."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    more = parts.where("p_retailprice > 0").agg((F.count("*") > 10).alias("more_available"))
    return top_rows(parts, [F.desc("p_retailprice"), F.asc("p_partkey")], 10, "p_retailprice").crossJoin(F.broadcast(more))


@query("""WITH c AS (SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS size_kb, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END)::BIGINT AS rss_kb FROM part GROUP BY 1)
 SELECT p_type, n, size_kb, rss_kb, CASE WHEN size_kb > 0 THEN rss_kb / size_kb::DOUBLE ELSE 0.0 END AS resident_ratio, greatest(0, size_kb - rss_kb) AS reserved_gap_kb FROM c""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, resident size, ratio and gap by category."""
    sums = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size_kb"), F.sum(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)).alias("rss_kb"))
    return sums.select("*", ratio(F.col("rss_kb"), F.col("size_kb")).alias("resident_ratio"), F.greatest(F.lit(0), F.col("size_kb") - F.col("rss_kb")).alias("reserved_gap_kb"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN 'collection' WHEN lower(p_name) LIKE '%bolt%' THEN 'reference' WHEN regexp_matches(lower(p_name), '(gear|plate)$') THEN 'payload' ELSE 'other' END AS family,
 lower(p_name) LIKE '%small%' AS is_small, regexp_matches(lower(p_name), '^(red|blue) ') AS is_coloured FROM part""")
def family_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching family and independent flags from a name."""
    name = F.lower("p_name")
    family = F.when(name.contains("ring"), "collection").when(name.contains("bolt"), "reference").when(name.rlike("(gear|plate)$"), "payload").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), name.contains("small").alias("is_small"), name.rlike("^(red|blue) ").alias("is_coloured"))


@query("""SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderstatus)::INT AS place FROM orders GROUP BY o_orderstatus""")
def state_counts_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of states in a preferred order, others behind by name."""
    return counts_in_order(table(spark, sf_dir, "orders"), "o_orderstatus", ["P", "O"])


@query(f"""SELECT user_id % 20 AS pool, count(*) AS threads, count(*) FILTER (event_type = 'view') AS runnable, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type = 'click') AS waiting,
 count(*) FILTER (event_type = 'error' OR (event_type = 'click' AND value >= 10)) AS stalled FROM {EVENTS} GROUP BY 1""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each pool; stalled are the blocked and the waiting that aren't idle."""
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("pool")).agg(
        F.count("*").alias("threads"), F.count_if(kind == "view").alias("runnable"), F.count_if(kind == "error").alias("blocked"), F.count_if(kind == "click").alias("waiting"), F.count_if((kind == "error") | ((kind == "click") & (F.col("value") >= 10))).alias("stalled")
    )


@query(f"""SELECT event_id, event_type, value, list FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY list) AS r FROM (
 SELECT event_id, event_type, value, 0 AS list FROM {EVENTS} WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, value, 1 FROM {EVENTS} WHERE value >= 50 UNION ALL SELECT event_id, event_type, value, 2 FROM {EVENTS} WHERE user_id % 10 = 0)) WHERE r = 1""")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distress events: three overlapping lists joined, the first list that has an event wins."""
    rows = events(spark, sf_dir)
    lists = [rows.where(c).select("event_id", "event_type", "value", F.lit(k).alias("list")) for k, c in enumerate(("event_type = 'error'", "value >= 50", "user_id % 10 = 0"))]
    return first_wins(lists, ["event_id"], ["event_id"])


@query("""SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS place FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) QUALIFY place = 1""")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each source that has not been seen."""
    unseen = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return unseen.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", F.lit(1).cast("long").alias("place"))


@query(f"""SELECT event_id, try_cast(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k, coalesce(try_cast(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT), 0) >= 50 AS large FROM {EVENTS}""")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric field of a JSON column; absent counts as 0 where it is used."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, sf_dir).select("event_id", k.alias("k"), (F.coalesce(k, F.lit(0)) >= 50).alias("large"))


@query(f"""WITH m AS (SELECT min(us) AS lo FROM {EVENTS}), w AS (SELECT e.*, (us - lo) // 3600000000 AS hour FROM {EVENTS}, m)
 SELECT hour, count(*) AS pauses, count(*) FILTER (event_type = 'error') AS failures, sum(cents)::BIGINT AS pause_cents, max(value) AS max_value, round(100.0::DOUBLE * sum(cents)::BIGINT / 100.0 / 3600000.0, 9) AS overhead_pct FROM w GROUP BY hour""")
def stw_overhead_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, totals and the share of paused time in each hour since the start."""
    rows = events(spark, sf_dir)
    start = rows.agg(F.min("us").alias("lo"))
    hours = rows.crossJoin(F.broadcast(start)).withColumn("hour", F.floor((F.col("us") - F.col("lo")) / 3_600_000_000))
    return hours.groupBy("hour").agg(
        F.count("*").alias("pauses"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("cents").alias("pause_cents"), F.max("value").alias("max_value"), F.round(F.lit(100.0) * F.sum("cents") / 100.0 / 3_600_000.0, 9).alias("overhead_pct")
    )


@query(f"""WITH t AS (SELECT event_type, user_id, count(*) AS n, sum(cents)::BIGINT AS total, max(value) AS max_value FROM {EVENTS} WHERE event_type LIKE '%err%' GROUP BY ALL)
 SELECT event_type, user_id, n, total, max_value, n / (sum(n) OVER ())::DOUBLE AS share FROM t QUALIFY row_number() OVER (ORDER BY n DESC, total DESC, user_id) <= 8""")
def jfr_like_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A focused slice: events whose type contains a text, ranked by thread, with shares."""
    totals = events(spark, sf_dir).where(F.lower("event_type").contains("err")).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.max("value").alias("max_value"))
    overall = totals.agg(F.sum("n").alias("_all"))
    return totals.orderBy(F.desc("n"), F.desc("total"), "user_id").limit(8).crossJoin(F.broadcast(overall)).select("event_type", "user_id", "n", "total", "max_value", (F.col("n") / F.col("_all")).alias("share"))


@query("""SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents,
 min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY ALL""")
def trend_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total, first and last of each key and year."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderkey", cents("o_totalprice").alias("c"))
    return rows.groupBy("y", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("c").alias("total_cents"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
