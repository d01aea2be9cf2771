"""Join, comparison and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators import compare
from heapstone.operators import timeline as t
from heapstone.plans.base import EVENTS, cents, events, query, table

WEEK = 604_800_000_000
DAY = 86_400_000_000

_SPAN = f"""m AS (SELECT min(us) AS lo, max(us) AS hi FROM {EVENTS}), w AS (SELECT k::BIGINT AS window_id, (lo + k * {WEEK})::BIGINT AS w_lo, (lo + k * {WEEK} + 3 * {DAY})::BIGINT AS w_hi FROM m, range(0, 1000) r(k) WHERE lo + k * {WEEK} <= hi)"""


def _windows(rows: DataFrame) -> DataFrame:
    bounds = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).where("lo IS NOT NULL")
    return bounds.select(F.posexplode(F.sequence(F.col("lo"), F.col("hi"), F.lit(WEEK))).alias("window_id", "w_lo")).select(F.col("window_id").cast("long").alias("window_id"), "w_lo", (F.col("w_lo") + 3 * DAY).alias("w_hi"))


@query(f"""WITH {_SPAN} SELECT window_id, count(*) AS n, sum(cents)::BIGINT AS cents FROM {EVENTS} JOIN w ON us <= w_hi + 250000 AND us + cents * 1000000 >= w_lo - 250000 GROUP BY window_id""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (as intervals) in a three-day window of each week from the first event to the last, with 250 ms slack; dealt to cells of a day."""
    rows = events(spark, sf_dir)
    spans = rows.withColumn("e", F.col("us") + F.col("cents") * 1_000_000)
    joined = t.overlap_join(spans, F.broadcast(_windows(rows)), "us", "e", "w_lo", "w_hi", 250_000, DAY)
    return joined.groupBy("window_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""WITH a AS (SELECT user_id, event_id, us FROM {EVENTS} WHERE event_type = 'error'), b AS (SELECT user_id, event_id AS other_id, us AS t FROM {EVENTS} WHERE event_type = 'purchase'),
 p AS (SELECT a.user_id, event_id, other_id, abs(t - us) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - us), other_id) AS r FROM a JOIN b ON a.user_id = b.user_id AND abs(t - us) <= {DAY})
 SELECT user_id, event_id, other_id, gap FROM p WHERE r = 1""")
def nearest_gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the nearest purchase of the same thread, before or after, within a day."""
    rows = events(spark, sf_dir)
    right = rows.where("event_type = 'purchase'").select("user_id", "us", F.col("event_id").alias("other_id"))
    return t.nearest_gap(rows.where("event_type = 'error'"), right, ["user_id"], "us", "us", "event_id", "other_id", DAY)


@query("""WITH w AS (SELECT l_partkey AS monitor, count(*) AS waiters, count(*) FILTER (l_returnflag = 'R') AS blocked FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING count(*) >= 2),
 o AS (SELECT l_partkey AS monitor, l_suppkey AS owner FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem WHERE l_linestatus = 'F') WHERE r = 1)
 SELECT monitor, waiters, blocked, owner, s_name AS owner_name FROM w LEFT JOIN o USING (monitor) LEFT JOIN supplier ON s_suppkey = owner""")
def waiter_owner_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors with two waiters or more, and their first owner."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("monitor"), "l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    waiters = lines.where("l_linestatus = 'O'").groupBy("monitor").agg(F.count("*").alias("waiters"), F.count_if(F.col("l_returnflag") == "R").alias("blocked")).where("waiters >= 2")
    owners = lines.where("l_linestatus = 'F'").groupBy("monitor").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("o")).select("monitor", F.col("o.l_suppkey").alias("owner"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("owner_name"))
    return waiters.join(owners, "monitor", "left").join(names, "owner", "left").select("monitor", "waiters", "blocked", "owner", "owner_name")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", cents("l_extendedprice").alias("c"), "l_shipdate")
    part = lambda c: rows.where(c).groupBy("l_partkey").agg(F.sum("c").alias("bytes"), F.count("*").alias("instances"))
    return part("l_shipdate >= TIMESTAMP_NTZ'1998-07-01 00:00:00'"), part("l_shipdate < TIMESTAMP_NTZ'1998-07-01 00:00:00'")


_HALVES = """c AS (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS bytes, count(*) AS instances FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01' GROUP BY 1),
 b AS (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS bytes, count(*) AS instances FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1)"""


@query(f"""WITH {_HALVES} SELECT l_partkey, c.bytes AS current_bytes, coalesce(b.bytes, 0) AS baseline_bytes, c.bytes - coalesce(b.bytes, 0) AS delta_bytes,
 c.instances AS current_instances, coalesce(b.instances, 0) AS baseline_instances, c.instances - coalesce(b.instances, 0) AS delta_instances FROM c LEFT JOIN b USING (l_partkey)""")
def baseline_left_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth by class over the baseline; classes only in the baseline don't show."""
    return compare.keyed_delta(*_halves(spark, sf_dir), ["l_partkey"], ["bytes", "instances"])


@query(f"""WITH {_HALVES} SELECT coalesce(c.l_partkey, b.l_partkey) AS l_partkey, coalesce(c.bytes, 0) AS current_bytes, coalesce(b.bytes, 0) AS baseline_bytes, coalesce(c.bytes, 0) - coalesce(b.bytes, 0) AS delta_bytes
 FROM c FULL JOIN b ON c.l_partkey = b.l_partkey""")
def full_outer_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change by key over the union of both sides' keys."""
    return compare.keyed_delta(*_halves(spark, sf_dir), ["l_partkey"], ["bytes"], outer=True)


_HALF_EVENTS = f"""m AS (SELECT min(us) + (max(us) - min(us)) // 2 AS mid, (max(us) - min(us)) / 2.0::DOUBLE / 60000000.0 AS minutes FROM {EVENTS}),
 s AS (SELECT event_type, us >= mid AS cur, count(*) AS n, sum(cents)::BIGINT AS c FROM {EVENTS}, m GROUP BY ALL),
 r AS (SELECT event_type, cur, n, c, n / minutes AS rate, 100.0::DOUBLE * c / (sum(c) OVER (PARTITION BY cur))::DOUBLE AS share, c * 1000.0::DOUBLE / (minutes * 60.0) AS bps FROM s, m)"""


@query(f"""WITH {_HALF_EVENTS} SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS current_n, coalesce(b.n, 0) AS baseline_n,
 round(greatest(0.0, coalesce(a.rate, 0) - coalesce(b.rate, 0)) + 2 * greatest(0.0, coalesce(a.share, 0) - coalesce(b.share, 0)) + greatest(0.0, coalesce(a.bps, 0) - coalesce(b.bps, 0)) / 1e6, 6) AS score
 FROM (SELECT * FROM r WHERE cur) a FULL JOIN (SELECT * FROM r WHERE NOT cur) b ON a.event_type = b.event_type""")
def regression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second half of the events against the first, by cause: rate, duration share and bytes, each rise counted."""
    rows = events(spark, sf_dir)
    span = rows.agg((F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).alias("mid"), ((F.max("us") - F.min("us")) / F.lit(2.0) / 60_000_000.0).alias("minutes"))
    sides = rows.crossJoin(F.broadcast(span)).groupBy("event_type", (F.col("us") >= F.col("mid")).alias("cur"), "minutes").agg(F.count("*").alias("n"), F.sum("cents").alias("c"))
    totals = sides.groupBy("cur").agg(F.sum("c").alias("all"))
    rated = sides.join(F.broadcast(totals), "cur").select("event_type", "cur", "n", (F.col("n") / F.col("minutes")).alias("rate"), (100.0 * F.col("c") / F.col("all")).alias("share"), (F.col("c") * 1000.0 / (F.col("minutes") * 60.0)).alias("bps"))
    d = compare.keyed_delta(rated.where("cur"), rated.where("NOT cur"), ["event_type"], ["n", "rate", "share", "bps"], outer=True)
    score = compare.regression_score(F.col("delta_rate"), F.col("delta_share"), F.col("delta_bps"))
    return d.select("event_type", "current_n", "baseline_n", F.round(score, 6).alias("score"))


@query("""WITH s AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month_no, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c FROM orders GROUP BY 1)
 SELECT month_no, n, c, n - lag(n) OVER w AS step_n, c - lag(c) OVER w AS step_c, n - first(n) OVER w AS since_first_n, c - first(c) OVER w AS since_first_c FROM s WINDOW w AS (ORDER BY month_no)""")
def pairwise_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly snapshots: change from the one before and from the first."""
    months = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month_no")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("c"))
    return compare.pairwise(months, [], "month_no", ["n", "c"])


@query("""SELECT DISTINCT lower(trim(n_name)) AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def normalized_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, trimmed and in lower case, on both sides."""
    nations = table(spark, sf_dir, "nation")
    side = lambda name, key, where="true": table(spark, sf_dir, name).where(where).join(nations, F.col(key) == F.col("n_nationkey")).select(F.lower(F.trim("n_name")).alias("name")).distinct()
    return side("customer", "c_nationkey").join(side("supplier", "s_nationkey", "s_acctbal > 5000"), "name", "left_semi")


@query("""SELECT o_orderkey AS id, 'order' AS kind, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c FROM orders GROUP BY 1
 UNION ALL SELECT l_orderkey, 'line', count(*), sum(round(l_extendedprice * 100)::BIGINT)::BIGINT FROM lineitem GROUP BY 1""")
def cogroup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several event lists under one id, by kind; all ids."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), cents("o_totalprice").alias("v"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"), cents("l_extendedprice").alias("v"))
    return orders.unionByName(lines).groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum("v").alias("c"))


_TYPE_WINDOWS = f"""t AS (SELECT user_id, event_type, min(us) AS lo, max(us) AS hi FROM {EVENTS} WHERE value > 60 GROUP BY ALL)"""


@query(f"""WITH {_TYPE_WINDOWS}, p AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi, greatest(b.lo - a.hi, a.lo - b.hi) AS gap
  FROM (SELECT * FROM t WHERE event_type = 'error') a FULL JOIN (SELECT * FROM t WHERE event_type = 'purchase') b ON a.user_id = b.user_id)
 SELECT user_id, CASE WHEN a_lo IS NULL OR b_lo IS NULL THEN 'NO_SHARED_CLOCK' WHEN gap <= 0 THEN 'ABSOLUTE_OVERLAP' WHEN gap <= 15 * {DAY // 24} THEN 'ABSOLUTE_SEQUENCE_NEARBY' ELSE 'ABSOLUTE_NO_OVERLAP' END AS status,
 CASE WHEN a_lo IS NULL OR b_lo IS NULL THEN 35 WHEN gap <= 0 THEN 78 WHEN gap <= 15 * {DAY // 24} THEN 68 ELSE 60 END AS score FROM p""")
def time_alignment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the windows of slow errors and slow purchases of each thread stand to each other, with a tolerance of 15 hours."""
    windows = events(spark, sf_dir).where("value > 60").groupBy("user_id", "event_type").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    side = lambda kind, p: windows.where(F.col("event_type") == kind).select("user_id", F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    pairs = side("error", "a").join(side("purchase", "b"), "user_id", "full_outer")
    status, score = compare.alignment(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), 15 * DAY // 24)
    return pairs.select("user_id", status.alias("status"), score.alias("score"))


@query(f"""WITH b AS (SELECT user_id, min(us) AS lo FROM {EVENTS} GROUP BY 1) SELECT event_id, round((us - lo) / 1000000.0::DOUBLE, 6) AS elapsed_s, lo + round((us - lo) / 1000000.0::DOUBLE * 1000000)::BIGINT AS anchored_us FROM {EVENTS} JOIN b USING (user_id)""")
def elapsed_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since each thread's start, and the wall time they are anchored to."""
    rows = events(spark, sf_dir)
    joined = rows.join(rows.groupBy("user_id").agg(F.min("us").alias("lo")), "user_id").withColumn("e", (F.col("us") - F.col("lo")) / F.lit(1_000_000.0))
    return joined.select("event_id", F.round("e", 6).alias("elapsed_s"), compare.anchored(F.col("e"), F.col("lo")).alias("anchored_us"))


@query(f"""WITH f AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, list_sort(list_distinct(list((cents % 7)::BIGINT))) AS locks FROM {EVENTS} WHERE value > 40 GROUP BY 1),
 g AS (SELECT kinds, locks, min(user_id) AS id, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(a.kinds, b.kinds)) AS k, len(list_intersect(a.locks, b.locks)) AS l FROM g a JOIN g b ON a.id < b.id OR (a.id = b.id AND a.n > 1))
 SELECT 'pair' AS relation, a_id, b_id, (60 + least(12, 6 * k) + least(8, 4 * l))::INT AS score FROM p WHERE k > 0 UNION ALL SELECT 'member', id, user_id, NULL FROM f JOIN g USING (kinds, locks)""")
def signal_alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures (kinds and locks of a thread) that share a kind: a base score, more for each shared kind and lock, capped.

    Rows with relation 'pair' score two signatures, a_id not above b_id; a signature with itself where several threads bear it. A signature's
    id is the smallest user_id that bears it. Rows with relation 'member' name a signature (a_id) and a thread that bears it (b_id), for every
    thread, without a score. Two threads score as their signatures do, so the pairs don't grow with the threads.
    """
    sets = F.array_sort(F.collect_set("event_type")).alias("kinds"), F.array_sort(F.collect_set(F.col("cents") % 7)).alias("locks")
    families = events(spark, sf_dir).where("value > 40").groupBy("user_id").agg(*sets)
    signatures = families.groupBy("kinds", "locks").agg(F.min("user_id").alias("id"), F.count("*").alias("n"))
    members = families.join(signatures, ["kinds", "locks"]).select(F.lit("member").alias("relation"), F.col("id").alias("a_id"), F.col("user_id").alias("b_id"), F.lit(None).cast("int").alias("score"))
    a, b = (signatures.select(F.explode("kinds").alias("kind"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "kinds", "locks"))) for p in "ab")
    shared = F.array_intersect("a_kinds", "b_kinds")
    k, l = F.size(shared), F.size(F.array_intersect("a_locks", "b_locks"))  # noqa: E741
    score = (F.lit(60) + F.least(F.lit(12), 6 * k) + F.least(F.lit(8), 4 * l)).cast("int")
    once = (F.col("a_id") < F.col("b_id")) | ((F.col("a_id") == F.col("b_id")) & (F.col("a_n") > 1))
    pairs = a.join(b, "kind").where(once).where(F.col("kind") == F.element_at(shared, 1)).select(F.lit("pair").alias("relation"), "a_id", "b_id", score.alias("score"))
    return pairs.unionByName(members)
