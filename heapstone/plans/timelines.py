"""Queries on ordered events: clusters, streaks, windows, representatives, each within a thread (user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators import sliced, sweep
from heapstone.operators import timeline as t
from heapstone.plans.base import EVENTS, events, query

#: Ten hours on the clock, or no line at all: the data's own density, see the tables' notes.
GAP_US, LINE_GAP = 36_000_000_000, 60

_ORDER = "PARTITION BY user_id ORDER BY CASE WHEN event_id > 0 THEN 0 ELSE 1 END, coalesce(event_id, 0), us"
_CLUSTERS = f"""SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (
 SELECT *, coalesce(NOT (us - lag(us) OVER w <= {GAP_US} OR coalesce(event_id, 0) - coalesce(lag(event_id) OVER w, 0) <= {LINE_GAP}) AND lag(us) OVER w IS NOT NULL, false) AS brk
 FROM {EVENTS} WINDOW w AS ({_ORDER}))"""


@query(f"SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_line, max(event_id) AS last_line, sum(cents)::BIGINT AS cents FROM ({_CLUSTERS}) GROUP BY user_id, cluster")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a thread's events by clock gap or line gap; events without a line number come last."""
    found = t.gap_clusters(events(spark, sf_dir), ["user_id"], "us", "event_id", GAP_US, LINE_GAP)
    return found.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_line"), F.max("event_id").alias("last_line"), F.sum("cents").alias("cents"))


@query(f"SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_line, max(event_id) AS last_line, sum(cents)::BIGINT AS cents FROM ({_CLUSTERS}) GROUP BY user_id, cluster")
def sliced_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters, each thread cut into slices of a thousand lines that tasks share."""
    found = sliced.gap_clusters(events(spark, sf_dir), ["user_id"], "us", "event_id", GAP_US, LINE_GAP, sliced.by_lines("event_id", 1000))
    return found.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_line"), F.max("event_id").alias("last_line"), F.sum("cents").alias("cents"))


@query(f"""WITH r AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY us, event_id) AS run FROM {EVENTS}),
 l AS (SELECT user_id, f, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(CASE WHEN f THEN n ELSE 0 END) AS streak FROM l GROUP BY user_id""")
def sliced_max_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of errors of each thread, by slices of a day."""
    return sliced.longest_streak(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_type") == "error", F.floor(F.col("us") / 86_400_000_000))


@query(f"""SELECT user_id, cluster, n, weight, first_line, last_line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, weight DESC, last_line - first_line, cluster) AS r FROM (
 SELECT user_id, cluster, count(*) AS n, sum(greatest(100, cents))::BIGINT AS weight, min(event_id) AS first_line, max(event_id) AS last_line FROM ({_CLUSTERS}) GROUP BY user_id, cluster)) WHERE r = 1""")
def best_gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cluster of each thread."""
    return t.best_gap_cluster(events(spark, sf_dir), ["user_id"], "us", "event_id", F.greatest(F.lit(100), F.col("cents")), GAP_US, LINE_GAP)


@query(f"""WITH i AS (SELECT *, us + cents * 10000000 AS e FROM {EVENTS}), m AS (SELECT *, us > max(e) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 250000 AS brk FROM i),
 c AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM m)
 SELECT user_id, cluster, count(*) AS n, min(us) AS start_us, max(e) AS end_us FROM c GROUP BY user_id, cluster""")
def interval_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of overlapping intervals with 250 ms slack: an event lasts as many thousand seconds as its value."""
    spans = events(spark, sf_dir).withColumn("e", F.col("us") + F.col("cents") * 10_000_000)
    return t.interval_clusters(spans, ["user_id"], "us", "e", 250_000, "event_id").groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("e").alias("end_us"))


@query(f"""WITH r AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY us, event_id) AS run FROM {EVENTS}),
 l AS (SELECT user_id, f, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(CASE WHEN f THEN n ELSE 0 END) AS streak FROM l GROUP BY user_id""")
def max_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of errors of each thread."""
    return t.longest_streak(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_type") == "error")


@query(f"""SELECT user_id, first_line, n, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, weight DESC, first_line) AS r FROM (
 SELECT user_id, event_id AS first_line, count(*) OVER w AS n, (sum(cents) OVER w)::BIGINT AS weight FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN CURRENT ROW AND 480 FOLLOWING))) WHERE r = 1""")
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest 480 lines of each thread."""
    return t.densest_window(events(spark, sf_dir), ["user_id"], "event_id", 480, F.col("cents"))


_AROUND = f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM {EVENTS}), f AS (SELECT *, min(i) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS a FROM i)"""


@query(_AROUND + " SELECT user_id, min(a)::BIGINT AS first_index, count(*) FILTER (event_type = 'purchase' AND coalesce(i > a, false)) AS after FROM f GROUP BY user_id")
def first_after_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of a thread's first error, and purchases after it."""
    found = t.around_first(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return found.select("user_id", F.col("first_index").cast("long").alias("first_index"), "after")


@query(_AROUND + " SELECT user_id, count(*) FILTER (event_type = 'view' AND coalesce(i < a, true)) AS before FROM f GROUP BY user_id")
def count_before_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views before a thread's first error."""
    return t.around_first(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view").select("user_id", "before")


@query(f"SELECT user_id, event_id, value, r AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC)::INT AS r FROM {EVENTS}) WHERE r <= 6")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six events of each thread."""
    return t.latest(events(spark, sf_dir), ["user_id"], [F.desc("us"), F.desc("event_id")], 6).select("user_id", "event_id", "value", "recency")


@query(f"""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS b,
 row_number() OVER (PARTITION BY user_id ORDER BY value DESC, us, event_id) AS c FROM {EVENTS}) WHERE a = 1 OR b = 1 OR c <= 6""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and most important events of each thread, eight at most."""
    return t.representatives(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 8).select("user_id", "event_id", "value")


_SCORE = """CASE event_type WHEN 'error' THEN 4.0 WHEN 'purchase' THEN 2.5 WHEN 'signup' THEN 2.2 WHEN 'click' THEN 1.8 ELSE 0.5 END + least(3.0, value / 50.0) + least(2.0, coalesce(try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), 0.0) / 40.0)"""


@query(f"SELECT event_id, round(({_SCORE})::DOUBLE, 6) AS score FROM {EVENTS}")
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family's weight and two capped measures."""
    weight = F.lit(0.5)
    for name, w in (("error", 4.0), ("purchase", 2.5), ("signup", 2.2), ("click", 1.8)):
        weight = F.when(F.col("event_type") == name, F.lit(w)).otherwise(weight)
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    score = weight + F.least(F.lit(3.0), F.col("value") / 50.0) + F.least(F.lit(2.0), k / 40.0)
    return events(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"))


@query(f"""WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS})
 SELECT user_id, event_id FROM i WHERE n <= 5 OR EXISTS (SELECT 1 FROM range(5) p(k) WHERE floor(k * (n - 1) / 4.0 + 0.5) = i)""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced events of each thread."""
    return t.evenly_spaced(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 5).select("user_id", "event_id")


@query(f"""WITH b AS (SELECT user_id, min(us) AS lo FROM {EVENTS} GROUP BY 1), a AS (SELECT e.*, (us - lo) / 1000000.0::DOUBLE AS s FROM {EVENTS} JOIN b USING (user_id)),
 w AS (SELECT user_id, greatest(0.0, min(s) FILTER (event_type = 'error') - 3600.0) AS lo, greatest(0.0, min(s) FILTER (event_type = 'error') + 3600.0) AS hi FROM a GROUP BY 1)
 SELECT a.user_id, count(*) AS n, sum(cents)::BIGINT AS cents, round(min(w.lo), 3) AS window_start FROM a JOIN w ON a.user_id = w.user_id AND s BETWEEN lo AND hi GROUP BY 1""")
def window_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within an hour to each side of a thread's first error: an anchored window, not below 0."""
    rows = events(spark, sf_dir)
    clocked = rows.join(rows.groupBy("user_id").agg(F.min("us").alias("lo")), "user_id").withColumn("s", (F.col("us") - F.col("lo")) / F.lit(1_000_000.0)).drop("lo")
    low, high = t.resolve_window(None, None, F.col("anchor"), F.lit(7200.0))
    anchors = clocked.where("event_type = 'error'").groupBy("user_id").agg(F.min("s").alias("anchor")).select("user_id", low.alias("lo"), high.alias("hi"))
    inside = clocked.join(anchors, "user_id").where(F.col("s").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.round(F.min("lo"), 3).alias("window_start"))


_SPANS = f"""spans AS (SELECT user_id % 10 AS g, user_id, us AS s, us + cents * 10000000 AS e FROM {EVENTS} WHERE event_type = 'error' AND cents >= 0),
 reach AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY g, user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INT AS brk FROM spans), part AS (SELECT *, sum(brk) OVER (PARTITION BY g, user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM reach),
 once AS (SELECT g, user_id, min(s) AS s, max(e) AS e FROM part GROUP BY g, user_id, p), marks AS (SELECT g, m, sum(d) AS d FROM (SELECT g, s AS m, 1 AS d FROM once UNION ALL SELECT g, e, -1 FROM once) GROUP BY g, m HAVING sum(d) <> 0),
 level AS (SELECT g, m AS start_us, lead(m) OVER (PARTITION BY g ORDER BY m) AS end_us, sum(d) OVER (PARTITION BY g ORDER BY m ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM marks)"""


def _distress(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = events(spark, sf_dir).where("event_type = 'error' AND cents >= 0").select((F.col("user_id") % 10).alias("g"), "user_id", F.col("us").alias("start_us"), (F.col("us") + F.col("cents") * 10_000_000).alias("end_us"))
    return sweep.levels(spans, ["g"], "user_id", "start_us", "end_us")


@query(f"WITH {_SPANS} SELECT g, start_us, end_us, n FROM level WHERE n > 0")
def distress_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When how many threads of a group are in distress at once: an error lasts as many thousand seconds as its value."""
    return _distress(spark, sf_dir)


@query(f"WITH {_SPANS} SELECT g, min(start_us) AS first, max(end_us) AS last, sum(end_us - start_us)::BIGINT AS covered, max(n) AS most, min(start_us) FILTER (n = top) AS most_from FROM (SELECT *, max(n) OVER (PARTITION BY g) AS top FROM level WHERE n > 0) GROUP BY g")
def distress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each group is in distress, and when most of its threads are."""
    return sweep.summary(_distress(spark, sf_dir), ["g"], "start_us", "end_us")
