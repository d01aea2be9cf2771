"""Diagnostic artifacts rendered from the tables, so that parsers and rule books run on text whose source rows SQL knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.plans.base import events, table


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def millis(c: Column) -> Column:
    """Hundredths as text with three decimals."""
    return _cat(F.floor(c / 100), ".", _digits(c % 100, 2), "0")


def gc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A G1 log for each thread: every event is a line, numbered by its id, ten a second; heap sizes in MB of 1024."""
    n, c = F.col("event_id"), F.col("cents")
    before = 500 + n % 524
    stamp = _cat("[", F.floor(n / 10), ".", n % 10, "00s][info][gc")
    heap = _cat(before, "M->", before - c % 200, "M(1024M) ", millis(c), "ms")
    full = F.when(n % 2 == 0, "G1 Compaction Pause").otherwise("Metadata GC Threshold")
    other = F.when(n % 3 == 0, _cat("] Allocation Stall (worker-", n % 7, ") ", millis(c), "ms")).when(n % 3 == 1, _cat(",task] GC(", n, ") Using ", n % 16 + 1, " workers of 16 for evacuation")).otherwise(_cat("] GC(", n, ") To-space exhausted"))
    kind = F.col("event_type")
    tail = (
        F.when(kind == "purchase", _cat("] GC(", n, ") Pause Young (Normal) (G1 Evacuation Pause) ", heap))
        .when(kind == "view", _cat("] GC(", n, ") Pause Young (Mixed) (G1 Evacuation Pause) ", heap))
        .when(kind == "error", _cat("] GC(", n, ") Pause Full (", full, ") ", heap))
        .when(kind == "click", _cat(",phases] GC(", n, ") Concurrent Mark ", millis(c), "ms"))
        .otherwise(other)
    )
    rows = events(spark, sf_dir).select(_cat("gc-", F.col("user_id")).alias("artifact_id"), (n + 1).cast("int").alias("line_no"), F.concat(stamp, tail).alias("line"))
    return rows.repartition(spark.sparkContext.defaultParallelism, "artifact_id")  # logs are files of their own, so as many tasks read them


#: The same events in SQL, as the parsed columns should be: tables p (pauses), q (all events with their kind).
GC_SQL = """e AS (SELECT event_id AS n, round(value * 100)::BIGINT AS c, event_type, 'gc-' || user_id AS artifact_id, event_id + 1 AS line_no, event_id / 10.0::DOUBLE AS elapsed_s FROM events),
 q AS (SELECT *, CASE WHEN event_type IN ('purchase', 'view', 'error') THEN 'pause' WHEN event_type = 'click' THEN 'phase' WHEN n % 3 = 0 THEN 'stall' WHEN n % 3 = 1 THEN 'worker' ELSE 'signal' END AS kind FROM e),
 p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'YOUNG' WHEN 'view' THEN 'MIXED' ELSE 'FULL' END AS pause_type, CASE WHEN event_type <> 'error' THEN 'G1 Evacuation Pause' WHEN n % 2 = 0 THEN 'G1 Compaction Pause' ELSE 'Metadata GC Threshold' END AS cause,
  500 + n % 524 AS before_mb, 500 + n % 524 - c % 200 AS after_mb, (500 + n % 524) / 1024.0::DOUBLE AS before_ratio, (500 + n % 524 - c % 200) / 1024.0::DOUBLE AS after_ratio, c / 100.0::DOUBLE AS pause_ms FROM q WHERE kind = 'pause')"""


def gc_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a log, with the line that names its collector."""
    return events(spark, sf_dir).select(_cat("gc-", F.col("user_id")).alias("artifact_id")).distinct().withColumn("content", F.lit("[0.001s][info][gc] Using G1"))


#: Names of classes by the key's remainder modulo 8.
_CLASSES = ("[B", "java.lang.String", "java.util.HashMap$Entry", "com.shop.cache.Page", "java.util.ArrayList", "java.lang.ref.WeakReference", "java.lang.Thread", "com.shop.Order")


def _named(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names)).cast("int") + 1)


def names_sql(names: tuple[str, ...], k: str) -> str:
    return f"list_element([{', '.join(repr(x) for x in names)}], ({k} % {len(names)} + 1)::INT)"


def histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heap histogram for each part size: a class for each part (its name and key make the class), bytes from the price."""
    k = F.col("p_partkey")
    name = F.when(k % 8 >= 3, _cat(_named(_CLASSES, k), k)).otherwise(_named(_CLASSES, k))
    row = _cat("  ", k + 1, ":  ", 10 * (k % 1000), "  ", F.round(F.col("p_retailprice") * 100).cast("long") * (k % 50), "  ", name, F.when(k % 2 == 0, " (java.base@21)").otherwise(""))
    return table(spark, sf_dir, "part").select(_cat("h-", F.col("p_size")).alias("artifact_id"), (k + 3).cast("int").alias("line_no"), row.alias("line"))


HISTOGRAM_SQL = f"""h AS (SELECT 'h-' || p_size AS artifact_id, p_partkey + 1 AS rank, 10 * (p_partkey % 1000) AS instances, round(p_retailprice * 100)::BIGINT * (p_partkey % 50) AS bytes, {names_sql(_CLASSES, "p_partkey")} || CASE WHEN p_partkey % 8 >= 3 THEN p_partkey::VARCHAR ELSE '' END AS class_name FROM part),
 f AS (SELECT *, class_name = '[B' AS byte_array, class_name = 'java.lang.String' AS string_like, class_name IN ('[B', 'java.lang.String') AS payload_like, regexp_matches(lower(class_name), 'map|list|set|queue|deque|vector|properties|collection|\\$entry|\\$node') AS collection_like,
  regexp_matches(lower(class_name), 'cache|\\$entry|\\$node') AS cache_like, regexp_matches(class_name, '\\$(Entry|Node)') AS entry_like, contains(lower(class_name), 'reference') AS reference_like, class_name = 'java.lang.Thread' AS thread_like FROM h)"""

_MAPPINGS = ("[ anon ]", "[ heap ]", "[ stack ]", "libjvm.so", "/var/lib/app.dat", "orders.jar", "vdso")


def pmap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process map for each part size; resident and dirty shares by the key. Odd sizes have maps without resident sizes."""
    k = F.col("p_partkey")
    size = 4 * (1 + F.round(F.col("p_retailprice")).cast("long") * (k % 13))
    address, mapping = F.lower(F.lpad(F.hex(k * 4096), 16, "0")), _named(_MAPPINGS, k)
    headed = _cat(address, "  ", size, "  ", F.floor(size / (1 + k % 5)).cast("long"), "  ", F.floor(size / (2 + k % 7)).cast("long"), " rw---   ", mapping)
    plain = _cat(address, " ", size, "K rw---   ", mapping)
    return table(spark, sf_dir, "part").select(_cat("m-", F.col("p_size")).alias("artifact_id"), (k + 3).cast("int").alias("line_no"), F.when(F.col("p_size") % 2 == 0, headed).otherwise(plain).alias("line"))


PMAP_SQL = f"""m AS (SELECT 'm-' || p_size AS artifact_id, p_partkey AS k, 4 * (1 + round(p_retailprice)::BIGINT * (p_partkey % 13)) AS size_kb, {names_sql(_MAPPINGS, "p_partkey")} AS mapping, list_element(['anon', 'heap', 'stack', 'shared-library', 'file-backed', 'file-backed', 'other'], (p_partkey % 7 + 1)::INT) AS category, p_size % 2 = 0 AS headed FROM part),
 r AS (SELECT *, CASE WHEN headed THEN size_kb // (1 + k % 5) END AS rss_kb, CASE WHEN headed THEN size_kb // (2 + k % 7) END AS dirty_kb FROM m)"""


def cgroup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version 2 snapshot for each customer: limits and use from the key and the balance."""
    k, b = F.col("c_custkey"), F.floor((F.col("c_acctbal") + 1000) * 100).cast("long")
    parts = (
        "[memory.current]", _cat(b * 1000), "[memory.max]", F.when(k % 4 == 0, "max").otherwise(_cat(b * (900 + 50 * (k % 9)))), "[memory.high]", _cat(b * 950), "[memory.events]", _cat("high ", k % 60), _cat("max ", k % 3), _cat("oom ", F.when(k % 10 == 7, 1).otherwise(0)), "oom_kill 0",
        "[memory.stat]", _cat("anon ", b * 7), _cat("file ", b), "[memory.pressure]", _cat("some avg10=", k % 8, ".50 avg60=", k % 5, ".25 avg300=0.00 total=1"), _cat("full avg10=0.", _digits(k % 90, 2), " avg60=0.", _digits(k % 11, 2), " avg300=0.00 total=1"),
        "[cpu.max]", F.when(k % 6 == 0, "max 100000").otherwise(_cat((k % 6) * 50000, " 100000")), "[cpuset.cpus.effective]", _cat("0-", k % 4, ",8"), "[cpu.stat]", "nr_periods 200", _cat("nr_throttled ", k % 100), _cat("throttled_usec ", k * 1000),
    )
    lines = F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return table(spark, sf_dir, "customer").select(_cat("c-", k).alias("artifact_id"), F.posexplode(lines).alias("_p", "line")).select("artifact_id", (F.col("_p") + 1).alias("line_no"), "line")


CGROUP_SQL = """b AS (SELECT c_custkey AS k, floor((c_acctbal + 1000) * 100)::BIGINT AS b FROM customer),
 v AS (SELECT 'c-' || k AS artifact_id, k, b * 1000 AS current_bytes, CASE WHEN k % 4 <> 0 THEN b * (900 + 50 * (k % 9)) END AS max_bytes, b * 950 AS high_bytes, k % 60 AS high_events, k % 3 AS max_events, CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END::BIGINT AS oom_events, 0::BIGINT AS oom_kill_events,
  (k % 8 || '.5')::DOUBLE AS memory_some_avg10, (k % 5 || '.25')::DOUBLE AS memory_some_avg60, ('0.' || lpad((k % 90)::VARCHAR, 2, '0'))::DOUBLE AS memory_full_avg10, ('0.' || lpad((k % 11)::VARCHAR, 2, '0'))::DOUBLE AS memory_full_avg60, 0.0::DOUBLE AS cpu_some_avg10, 0.0::DOUBLE AS cpu_full_avg10,
  CASE WHEN k % 6 <> 0 THEN (k % 6) / 2.0::DOUBLE END AS quota_cores, (k % 4 + 2)::INT AS cpus, k % 100 AS throttled, k AS throttled_ms, (k % 100) / 200.0::DOUBLE AS throttled_ratio FROM b),
 s AS (SELECT *, max_bytes IS NOT NULL AS max_defined, true AS high_defined, greatest(0, max_bytes - current_bytes) AS headroom_to_max_bytes, CASE WHEN max_bytes > 0 THEN current_bytes / max_bytes::DOUBLE ELSE 0.0 END AS usage_of_max_ratio, CASE WHEN high_bytes > 0 THEN current_bytes / high_bytes::DOUBLE ELSE 0.0 END AS usage_of_high_ratio,
  least(quota_cores, cpus::DOUBLE) AS cpu_ceiling_cores FROM v)"""


def kernel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel log for each customer: a line for each order, kills, notes and lines about other things."""
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "MMM d HH:mm:ss")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.when(k % 3 == 0, _cat(" node kernel: Memory cgroup out of memory: Killed process ", k, " (java", k % 4, ") total-vm:", cents, "kB, anon-rss:", F.floor(cents / 2), "kB, file-rss:", k % 1000, "kB, shmem-rss:0kB")).when(k % 3 == 1, _cat(" node kernel: oom-kill: constraint=CONSTRAINT_MEMCG,oom_memcg=/pods/", k % 9, ",task=java,pid=", k, ",uid=1")).otherwise(" node kernel: usb 1-1: new device")
    return table(spark, sf_dir, "orders").select(_cat("k-", F.col("o_custkey")).alias("artifact_id"), (k + 1).cast("int").alias("line_no"), F.concat(stamp, text).alias("line"))


def pod_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod description for each customer with two containers."""
    k = F.col("c_custkey")

    def container(name: str, n: Column) -> list[Column | str]:
        return [_cat("  ", name, ":"), F.when(n % 3 == 0, "    State:          Waiting").otherwise("    State:          Running"), F.when(n % 3 == 0, "      Reason:       CrashLoopBackOff").otherwise("      Started:      Mon, 30 Mar 2026 11:42:13 -0700"), "    Last State:     Terminated", F.when(n % 2 == 0, "      Reason:       OOMKilled").otherwise("      Reason:       Error"), _cat("      Exit Code:    ", 130 + n % 9), _cat("    Restart Count:  ", n % 7)]

    parts = [_cat("Name:           pod-", k), "Namespace:      shop", "Containers:", *container("app", k), *container("side", k + 1), "Conditions:", "  Type   Status"]
    lines = F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return table(spark, sf_dir, "customer").select(_cat("p-", k).alias("artifact_id"), F.posexplode(lines).alias("_p", "line")).select("artifact_id", (F.col("_p") + 1).alias("line_no"), "line")


_NMT = ("Java Heap", "Class", "Thread", "Code", "GC", "Internal", "Symbol", "Arena Chunk")


def nmt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of native memory for each customer nation: one line a category, sizes summed over its customers, and the details of some."""
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 8).cast("int").alias("g")).agg(F.count("*").alias("m"), F.sum(F.floor(F.col("c_acctbal") + 1000).cast("long")).alias("b"))
    line = _cat("-  ", _named(_NMT, F.col("g")), " (reserved=", F.col("b") * 9, "KB +", F.col("m"), "KB, committed=", F.col("b"), "KB ", F.when(F.col("n") % 2 == 0, "+").otherwise("-"), F.col("m") * 700, "KB)")
    more = F.when(F.col("g") == 1, F.array(_cat("  (classes #", F.col("m") * 100, " +", F.col("m") * 60, ")"), F.lit("  (  Metadata)"), _cat("  (    reserved=", F.col("b") * 3, "KB, committed=", F.col("b") * 2, "KB +4KB)"), _cat("  (    used=", F.col("b") + F.col("m"), "KB +", F.col("m"), "KB)"), F.lit("  (  Class space)"), _cat("  (    reserved=", F.col("b") * 2, "KB, committed=", F.col("b"), "KB)"), _cat("  (    used=", F.floor(F.col("b") * 19 / 20), "KB +", F.col("m"), "KB)"))).when(F.col("g") == 2, F.array(_cat("  (thread #", F.col("m") * 20, ")"), _cat("  (stack: reserved=", F.col("b"), "KB +8KB, committed=", F.floor(F.col("b") / 2), "KB)"))).otherwise(F.expr("cast(array() AS array<string>)"))
    rows = by.select("n", F.posexplode(F.concat(F.array(line), more)).alias("_p", "line"), ((F.col("g") + 1) * 20).alias("_at"))
    total = by.groupBy("n").agg(F.sum("b").alias("b"), F.sum("m").alias("m")).select("n", F.lit(0).alias("_p"), _cat("Total: reserved=", F.col("b") * 9, "KB +", F.col("m"), "KB, committed=", F.col("b"), "KB +", F.col("m") * 900, "KB").alias("line"), F.lit(1).alias("_at"))
    return rows.unionByName(total).select(_cat("n-", F.col("n")).alias("artifact_id"), (F.col("_at") + F.col("_p")).cast("int").alias("line_no"), "line")


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread dump for each supplier: every line item is a thread of a pool, its flags give state, frames and monitors."""
    k, flag, status = F.col("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus")
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + k % 1000) * 64 + F.floor("l_quantity")
    name = _cat("pool-", k % 5, "-thread-", seq)
    monitor = _cat("<0x", F.lower(F.lpad(F.hex(k % 11 + 16), 8, "0")), ">")
    state = F.when(flag == "A", "RUNNABLE").when((flag == "R") & (status == "O"), "BLOCKED (on object monitor)").when(flag == "R", "WAITING (parking)").otherwise("TIMED_WAITING (sleeping)")
    frame = F.when(k % 4 == 0, "\tat java.net.SocketInputStream.read(S.java:1)").when(k % 4 == 1, "\tat java.util.concurrent.ThreadPoolExecutor.getTask(T.java:2)").otherwise(_cat("\tat com.shop.Order.run", k % 3, "(Order.java:", k % 90, ")"))
    lock = F.when((flag == "R") & (status == "O"), _cat("\t- waiting to lock ", monitor, " (a java.lang.Object)")).when(flag == "A", _cat("\t- locked ", monitor, " (a java.lang.Object)")).otherwise("\tat com.shop.Main.main(Main.java:1)")
    head = _cat('"', name, '" #', F.col("l_orderkey"), F.when(k % 2 == 0, " daemon").otherwise(""), " prio=5 cpu=", 100 * (k % 80), ".00ms elapsed=", F.col("l_quantity").cast("int"), ".00s tid=0x1 nid=0x", k, " state [0x1]")
    lines = F.array(head, _cat("   java.lang.Thread.State: ", state), frame, lock, F.lit(""))
    at = seq * 5
    return table(spark, sf_dir, "lineitem").select(_cat("t-", F.col("l_suppkey")).alias("artifact_id"), at.alias("_at"), F.posexplode(lines).alias("_p", "line")).select("artifact_id", (F.col("_at") + F.col("_p")).alias("line_no"), "line")


DUMP_SQL = """t AS (SELECT 't-' || l_suppkey AS artifact_id, l_partkey AS k, ((l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 64 + floor(l_quantity)::BIGINT AS seq, 'pool-' || (l_partkey % 5) || '-thread-' || (((l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 64 + floor(l_quantity)::BIGINT) AS name, 'pool-' || (l_partkey % 5) || '-thread' AS pool_name,
  CASE WHEN l_returnflag = 'A' THEN 'RUNNABLE' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'BLOCKED' WHEN l_returnflag = 'R' THEN 'WAITING' ELSE 'TIMED_WAITING' END AS state, '0x' || lpad(lower(to_hex(l_partkey % 11 + 16)), 8, '0') AS monitor,
  l_partkey % 4 = 0 AS in_io, l_partkey % 4 = 1 AS idle, l_partkey % 2 = 0 AS daemon, 100.0::DOUBLE * (l_partkey % 80) AS cpu_ms, floor(l_quantity)::DOUBLE AS elapsed_s FROM lineitem)"""


def crash_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash log for each supplier, of five kinds by its key."""
    k = F.col("s_suppkey")
    reason = F.when(k % 5 == 0, "# pthread_create failed (EAGAIN), unable to create native thread").when(k % 5 == 1, _cat("# There is insufficient memory for the Java Runtime Environment to continue.\n# Native memory allocation (mmap) failed to map ", k * 4096, " bytes.")).when(k % 5 == 2, "# OutOfMemoryError: Compressed class space").when(k % 5 == 3, "# CodeCache is full. Compiler has been disabled.").otherwise("#  SIGSEGV (0xb) at pc=0x1, pid=2\n# Problematic frame:\n# V  [libjvm.so+0x1]  G1FullGCMarker::mark()+0x2")
    text = _cat("#\n", reason, "\n# JRE version: OpenJDK (21.0.", k % 9, ")\n", 'Current thread (0x1):  JavaThread "', F.when(k % 2 == 0, "C2 CompilerThread0").otherwise(F.col("s_name")), '" daemon\nHost: node-', k % 3, "\nTime: now elapsed time: ", k % 100, ".5 seconds\n")
    return table(spark, sf_dir, "supplier").select(_cat("x-", k).alias("artifact_id"), text.alias("content"))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flight recording for each thread: events as the reader of JSON lines gives them."""
    kind, n, c = F.col("event_type"), F.col("event_id"), F.col("cents")
    name = F.when(kind == "error", "jdk.JavaMonitorEnter").when(kind == "click", "jdk.ObjectAllocationSample").when(kind == "view", "jdk.ExecutionSample").when(kind == "purchase", F.when(n % 2 == 0, "jdk.GCPhasePause").otherwise("jdk.OldObjectSample")).otherwise(F.when(n % 2 == 0, "jdk.ThreadPark").otherwise("jdk.CPULoad"))
    frames = F.array(F.struct(_cat("com.shop.Order.step", n % 3).alias("method"), F.lit(True).alias("java")), F.struct(F.lit("com.shop.Main.main").alias("method"), F.lit(True).alias("java")))
    none = lambda t: F.lit(None).cast(t)
    start = F.date_format(F.timestamp_micros(F.floor(F.col("us") / 1000) * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events(spark, sf_dir).select(
        _cat("j-", F.col("user_id")).alias("artifact_id"), name.alias("type"), start.alias("startTime"), F.when(kind.isin("error", "purchase", "signup"), F.floor(c / 10).cast("long")).alias("durationMs"), _cat("t", n % 4).alias("thread"), F.when(kind.isin("click", "purchase"), _cat("com.shop.C", n % 5)).alias("className"), F.when(kind.isin("click", "purchase"), c * 100).alias("bytes"),
        none("string").alias("allocator"), none("string").alias("rootType"), none("string").alias("rootSystem"), none("string").alias("rootDescription"), F.when(kind == "purchase", n % 10).alias("referenceDepth"), F.when(kind == "purchase", c * 10).alias("objectAgeMs"), F.when(kind == "signup", (n % 150) / F.lit(1.0)).alias("machineTotal"), F.when(kind == "signup", (n % 90) / F.lit(100.0)).alias("jvmTotal"), F.when(kind != "signup", frames).alias("stack"),
    )
