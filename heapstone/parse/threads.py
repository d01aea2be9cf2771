"""Thread dumps: sections of lines to one row a thread; deadlocks, contended monitors, pools; one summary row an artifact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.functions.scalars import found, number
from heapstone.sources.stored import stored


def _line() -> Column:
    return F.col("line")


KEY = "artifact_id"
_HEADER = r'^"(.+?)"(?=\s|$)(?!:)'
STATES = ("NEW", "RUNNABLE", "BLOCKED", "WAITING", "TIMED_WAITING", "TERMINATED")
#: Frames of threads that wait for work, for the network or disk, for a forked task, of pinned virtual threads.
IDLE = ("ThreadPoolExecutor.getTask", "LinkedBlockingQueue.take", "SynchronousQueue", "DelayedWorkQueue.take", "ForkJoinPool.awaitWork", "ScheduledThreadPoolExecutor")
IO = ("SocketInputStream", "SocketChannelImpl", "NioSocketImpl", "SocketDispatcher", "FileInputStream.read", "epollWait", "Net.poll", "httpclient", "jdbc")
JOIN = ("ForkJoinTask.join", "ForkJoinTask.awaitDone", "ForkJoinTask.get", "ForkJoinTask.invoke", "CompletableFuture.join", "CompletableFuture.get")
PINNED = ("pinned", "VirtualThread.parkOnCarrierThread", "Continuation.onPinned")


def _holds(texts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(_line(), F.lit(t)) for t in texts))


def _is_header() -> Column:
    return F.startswith(_line(), F.lit('"')) & _line().rlike(_HEADER) & ~_line().rlike(r'^"[^"]*":\s*$')


def sections(lines: DataFrame) -> DataFrame:
    """Lines of threads, each with the line of its header (``_s``); a section ends with an empty line. One window tells both."""
    order = Window.partitionBy(KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.max(F.when(c, F.col("line_no"))).over(order)
    marked = lines.withColumns({"_s": last(_is_header()), "_end": last(F.trim("line") == "")})
    return marked.where("_s IS NOT NULL AND (_end IS NULL OR _end < _s)").drop("_end")


def pool_name(name: Column) -> Column:
    """A name without its trailing number, where it looks like one of a pool."""
    base = found(name, r"^(.+?)[-#]\d+$")
    return F.when(F.lower(name).rlike(r"pool|exec|worker|thread-\d|scheduler|forkjoin|async|task"), base)


def threads(lines: DataFrame) -> DataFrame:
    """name, daemon, nid, state, state_detail, top_frame, cpu_ms, elapsed_s, waiting_to_lock, parking_for, locked, pool_name, idle and frame flags, deadlocked."""
    rows = sections(lines)
    # a plain text is looked for before each pattern, since few lines hold it
    head = F.max(F.when(F.startswith(_line(), F.lit('"')) & _line().rlike(_HEADER), _line()))
    all_of = lambda p: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.contains(_line(), F.lit("<0x")) & _line().rlike(p), F.struct("line_no", F.regexp_extract_all(_line(), F.lit(p), F.lit(1)).alias("m"))))), lambda x: x["m"]))
    state = r"java\.lang\.Thread\.State:\s+(\w+)(?:\s+\(([^)]*)\))?"
    told = F.contains(_line(), F.lit("java.lang.Thread.State:"))
    g = rows.groupBy(KEY, "_s").agg(
        F.min("line_no").alias("line_no"), head.alias("h"), F.max(F.when(told, found(_line(), state, 1))).alias("st"), F.max(F.when(told, found(_line(), state, 2))).alias("state_detail"), F.min_by(found(_line(), r"^\s+at\s+(.*?)\s*$"), F.when(F.contains(_line(), F.lit("at")) & _line().rlike(r"^\s+at\s"), F.col("line_no"))).alias("top_frame"),
        all_of(r"waiting to (?:lock|re-lock)[^<]*<(0x[0-9a-f]+)>").alias("waiting_to_lock"), all_of(r"parking to wait for\s+<(0x[0-9a-f]+)>").alias("parking_for"), all_of(r"- locked <(0x[0-9a-f]+)>").alias("locked"),
        F.max(_holds(IDLE)).alias("idle_executor"), F.max(_holds(IO)).alias("in_io"), F.max(_holds(JOIN)).alias("in_join"), F.max(_holds(PINNED)).alias("pinned"),
    )
    h = F.col("h")
    low = F.lower("h")
    fallback = F.when(low.contains("waiting for monitor entry"), "BLOCKED").when(low.contains("runnable"), "RUNNABLE").when(low.contains("sleeping") | low.contains("timed"), "TIMED_WAITING").when(low.contains("waiting on condition") | low.contains("in object.wait"), "WAITING").otherwise("UNKNOWN")
    name = F.regexp_extract(h, _HEADER, 1)
    out = g.select(KEY, "line_no", name.alias("name"), h.rlike(r'"\s+(?:#\d+\s+)?(?:\[\d+\]\s+)?daemon\b').alias("daemon"), found(h, r"\bnid=(\S+)").alias("nid"), F.coalesce("st", fallback).alias("state"), "state_detail", "top_frame", number(h, r"\bcpu=([\d.]+)ms").alias("cpu_ms"), number(h, r"\belapsed=([\d.]+)s").alias("elapsed_s"), "waiting_to_lock", "parking_for", "locked", pool_name(name).alias("pool_name"), "idle_executor", "in_io", "in_join", "pinned")
    # by artifact, as the threads lie already, so that they are not shuffled again
    held = deadlocks(lines).select(KEY, F.col("names").alias("_held"))
    return out.join(held, KEY, "left").withColumn("deadlocked", F.coalesce(F.array_contains("_held", F.col("name")), F.lit(False))).drop("_held")


def deadlocks(lines: DataFrame) -> DataFrame:
    """artifact_id, reported, names: the cycles that the JVM reports."""
    start, end, named = r"Found (?:one|\d+) Java-level deadlock", r"Java stack information for the threads listed above", r'^"[^"]+":\s*$'
    tells = F.contains(_line(), F.lit("Java-level deadlock")) | F.contains(_line(), F.lit("Java stack information")) | (F.startswith(_line(), F.lit('"')) & _line().rlike(named))
    order = Window.partitionBy(KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.where(tells).withColumn("_d", F.sum(_line().rlike(start).cast("int") - _line().rlike(end).cast("int")).over(order)).where("_d > 0")
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(_line().rlike(named), F.struct("line_no", F.regexp_extract(_line(), r'^"([^"]+)"', 1).alias("n"))))), lambda x: x["n"]))
    return inside.groupBy(KEY).agg(F.count_if(_line().rlike(start)).alias("reported"), names.alias("names"))


def hotspots(rows: DataFrame) -> DataFrame:
    """Monitors that two threads or more wait for, with the first owner: artifact_id, monitor, waiters, blocked, waiting_names, owner, owner_state."""
    # waiters and owners of a monitor in one pass over the threads
    of = lambda monitors, waits: F.transform(F.array_distinct(monitors), lambda m: F.struct(m.alias("monitor"), F.lit(waits).alias("waits")))
    marks = F.concat(of(F.concat("waiting_to_lock", "parking_for"), True), of(F.col("locked"), False))
    each = rows.select(KEY, "name", "state", "line_no", F.explode(marks).alias("_m")).select(KEY, "name", "state", "line_no", "_m.*")
    waiting = F.transform(F.array_sort(F.collect_list(F.when(F.col("waits"), F.struct("line_no", "name")))), lambda x: x["name"])
    owner = F.min(F.when(~F.col("waits"), F.struct("line_no", "name", "state")))
    grouped = each.groupBy(KEY, "monitor").agg(F.count_if("waits").alias("waiters"), F.count_if(F.col("waits") & (F.col("state") == "BLOCKED")).alias("blocked"), waiting.alias("waiting_names"), owner.alias("o")).where("waiters >= 2")
    return grouped.select(KEY, "monitor", "waiters", "blocked", "waiting_names", F.col("o.name").alias("owner"), F.col("o.state").alias("owner_state"))


def pools(rows: DataFrame) -> DataFrame:
    """Pools with their threads by state; stalled are the blocked and those that wait without being idle."""
    state = lambda s: F.count_if(F.col("state") == s)
    stalled = (F.col("state") == "BLOCKED") | (F.col("state").isin("WAITING", "TIMED_WAITING") & ~F.col("idle_executor"))
    return rows.where("pool_name IS NOT NULL").groupBy(KEY, "pool_name").agg(F.count("*").alias("threads"), state("RUNNABLE").alias("runnable"), state("BLOCKED").alias("blocked"), state("WAITING").alias("waiting"), state("TIMED_WAITING").alias("timed_waiting"), F.count_if("idle_executor").alias("idle"), F.count_if(stalled).alias("stalled"), F.count_if("in_io").alias("in_io"), F.count_if("in_join").alias("in_join"), F.count_if((F.col("state") == "RUNNABLE") & ~F.col("in_io")).alias("runnable_not_io"))


def kept(lines: DataFrame) -> DataFrame:
    """``threads``, written once for what reads them several times; without the columns that only single threads are shown by."""
    return stored(threads(lines).drop("state_detail", "top_frame", "nid", "daemon", "deadlocked"), "threads")


def summary(lines: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """What the rules read: states, deadlock, the strongest monitor, the most stalled pool, pileups, pinned and spinning threads. ``rows``: ``kept(lines)``, where they are there already."""
    rows = kept(lines) if rows is None else rows
    spin = (F.col("state") == "RUNNABLE") & (F.col("cpu_ms") >= 1000) & (F.col("elapsed_s") >= 5)
    share = F.col("cpu_ms") / (F.col("elapsed_s") * 1000)
    base = rows.groupBy(KEY).agg(F.count("*").alias("thread_count"), *(F.count_if(F.col("state") == s).alias(f"{s.lower()}_count") for s in STATES), F.count_if("pinned").alias("pinned_count"), F.coalesce(F.max(F.when(spin, share)), F.lit(0.0)).alias("spin_share"), F.coalesce(F.max_by(F.when(spin, F.col("cpu_ms")), F.when(spin, share)), F.lit(0.0)).alias("spin_cpu_ms"))
    strongest = hotspots(rows).groupBy(KEY).agg(F.min_by(F.struct("blocked", "waiters", "monitor"), F.struct(-F.col("blocked"), -F.col("waiters"), F.col("monitor"))).alias("m")).select(KEY, F.col("m.blocked").alias("monitor_blocked"), F.col("m.waiters").alias("monitor_waiters"), F.col("m.monitor").alias("monitor"))
    p = pools(rows)
    stuck = p.where("blocked >= 2 OR (threads >= 3 AND runnable = 0 AND stalled >= 2)").groupBy(KEY).agg(F.max(F.struct("blocked", "stalled", "threads", "runnable", "pool_name")).alias("p")).select(KEY, *(F.col(f"p.{c}").alias(f"pool_{c}") for c in ("blocked", "stalled", "threads", "runnable")))
    io = p.where("threads >= 3 AND in_io >= 2").groupBy(KEY).agg(F.max(F.struct("in_io", "runnable_not_io")).alias("p")).select(KEY, F.col("p.in_io").alias("io_threads"), F.col("p.runnable_not_io").alias("io_pool_runnable"))
    join = p.where("in_join >= 2").groupBy(KEY).agg(F.max(F.struct("in_join", "runnable")).alias("p")).select(KEY, F.col("p.in_join").alias("join_threads"), F.col("p.runnable").alias("join_pool_runnable"))
    out = base.join(deadlocks(lines).select(KEY, (F.col("reported") > 0).alias("deadlock")), KEY, "left")
    for other in (strongest, stuck, io, join):
        out = out.join(other, KEY, "left")
    return out.fillna(False, ["deadlock"]).fillna(0)
