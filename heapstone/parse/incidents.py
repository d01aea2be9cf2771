"""Kernel and pod OOM signals, JVM crash logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.functions.scalars import found, number


def _line() -> Column:
    return F.col("line")


KEY = "artifact_id"


def kernel_events(lines: DataFrame, year: int) -> DataFrame:
    """Kernel lines about memory: killed, pid, process, sizes in KB, group, task, event_ts (the log has no year, so it is given)."""
    rows = lines.where(_line().rlike(r"(?i)out of memory: killed process|oom-kill:|invoked oom-killer|oom_reaper"))
    stamp = found(_line(), r"^([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2})")
    ts = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(stamp, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    size = lambda name: number(_line(), rf"(?i)\b{name}:(\d+)kB", 1, "long")
    killed = _line().rlike(r"(?i)killed process")
    return rows.select(
        KEY, "line_no", killed.alias("killed"), ts.alias("event_ts"), F.coalesce(number(_line(), r"(?i)killed process (\d+)", 1, "long"), number(_line(), r"\bpid=(\d+)", 1, "long"), number(_line(), r"reaped process (\d+)", 1, "long")).alias("pid"), F.coalesce(found(_line(), r"process \d+ \(([^)]+)\)"), found(_line(), r"\btask=([^,\s]+)")).alias("process"),
        *(size(n).alias(f"{n.replace('-', '_')}_kb") for n in ("total-vm", "anon-rss", "file-rss", "shmem-rss")), found(_line(), r"oom_memcg=([^,\s]+)").alias("memcg"), found(_line(), r"\btask=([^,\s]+)").alias("task"),
    )


def pods(lines: DataFrame) -> DataFrame:
    """One row for each container of a pod description: state, reasons, exit code, restarts. Headers are carried forward by their indent."""
    order = Window.partitionBy(KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, True).over(order)
    top = F.when(_line().rlike(r"^\S[^:]*:"), F.regexp_extract(_line(), r"^([^:]+):", 1))
    marked = lines.withColumn("_top", last(top)).withColumn("_pod", last(found(_line(), r"^Name:\s+(\S+)"))).withColumn("_ns", last(found(_line(), r"^Namespace:\s+(\S+)"))).where(F.col("_top").isin("Containers", "Init Containers"))
    container = found(_line(), r"^  (\S[^:]*):\s*$")
    part = F.when(_line().rlike(r"^    State:"), "state").when(_line().rlike(r"^    Last State:"), "last").when(_line().rlike(r"^    \S"), "none")
    rows = marked.withColumn("container", last(container)).withColumn("_part", last(part)).where("container IS NOT NULL")
    get = lambda p, where=None: F.max(F.when(F.lit(True) if where is None else F.col("_part") == where, found(_line(), p)))
    return rows.groupBy(KEY, "container").agg(
        F.max("_pod").alias("pod"), F.max("_ns").alias("namespace"), get(r"^    State:\s+(\S+)").alias("state"), get(r"^\s+Reason:\s+(\S+)", "state").alias("state_reason"), get(r"^    Last State:\s+(\S+)").alias("last_state"), get(r"^\s+Reason:\s+(\S+)", "last").alias("last_reason"),
        get(r"^\s+Exit Code:\s+(-?\d+)", "last").cast("int").alias("exit_code"), get(r"^    Restart Count:\s+(\d+)").cast("int").alias("restart_count"), get(r"^\s+Started:\s+(.*\S)", "last").alias("started"), get(r"^\s+Finished:\s+(.*\S)", "last").alias("finished"),
    )


def oom_summary(lines: DataFrame, year: int) -> DataFrame:
    """Kills by the kernel, pods killed, restarts; one row an artifact that shows any."""
    k = kernel_events(lines, year).groupBy(KEY).agg(F.count_if("killed").alias("kernel_oom_kill_count"), F.count_if(~F.col("killed")).alias("kernel_context_count"), F.array_sort(F.collect_set("process")).alias("process_names"), F.min("event_ts").alias("earliest_ts"), F.max("event_ts").alias("latest_ts"))
    p = pods(lines).groupBy(KEY).agg(F.count_if((F.col("state_reason") == "OOMKilled") | (F.col("last_reason") == "OOMKilled")).alias("pod_oom_killed_count"), F.count_if(F.col("state_reason") == "CrashLoopBackOff").alias("crash_loop_count"), F.coalesce(F.max("restart_count"), F.lit(0)).alias("max_restart_count"))
    return k.join(p, KEY, "full_outer").fillna(0)


def crash_summary(artifacts: DataFrame) -> DataFrame:
    """One row for each JVM crash log: signal, crash type (first that fits), thread, frame, versions, times, sizes."""
    c = F.col("content")
    low = F.lower(c)
    signal = found(c, r"(?m)^#\s+((?:SIG[A-Z]+|EXCEPTION_[A-Z_]+)[^\n]*?)\s*$")
    requested = number(c, r"(?i)failed to (?:allocate|map|commit) \(?(\d+)", 1, "long")
    cache = r"(?i)CodeCache:\s*size=(\d+)Kb\s+used=(\d+)Kb\s+max_used=(\d+)Kb\s+free=(\d+)Kb"
    kind = (
        F.when(low.contains("unable to create native thread") | low.contains("pthread_create failed"), "native_thread_exhaustion")
        .when(low.contains("compressed class space"), "compressed_class_space_oom")
        .when(low.contains("codecache is full") | low.contains("code cache is full"), "code_cache_full")
        .when(low.contains("insufficient memory for the java runtime") | low.contains("native memory allocation"), "native_allocation_failure")
        .when(signal.isNotNull(), "fatal_signal")
        .otherwise("unknown")
    )
    frame = found(c, r"(?m)^# Problematic frame:\s*\n#\s+(.*?)\s*$")
    full = low.contains("codecache is full") | low.contains("code cache is full")
    return artifacts.select(
        KEY, signal.alias("signal"), kind.alias("crash_type"), found(c, r"(?m)^# JRE version:\s+(.*?)\s*$").alias("jre_version"), found(c, r"(?m)^# Java VM:\s+(.*?)\s*$").alias("vm"), found(c, r"(?m)^Command Line:\s+(.*?)\s*$").alias("command_line"), found(c, r"(?m)^Current thread[^\"\n]*\"([^\"]+)\"").alias("current_thread_name"),
        found(c, r"(?m)^Host:\s+(.*?)\s*$").alias("host"), frame.alias("problem_frame"), found(frame, r"^\S+\s+\[[^\]]*\]\s+(.*?)(?:\+0x[0-9a-f]+)?$").alias("problem_symbol"), found(c, r"(?m)^Time:\s+(.*?)\s+elapsed time").alias("crash_time_text"), number(c, r"elapsed time:\s+([\d.]+) seconds").alias("elapsed_s"), requested.alias("requested_bytes"),
        number(c, cache, 1, "long").alias("code_cache_size_kb"), number(c, cache, 2, "long").alias("code_cache_used_kb"), number(c, cache, 4, "long").alias("code_cache_free_kb"), (full | c.rlike(cache) & full).alias("code_cache_full"),
    )
