"""Heap histograms, process maps, native memory tracking, cgroup snapshots: lines to tables, tables to one summary row an artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapstone.functions.scalars import found, number
from heapstone.operators.compare import last_of
from heapstone.operators.context import section_of
from heapstone.operators.ranking import dominant, ratio


def _line() -> Column:
    return F.col("line")


KEY = "artifact_id"

# --- heap histogram ---

_ROW = r"^\s*(\d+):\s+(\d+)\s+(\d+)\s+(\S.*?)\s*$"
#: Families of classes. Names that match whole, and parts of the name in lower case.
WHOLE = {"byte_array": ("[B",), "string_like": ("java.lang.String", "[C"), "payload_like": ("[B", "[C", "java.lang.String"), "thread_like": ("java.lang.Thread",)}
PARTS = {
    "collection_like": ("map", "list", "set", "queue", "deque", "vector", "properties", "collection", "$entry", "$node"), "cache_like": ("cache", "$entry", "$node"), "entry_like": ("$entry", "$node"), "reference_like": ("reference",),
}
FAMILIES = (*WHOLE, *PARTS)


def families(name: Column) -> dict[str, Column]:
    """A flag for each family."""
    any_part = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.lower(name).contains(x))
    return {k: name.isin(*v) for k, v in WHOLE.items()} | {k: any_part(v) for k, v in PARTS.items()}


def histogram(lines: DataFrame) -> DataFrame:
    """artifact_id, rank, instances, bytes, class_name, and a flag for each family."""
    rows = lines.where(_line().rlike(_ROW)).select(KEY, number(_line(), _ROW, 1, "long").alias("rank"), number(_line(), _ROW, 2, "long").alias("instances"), number(_line(), _ROW, 3, "long").alias("bytes"), F.regexp_replace(F.regexp_extract(_line(), _ROW, 4), r"\s+\([\w.@/-]+\)$", "").alias("class_name"))
    return rows.withColumns(families(F.col("class_name")))


def histogram_totals(lines: DataFrame) -> DataFrame:
    """artifact_id, total_instances, total_bytes from the footer."""
    pattern = r"^\s*Total\s*:?\s+(\d+)\s+(\d+)\s*$"
    return lines.where(_line().rlike(pattern)).groupBy(KEY).agg(F.max(number(_line(), pattern, 1, "long")).alias("total_instances"), F.max(number(_line(), pattern, 2, "long")).alias("total_bytes"))


def histogram_summary(lines: DataFrame) -> DataFrame:
    """Sums by family, the top consumer and its shares; totals from the footer, else of the visible rows."""
    rows = histogram(lines)
    sums = [F.count("*").alias("visible_entries"), F.sum("instances").alias("visible_instances"), F.sum("bytes").alias("visible_bytes"), F.max(F.struct("bytes", (-F.col("rank")).alias("r"), "class_name", "instances")).alias("top")]
    for name in FAMILIES:
        sums += [F.sum(F.when(F.col(name), F.col("bytes")).otherwise(0)).alias(f"{name}_bytes"), F.sum(F.when(F.col(name), F.col("instances")).otherwise(0)).alias(f"{name}_instances")]
    out = rows.groupBy(KEY).agg(*sums).join(histogram_totals(lines), KEY, "left")
    total = F.coalesce("total_bytes", "visible_bytes")
    return out.withColumns({
        "total_instances": F.coalesce("total_instances", "visible_instances"), "total_bytes": total, "top_consumer": F.col("top.class_name"), "top_consumer_bytes": F.col("top.bytes"),
        "top_consumer_visible_share": ratio(F.col("top.bytes"), F.col("visible_bytes")), "top_consumer_total_share": ratio(F.col("top.bytes"), total), "visible_coverage": ratio(F.col("visible_bytes"), total),
    }).drop("top")


# --- process map ---

_HEADED = r"^([0-9a-f]{8,16})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(.*?)\s*$"
_PLAIN = r"^([0-9a-f]{8,16})\s+(\d+)K\s+(\S+)\s+(.*?)\s*$"


def mapping_category(mapping: Column) -> Column:
    low = F.lower(mapping)
    return F.when(low.contains("anon"), "anon").when(low.contains("heap"), "heap").when(low.contains("stack"), "stack").when(low.rlike(r"\.so(?:\.|$|\s)"), "shared-library").when(mapping.contains("/") | low.rlike(r"\.\w{1,8}$"), "file-backed").otherwise("other")


def pmap(lines: DataFrame) -> DataFrame:
    """Mappings with sizes in KB; rows with resident and dirty sizes, else those without."""
    part = lambda p, k: number(_line(), p, k, "long")
    headed = lines.where(_line().rlike(_HEADED)).select(KEY, "line_no", found(_line(), _HEADED, 1).alias("address"), part(_HEADED, 2).alias("size_kb"), part(_HEADED, 3).alias("rss_kb"), part(_HEADED, 4).alias("dirty_kb"), found(_line(), _HEADED, 5).alias("mode"), F.regexp_extract(_line(), _HEADED, 6).alias("mapping"))
    none = F.lit(None).cast("long")
    plain = lines.where(_line().rlike(_PLAIN)).select(KEY, "line_no", found(_line(), _PLAIN, 1).alias("address"), part(_PLAIN, 2).alias("size_kb"), none.alias("rss_kb"), none.alias("dirty_kb"), found(_line(), _PLAIN, 3).alias("mode"), F.regexp_extract(_line(), _PLAIN, 4).alias("mapping"))
    rows = headed.unionByName(plain.join(headed.select(KEY).distinct(), KEY, "left_anti"))
    share = lambda c: F.when(F.col(c).isNotNull(), ratio(F.col(c), F.col("size_kb")))
    return rows.withColumns({"category": mapping_category(F.col("mapping")), "resident_ratio": share("rss_kb"), "reserved_gap_kb": F.when(F.col("rss_kb").isNotNull(), F.greatest(F.lit(0), F.col("size_kb") - F.col("rss_kb"))), "dirty_ratio": share("dirty_kb")})


def pmap_categories(lines: DataFrame) -> DataFrame:
    """artifact_id, category, n, size_kb, rss_kb, dirty_kb, resident_ratio, reserved_gap_kb."""
    sums = pmap(lines).groupBy(KEY, "category").agg(F.count("*").alias("n"), F.sum("size_kb").alias("size_kb"), F.sum("rss_kb").alias("rss_kb"), F.sum("dirty_kb").alias("dirty_kb"))
    return sums.withColumns({"resident_ratio": F.when(F.col("rss_kb").isNotNull(), ratio(F.col("rss_kb"), F.col("size_kb"))), "reserved_gap_kb": F.greatest(F.lit(0), F.col("size_kb") - F.col("rss_kb"))})


def pmap_summary(lines: DataFrame) -> DataFrame:
    """Totals (from the footer, else summed), shares of anonymous memory, the largest mappings, the top category by size."""
    anon = F.col("category") == "anon"
    rows = pmap(lines)
    sums = rows.groupBy(KEY).agg(
        F.count("*").alias("mapping_count"), F.sum("size_kb").alias("s"), F.sum("rss_kb").alias("r"), F.sum("dirty_kb").alias("d"), F.sum(F.when(anon, F.col("size_kb")).otherwise(0)).alias("anon_size_kb"), F.sum(F.when(anon, F.col("rss_kb"))).alias("anon_rss_kb"), F.sum(F.when(anon, F.col("dirty_kb"))).alias("anon_dirty_kb"),
        F.max("size_kb").alias("largest_mapping_kb"), F.max("rss_kb").alias("largest_resident_kb"), F.max(F.struct(F.col("rss_kb"), F.col("size_kb"))).alias("lr"),
    )
    headed, plain = r"^total kB\s+(\d+)\s+(\d+)\s+(\d+)", r"^\s*total\s+(\d+)K"
    footer = lines.where(_line().rlike(headed) | _line().rlike(plain)).groupBy(KEY).agg(F.max(F.coalesce(number(_line(), headed, 1, "long"), number(_line(), plain, 1, "long"))).alias("fs"), F.max(number(_line(), headed, 2, "long")).alias("fr"), F.max(number(_line(), headed, 3, "long")).alias("fd"))
    pid = lines.where(_line().rlike(r"^\d+:\s")).groupBy(KEY).agg(F.min(number(_line(), r"^(\d+):", 1, "long")).alias("pid"))
    top = dominant(rows, [KEY], "category", F.col("size_kb"), "line_no").select(KEY, F.col("category").alias("top_size_category"))
    out = sums.join(footer, KEY, "left").join(pid, KEY, "left").join(top, KEY, "left")
    out = out.withColumns({"total_size_kb": F.coalesce("fs", "s"), "total_rss_kb": F.coalesce("fr", "r"), "total_dirty_kb": F.coalesce("fd", "d"), "largest_resident_size_kb": F.col("lr.size_kb")}).drop("s", "r", "d", "fs", "fr", "fd", "lr")
    positive = lambda a, b: F.when(F.col(a) > 0, ratio(F.col(a), F.col(b))).otherwise(F.lit(0.0))
    out = out.withColumns({"rss_available": F.col("total_rss_kb").isNotNull(), "reserved_gap_kb": F.greatest(F.lit(0), F.col("total_size_kb") - F.col("total_rss_kb"))})
    return out.withColumns({"anon_virtual_share": positive("anon_size_kb", "total_size_kb"), "anon_resident_share": positive("anon_rss_kb", "total_rss_kb"), "anon_resident_ratio": positive("anon_rss_kb", "anon_size_kb"), "resident_ratio": positive("total_rss_kb", "total_size_kb"), "reserved_gap_ratio": positive("reserved_gap_kb", "total_size_kb")})


# --- native memory tracking ---

_CATEGORY = r"^-\s+(\S.*?)\s+\(reserved=(\d+)KB(?: ([+-]\d+)KB)?, committed=(\d+)KB(?: ([+-]\d+)KB)?"


def nmt_categories(lines: DataFrame) -> DataFrame:
    """artifact_id, category, reserved_kb, committed_kb and their changes (null in a plain summary); a repeated category: the last."""
    rows = lines.where(_line().rlike(_CATEGORY)).select(
        KEY, "line_no", F.regexp_extract(_line(), _CATEGORY, 1).alias("category"), number(_line(), _CATEGORY, 2, "long").alias("reserved_kb"), number(_line(), _CATEGORY, 3, "long").alias("reserved_delta_kb"), number(_line(), _CATEGORY, 4, "long").alias("committed_kb"), number(_line(), _CATEGORY, 5, "long").alias("committed_delta_kb")
    )
    return last_of(rows, [KEY, "category"], "line_no").drop("line_no")


def nmt_summary(lines: DataFrame) -> DataFrame:
    """Totals, classes, threads, stacks, metaspace and class space with changes, sums of some categories, snapshot_kind (summary or diff)."""
    after = section_of(lines, [KEY], F.when(_line().rlike(r"\(\s*Metadata"), "meta").when(_line().rlike(r"Class space"), "class").when(_line().startswith("-"), "none"))
    first = lambda p, k, where=F.lit(True): F.min_by(number(_line(), p, k, "long"), F.when(where & _line().rlike(p), F.col("line_no")))
    total, stack, pair, used = r"^Total: reserved=(\d+)KB(?: ([+-]\d+)KB)?, committed=(\d+)KB(?: ([+-]\d+)KB)?", r"\(stack: reserved=(\d+)KB(?: ([+-]\d+)KB)?, committed=(\d+)KB", r"reserved=(\d+)KB(?: [+-]\d+KB)?, committed=(\d+)KB(?: ([+-]\d+)KB)?", r"used=(\d+)KB(?: ([+-]\d+)KB)?"
    meta, space = F.col("section") == "meta", F.col("section") == "class"
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    base = after.groupBy(KEY).agg(
        first(total, 1).alias("reserved_kb"), zero(first(total, 2), "reserved_delta_kb"), first(total, 3).alias("committed_kb"), zero(first(total, 4), "committed_delta_kb"), F.max(_line().rlike(r"committed=\d+KB [+-]\d+KB")).alias("_diff"),
        zero(first(r"\(classes #(\d+)(?: ([+-]\d+))?", 1), "class_count"), zero(first(r"\(classes #(\d+)(?: ([+-]\d+))?", 2), "class_count_delta"), zero(first(r"\(thread #(\d+)", 1), "thread_count"), zero(first(stack, 1), "stack_reserved_kb"), zero(first(stack, 2), "stack_reserved_delta_kb"), zero(first(stack, 3), "stack_committed_kb"),
        zero(first(pair, 1, meta), "metaspace_reserved_kb"), zero(first(pair, 2, meta), "metaspace_committed_kb"), zero(first(used, 1, meta), "metaspace_used_kb"), zero(first(used, 2, meta), "metaspace_used_delta_kb"),
        zero(first(pair, 1, space), "class_space_reserved_kb"), zero(first(pair, 2, space), "class_space_committed_kb"), zero(first(used, 1, space), "class_space_used_kb"), zero(first(used, 2, space), "class_space_used_delta_kb"),
    )
    inner = F.col("category").isin("Internal", "Unknown", "Arena Chunk")
    native = ~F.col("category").isin("Java Heap", "Metaspace")
    pick = lambda name, c: F.coalesce(F.max(F.when(F.col("category") == name, F.col(c))), F.lit(0))
    sums = nmt_categories(lines).groupBy(KEY).agg(
        F.sum(F.when(inner, F.col("committed_kb")).otherwise(0)).alias("internal_committed_kb"), F.sum(F.when(inner, F.coalesce("committed_delta_kb", F.lit(0))).otherwise(0)).alias("internal_committed_delta_kb"),
        F.sum(F.when(native, F.col("reserved_kb")).otherwise(0)).alias("non_heap_reserved_kb"), F.sum(F.when(native, F.col("committed_kb")).otherwise(0)).alias("non_heap_committed_kb"),
        pick("Code", "committed_kb").alias("code_committed_kb"), pick("Code", "committed_delta_kb").alias("code_committed_delta_kb"), pick("Class", "committed_kb").alias("class_committed_kb"), pick("Class", "committed_delta_kb").alias("class_committed_delta_kb"), pick("GC", "committed_kb").alias("gc_committed_kb"),
    )
    out = base.join(sums, KEY, "left").withColumn("snapshot_kind", F.when(F.col("_diff"), "diff").otherwise("summary")).drop("_diff")
    return out.withColumns({"non_heap_gap_kb": F.greatest(F.lit(0), F.col("non_heap_reserved_kb") - F.col("non_heap_committed_kb")), "non_heap_commit_ratio": ratio(F.col("non_heap_committed_kb"), F.col("non_heap_reserved_kb"))})


# --- cgroup snapshot ---


def cgroup_values(lines: DataFrame) -> DataFrame:
    """artifact_id, section, key, value: a lone number has its section's name as key; ``max`` is null. Headers are [name], == name == or == name."""
    header = r"^\s*(?:\[([\w./-]+)\]|=+\s*([\w./-]+?)\s*=*)\s*$"
    name = F.coalesce(found(_line(), header, 1), found(_line(), header, 2))
    rows = section_of(lines, [KEY], name).where(F.col("section").isNotNull() & name.isNull())
    pair = r"^\s*([\w.]+)[ :=]+(\d+|max)\s*$"
    key, value = F.coalesce(found(_line(), pair, 1), F.col("section")), F.coalesce(found(_line(), pair, 2), found(_line(), r"^\s*(-?\d+|max)\s*$"))
    return rows.where(value.isNotNull()).select(KEY, "section", key.alias("key"), F.when(value != "max", value).cast("long").alias("value"))


def cgroup_pressure(lines: DataFrame) -> DataFrame:
    """artifact_id, section, kind (some, full), avg10, avg60, avg300, total."""
    p = r"^\s*(some|full) avg10=([\d.]+) avg60=([\d.]+) avg300=([\d.]+) total=(\d+)"
    header = r"^\s*(?:\[([\w./-]+)\]|=+\s*([\w./-]+?)\s*=*)\s*$"
    rows = section_of(lines, [KEY], F.coalesce(found(_line(), header, 1), found(_line(), header, 2))).where(_line().rlike(p))
    return rows.select(KEY, "section", found(_line(), p, 1).alias("kind"), number(_line(), p, 2).alias("avg10"), number(_line(), p, 3).alias("avg60"), number(_line(), p, 4).alias("avg300"), number(_line(), p, 5, "long").alias("total"))


def cpu_count(cpuset: Column) -> Column:
    """Number of CPUs in a set such as 0-3,8."""
    size = lambda r: F.when(r.contains("-"), F.split(r, "-")[1].try_cast("int") - F.split(r, "-")[0].try_cast("int") + 1).otherwise(F.when(r.rlike(r"^\d+$"), 1).otherwise(0))
    return F.aggregate(F.transform(F.split(F.trim(cpuset), r"\s*,\s*"), size), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def cgroup_summary(lines: DataFrame) -> DataFrame:
    """Use, limits, headroom, events, pressure and CPU ceiling of a snapshot of either version."""
    values, psi = cgroup_values(lines), cgroup_pressure(lines)
    get = lambda section, key=None: F.max(F.when((F.col("section") == section) & (F.col("key") == (key or section)), F.col("value")))
    there = lambda section: F.max(F.col("section") == section)
    zero = lambda c: F.coalesce(c, F.lit(0))
    v = values.groupBy(KEY).agg(
        zero(F.coalesce(get("memory.current"), get("memory.usage_in_bytes"))).alias("current_bytes"), F.coalesce(get("memory.max"), get("memory.limit_in_bytes")).alias("max_bytes"), get("memory.high").alias("high_bytes"),
        *(zero(get("memory.events", k)).alias(f"{k}_events") for k in ("high", "max", "oom", "oom_kill")), zero(get("memory.failcnt")).alias("failcnt"),
        *(zero(get("memory.stat", k)).alias(f"{k}_bytes") for k in ("anon", "file", "slab", "kernel")), there("memory.max").alias("v2"),
        zero(get("cpu.stat", "nr_periods")).alias("periods"), zero(get("cpu.stat", "nr_throttled")).alias("throttled"), zero(F.coalesce(get("cpu.stat", "throttled_usec") / 1000, get("cpu.stat", "throttled_time") / 1000000)).cast("long").alias("throttled_ms"),
        get("cpu.cfs_quota_us").alias("quota_v1"), get("cpu.cfs_period_us").alias("period_v1"),
    )
    avg = lambda section, kind, c: zero(F.max(F.when((F.col("section") == section) & (F.col("kind") == kind), F.col(c)))).alias(f"{section.split('.')[0]}_{kind}_{c}")
    p = psi.groupBy(KEY).agg(*(avg(s, k, c) for s in ("memory.pressure", "cpu.pressure") for k in ("some", "full") for c in ("avg10", "avg60")))
    quota = r"^\s*(\d+|max) (\d+)\s*$"
    header = r"^\s*(?:\[([\w./-]+)\]|=+\s*([\w./-]+?)\s*=*)\s*$"
    named = section_of(lines, [KEY], F.coalesce(found(_line(), header, 1), found(_line(), header, 2)))
    q = named.groupBy(KEY).agg(F.max(F.when((F.col("section") == "cpu.max") & _line().rlike(quota), number(_line(), quota, 1))).alias("quota_us"), F.max(F.when((F.col("section") == "cpu.max") & _line().rlike(quota), number(_line(), quota, 2))).alias("period_us"), F.max(F.when((F.col("section") == "cpuset.cpus.effective") & _line().rlike(r"^\s*\d[\d,-]*\s*$"), cpu_count(_line()))).alias("cpus"))
    out = v.join(p, KEY, "left").join(q, KEY, "left").fillna(0.0, [f"{s}_{k}_{c}" for s in ("memory", "cpu") for k in ("some", "full") for c in ("avg10", "avg60")])
    quota_us, period = F.coalesce("quota_us", F.when(F.col("quota_v1") > 0, F.col("quota_v1"))), F.coalesce("period_us", F.col("period_v1"))
    cores = F.when(period > 0, quota_us / period)
    unlimited = F.col("max_bytes") >= F.lit(1 << 60)
    out = out.withColumn("max_bytes", F.when(~unlimited, F.col("max_bytes")))
    return out.withColumns({
        "max_defined": F.col("max_bytes").isNotNull(), "high_defined": F.col("high_bytes").isNotNull(), "headroom_to_max_bytes": F.greatest(F.lit(0), F.col("max_bytes") - F.col("current_bytes")), "usage_of_max_ratio": ratio(F.col("current_bytes"), F.col("max_bytes")), "usage_of_high_ratio": ratio(F.col("current_bytes"), F.col("high_bytes")),
        "max_events": F.greatest("max_events", "failcnt"), "quota_cores": cores, "cpu_ceiling_cores": zero(F.least(cores, F.when(F.col("cpus") > 0, F.col("cpus").cast("double")))), "throttled_ratio": ratio(F.col("throttled"), F.col("periods")),
    }).drop("failcnt", "quota_v1", "period_v1")


