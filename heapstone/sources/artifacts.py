"""Reading diagnostic artifacts: whole files, their kind, their lines, an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapstone.operators.context import lines as split_lines

#: Kinds of artifacts, and other names that they go by.
KINDS = ("GC_LOG", "JFR", "THREAD_DUMP", "HS_ERR_LOG", "NMT", "HEAP_HISTOGRAM", "PMAP", "CONTAINER_MEMORY", "OOM_SIGNAL")
ALIASES = {"HS_ERR": "HS_ERR_LOG", "NMT_MEMORY": "NMT", "PMAP_OUTPUT": "PMAP"}
#: Files of a cgroup folder that make one artifact, in the order they are joined.
CGROUP_FILES = (
    "memory.current", "memory.max", "memory.high", "memory.events", "memory.stat", "memory.pressure", "cpu.max", "cpu.stat", "cpu.pressure", "cpuset.cpus.effective",
    "memory.usage_in_bytes", "memory.limit_in_bytes", "memory.failcnt", "memory.oom_control", "cpu.cfs_quota_us", "cpu.cfs_period_us",
)


def kind_named(name: str) -> str:
    """A kind by its name or alias, whatever the case and separators; UNKNOWN if there is none."""
    plain = name.strip().upper().replace("-", "_").replace(".", "_")
    plain = ALIASES.get(plain, plain)
    return plain if plain in KINDS else "UNKNOWN"


def artifact_type(content: Column, name: Column) -> Column:
    """The kind of a file from its content and name: ordered tests, the first that holds wins."""
    low = F.lower(content)
    has = lambda *texts: F.coalesce(sum((low.contains(x).cast("int") for x in texts), F.lit(0)), F.lit(0)) > 0
    all_of = lambda *texts: F.coalesce(sum((low.contains(x).cast("int") for x in texts), F.lit(0)), F.lit(0)) == len(texts)
    kernel = F.coalesce(content.rlike(r"(?im)killed process \d+|oom-kill:|invoked oom-killer|oom_reaper"), F.lit(False))
    oom = kernel | has("oomkilled") | all_of("crashloopbackoff", "restart count", "last state")
    version_2 = all_of("[memory.current]", "[memory.events]") & has("[memory.stat]", "[memory.pressure]", "[memory.max]", "[memory.high]")
    version_1 = all_of("[memory.usage_in_bytes]", "[memory.stat]") & has("[memory.limit_in_bytes]", "[memory.soft_limit_in_bytes]", "[memory.failcnt]", "[memory.oom_control]")
    header = F.coalesce(content.rlike(r'(?m)^"[^"]+".*\bnid='), F.lit(False))
    crash = has("a fatal error has been detected", "there is insufficient memory for the java runtime environment", "native memory allocation (malloc) failed") | all_of("#", "possible reasons:", "possible solutions:")
    dump = has("full thread dump", "found one java-level deadlock", "java-level deadlock:") | has("java.lang.thread.state:") & header
    nmt = has("native memory tracking") | all_of("total:", "reserved=", "committed=") | all_of("-java heap", "-class")
    pmap = all_of("address", "kbytes", "rss") | has("total kb") | has("[ anon ]") & has("rw---", "r-x--", "-----")
    return (
        F.when(F.lower(name).endswith(".jfr"), "JFR")
        .when(F.coalesce(content, F.lit("")) == "", "UNKNOWN")
        .when(crash, "HS_ERR_LOG")
        .when(dump, "THREAD_DUMP")
        .when(oom, "OOM_SIGNAL")
        .when(version_2 | version_1, "CONTAINER_MEMORY")
        .when(nmt, "NMT")
        .when(all_of("#instances", "#bytes") | all_of("num", "#instances", "class name"), "HEAP_HISTOGRAM")
        .when(pmap, "PMAP")
        .when(has("gc(", "[gc", "full gc", "young generation", "old generation"), "GC_LOG")
        .otherwise("UNKNOWN")
    )


def read_artifacts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """artifact_id (the path), name, type, content, content_length for every file under ``path``. A given kind replaces the classification.

    A file is one row, as kinds are told from whole contents; logs that may outgrow a row are read by ``read_lines``.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("artifact_id"), F.col("value").alias("content"))
    name = F.element_at(F.split("artifact_id", "/"), -1)
    found = F.lit(kind_named(kind)) if kind else artifact_type(F.col("content"), name)
    return files.select("artifact_id", name.alias("name"), found.alias("type"), "content", F.length("content").cast("long").alias("content_length"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """artifact_id, line_no (from 1), line of every file under ``path``, read in blocks: a large file is the work of many tasks, and never one row.

    Lines are numbered within each block of a file; the blocks' counts, a few rows, are summed up for where each begins.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("artifact_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    block = ["artifact_id", "_block"]
    earlier = Window.partitionBy("artifact_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*block).agg(F.count("*").alias("_n")).select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_id"))
    return rows.join(starts, block).select("artifact_id", (F.col("_start") + inside).cast("int").alias("line_no"), "line")


def with_cgroup_groups(artifacts: DataFrame) -> DataFrame:
    """Files of one cgroup folder joined to one artifact of that kind, in a fixed order, each under a ``[file]`` header.

    A folder qualifies with its usage and a limit (either version). A folder has at most as many such files as there are names.
    """
    folder = F.regexp_extract("artifact_id", "^(.*)/[^/]*$", 1)
    order = F.array_position(F.array(*map(F.lit, CGROUP_FILES)), F.col("name"))
    members = artifacts.withColumn("_folder", folder).withColumn("_order", order)
    piece = F.struct("_order", F.concat(F.lit("["), "name", F.lit("]\n"), F.col("content")).alias("text"))
    grouped = members.where("_order > 0").groupBy("_folder").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.collect_set("name").alias("names"))
    fits = (F.array_contains("names", "memory.current") & F.arrays_overlap("names", F.array(F.lit("memory.max"), F.lit("memory.high")))) | (F.array_contains("names", "memory.usage_in_bytes") & F.array_contains("names", "memory.limit_in_bytes"))
    joined = grouped.where(fits)
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    made = joined.select(F.col("_folder").alias("artifact_id"), F.element_at(F.split("_folder", "/"), -1).alias("name"), F.lit("CONTAINER_MEMORY").alias("type"), text.alias("content")).withColumn("content_length", F.length("content").cast("long"))
    rest = members.join(joined.select("_folder", F.lit(True).alias("_made")), "_folder", "left").where("_made IS NULL OR _order = 0").select(*artifacts.columns)
    return rest.unionByName(made.select(*artifacts.columns))


def inventory(artifacts: DataFrame) -> DataFrame:
    """One row for each file: whether its kind is known."""
    known = F.when(F.col("type") == "UNKNOWN", "UNSUPPORTED").otherwise("SUPPORTED")
    return artifacts.select("artifact_id", "name", "type", known.alias("status"), "content_length")


def of_kind(artifacts: DataFrame, kind: str) -> DataFrame:
    return artifacts.where(F.col("type") == kind)


def artifact_lines(artifacts: DataFrame) -> DataFrame:
    """artifact_id, line_no (from 1), line."""
    return split_lines(artifacts, ["artifact_id"], "content")
