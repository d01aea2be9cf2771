"""Queries of retrieval, focused views of recordings and snapshots, alignments and snapshot ordering, over rendered artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators import retrieval
from heapstone.operators.context import Selector
from heapstone.parse import gc, jfr, memory
from heapstone.plans import rendered as r
from heapstone.plans.base import query, table
from heapstone.plans.parsed import _GROWTH, _HISTOGRAM, _HOTSPOTS, _JFR, _NMT, _SUMMARY, _WINDOWS, _gc_summary, _timeline
from heapstone.plans.texts import _LINES
from heapstone.rulebook import alignment, digests
from heapstone.sources import ordering
from heapstone.views import compute
from heapstone.views import jfr as slices
from heapstone.views import snapshots

# --- retrieval ---


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heapstone.operators.context import lines

    return lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "text"), ["artifact_id"], "text")


_DOCS = f"l AS (SELECT doc_id AS artifact_id, line_no, line FROM {_LINES}), ends AS (SELECT artifact_id, max(line_no) AS last FROM l GROUP BY 1)"
#: Ranges in table x (artifact_id, a, b), merged where they overlap or follow each other.
_MERGE = """y AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY artifact_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, false)::INT AS brk FROM x), z AS (SELECT *, sum(brk) OVER (PARTITION BY artifact_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM y),
 m AS (SELECT artifact_id, min(a) AS first_line, max(b) AS last_line, count(*) AS n FROM z GROUP BY artifact_id, g)"""


@query(f"""WITH {_DOCS}, x AS (SELECT artifact_id, greatest(1, line_no - 5) AS a, least(last, line_no + 5) AS b FROM l JOIN ends USING (artifact_id) WHERE contains(lower(line), 'the')), {_MERGE}
 SELECT artifact_id, first_line::INT AS first_line, last_line::INT AS last_line, n FROM m""")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines to each side of every line that holds a word, merged."""
    lines = _documents(spark, sf_dir)
    return retrieval.evidence_windows(lines.where(F.lower("line").contains("the")).select("artifact_id", "line_no"), lines)


@query(f"""WITH {_DOCS}, f AS (SELECT artifact_id, min(line_no) FILTER (contains(lower(line), 'and')) AS a, max(line_no) FILTER (contains(lower(line), 'tion')) AS b, max(line_no) AS last FROM l GROUP BY 1 HAVING a IS NOT NULL OR b IS NOT NULL)
 SELECT artifact_id, greatest(1, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE coalesce(a, b) - 5 END)::INT AS first_line, least(last, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) ELSE coalesce(a, b) + 10 END)::INT AS last_line FROM f""")
def raw_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first line with one token to the last with another."""
    return retrieval.time_span(_documents(spark, sf_dir), "and", "TION")


@query(f"""WITH {_DOCS}, p AS (SELECT artifact_id, last, unnest([1, last, (last + 1) // 2, 1, floor(0.25 * (last - 1) + 0.5)::BIGINT + 1, floor(0.5 * (last - 1) + 0.5)::BIGINT + 1, floor(0.75 * (last - 1) + 0.5)::BIGINT + 1, last]) AS line_no FROM ends) SELECT DISTINCT artifact_id, line_no::INT AS line_no FROM p""")
def broad_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle, last and five evenly spaced lines of each text."""
    return retrieval.anchors(_documents(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT artifact_id, sum(length(line) + 1)::BIGINT - 1 AS chars, count(*) AS n_lines, sum(length(line) + 1) - 1 <= 16000 AND count(*) <= 160 AS small FROM l GROUP BY 1")
def small_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are short enough to be shown whole."""
    return retrieval.is_small(_documents(spark, sf_dir))


@query(f"""WITH {_DOCS}, x AS (SELECT artifact_id, greatest(1, line_no - 5) AS a, least(last, line_no + 5) AS b FROM l JOIN ends USING (artifact_id) WHERE contains(lower(line), 'tion the')), {_MERGE},
 s AS (SELECT artifact_id, 'evidence-' || lpad((row_number() OVER (PARTITION BY artifact_id ORDER BY first_line))::VARCHAR, 3, '0') AS slice_id, 'evidence' AS kind, first_line, last_line, 0 AS o FROM m
  UNION ALL SELECT artifact_id, 'raw-chunk-' || lpad(((line_no - 1) // 24 + 1)::VARCHAR, 3, '0'), 'raw', min(line_no), max(line_no), 1 FROM l GROUP BY artifact_id, (line_no - 1) // 24)
 SELECT artifact_id, slice_id, kind, first_line::INT AS first_line, last_line::INT AS last_line, row_number() OVER (PARTITION BY artifact_id ORDER BY o, first_line, slice_id)::INT AS ordinal FROM s""")
def slice_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each text: evidence windows, then raw chunks, in order."""
    lines = _documents(spark, sf_dir)
    return retrieval.index(lines, lines.where(F.lower("line").contains("tion the")).select("artifact_id", "line_no"))


@query(f"""WITH {r.GC_SQL}, ends AS (SELECT artifact_id, max(line_no) AS last FROM q GROUP BY 1), x AS (SELECT artifact_id, greatest(1, line_no - 2) AS a, least(last, line_no + 2) AS b FROM p JOIN ends USING (artifact_id) WHERE cause = 'Metadata GC Threshold'), {_MERGE}
 SELECT artifact_id, first_line::INT AS first_line, last_line::INT AS last_line FROM m QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY first_line) <= 3""")
def gc_event_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three raw windows around the pauses that ``cause=metadata`` asks for."""
    lines = r.gc_lines(spark, sf_dir)
    empty = spark.createDataFrame([], "artifact_id string, slice_id string, kind string, first_line int, last_line int, ordinal int")
    return retrieval.retrieve(lines, empty, gc.stored_events(lines), Selector.parse("cause=metadata"))[1]


@query(f"""WITH {r.GC_SQL} SELECT artifact_id, count(*) AS n, max(pause_ms) AS max_ms, quantile_disc(pause_ms, 0.5) AS p50_ms, quantile_disc(pause_ms, 0.95) AS p95_ms, quantile_disc(pause_ms, 0.99) AS p99_ms FROM p WHERE c > 0 GROUP BY 1""")
def gc_default_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request without any trigger gets: percentiles of pauses above 0."""
    return compute.compute("GC_LOG", compute.Source(lines=r.gc_lines(spark, sf_dir)), "how long were the stops?")[1]


# --- recordings ---

_RANK = """sums AS (SELECT artifact_id, key, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, sum(size_bytes)::BIGINT AS bytes FROM f WHERE key IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT *, n / (sum(n) OVER w)::DOUBLE AS share, CASE WHEN sum(total_ms) OVER w > 0 THEN total_ms / (sum(total_ms) OVER w)::DOUBLE ELSE 0.0 END AS time_share, CASE WHEN sum(bytes) OVER w > 0 THEN bytes / (sum(bytes) OVER w)::DOUBLE ELSE 0.0 END AS byte_share, row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, bytes DESC, total_ms DESC, key)::INT AS position FROM sums WINDOW w AS (PARTITION BY artifact_id))
 SELECT artifact_id, position, key, n, total_ms, bytes, share, time_share, byte_share FROM u WHERE position <= 8"""


@query(f"WITH {_JFR}, f AS (SELECT *, class_name AS key FROM j WHERE thread = 't1'), {_RANK}")
def jfr_thread_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of one thread's events, ranked with their shares."""
    return slices.ranked(slices.by_thread(_timeline(spark, sf_dir), "T1"), "class_name")


@query(f"WITH {_JFR}, f AS (SELECT *, thread AS key FROM j WHERE signal_family = 'lockContention'), {_RANK}")
def jfr_family_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the family that goes by ``locks``, ranked with their shares."""
    return slices.ranked(slices.by_family(_timeline(spark, sf_dir), "locks"), "thread")


@query(f"""WITH {_JFR}, lo AS (SELECT artifact_id, min(start_us) + 86400000000 AS a, min(start_us) + 864000000000 AS b FROM j GROUP BY 1), f AS (SELECT j.*, signal_family AS key FROM j JOIN lo USING (artifact_id) WHERE start_us <= b AND end_us >= a), {_RANK}""")
def jfr_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the events in a window given as offsets from the recording's start."""
    return slices.ranked(slices.time_window(_timeline(spark, sf_dir), Selector.parse("start=864000s, end=86400s")), "signal_family")


@query(f"""WITH {_WINDOWS}, i AS (SELECT top.artifact_id, top.window_id, signal_family, duration_ms, size_bytes FROM top JOIN j ON j.artifact_id = top.artifact_id AND j.start_us <= top.end_us + 250000 AND j.end_us >= top.start_us - 250000 WHERE top.focus = 'runtime')
 SELECT artifact_id, window_id, signal_family, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, sum(size_bytes)::BIGINT AS bytes FROM i GROUP BY 1, 2, 3""")
def jfr_incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the runtime incident of each recording, by family."""
    return slices.incident(_timeline(spark, sf_dir), "runtime")


@query(f"""WITH {_JFR}, c AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM j WHERE signal_family = 'allocation' GROUP BY 1)
 SELECT artifact_id, field, n AS present, 1.0::DOUBLE AS share FROM c, (SELECT unnest(['startTime', 'thread', 'className', 'bytes']) AS field)""")
def jfr_type_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields the events of one type hold."""
    return slices.type_detail(r.recording(spark, sf_dir), "jdk.ObjectAllocationSample").select("artifact_id", "field", "present", "share")


# --- snapshots ---


@query(f"WITH {_HISTOGRAM} SELECT artifact_id, position, class_name, bytes, instances FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY bytes DESC, rank)::INT AS position FROM f) WHERE position <= 10")
def histogram_top_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest classes of each histogram."""
    return snapshots.top_consumers(r.histogram_lines(spark, sf_dir))


@query(f"""WITH {_GROWTH}, lasts AS (SELECT artifact_id, class_name, bytes, instances FROM f QUALIFY row_number() OVER (PARTITION BY artifact_id, class_name ORDER BY rank DESC) = 1),
 d AS (SELECT pair_id, c.class_name, c.bytes - coalesce(b.bytes, 0) AS growth_bytes, c.instances - coalesce(b.instances, 0) AS growth_instances FROM pairs JOIN lasts c ON c.artifact_id = 'h-' || (pair_id + 1) LEFT JOIN lasts b ON b.artifact_id = 'h-' || pair_id AND b.class_name = c.class_name)
 SELECT pair_id, position, class_name, growth_bytes, growth_instances FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY growth_bytes DESC, class_name)::INT AS position FROM d WHERE growth_bytes > 0) WHERE position <= 10""")
def histogram_growth_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten classes that grew most from one histogram to the next."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    pairs = sizes.join(sizes.select((F.col("p_size") - 1).alias("p_size")), "p_size", "left_semi").select(F.col("p_size").alias("pair_id"), F.concat(F.lit("h-"), "p_size").alias("baseline_id"), F.concat(F.lit("h-"), F.col("p_size") + 1).alias("current_id"))
    return snapshots.growth_ranking(pairs, memory.histogram(r.histogram_lines(spark, sf_dir)))


@query(f"WITH {_NMT}, c AS (SELECT 'n-' || nation AS artifact_id, {r.names_sql(r._NMT, 'g')} AS category, 8 * b AS gap_kb, b / (9 * b)::DOUBLE AS commit_ratio FROM g WHERE g <> 0 AND b > 0) SELECT artifact_id, category, gap_kb, commit_ratio, position FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY gap_kb DESC, category)::INT AS position FROM c) WHERE position <= 5")
def nmt_reservation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five native categories with most reserved but uncommitted memory."""
    return snapshots.reservation_gaps(r.nmt_lines(spark, sf_dir))


@query(f"WITH {_HOTSPOTS} SELECT artifact_id, position, monitor, waiters, waiters AS blocked, owner FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY waiters DESC, monitor)::INT AS position FROM waits LEFT JOIN owners USING (artifact_id, monitor)) WHERE position <= 6")
def thread_blocked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most contended monitors of each dump."""
    return snapshots.blocked_clusters(r.dump_lines(spark, sf_dir))


# --- alignments and ordering ---

_KINDS = tuple((short, tuple(name for name, _ in alignment.FAMILIES[kind])) for kind, short in alignment.SHORT.items())
_STATUS = (alignment.OVERLAP, alignment.NEARBY, alignment.APART, alignment.NO_CLOCK)


def _wide_sql() -> str:
    parts = []
    for a, (short, names) in enumerate(_KINDS):
        dealt = ", ".join(f"CASE WHEN (k * 31 + {i} * 17 + {a} * 7 + k // 11) % 5 < 3 THEN '{name}' END" for i, name in enumerate(names))
        parts.append(f"CASE WHEN (k + {a}) % 7 <> 0 THEN list_filter([{dealt}], lambda x: x IS NOT NULL) END AS {short}_families")
    for c, clock in enumerate(alignment.CLOCKS):
        parts.append(f"CASE WHEN (k * 13 + {c} * 5) % 5 < 4 THEN list_element([{', '.join(repr(s) for s in _STATUS)}], ((k * 13 + {c} * 5) % 5 + 1)::INT) END AS t_{clock}")
    for short in ("jfr", "dump", "heap"):
        for w, what in enumerate(alignment.IDENTITIES):
            parts.append(f"['{what}' || ((k + {len(short)}) % {3 + w}), '{what}' || (k * {len(short)} % {4 + w})] AS {short}_{what}")
    return f"SELECT c_custkey AS incident, {', '.join(parts)}, k % 3 = 0 AS dump_blocked_pools, k % 4 = 0 AS nmt_gap_categories FROM (SELECT c_custkey, c_custkey AS k FROM customer)"


def _hit(kind: str, *names: str) -> str:
    return f"coalesce(list_has_any({kind}_families, [{', '.join(repr(n) for n in names)}]), false)"


def _both(what: str, a: str = "jfr", b: str = "dump") -> str:
    return f"list_has_any({a}_{what}, {b}_{what})"


def _clock(clock: str, base: str, overlap: int, nearby: int = 0, apart: int = 0, floor: int = 58) -> str:
    return f"CASE t_{clock} WHEN 'ABSOLUTE_OVERLAP' THEN {base} + {overlap} WHEN 'ABSOLUTE_SEQUENCE_NEARBY' THEN {base} + {nearby} WHEN 'ABSOLUTE_NO_OVERLAP' THEN {f'greatest({floor}, {base} - {apart})' if apart else base} ELSE {base} END"


_CRASH_CODE, _NMT_CODE = _hit("crash", "code-cache-pressure"), _hit("nmt", "code-cache-pressure")
_META = f"(CASE WHEN {_hit('gc', 'metaspace-pressure')} THEN 82 ELSE 76 END)"
_SCORES = (
    ("jfr-gc-pressure-alignment", f"{_hit('gc', 'gc-distress')} AND {_hit('jfr', *alignment.HEAP_SIDE)}", _clock("jfr_gc", "80", 8)),
    ("jfr-metaspace-class-pressure-alignment", f"{_hit('jfr', 'class-loading-pressure')} AND {_hit('nmt', 'metaspace-pressure')}", f"{_META} + CASE WHEN t_jfr_gc = 'ABSOLUTE_OVERLAP' THEN 8 WHEN t_jfr_gc = 'ABSOLUTE_NO_OVERLAP' THEN -4 WHEN t_nmt = 'ABSOLUTE_OVERLAP' THEN 4 WHEN t_nmt = 'ABSOLUTE_NO_OVERLAP' THEN -2 ELSE 0 END"),
    ("jfr-code-cache-pressure-alignment", f"{_hit('jfr', 'code-cache-pressure')} AND ({_CRASH_CODE} OR {_NMT_CODE})", f"CASE WHEN {_CRASH_CODE} AND {_NMT_CODE} THEN 86 WHEN {_CRASH_CODE} THEN 80 ELSE 76 END + CASE t_nmt WHEN 'ABSOLUTE_OVERLAP' THEN 4 WHEN 'ABSOLUTE_NO_OVERLAP' THEN -2 ELSE 0 END + CASE WHEN t_crash_native = 'ABSOLUTE_SEQUENCE_NEARBY' THEN 2 ELSE 0 END"),
    ("jfr-thread-dump-contention-alignment", f"{_hit('jfr', 'lock-contention')} AND {_hit('dump', 'lock-contention')}", _clock("dump", f"(84 + {' + '.join(f'CASE WHEN {_both(w)} THEN {p} ELSE 0 END' for w, p in (('threads', 6), ('pools', 4), ('frames', 4), ('locks', 4)))})", 8, 0, 12)),
    ("jfr-heap-class-overlap", f"{_both('classes', 'jfr', 'heap')} OR {_both('groups', 'jfr', 'heap')}", _clock("heap", f"(CASE WHEN {_both('classes', 'jfr', 'heap')} THEN 90 ELSE 75 END)", 8, 0, 12)),
    ("thread-dump-nmt-thread-pressure-alignment", f"{_hit('dump', 'thread-pool-pressure', 'lock-contention')} AND {_hit('nmt', 'thread-pressure')}", _clock("dump_nmt", f"(82 + CASE WHEN dump_blocked_pools THEN 4 ELSE 0 END + CASE WHEN {_hit('dump', 'lock-contention')} THEN 3 ELSE 0 END)", 8, 4, 12)),
    ("nmt-pmap-reservation-mismatch-alignment", f"{_hit('nmt', 'reservation-mismatch')} AND {_hit('pmap', 'reservation-mismatch')}", _clock("nmt_pmap", "(84 + CASE WHEN nmt_gap_categories THEN 3 ELSE 0 END)", 8, 4, 12)),
    ("hs-err-native-pressure-alignment", f"{_hit('crash', 'native-pressure')} AND ({_hit('nmt', 'native-pressure')} OR {_hit('pmap', 'native-pressure')})", _clock("crash_native", f"(82 + CASE WHEN {_hit('nmt', 'native-pressure')} AND {_hit('pmap', 'native-pressure')} THEN 4 ELSE 0 END)", 8, 5, 10, 56)),
    ("compressed-class-space-pressure-alignment", f"{_hit('crash', 'compressed-class-space-pressure')} AND {_hit('nmt', 'compressed-class-space-pressure')}", _clock("crash_native", "88", 6, 4, 10, 68)),
    ("container-oom-pressure-alignment", f"{_hit('container', 'container-pressure')} AND {_hit('oom', 'oom-termination')}", _clock("container_oom", "88", 8, 5, 14)),
    ("jfr-gc-heap-pressure-alignment", f"{_hit('gc', 'gc-distress')} AND {_hit('heap', 'retention-pressure')} AND {_hit('jfr', 'allocation-pressure', 'retention-pressure')} AND coalesce(t_jfr_gc, '') <> 'ABSOLUTE_NO_OVERLAP' AND coalesce(t_heap, '') <> 'ABSOLUTE_NO_OVERLAP'", f"CASE WHEN {_both('classes', 'jfr', 'heap')} THEN 100 ELSE 92 END + CASE WHEN t_jfr_gc = 'ABSOLUTE_OVERLAP' THEN 5 ELSE 0 END + CASE WHEN t_heap = 'ABSOLUTE_OVERLAP' THEN 4 ELSE 0 END"),
    ("jfr-native-pressure-alignment", f"(nmt_families IS NOT NULL OR pmap_families IS NOT NULL) AND {_hit('jfr', *alignment.HEAP_SIDE)}", _clock("nmt", "(CASE WHEN gc_families IS NOT NULL THEN 72 ELSE 68 END)", 8, 0, 8, 56)),
)
_ALIGNED = " UNION ALL ".join(f"SELECT incident, '{name}' AS alignment, ({score})::INT AS score FROM w WHERE {test}" for name, test, score in _SCORES)


@query(f"WITH w AS ({_wide_sql()}), a AS ({_ALIGNED}) SELECT incident, alignment, score, position FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, alignment)::INT AS position FROM a) WHERE position <= 10")
def signal_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of each customer's incident; families, identities and clocks are dealt by a fixed rule of the key."""
    k = F.col("c_custkey")
    columns = {}
    for a, (short, names) in enumerate(_KINDS):
        dealt = F.array(*(F.when((k * 31 + i * 17 + a * 7 + F.floor(k / 11)) % 5 < 3, F.lit(name)) for i, name in enumerate(names)))
        columns[f"{short}_families"] = F.when((k + a) % 7 != 0, F.filter(dealt, lambda x: x.isNotNull()))
    for c, clock in enumerate(alignment.CLOCKS):
        columns[f"t_{clock}"] = F.when((k * 13 + c * 5) % 5 < 4, F.element_at(F.array(*map(F.lit, _STATUS)), ((k * 13 + c * 5) % 5 + 1).cast("int")))
    for short in ("jfr", "dump", "heap"):
        for w, what in enumerate(alignment.IDENTITIES):
            columns[f"{short}_{what}"] = F.array(F.concat(F.lit(what), (k + len(short)) % (3 + w)), F.concat(F.lit(what), k * len(short) % (4 + w)))
    wide = table(spark, sf_dir, "customer").select(k.alias("incident"), *(c.alias(n) for n, c in columns.items()), (k % 3 == 0).alias("dump_blocked_pools"), (k % 4 == 0).alias("nmt_gap_categories"))
    return alignment.alignments(wide, ["incident"])


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS captured, CASE WHEN o_custkey % 3 = 1 THEN 'dump-' || strftime(o_orderdate, '%Y-%m-%d') || '.txt' ELSE 'dump.txt' END AS name, o_orderkey * 7919 % 1000 AS modified FROM orders),
 d AS (SELECT *, CASE WHEN count(captured) OVER w = count(*) OVER w AND min(captured) OVER w <> max(captured) OVER w THEN 'capture-time' WHEN g % 3 = 1 AND min(name) OVER w <> max(name) OVER w THEN 'filename-time' WHEN min(modified) OVER w <> max(modified) OVER w THEN 'modified-time' ELSE 'input' END AS basis FROM o WINDOW w AS (PARTITION BY g))
 SELECT g, k, basis, row_number() OVER (PARTITION BY g ORDER BY CASE basis WHEN 'capture-time' THEN epoch_us(captured) WHEN 'filename-time' THEN epoch_us(strptime(name[6:15], '%Y-%m-%d')) WHEN 'modified-time' THEN modified ELSE 0 END, k)::INT AS position FROM d""")
def snapshot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each customer ordered by the best evidence: capture time, a date in the name, time of change, input order."""
    k = F.col("o_custkey")
    named = F.when(k % 3 == 1, F.concat(F.lit("dump-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".txt"))).otherwise("dump.txt")
    rows = table(spark, sf_dir, "orders").select(k.alias("g"), F.col("o_orderkey").alias("k"), F.when(k % 3 == 0, F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")).alias("captured_us"), named.alias("name"), (F.col("o_orderkey") * 7919 % 1000).alias("modified_us"))
    return ordering.ordered(rows, ["g"], "k")


# --- digests of pairs ---


def _next_thread(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    both = users.join(users.select((F.col("user_id") - 1).alias("user_id")), "user_id", "left_semi")
    return both.select(F.col("user_id").alias("pair_id"), F.concat(F.lit(f"{prefix}-"), "user_id").alias("baseline_id"), F.concat(F.lit(f"{prefix}-"), F.col("user_id") + 1).alias("current_id"))


_PAIRS = "pairs AS (SELECT user_id AS pair_id FROM events WHERE user_id + 1 IN (SELECT user_id FROM events) GROUP BY 1)"


def _two_sides(source: str, key: str, prefix: str) -> str:
    side = lambda p, at: f"{p} AS (SELECT pair_id, s.* FROM pairs JOIN {source} s ON s.artifact_id = '{prefix}-' || ({at}))"
    return f"{_PAIRS}, {side('cur', 'pair_id + 1')}, {side('base', 'pair_id')}, j2 AS (SELECT coalesce(cur.pair_id, base.pair_id) AS pair_id, coalesce(cur.{key}, base.{key}) AS key, cur, base FROM cur FULL JOIN base ON cur.pair_id = base.pair_id AND cur.{key} = base.{key})"


def _delta_sql(measures: tuple[str, ...]) -> str:
    return ", ".join(f"coalesce(cur.{m}, 0) AS current_{m}, coalesce(base.{m}, 0) AS baseline_{m}, coalesce(cur.{m}, 0) - coalesce(base.{m}, 0) AS delta_{m}" for m in measures)


@query(f"WITH {r.GC_SQL}, mix AS (SELECT artifact_id, cause, count(*) AS n, sum(c * 10)::BIGINT AS total_us FROM p GROUP BY 1, 2), {_two_sides('mix', 'cause', 'gc')} SELECT pair_id, key AS cause, {_delta_sql(('n', 'total_us'))} FROM j2")
def gc_cause_mix_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of pauses in each log against the next thread's."""
    return digests.cause_mix(_next_thread(spark, sf_dir, "gc"), gc.pauses(r.gc_lines(spark, sf_dir)))


_TREND = f"""{_JFR}, len AS (SELECT artifact_id, greatest(1.0, (max(end_us) - min(start_us)) / 1000.0::DOUBLE) AS ms FROM j GROUP BY 1),
 rated AS (SELECT artifact_id, signal_family, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, sum(size_bytes)::BIGINT AS bytes, count(*) * 60000 / any_value(ms) AS rate, 100 * sum(duration_ms)::BIGINT / any_value(ms) AS share, sum(size_bytes)::BIGINT * 1000 / any_value(ms) AS bps FROM j JOIN len USING (artifact_id) GROUP BY 1, 2), {_two_sides('rated', 'signal_family', 'j')}"""


@query(f"""WITH {_TREND} SELECT pair_id, key, {_delta_sql(("n", "total_ms", "bytes"))}, round(greatest(0.0, coalesce(cur.rate, 0) - coalesce(base.rate, 0)) + 2 * greatest(0.0, coalesce(cur.share, 0) - coalesce(base.share, 0)) + greatest(0.0, coalesce(cur.bps, 0) - coalesce(base.bps, 0)) / 1e6, 6) AS score FROM j2""")
def jfr_family_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each recording against the next thread's, with the regression score."""
    found = digests.trend(_next_thread(spark, sf_dir, "j"), _timeline(spark, sf_dir), "signal_family")
    return found.select("pair_id", "key", *(f"{side}_{m}" for m in ("n", "total_ms", "bytes") for side in ("current", "baseline", "delta")), "score")


@query(f"""WITH {_TREND} SELECT pair_id, key, {_delta_sql(("n", "total_ms", "bytes"))} FROM j2 WHERE key IN ({', '.join(repr(f) for f in digests.RUNTIME)})""")
def jfr_runtime_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of runtime pressure from one recording to the next."""
    return digests.family_deltas(_next_thread(spark, sf_dir, "j"), _timeline(spark, sf_dir), digests.RUNTIME)


@query(f"""WITH {_WINDOWS}, firsts AS (SELECT artifact_id, focus, score_micro, n FROM top WHERE rank = 1), {_PAIRS} SELECT pair_id, c.focus AS current_focus, c.score_micro AS current_score_micro, c.n AS current_n, b.focus AS baseline_focus, b.score_micro AS baseline_score_micro, b.n AS baseline_n, coalesce(c.focus = b.focus, false) AS same_focus,
 coalesce(c.score_micro, 0) - coalesce(b.score_micro, 0) AS delta_score_micro FROM pairs JOIN firsts b ON b.artifact_id = 'j-' || pair_id JOIN firsts c ON c.artifact_id = 'j-' || (pair_id + 1)""")
def jfr_dominant_incident_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first incident of each recording against the next thread's."""
    return digests.dominant_incidents(_next_thread(spark, sf_dir, "j"), jfr.incident_windows(_timeline(spark, sf_dir)))


@query(f"""WITH {_JFR}, h AS (SELECT artifact_id, top_method, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY artifact_id))::DOUBLE AS share FROM j WHERE signal_family = 'executionSample' GROUP BY 1, 2), best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, top_method) = 1), {_PAIRS}
 SELECT pair_id, c.top_method AS current_top_method, c.n AS current_n, c.share AS current_share, b.top_method AS baseline_top_method, b.n AS baseline_n, b.share AS baseline_share, c.top_method IS DISTINCT FROM b.top_method AS shifted FROM pairs LEFT JOIN best b ON b.artifact_id = 'j-' || pair_id LEFT JOIN best c ON c.artifact_id = 'j-' || (pair_id + 1) WHERE b.n IS NOT NULL OR c.n IS NOT NULL""")
def jfr_dominant_hotspot_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hottest method of each recording against the next thread's."""
    return digests.dominant_hotspots(_next_thread(spark, sf_dir, "j"), _timeline(spark, sf_dir), ("executionSample",))


@query(f"""WITH {_SUMMARY}, {_PAIRS} SELECT pair_id, b.dominant_cause_by_count AS baseline_cause, c.dominant_cause_by_count AS current_cause, b.dominant_cause_by_count IS DISTINCT FROM c.dominant_cause_by_count AS cause_changed, {", ".join(f"c.{m} - b.{m} AS delta_{m}" for m in ("pause_count", "full_gc_count", "near_capacity_count", "allocation_stall_count"))}, b.p95_pause_ms AS baseline_p95, c.p95_pause_ms AS current_p95
 FROM pairs JOIN s b ON b.artifact_id = 'gc-' || pair_id JOIN s c ON c.artifact_id = 'gc-' || (pair_id + 1)""")
def gc_comparison_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides and the changes of each log and the next thread's."""
    d = digests.gc_changes(_next_thread(spark, sf_dir, "gc"), _gc_summary(spark, sf_dir))
    return d.select("pair_id", F.col("baseline_dominant_cause_by_count").alias("baseline_cause"), F.col("current_dominant_cause_by_count").alias("current_cause"), F.col("dominant_cause_by_count_changed").alias("cause_changed"), *(f"delta_{m}" for m in ("pause_count", "full_gc_count", "near_capacity_count", "allocation_stall_count")), F.col("baseline_p95_pause_ms").alias("baseline_p95"), F.col("current_p95_pause_ms").alias("current_p95"))
