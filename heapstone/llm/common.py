"""What the operators of this subpackage share: column picking, stored intermediate tables, sliced running totals, word hashes.

Each operator takes only the columns it names (``pick``), so extra columns, whatever their names, never clash with its own.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: words are maximal runs of anything else.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our names and types: ``pick(df, doc_id="long")``."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't add up in a Python worker."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 2000:
        spark.conf.set(rows, "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "heapstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Written tables that cut the lineage of a job, in the shared folder. ``drop`` removes one, ``finish`` all but those that a result reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.live = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stored_at = path
        self.live.add(path)
        return kept

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.live.discard(path)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stored_at", None)
        if path:
            self._delete(path)

    def finish(self, *read: DataFrame) -> None:
        """Removes every table of this store but those in ``read``, which a result still reads; these stay until the folder is cleared."""
        for path in self.live - {getattr(df, "_stored_at", None) for df in read}:
            self._delete(path)


def slices_for(rows: int, most: int = 50_000) -> int:
    """How many slices hold ``rows`` rows at about ``most`` each: a power of two, growing with the input."""
    return 1 << max(0, (max(rows, 1) - 1) // most).bit_length()


def running_before(df: DataFrame, group: list[str], order: list[str], value: str, out: str, slice_by: Column) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    ``slice_by`` cuts each group into ordered slices (it must not decrease along ``order``), so no task holds a whole group:
    slice totals are summed up first (a few rows for each slice), then each slice is numbered by itself.
    """
    cut = df.withColumn("_slice", slice_by)
    keys = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).agg(F.sum(value).alias("_total")).select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(starts, keys).withColumn(out, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_slice", "_start")


def hash60(*parts: Column) -> Column:
    """A uniform number below 2**60 from strings, the same in any SQL engine with md5; nulls count as the character U+0000."""
    joined = F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


# --- word hashes ---

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of a text that is hashed at once.
LONG_TEXT = 1 << 19


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text.

    A word's hash is a difference of prefix sums over its bytes, so the work is a few array operations for the whole list. These take some 40
    bytes for each byte of text, so long texts are hashed span by span; a word's hash doesn't depend on its place.
    """
    if any(len(t) > LONG_TEXT for t in texts):
        parts = [[_hashed([span], lower)[0] for span in spans_of(t, LONG_TEXT)] if len(t) > LONG_TEXT else [_hashed([t], lower)[0]] for t in texts]
        return np.concatenate([h for part in parts for h in part]), np.array([sum(map(len, part)) for part in parts])
    return _hashed(texts, lower)


def _hashed(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    blank = _BLANK[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's set of ``width``-word shingles as sorted 64-bit hashes; a shorter text has its whole sequence as the only one, an empty one none."""
    hashes, counts = word_hashes(texts, lower=True)
    folded = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        folded = mix(folded * np.uint64(_BASE) + hashes[k : k + len(folded)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(folded[at : at + n - width + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for h in hashes[at : at + n]:
                one = mix(one * np.uint64(_BASE) + h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def chunks_of(column: pa.Array, most: int = 1 << 19) -> Iterator[list[bytes]]:
    """UTF-8 texts of an Arrow column (null: empty), in lists of about ``most`` bytes."""
    held, size = [], 0
    for t in column.cast(pa.binary()):
        text = t.as_py() or b""
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def spans_of(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in spans of about ``most`` bytes that begin at white space, so no word is cut; a longer word is a span of its own."""
    at = 0
    while len(text) - at > most:
        cut = _SPACE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_SPACE = re.compile(rb"[\t-\r ]")
_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What one operator remembers in this Python worker from task to task; ``free_others`` drops it when another operator comes."""
    return _held.setdefault(owner, {})


def free_others(owner: str) -> None:
    """Drops what other operators remember, so that their caches don't add up in workers that serve one after the other, and gives freed memory back."""
    for name in [n for n in _held if n != owner]:
        del _held[name]
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are passed over, batches are bounded, and Arrow gives back what it freed."""
    small_batches(df.sparkSession)
    owner = work.__module__

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others(owner)
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out
                del out
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(each, schema)
