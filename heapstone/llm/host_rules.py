"""Host-level quality rules: a document falls by its own rules, or with its host.

Rule failures are counted by host; each host's failure rate is shrunk towards all hosts by a beta prior fitted to the hosts themselves
(empirical Bayes), and hosts whose shrunk rate reaches a threshold lose all their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heapstone.llm.common import Store, chunks_of, map_arrow, pick, word_hashes

SYMBOLS = b"#*$%&|<>"
#: A document fails with fewer words, or with a larger share of words in repeated three-word windows.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3
#: A host whose shrunk failure rate is this or more is dropped; the prior's strength lies between these numbers of documents.
HOST_RATE, STRENGTH = 0.6, (2.0, 10_000.0)

#: Hosts that are broadcast (some 100 bytes each); beyond, both sides are shuffled with so many salts.
MOST_HOSTS, SALTS = 200_000, 32

SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    hashes, counts = word_hashes(texts, lower=False)
    out = np.zeros((len(texts), 5), np.int64)
    at = 0
    for row, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        h = hashes[at : at + n]
        at += n
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        out[row, 0] = n
        out[row, 1] = sum(len(w.decode()) for w in text.split()) if not text.isascii() else len(b"".join(text.split()))
        out[row, 2] = len(text) - len(text.translate(None, SYMBOLS))
        out[row, 3] = len(lines) - len(set(lines))
        if n >= WINDOW:
            _, which, times = np.unique(h[:-2] * np.uint64(3) ^ (h[1:-1] * np.uint64(5) + (h[2:] << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            repeated = times[which] > 1
            covered = np.zeros(n, bool)
            for k in range(WINDOW):
                covered[k : n - WINDOW + 1 + k] |= repeated
            out[row, 4] = covered.sum()
    return out


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([text_statistics(chunk) for chunk in chunks_of(batch.column("text"))])


def _statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = [pa.array(c) for c in _measured(batch).T]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *STATISTICS])


def _failed(table: np.ndarray) -> np.ndarray:
    return (table[:, 0] < LEAST_WORDS) | (100 * table[:, 4] > REPEATED_PERCENT * table[:, 0])


def rule_failures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Statistics and ``base_failed`` of every document. Null or empty text has no words and fails; a null host is a host."""
    rows = pick(docs, doc_id="long", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    measured = map_arrow(rows, _statistics, SCHEMA)
    return measured.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_rejected: one row a host.

    The prior is a beta with the hosts' pooled rate m and strength s by moments: the variance of host rates around m, less what sampling alone
    would give, is m (1 - m) / (s + 1). s is kept within STRENGTH; where all hosts behave alike it is the largest.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    pooled = hosts.agg(F.sum("n_docs").alias("_n"), F.sum("n_failed").alias("_f"), F.count("*").alias("_hosts"))
    rated = hosts.crossJoin(F.broadcast(pooled.select((F.col("_f") / F.col("_n")).alias("_m"))))
    spread = rated.agg(
        F.max("_m").alias("_m"), F.sum("n_docs").alias("_n"), F.count("*").alias("_hosts"),
        F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("_m"), 2)).alias("_v"),
    )
    sampling = F.col("_m") * (1 - F.col("_m"))
    excess = (F.col("_v") - (F.col("_hosts") - 1) * sampling) / F.col("_n")
    strength = F.when((excess > 0) & (sampling > 0), F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), sampling / excess - 1))).otherwise(F.lit(STRENGTH[1]))
    prior = spread.select("_m", strength.alias("_s"))
    shrunk = (F.col("n_failed") + F.col("_m") * F.col("_s")) / (F.col("n_docs") + F.col("_s"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk >= HOST_RATE).alias("host_rejected"))


def _host_key(host: Column) -> Column:
    """A key that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the statistics, base_failed, shrunk_rate, kept: a row for each row of ``docs``; rows with a null id are judged like any other.

    Texts are measured once; their statistics are stored. Hosts are counted with partial sums before the shuffle; their verdicts join back by a
    null-safe key, broadcast while there are at most MOST_HOSTS of them.
    """
    failures = Store(docs.sparkSession, "host-rules").keep(rule_failures(docs, host))  # the result reads it
    verdicts = host_verdicts(failures).select(_host_key(F.col("host")).alias("_key"), "shrunk_rate", "host_rejected")
    joined = _with_hosts(failures.withColumn("_key", _host_key(F.col("host"))), verdicts, "inner", F.struct("doc_id", "word_chars"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("_key", "host_rejected")


def _with_hosts(rows: DataFrame, hosts: DataFrame, how: str, deal: Column) -> DataFrame:
    """Rows joined with a table of hosts on ``_key``. Beyond MOST_HOSTS both are shuffled, each host to SALTS places by ``deal``, so a common one is not one task."""
    if hosts.count() <= MOST_HOSTS:
        return rows.join(F.broadcast(hosts), "_key", how)
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], how).drop("_salt")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that their own rules and their host's verdict keep.

    Texts are measured once: rows are stored with their own verdict, hosts are counted from it, and only the few rejected hosts join back.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text_at, host_at = inner[names.index("text")], inner[names.index(host)]
    plain = docs.toDF(*inner)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.drop_columns(["text"]).append_column("base_failed", pa.array(_failed(_measured(batch))))

    judged = map_arrow(plain.withColumn("text", F.col(text_at).cast("string")), judge, T.StructType([*plain.schema.fields, T.StructField("base_failed", T.BooleanType())]))
    stored = Store(docs.sparkSession, "host-rules").keep(judged)  # the result reads it
    verdicts = host_verdicts(stored.select(F.col(host_at).cast("string").alias("host"), "base_failed"))
    rejected = verdicts.where("host_rejected").select(_host_key(F.col("host")).alias("_key"))
    kept = stored.where("NOT base_failed").withColumn("_key", _host_key(F.col(host_at)))
    return _with_hosts(kept, rejected, "left_anti", F.col(text_at).cast("string")).select(*inner).toDF(*names)
