"""Nearest neighbours by inner product: inverted lists and an adaptive scan of dimensions.

Vectors get one more coordinate that makes all of them as long as the longest, so the largest inner product is the smallest distance. A random
rotation spreads each vector evenly over the coordinates; then the share of a squared distance that the first d of D coordinates hold is
d / D with a known spread. Within a probed list, distances grow column block by column block, and a candidate is abandoned once its partial
distance is Z deviations above that share of the query's bound. Scores of survivors are exact, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.llm.common import Store, map_arrow, pick, small_batches

#: Bounds of what the index is fitted on and of the queries that set the number of probes.
SAMPLE, TUNING = 20_000, 64
#: Share of true neighbours that the probed lists shall hold; deviations of the test; columns of a block; rows of a task's blocks.
TARGET, Z, COLUMNS, ROWS, QUERIES = 0.985, 3.0, 16, 4096, 512


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """Fitted on a bounded sample: rotation, length of the longest vector, list centres, the sample itself (rotated), lists to probe."""

    rotation: np.ndarray
    longest: float
    centres: np.ndarray
    sample: np.ndarray
    probes: int = 1

    def place(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with the extra coordinate: queries get 0 there, after scaling to the common length (their order of answers is the same)."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        if query:
            wide = np.hstack((vectors * (self.longest / norms), np.zeros_like(norms)))
        else:
            wide = np.hstack((vectors, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))))
        return (wide @ self.rotation).astype(np.float32)

    def nearest(self, placed: np.ndarray) -> np.ndarray:
        """The list of each row."""
        return np.concatenate([squared(placed[i : i + 2048], self.centres).argmin(1) for i in range(0, max(1, len(placed)), 2048)])

    def order(self, placed: np.ndarray) -> np.ndarray:
        """Lists of each row, nearest first."""
        return np.argsort(squared(placed, self.centres), axis=1, kind="stable")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def fit(sample: np.ndarray, longest: float, total: int, seed: int = 3, rounds: int = 8) -> Index:
    """Lists: half the square root of the number of vectors, eight sampled vectors a list at least."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
    index = Index(rotation, longest, np.zeros((0, sample.shape[1] + 1), np.float32), np.zeros((0, sample.shape[1] + 1), np.float32))
    index.sample = placed = index.place(sample, query=False)
    k = max(1, min(int(np.sqrt(total) / 2), len(sample) // 8))
    centres = placed[rng.choice(len(placed), k, replace=False)].copy()
    for _ in range(rounds):
        index.centres = centres
        nearest = index.nearest(placed)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, placed)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
    index.centres = centres
    return index


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def scan(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that no test abandons: ``bound`` is each y's squared distance beyond which nothing is wanted."""
    dims = x.shape[1]
    left, right, partial = None, None, None
    for start in range(0, dims, COLUMNS):
        end = min(dims, start + COLUMNS)
        a, b = x[:, start:end], y[:, start:end]
        if left is None:
            block = squared(a, b)
        elif len(left) * 8 > x.shape[0] * y.shape[0]:
            block = squared(a, b)[left, right] + partial
        else:
            block = ((a[left] - b[right]) ** 2).sum(1) + partial
        spread = np.sqrt(2 * (dims - end) / (end * (dims + 2)))
        limit = bound * (end / dims) * (1 + Z * spread) + 1e-3 * np.abs(bound) + 1e-9
        if left is None:
            left, right = np.nonzero(block <= limit[None, :])
            partial = block[left, right]
        else:
            keep = block <= limit[right]
            left, right, partial = left[keep], right[keep], block[keep]
    return left, right


def best(queries: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k largest scores, ties to smaller ids."""
    order = np.lexsort((vec_ids, -scores, queries))
    q = queries[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tuning: int = TUNING) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, its k nearest of all other rows by inner product.

    Null, zero or non-finite vectors, null ids, and vectors not of the commonest dimension take no part. An id is one vector, as a query and as
    a candidate: of rows that share an id the one with the least vector, component by component, counts. Of equal vectors only the k + 1 smallest
    ids can be among the nearest, so only these are candidates (cut before the shuffle); equal queries are searched once. Lists and a list's
    queries are cut into blocks of bounded size, so one crowded region is shared by many tasks. Queries whose probed lists gave too few answers
    are searched again in twice as many lists, without tests. Fewer candidates than k: all. No valid vector: no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    store = Store(spark, "vectors")
    raw = pick(vectors, **{id_col: "long", vector_col: "array<double>"}).toDF("vec_id", "v").where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = raw.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dims = sizes[0]["d"]
    sized = _one_each(raw.where(F.size("v") == dims))
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = store.keep(sized.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"))
    asked = sized.where(F.col("vec_id") % every == 0)
    groups = store.keep(asked.groupBy("v").agg(F.min("vec_id").alias("qid")))
    total, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not groups.take(1):
        return empty
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    index = fit(sample, longest, total)
    placed = store.keep(_placed(rows, index, dims))
    index.probes = _probes(groups, placed, index, dims, k, tuning)
    lists = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # as many rows as the index has lists
    found = store.keep(_search_lists(groups, placed, index, lists, dims, k, index.probes, True))
    probes, exact = index.probes, False
    while not exact:
        enough = found.groupBy("qid").count().where(F.col("count") >= min(k + 1, total)).select("qid")
        short = store.keep(groups.join(enough, "qid", "left_anti"))
        if not short.take(1):
            break
        probes = 2 * probes
        exact = probes >= len(index.centres)
        again = _search_lists(short, placed, index, lists, dims, k, probes, False)
        found = store.keep(found.join(short.select("qid"), "qid", "left_anti").unionByName(again))
    merged = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    of_query = asked.join(groups, "v").select(F.col("vec_id").alias("query_id"), "qid")
    answers = of_query.join(merged.select("qid", "vec_id", "score"), "qid").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    store.finish(groups, found)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_each(rows: DataFrame) -> DataFrame:
    """One vector for each vec_id. Only ids are counted over all rows; vectors are shuffled for repeated ids alone."""
    repeated = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not repeated.take(1):
        return rows
    least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(least)


def _placed(rows: DataFrame, index: Index, dims: int) -> DataFrame:
    """vec_id, list, the placed vector (32-bit) and the original (64-bit), as bytes."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"), dims)
        p = index.place(v, query=False)
        lists = index.nearest(p)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(lists.astype(np.int32)), pa.array([x.tobytes() for x in p], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "list", "p", "v"])

    return map_arrow(rows, place, "vec_id long, list int, p binary, v binary")


def _probes(groups: DataFrame, placed: DataFrame, index: Index, dims: int, k: int, tuning: int) -> int:
    """Lists to probe so that TARGET of the true neighbours of some queries, found by brute force over all vectors, lie in them."""
    some = groups.orderBy(F.xxhash64("qid"), "qid").limit(tuning).collect()
    q = np.array([r["v"] for r in some])

    def brute(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(-1, dims)
        scores = (q @ v.T).ravel()
        ids = np.tile(np.asarray(batch.column("vec_id")), len(q))
        at = best(np.repeat(np.arange(len(q)), len(v)), ids, ids, scores, k)
        return pa.RecordBatch.from_arrays([pa.array(at // len(v), pa.int32()), pa.array(ids[at]), pa.array(scores[at]), batch.column("list").take(pa.array(at % len(v)))], names=["q", "vec_id", "score", "list"])

    near = map_arrow(placed, brute, "q int, vec_id long, score double, list int")
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).select("q", "list").collect()
    ranks = np.argsort(index.order(index.place(q, query=True)), axis=1)
    needed = np.sort([ranks[r["q"], r["list"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def _search_lists(groups: DataFrame, placed: DataFrame, index: Index, lists: dict[int, int], dims: int, k: int, probes_each: int, tested: bool) -> DataFrame:
    """qid, vec_id, score: the k + 1 best of each block of each probed list, as far as they may be among the query's best.

    With ``tested``, a query's bound is the distance of the k + 1st nearest sampled vector of its own lists; otherwise no candidate is abandoned.
    """
    spark = groups.sparkSession
    sample_lists = index.nearest(index.sample)
    blocks = np.array([-(-lists.get(i, 0) // ROWS) for i in range(len(index.centres))])
    counts = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks) if b], "list int, blocks int")

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"), dims)
        y = index.place(v, query=True)
        chosen = index.order(y)[:, :probes_each]
        bound = np.full(len(y), np.float32(np.inf))
        if tested and len(index.sample) > k:
            probed = np.zeros((len(y), len(index.centres)), bool)
            np.put_along_axis(probed, chosen, True, axis=1)
            near = np.where(probed[:, sample_lists], squared(y, index.sample), np.float32(np.inf))
            bound = np.partition(near, k, axis=1)[:, k]
        qids = np.asarray(batch.column("qid"))
        row = np.repeat(np.arange(len(y)), chosen.shape[1])
        ys, vs = [x.tobytes() for x in y], [x.tobytes() for x in v]
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(chosen.ravel().astype(np.int32)), pa.array(bound[row].astype(np.float64)), pa.array([ys[i] for i in row], pa.binary()), pa.array([vs[i] for i in row], pa.binary())], names=["id", "list", "bound", "p", "v"])

    probes = map_arrow(groups, probe, "id long, list int, bound double, p binary, v binary")
    loads = probes.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERIES).alias("q_blocks"))
    cut = counts.join(loads, "list")
    spread = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name).cast("long") - 1))
    deal = lambda c, name: F.pmod(F.xxhash64(c), F.col(name).cast("long"))
    asked = probes.join(F.broadcast(cut), "list").select("list", spread("blocks").alias("block"), deal("id", "q_blocks").alias("q_block"), F.lit(True).alias("is_query"), "id", "bound", "p", "v")
    held = placed.join(F.broadcast(cut), "list").select("list", deal("vec_id", "blocks").alias("block"), spread("q_blocks").alias("q_block"), F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), F.lit(0.0).alias("bound"), "p", "v")

    def compare(table: pa.Table) -> pa.Table:
        split = np.array(table.column("is_query").to_pylist(), bool)
        ids, bound = np.asarray(table.column("id")), np.asarray(table.column("bound"))
        p = np.frombuffer(b"".join(table.column("p").to_pylist()), np.float32).reshape(len(ids), -1)
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
        left, right = scan(p[~split], p[split], bound[split])
        scores = np.concatenate([np.einsum("ij,ij->i", v[~split][left[i : i + 65536]], v[split][right[i : i + 65536]]) for i in range(0, max(1, len(left)), 65536)])
        q, c = ids[split][right], ids[~split][left]
        at = best(q, left, c, scores, k + 1)
        return pa.table({"qid": pa.array(q[at]), "vec_id": pa.array(c[at]), "score": pa.array(scores[at])})

    return asked.unionByName(held).groupBy("list", "block", "q_block").applyInArrow(compare, "qid long, vec_id long, score double")
