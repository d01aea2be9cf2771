"""Near duplicates: MinHash bands, sequential Bayesian verification on signatures, exact confirmation on full shingle sets.

1. Rows with the same shingle set form a class. Its number (``rep``) is its smallest doc_id or, where classes share that, its smallest row.
2. Classes that agree on a whole band of their signature share a bucket. In each bucket every member is compared with the pivot, its smallest class.
3. Where a bucket still holds several components, the members outside the largest one are compared with all members outside their own
   component, block by block, each pair in the first band that it shares only. What is connected already is never compared again.
   Blocks first see short signatures (a byte for each hash, four for each band), some 300 bytes a member; full signatures and shingle sets
   are then sent for those members of a block that still have a plausible partner in it.
4. A comparison looks at batches of the two signatures and stops as soon as the posterior chance of reaching the threshold falls below
   ``PRUNE``; survivors are confirmed on the full sets. Only links of a spanning forest leave a task.

No task emits the pairs of a bucket, and a bucket's blocks are of bounded size. A pair at the threshold shares no band with a chance of
``MISS`` and is pruned by one of some nine looks with a chance of about 1e-5 in all; higher similarities are missed less often.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import Store, chunks_of, map_arrow, mix, pick, shingle_sets, small_batches

MISS, PRUNE, BATCH = 1e-6, 1e-6, 20
#: Members of a bucket that one task compares: outsiders and others.
BLOCKS = (128, 512)
#: Ids that may be broadcast: 16 MB or so. Beyond, the same join is shuffled.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Likeness:
    """Links documents with 100 * |A & B| >= percent * |A | B| of their ``width``-word shingles; bands of ``rows`` hashes."""

    width: int = 5
    percent: int = 80
    rows: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(97)
        n = self.bands * self.rows
        return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)

    @cached_property
    def needed(self) -> list[tuple[int, int]]:
        """(hashes seen, least matches): with fewer, the posterior P(J >= threshold), from a uniform prior, is under PRUNE.

        For m of n matches that posterior is P(Bin(n + 1, threshold) <= m).
        """
        t, out = self.percent / 100, []
        for n in [*range(BATCH, self.bands * self.rows, BATCH), self.bands * self.rows]:
            total, m = 0.0, -1
            while total < PRUNE:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        a, b = self.hashes
        out = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(shingles), 1024):
            out = np.minimum(out, ((shingles[k : k + 1024, None] * a + b) >> np.uint64(32)).min(0).astype(np.uint32))
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, bands): 56 bits of the band's hashes below the band's number."""
        parts = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        folded = np.zeros(parts.shape[:2], np.uint64)
        for k in range(self.rows):
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return ((folded >> np.uint64(8)) | (np.arange(self.bands, dtype=np.uint64) << np.uint64(56))).astype(np.int64)

    def plausible(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs (a[left[i]], b[right[i]]) survive all batches, and their matches."""
        alive, matches, seen = np.arange(len(left)), np.zeros(len(left), np.int64), 0
        for n, least in self.needed:
            matches = matches + (a[left[alive], seen:n] == b[right[alive], seen:n]).sum(1)
            keep = matches >= least
            alive, matches, seen = alive[keep], matches[keep], n
            if not len(alive):
                break
        return alive, matches

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * 100 < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _arrays(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells one text of a doc_id from another: a 64-bit hash and the length in bytes."""
    return pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("t_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("t_size"), "text")


IDENTITY = ["doc_id", "t_hash", "t_size"]


def _signed(docs: DataFrame, like: Likeness) -> DataFrame:
    """IDENTITY, n_shingles, two hashes of the whole set, band keys, short signature, number of the row (kept by storing it)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, one, two, signatures = [], [], [], []
        for chunk in chunks_of(batch.column("text")):
            for s in shingle_sets(chunk, like.width):
                sizes.append(len(s))
                one.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).astype(np.int64)))
                if len(s):
                    signatures.append(like.signature(s))
        every = np.array(signatures, np.uint32).reshape(-1, like.bands * like.rows)
        keys, full = like.band_keys(every), np.array(sizes) > 0
        offsets = np.concatenate(([0], np.cumsum(np.where(full, like.bands, 0)))).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
        short = iter(x.tobytes() for x in (every >> np.uint32(24)).astype(np.uint8))
        shorts = pa.array([next(short) if f else None for f in full], pa.binary())
        names = [*IDENTITY, "n_shingles", "k1", "k2", "bands", "short"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in IDENTITY), *(pa.array(x, pa.int64()) for x in (sizes, one, two)), bands, shorts], names=names)

    signed = map_arrow(_identified(docs), sign, "doc_id long, t_hash long, t_size int, n_shingles long, k1 long, k2 long, bands array<long>, short binary")
    return signed.withColumn("row", F.monotonically_increasing_id())


def _bounded(ids: DataFrame) -> DataFrame:
    """A table for the smaller side of a join: broadcast while it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _with_sets(docs: DataFrame, needed: DataFrame, like: Likeness) -> DataFrame:
    """rep, signature, shingles of the classes in ``needed`` (rep, IDENTITY, same). Of rows that repeat id and text (``same``) one is taken."""
    texts = _identified(docs).join(_bounded(needed), IDENTITY)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for chunk in chunks_of(batch.column("text")) for s in shingle_sets(chunk, like.width)]
        return pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array([like.signature(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "signature", "shingles"]
        )

    made = lambda rows: map_arrow(rows.select("rep", "text"), sets, "rep long, signature binary, shingles binary")
    if not needed.where("same > 1").take(1):
        return made(texts)
    return made(texts.where("same = 1")).unionByName(made(texts.where("same > 1").dropDuplicates(["rep"])))


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links among (a, b): pruned on signatures, confirmed on sets."""
    side = lambda name: sets.select(*(F.col(c).alias(n) for c, n in (("rep", name), ("signature", f"sig_{name}"), ("shingles", f"set_{name}"))))

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig_a, sig_b = (np.array(_arrays(batch.column(c), np.uint32)) for c in ("sig_a", "sig_b"))
        every = np.arange(batch.num_rows)
        alive, _ = like.plausible(sig_a, sig_b, every, every)
        few = batch.take(pa.array(alive))
        good = [like.linked(x, y) for x, y in zip(_arrays(few.column("set_a"), np.uint64), _arrays(few.column("set_b"), np.uint64), strict=True)]
        return few.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b", "set_a", "set_b"), confirm, "a long, b long")


def components(edges: DataFrame, store: Store) -> DataFrame:
    """id, component for every id in ``edges`` (a, b): the smallest id it can reach. Rows of edges may repeat; an empty table gives no rows.

    Each round sends every node to the neighbour of the lowest rank and contracts: the rank is the id itself in the first round (stars
    collapse at once), then a hash, so any graph shrinks by a constant share a round. Rounds are stored; degrees are summed before the shuffle.
    """
    links = store.keep(edges.where("a <> b").select("a", "b").distinct())
    at, rounds = None, 0
    while links.take(1):
        rank = lambda c: F.col(c) if rounds == 0 else F.xxhash64(F.col(c), F.lit(rounds))  # noqa: B023, E731
        both = links.union(links.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("best"))
        parent = store.keep(best.select(F.col("a").alias("id"), F.when(F.col("best.r") < rank("a"), F.col("best.to")).otherwise(F.col("a")).alias("to")))
        if at is None:
            moved = store.keep(parent.select("id", F.col("to").alias("node")))
        else:
            moved = store.keep(at.join(parent.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("to", "node").alias("node")))
        ends = links.join(parent.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(parent.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        shorter = store.keep(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        for old in (links, parent, at):
            if old is not None:
                store.drop(old)
        links, at, rounds = shorter, moved, rounds + 1
    if at is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    names = at.groupBy("node").agg(F.min("id").alias("component"))
    return store.keep(at.join(names, "node").select("id", "component"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Sizes of many intersections at once, by products of 0/1 matrices over slices of the shingles; None where pair by pair is cheaper."""
    rows, cols = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
    known, place = np.unique(np.concatenate([a[i] for i in rows[0]]), return_inverse=True)
    if 4 * len(rows[0]) * len(cols[0]) * len(known) > len(left) * 600_000:
        return None
    x_row = np.repeat(np.arange(len(rows[0])), [len(a[i]) for i in rows[0]])
    other = np.concatenate([b[j] for j in cols[0]])
    where = np.minimum(np.searchsorted(known, other), len(known) - 1)
    hit = known[where] == other
    y_row, y_at = np.repeat(np.arange(len(cols[0])), [len(b[j]) for j in cols[0]])[hit], where[hit]
    total = np.zeros((len(rows[0]), len(cols[0])), np.float32)
    for k in range(0, len(known), 8192):
        x, y = np.zeros((len(rows[0]), 8192), np.float32), np.zeros((len(cols[0]), 8192), np.float32)
        inside = (place >= k) & (place < k + 8192)
        x[x_row[inside], place[inside] - k] = 1
        inside = (y_at >= k) & (y_at < k + 8192)
        y[y_row[inside], y_at[inside] - k] = 1
        total += x @ y.T
    return total[rows[1], cols[1]].astype(np.int64)


def _open_pairs(outsider: np.ndarray, ids: np.ndarray, comps: np.ndarray, loose: np.ndarray, keys: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outsiders and members of a block, and which of their pairs lie in different components and share no band before this one (each once)."""
    s, n = np.flatnonzero(outsider), np.flatnonzero(~outsider)
    open_ = (comps[s][:, None] != comps[n][None, :]) & (~loose[n][None, :] | (ids[s][:, None] < ids[n][None, :]))
    for k in range(band):
        open_ &= keys[s, k][:, None] != keys[n, k][None, :]
    return s, n, *np.nonzero(open_)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    ids, comps = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "comp"))
    return np.array(table.column("side").to_pylist()) == 0, ids, comps, np.array(table.column("loose").to_pylist(), bool)


def _block_hopefuls(table: pa.Table, like: Likeness) -> pa.Table:
    """The rows of a block that have a plausible partner in it by their short signatures: a byte agrees wherever the hash does, so none is lost."""
    shorts, keys = np.array(_arrays(table.column("short"), np.uint8)), np.array(_arrays(table.column("marks"), np.uint32))
    s, n, left, right = _open_pairs(*_columns(table), keys, int(table.column("key")[0].as_py() >> 56))
    alive, _ = like.plausible(shorts[s], shorts[n], left, right)
    rows = np.concatenate((np.unique(s[left[alive]]), np.unique(n[right[alive]])))
    return table.select(["key", "sb", "nb", "side", "loose", "rep", "comp"]).take(pa.array(rows, pa.int64()))


def _block_links(table: pa.Table, like: Likeness) -> list[tuple[int, int]]:
    """Links between components found among one block of outsiders and one of members, as a forest."""
    outsider, ids, comps, loose = _columns(table)
    signatures = np.array(_arrays(table.column("signature"), np.uint32))
    sets = _arrays(table.column("shingles"), np.uint64)
    s, n, left, right = _open_pairs(outsider, ids, comps, loose, like.band_keys(signatures), int(table.column("key")[0].as_py() >> 56))
    alive, matches = like.plausible(signatures[s], signatures[n], left, right)
    if not len(alive):
        return []
    order = np.argsort(-matches, kind="stable")
    left, right = s[left[alive[order]]], n[right[alive[order]]]
    both = _overlaps(sets, sets, left, right) if len(left) > 64 else None
    root = {int(c): int(c) for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        x, y = find(int(comps[i])), find(int(comps[j]))
        if x != y and (like.linked(sets[i], sets[j]) if both is None else 100 * both[k] >= like.percent * (len(sets[i]) + len(sets[j]) - both[k])):
            root[max(x, y)] = min(x, y)
            links.append((int(comps[i]), int(comps[j])))
    return links


def _block_tables(members: DataFrame, found: DataFrame, shorts: DataFrame) -> DataFrame:
    """key, sb, nb, side, loose, rep, comp and the columns of ``shorts`` (rep, ...), joined before rows are dealt to blocks: each block of outsiders with each block of members, for buckets that hold several components."""
    named = members.where("rep <> pivot").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    counts = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    tops = counts.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("comps"), F.max(F.struct(F.col("c"), (-F.col("comp")).alias("m"))).alias("top")).where("comps > 1")
    sizes = tops.select("key", (-F.col("top.m")).alias("main"), F.ceil((F.col("n") - F.col("top.c")) / BLOCKS[0]).alias("s_blocks"), F.ceil(F.col("n") / BLOCKS[1]).alias("n_blocks"))
    rows = named.join(sizes, "key").withColumn("loose", F.col("comp") != F.col("main")).join(shorts, "rep")
    more = [c for c in shorts.columns if c != "rep"]
    deal = lambda blocks, seed: F.pmod(F.xxhash64(F.col("rep"), F.lit(seed)), F.col(blocks))
    to = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    outsiders = rows.where("loose").select("key", deal("s_blocks", 1).alias("sb"), to("n_blocks").alias("nb"), F.lit(0).alias("side"), "loose", "rep", "comp", *more)
    others = rows.select("key", to("s_blocks").alias("sb"), deal("n_blocks", 2).alias("nb"), F.lit(1).alias("side"), "loose", "rep", "comp", *more)
    return outsiders.unionByName(others)


def _decided(docs: DataFrame, like: Likeness, store: Store) -> DataFrame:
    """row, IDENTITY, n_shingles, component_id, stays for every row of ``docs``: stays is true for one row of each component and for rows without one."""
    small_batches(docs.sparkSession)
    signed = store.keep(_signed(docs, like))
    placed = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    lead = F.min(F.struct("doc_id", "row")).alias("lead")
    classes = store.keep(placed.groupBy("n_shingles", "k1", "k2").agg(F.min("row").alias("rep"), lead, F.min_by(F.struct(*IDENTITY), "row").alias("first"), F.any_value("bands").alias("bands"), F.any_value("short").alias("short")))
    if not classes.groupBy("lead.doc_id").count().where("count > 1").take(1):
        # Each class has a smallest doc_id of its own, the usual case: then that is its number, so pivots are the originals that ids follow.
        classes = classes.withColumn("rep", F.col("lead.doc_id"))
    entries = classes.select(F.explode("bands").alias("key"), "rep")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("y")).where("n > 1")
    buckets = store.keep(shared.groupBy("n", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "pivot", "n"))
    members = store.keep(entries.join(buckets, "key"))
    repeated = _bounded(store.keep(placed.groupBy(*IDENTITY).agg(F.count("*").alias("same")).where("same > 1")))
    wanted = classes.join(members.select("rep").distinct(), "rep").select("rep", "first.*").join(repeated, IDENTITY, "left").select("rep", *IDENTITY, F.coalesce("same", F.lit(1)).alias("same"))
    sets = store.keep(_with_sets(docs, store.keep(wanted), like))
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(store.keep(_confirmed(stars, sets, like)), store)

    def compare(table: pa.Table) -> pa.Table:
        links = _block_links(table, like)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    marks = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    shorts = classes.select("rep", "short", _packed(marks).alias("marks"))
    blocks = _block_tables(members.where("n > 2"), found, shorts)
    cell = ["key", "sb", "nb"]
    hopeful = store.keep(blocks.groupBy(*cell).applyInArrow(lambda t: _block_hopefuls(t, like), "key long, sb long, nb long, side int, loose boolean, rep long, comp long"))
    more = components(store.keep(hopeful.join(sets, "rep").groupBy(*cell).applyInArrow(compare, "a long, b long")), store)
    named = classes.select("n_shingles", "k1", "k2", "rep", "lead").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    joined = named.join(more.select(F.col("id").alias("comp"), F.col("component").alias("wider")), "comp", "left").withColumn("group", F.coalesce("wider", "comp"))
    final = joined.join(joined.groupBy("group").agg(F.min("lead").alias("head")), "group").select("n_shingles", "k1", "k2", "head")
    out = signed.drop("bands", "short").join(final, ["n_shingles", "k1", "k2"], "left")
    alone = F.col("head").isNull() | F.col("doc_id").isNull()
    decided = out.select("row", *IDENTITY, "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (alone | (F.col("row") == F.col("head.row"))).alias("stays"))
    kept = store.keep(decided)
    store.finish(kept)
    return kept


def _packed(marks: Column) -> Column:
    """Numbers below 2**32 as little-endian bytes."""
    hexes = F.transform(marks, lambda x: F.lpad(F.hex(x), 8, "0"))
    swapped = F.transform(hexes, lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))
    return F.unhex(F.array_join(swapped, ""))


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the smallest doc_id that links reach; kept says that it is the row's own. Texts that are null or without words have no
    shingles and link with nothing. Rows without a doc_id link with nothing: their component_id is null and they are kept. Repeated rows
    share their component; where one doc_id has several texts, each row goes by its own text. An empty table gives no rows.
    """
    decided = _decided(docs, like, Store(docs.sparkSession, "near-dup"))
    return decided.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns.

    Rows are told apart by id and text, so of several texts under one doc_id only those go that are near a row that stays. Rows without a
    doc_id, and rows without words, are near nothing and stay. Of rows that repeat both id and text, one stays.
    """
    decided = _decided(docs, like, Store(docs.sparkSession, "near-dup-kept"))
    fate = decided.groupBy(*IDENTITY).agg(F.count_if("stays").alias("stay"), F.count("*").alias("rows")).where("doc_id IS NOT NULL AND stay < rows")
    gone, split = fate.where("stay = 0").select(*IDENTITY), fate.where("stay > 0").select(*IDENTITY)
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]
    text, doc_id = (F.col(inner[names.index(c)]) for c in ("text", "doc_id"))
    rows = docs.toDF(*inner).withColumns({"doc_id": doc_id.cast("long"), "t_hash": F.xxhash64(text.cast("string")), "t_size": F.coalesce(F.octet_length(text.cast("string")), F.lit(-1))})
    left = rows.join(_bounded(gone), IDENTITY, "left_anti")
    if split.take(1):
        few = _bounded(split)
        left = left.join(few, IDENTITY, "left_anti").unionByName(left.join(few, IDENTITY, "left_semi").dropDuplicates(IDENTITY))
    return left.select(*inner).toDF(*names)
