"""Trie of conversation prefixes: radix partitioning by turn, most significant first, until buckets are local, then multikey quicksort.

Turns are encoded by a dictionary of all distinct ones. A bucket holds the conversations that begin with the same turns; each round splits the
buckets that are still too large by the id of their next turn, which emits one node for each child. Children small enough for a task are
local: a multikey quicksort takes them apart and emits their nodes on the way. A child with one sequence left needs no sorting at all: its
nodes are its turns, however many. Equal conversations are one sequence with a weight. Sums over subtrees go up the rounds afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import Store, hash60, pick, running_before, small_batches, word_count
from heapstone.llm.radix import each_copy, long_digits, ranks

#: Rows of a local bucket: at most so many, and at most this part of all rows (but LEAST), so that no task has much more than others.
MOST, PART, LEAST = 20_000, 256, 256
#: Ids whose decimal texts one row of members joins.
BLOCK = 1 << 16
#: Depths that one slice of a long conversation holds.
SLICE = 4096

_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, top boolean"


def encoded_turns(conversations: DataFrame, store: Store) -> DataFrame:
    """conv_id, pos (0, 1, ...), size, sym, words: every turn at its place, as its number in the dictionary of distinct turns.

    Turns stand by number (null first); those of one number by the MD5 of length of role, role and text. Equal rows are turns of their own.
    Null roles and texts are empty; rows without conv_id take no part.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    what = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    hashed = rows.select("conv_id", "turn", what.alias("what"), word_count(text).alias("words"))
    counted = store.keep(hashed.groupBy("conv_id", "turn", "what", "words").agg(F.count("*").alias("copies")).withColumn("key", F.concat(long_digits(F.col("turn")), "what")))
    dictionary = store.keep(counted.select("what").distinct().select("what", F.monotonically_increasing_id().alias("sym")))
    placed = each_copy(ranks(counted, store, ["conv_id"], "key", "copies", "pos", "size"), "copies", "pos")
    return store.keep(placed.select("conv_id", "pos", "size", "what", "words").join(dictionary, "what").drop("what"))


def rebuilt(turns: DataFrame, store: Store, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, sym, words) and lengths (conv_id, len) after each conversation c takes the first h turns of c - c % every in place of its own.

    h is the CRC of the decimal c modulo ``heads``. A conversation without turns then stays, with length 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = turns.where("pos = 0").select("conv_id", "size")
    wants = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    has = wants.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("_n")), "base", "left").withColumn("b", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = store.keep(has.select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).alias("len")))
    own = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", "b"), "conv_id").select("conv_id", (F.col("b") + F.col("pos") - F.col("h") + 1).alias("depth"), "sym", "words")
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "sym", "words")
    taken = convs.where("b > 0").select("conv_id", "base", "b").join(first, "base").where("pos < b").select("conv_id", (F.col("pos") + 1).alias("depth"), "sym", "words")
    return store.keep(own.unionByName(taken)), convs.select("conv_id", "len")


def distinct_sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """rep, m, len, ends_sha256: of equal conversations the smallest id, their number, and the digest of all their ids.

    Sequences are told apart by length and 124 bits of hashes. Ids are joined in blocks of ranges, which one digest then takes in order, so
    the ids of a large group are never held together.
    """
    hashes = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "sym")).alias("x0"), F.bit_xor(hash60(F.col("depth"), F.col("sym"))).alias("x1"))
    key = ["len", "x0", "x1"]
    told = lengths.join(hashes, "conv_id", "left").select("conv_id", "len", F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("x1", F.lit(0)).alias("x1"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = told.groupBy(*key, "block").agg(F.min("conv_id").alias("rep"), F.count("*").alias("m"), ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rep, m, sha = None, 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                which = (row["len"], row["x0"], row["x1"])
                if which != now:
                    if now is not None:
                        out.append((rep, m, now[0], sha.hexdigest()))
                    now, rep, m, sha = which, row["rep"], 0, sha256()
                sha.update(("," * bool(m) + row["ids"]).encode())
                m += row["m"]
            yield _batch(out, "rep m len ends_sha256")
        if now is not None:
            yield _batch([(rep, m, now[0], sha.hexdigest())], "rep m len ends_sha256")

    small_batches(turns.sparkSession)
    return blocks.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(digest, "rep long, m long, len long, ends_sha256 string")


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"ends_sha256": pa.string(), "top": pa.bool_()}
    return pa.record_batch([pa.array([r[k] for r in rows], kinds.get(name, pa.int64())) for k, name in enumerate(names.split())], names.split())


def bucket_nodes(depth: int, top: int, parent: int | None, top_words: int, members: list[tuple[int, int, list[int], list[int]]]) -> list[tuple]:
    """The nodes of one bucket, its top included, by multikey quicksort of its members (rep, weight, ids of the turns below the top, their words)."""
    conv, above, at, weight, words, ends = [top], [-1], [depth], [sum(m for _, m, *_ in members)], [top_words], [next((r for r, _, s, _ in members if not s), None)]

    def node(group: list, k: int, under: int) -> int:
        conv.append(min(g[0] for g in group))
        above.append(under)
        at.append(depth + k + 1)
        weight.append(sum(g[1] for g in group))
        words.append(group[0][3][k])
        ends.append(next((g[0] for g in group if len(g[2]) == k + 1), None))
        return len(conv) - 1

    work = [([g for g in members if g[2]], 0, 0)]
    while work:
        group, k, under = work.pop()
        if len(group) == 1:  # one sequence is left: its other turns are a chain
            for j in range(k, len(group[0][2])):
                under = node(group, j, under)
        elif group:
            pivot = sorted(g[2][k] for g in (group[0], group[len(group) // 2], group[-1]))[1]
            same = [g for g in group if g[2][k] == pivot]
            work.append(([g for g in same if len(g[2]) > k + 1], k + 1, node(same, k, under)))
            work += (([g for g in group if g[2][k] < pivot], k, under), ([g for g in group if g[2][k] > pivot], k, under))
    children, leaves, saved = [0] * len(conv), [0] * len(conv), [(w - 1) * t for w, t in zip(weight, words, strict=True)]
    for i in range(len(conv) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if i:
            children[above[i]] += 1
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    return [(at[i], conv[i], conv[above[i]] if i else parent, weight[i], children[i], leaves[i], saved[i], ends[i], i == 0) for i in range(len(conv))]


def _local(rows: DataFrame) -> DataFrame:
    """Nodes of the local buckets; rows: depth, top, parent, top_words, rep, m, at, sym, words, one for each turn below the top (at null: none)."""
    names = "depth conv_id parent_conv_id n_convs n_children n_leaves saved_tokens end top"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, members = None, []
        for batch in batches:
            out = []
            for depth, top, parent, top_words, rep, m, at, sym, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket is None or bucket[:2] != (depth, top):
                    if bucket is not None:
                        out += bucket_nodes(*bucket, members)
                    bucket, members = (depth, top, parent, top_words), []
                if not members or members[-1][0] != rep:
                    members.append((rep, m, [], []))
                if at is not None:
                    members[-1][2].append(sym)
                    members[-1][3].append(words)
            yield _batch(out, names)
        if bucket is not None:
            yield _batch(bucket_nodes(*bucket, members), names)

    small_batches(rows.sparkSession)
    ordered = rows.select("depth", "top", "parent", "top_words", "rep", "m", "at", "sym", "words").repartition("depth", "top").sortWithinPartitions("depth", "top", "rep", "at")
    return ordered.mapInArrow(work, _NODE)


def _chains(singles: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the children that hold one sequence: its turns from there on. Nothing is saved but by copies, whose words are summed from the end."""
    rows = turns.join(singles, "rep").where(F.col("at") >= F.col("depth"))
    once = rows.where("m = 1").withColumn("saved", F.lit(0).cast("long"))
    more = rows.where("m > 1")
    total = more.groupBy("rep").agg(F.sum("words").alias("_all"))
    summed = running_before(more, ["rep"], ["at"], "words", "_before", F.floor(F.col("at") / SLICE)).join(total, "rep")
    copied = summed.withColumn("saved", (F.col("m") - 1) * (F.col("_all") - F.col("_before"))).drop("_before", "_all")
    last, top = F.col("at") == F.col("len"), F.col("at") == F.col("depth")
    return once.unionByName(copied).select(
        F.col("at").alias("depth"), F.col("rep").alias("conv_id"), F.when(top, F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("rep")).alias("end"), top.alias("top"),
    )


def trie(turns: DataFrame, sequences: DataFrame, store: Store, most: int | None = None) -> DataFrame:
    """The nodes (_NODE) of the trie over ``turns`` (rep, at, sym, words) of ``sequences`` (rep, m, len); ``end``: the sequence that ends there, if any."""
    n_seq, n_rows, root = sequences.agg(F.count("*"), F.sum("len"), F.min("rep")).first()
    if not n_seq:
        return turns.sparkSession.createDataFrame([], _NODE)
    most = most or min(MOST, max(LEAST, n_rows // PART))
    no_parent, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    members = sequences.select(F.lit(root).cast("long").alias("top"), no_parent.alias("parent"), zero.alias("top_words"), zero.alias("depth"), "rep", "m", "len")
    kinds, levels, is_open, depth = [], [], n_rows > most, 0
    if not is_open:
        kinds.append(members.withColumn("kind", F.lit("local")))
    else:
        top = sequences.agg(F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("end"))
        levels.append(store.keep(top.select(zero.alias("depth"), "conv_id", no_parent.alias("parent_conv_id"), "n_convs", zero.alias("words"), "end")))
    while is_open:
        below = turns.where(F.col("at") == depth + 1).drop("at")
        coming = store.keep(members.select("top", "rep", "m", "len").join(below, "rep"))
        depth += 1
        kind = F.when(F.count("*") == 1, "single").when(F.sum("len") - F.count("*") * depth > most, "open").otherwise("local")
        split = store.keep(
            coming.groupBy("top", "sym").agg(F.min("rep").alias("child"), F.sum("m").alias("n_convs"), F.max("words").alias("top_words"), F.max(F.when(F.col("len") == depth, F.col("rep"))).alias("end"), kind.alias("kind"))
        )
        dealt = store.keep(
            coming.drop("words").join(split.select("top", "sym", "child", "top_words", "kind"), ["top", "sym"])
            .select(F.col("child").alias("top"), F.col("top").alias("parent"), "top_words", F.lit(depth).cast("long").alias("depth"), "rep", "m", "len", "kind")
        )
        store.drop(coming)
        kinds.append(dealt)
        members = dealt.where("kind = 'open'")
        opened = split.where("kind = 'open'")
        is_open = bool(opened.take(1))
        if is_open:
            levels.append(opened.select(F.lit(depth).cast("long").alias("depth"), F.col("child").alias("conv_id"), F.col("top").alias("parent_conv_id"), "n_convs", F.col("top_words").alias("words"), "end"))
    placed = kinds[0]
    for more in kinds[1:]:
        placed = placed.unionByName(more)
    small = placed.where("kind = 'local'")
    inner = small.join(turns.withColumnRenamed("rep", "_rep"), (F.col("rep") == F.col("_rep")) & (F.col("at") > F.col("depth")), "left")
    nodes = store.keep(_local(inner).unionByName(_chains(placed.where("kind = 'single'").drop("top_words", "top"), turns)))
    return _sums_of_open(nodes, levels, store) if levels else nodes


def _sums_of_open(nodes: DataFrame, levels: list[DataFrame], store: Store) -> DataFrame:
    """The nodes and those of the rounds, whose sums over subtrees are taken from their children, deepest round first."""
    parts = ["n_children", "n_leaves", "saved_tokens"]
    sums = (F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    tops = store.keep(nodes.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(*sums))
    every, below = nodes, None
    for depth in range(len(levels) - 1, -1, -1):
        given = tops.where(F.col("depth") == depth).select("conv_id", *parts)
        if below is not None:
            given = given.unionByName(below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(*sums))
            given = given.groupBy("conv_id").agg(*(F.sum(p).alias(p) for p in parts))
        summed = levels[depth].join(given, "conv_id").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
        below = store.keep(summed.withColumn("top", F.lit(False)).select(*nodes.columns))
        every = every.unionByName(below)
    return every


def prefix_trie(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node of the rebuilt conversations.

    What counts as a turn and how ties stand is in ``encoded_turns``, the rebuilding in ``rebuilt``. ``most`` bounds the rows of a local bucket.
    The rounds number as many as the turns that more than ``most`` rows of different conversations share. Empty table: no rows.
    """
    store = Store(conversations.sparkSession, "trie")
    encoded = encoded_turns(conversations, store)
    turns, lengths = rebuilt(encoded, store)
    sequences = store.keep(distinct_sequences(turns, lengths))
    kept = turns.withColumnsRenamed({"conv_id": "rep", "depth": "at"}).join(sequences.select("rep"), "rep", "left_semi")
    nodes = store.keep(trie(store.keep(kept), sequences, store, most))
    store.finish(nodes, sequences)
    ended = nodes.join(sequences.select(F.col("rep").alias("end"), "ends_sha256"), "end", "left")
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
