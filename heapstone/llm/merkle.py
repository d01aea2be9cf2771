"""Merkle manifest of a dataset: a digest tree over all rows by group, with a proof for each row.

Ranks within a group come from digit histograms (``radix``). A rank's digits in base ``fanout`` key the nodes of a trie: the node above a
node has its key without the last digit. Nodes that share all but their last few digits are reduced together, some thousand at a time, so
each step divides the rows by that number; the subroots of the groups are the leaves of a last trie. Proofs go down the same steps: a
chunk's siblings above it are computed once and handed to all of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import Store, pick
from heapstone.llm.radix import each_copy, long_digits, ranks, text_digits

#: Nodes that one chunk holds at most.
CHUNK = 1024

_CELL = ["g", "chunk"]
Emit = Callable[[pa.Table, list[list[str]], pa.Table], pa.Table]
_NODES = "g string, pos long, digest string, size long"
_PATHS = "g string, pos long, path array<string>, subroot string, root string"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its number of UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(nodes: int, fanout: int) -> int:
    """Levels until one node is left."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


@dataclass(frozen=True)
class Shape:
    """How many nodes make one above, and how many digits of a rank a chunk covers."""

    fanout: int
    digits: int

    @classmethod
    def of(cls, fanout: int, chunk: int) -> Shape:
        digits = 1
        while fanout ** (digits + 1) <= chunk:
            digits += 1
        return cls(fanout, digits)

    @property
    def span(self) -> int:
        return self.fanout**self.digits

    def levels(self, size: int) -> int:
        """Levels that one step reduces of a group of ``size`` nodes."""
        return min(self.digits, _height(size, self.fanout))


def _rows(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a chunk, level by level, itself included."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([_sha("".join(rows[-1][i : i + fanout])) for i in range(0, len(rows[-1]), fanout)])
    return rows


def _siblings(rows: list[list[str]], at: int, fanout: int) -> Iterator[str]:
    """What stands left of a node, then right of it, for each level below the last."""
    for row in rows[:-1]:
        first = at - at % fanout
        yield "".join(row[first:at])
        yield "".join(row[at + 1 : first + fanout])
        at //= fanout


def _sorted_nodes(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    table = table.sort_by("pos")
    return table, table["digest"].to_pylist(), table["size"][0].as_py()


def _up(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One node a chunk; ``size`` is the number of nodes of the group then."""

    def reduce(table: pa.Table) -> pa.Table:
        table, digests, size = _sorted_nodes(table)
        root = _rows(digests, shape.fanout, shape.levels(size))[-1][0]
        return pa.table({"g": table["g"][:1], "pos": table["chunk"][:1], "digest": [root], "size": [-(-size // shape.span)]})

    return nodes.groupBy(*_CELL).applyInArrow(reduce, _NODES)


def _chunked(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("pos") / shape.span))


def _tree(nodes: DataFrame, store: Store, shape: Shape) -> list[DataFrame]:
    """The nodes of every step, from ``nodes`` (g, pos, digest, size and more) to one node for each group."""
    steps, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        steps.append(store.keep(_up(_chunked(steps[-1], shape), shape)))
        most = -(-most // shape.span)
    return steps


def _down(nodes: DataFrame, above: DataFrame, shape: Shape, emit: Emit, schema: str) -> DataFrame:
    """``emit(table, paths, above)`` for each chunk: its rows by position, their siblings up to the root, and the row of ``above`` for it."""

    def open_chunk(table: pa.Table, parent: pa.Table) -> pa.Table:
        table, digests, size = _sorted_nodes(table)
        rows, rest = _rows(digests, shape.fanout, shape.levels(size)), parent["path"][0].as_py()
        return emit(table, [[*_siblings(rows, at, shape.fanout), *rest] for at in range(len(digests))], parent)

    parents = above.withColumnRenamed("pos", "chunk")
    return _chunked(nodes, shape).groupBy(*_CELL).cogroup(parents.groupBy(*_CELL)).applyInArrow(open_chunk, schema)


def _emit_paths(table: pa.Table, paths: list[list[str]], parent: pa.Table) -> pa.Table:
    n = table.num_rows
    return pa.table({"g": table["g"], "pos": table["pos"], "path": pa.array(paths, pa.list_(pa.string())), "subroot": parent["subroot"].to_pylist() * n, "root": parent["root"].to_pylist() * n})


def _fold(leaf: str, path: list[str]) -> str:
    for k in range(0, len(path), 2):
        leaf = _sha(path[k] + leaf + path[k + 1])
    return leaf


def _emit_audit(table: pa.Table, paths: list[list[str]], parent: pa.Table) -> pa.Table:
    n, root = table.num_rows, parent["root"][0].as_py()
    folded = [_fold(leaf, path) for leaf, path in zip(table["seen"].to_pylist(), paths, strict=True)]
    return pa.table(
        {
            "doc_id": table["doc_id"], "leaf": table["digest"], "subroot": parent["subroot"].to_pylist() * n, "root": [root] * n,
            "proof_sha256": [_sha("".join(path)) for path in paths], "folded_root": folded, "verified": [f == root for f in folded],
        }
    )


def _emit_proofs(table: pa.Table, paths: list[list[str]], parent: pa.Table) -> pa.Table:
    n = table.num_rows
    return pa.table({"lang": table["lang"], "pos": table["pos"], "doc_id": table["doc_id"], "leaf": table["digest"], "siblings": pa.array(paths, pa.list_(pa.string())), "subroot": parent["subroot"].to_pylist() * n, "root": parent["root"].to_pylist() * n})


def leaves(docs: DataFrame, store: Store) -> DataFrame:
    """g, lang, doc_id, digest, seen, pos, size: every row at its rank in its language.

    Ranks follow doc_id (null first), rows of one id their leaf digest; equal rows take neighbouring ranks. ``seen`` is the leaf as somebody
    who tampered would show it: n_chars is one more where 7 divides the CRC of the id; a null id or null n_chars stays.
    """
    rows = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    other = digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    hashed = store.keep(rows.select("lang", "doc_id", leaf.alias("digest"), F.when(tampered, other).alias("other")))
    counted = hashed.groupBy("lang", "doc_id", "digest", "other").agg(F.count("*").alias("copies"))
    keyed = counted.select("*", text_digits(F.col("lang")).alias("g"), F.concat(long_digits(F.col("doc_id")), F.col("digest")).alias("key"))
    placed = ranks(store.keep(keyed), store, ["g"], "key", "copies", "pos", "size")
    return store.keep(each_copy(placed, "copies", "pos").select("g", "lang", "doc_id", "digest", F.coalesce("other", "digest").alias("seen"), "pos", "size"))


def _opened(docs: DataFrame, shape: Shape, emit: Emit, schema: str) -> DataFrame:
    store = Store(docs.sparkSession, "merkle")
    rows = leaves(docs, store)
    steps = _tree(rows, store, shape)
    tops = steps[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("digest"), F.lit(1).cast("long").alias("copies"))
    groups = store.keep(ranks(tops, store, ["g"], "key", "copies", "pos", "size").drop("copies"))
    upper = _tree(groups, store, shape)
    paths = upper[-1].select("g", "pos", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for step in reversed(upper[:-1]):
        paths = _down(step, paths, shape, _emit_paths, _PATHS)
    paths = groups.join(paths.select("pos", "path", "root"), "pos").select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for step in reversed(steps[1:-1]):
        paths = _down(step, store.keep(paths), shape, _emit_paths, _PATHS)
    kept = store.keep(paths)
    store.finish(rows, kept)
    return _down(rows, kept, shape, emit, schema)


def proofs(docs: DataFrame, fanout: int = 2, chunk: int = CHUNK) -> DataFrame:
    """lang, pos, doc_id, leaf, siblings, subroot, root: for each row what a verifier needs. ``siblings`` has two texts a level from the leaf up to the
    root, the digests that stand left and right of the node; folding them around the leaf gives the root. Empty table: no rows."""
    return _opened(docs, Shape.of(fanout, chunk), _emit_proofs, "lang string, pos long, doc_id long, leaf string, siblings array<string>, subroot string, root string")


def audit(docs: DataFrame, fanout: int = 2, chunk: int = CHUNK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, checked with the leaf as ``leaves`` says it is shown.

    Nulls in any column are part of the leaf, a null language is a group of its own and the first, a null id comes first in its group. Rows of
    equal id stand by their digests, equal rows side by side. Long texts are hashed where they are read and never shuffled. Empty table: no rows.
    """
    return _opened(docs, Shape.of(fanout, chunk), _emit_audit, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
