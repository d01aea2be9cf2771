"""Packing by power-of-two decomposition.

Each document's ids (with a closing 0) are cut along the binary form of their number: pieces of ``most`` tokens, then one piece for each
set bit of the rest, longest first. Pieces of equal length share a bucket, and each piece is a sequence of its own, so no sequence
crosses documents and none needs padding: a batch takes sequences from one bucket.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import Store, chunks_of, hash60, held, map_arrow, pick, running_before, slices_for

#: White space of the tokenizer's own pattern. A token never spans a change from other characters to white space.
BLANK = "\t-\r \x85\xa0  -     　"
_UNITS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+$")
_EDGE = re.compile(f"[{BLANK}]")
_OTHER = re.compile(f"[{BLANK[:1]}\x0b-\r{BLANK[4:]}]")
#: Units that one Python worker remembers; the older half goes when they are full.
MOST_CACHED = 1 << 20
#: Units that the tokenizer gets in one text.
LINE = 256
#: Bytes of texts whose words are held at a time.
CHUNK = 1 << 19


class UnitEncoder:
    """Ids of whole texts by way of units (white space and what follows it), each encoded once by the tokenizer and remembered as bytes.

    Texts whose words are parted by single spaces and line ends, the usual case, are split without a regular expression; there the unit of a
    word is the space before it and the word, or a line end and the word. Units are held in two generations: those asked for move to the
    newer one, and the older one is dropped when the newer is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.added = {token.content: np.array([number], "<u4").tobytes() for number, token in added}
        if any(token.lstrip or token.rstrip or token.single_word or token.normalized and self.tokenizer.normalizer for _, token in added):
            raise ValueError("an added token of this file takes in what stands around it")
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.end = np.array([self.line_end], "<u4").tobytes()
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _tokenize(self, units: list[str]) -> list[bytes]:
        """Words go to the tokenizer in lines of many, which a line end's own token parts again; units with other white space one by one."""
        alone = [bool(_EDGE.search(u, 1)) or u[:1] != " " and bool(_EDGE.match(u)) for u in units]
        many = [u for u, a in zip(units, alone, strict=True) if not a]
        lines = ["\n".join(many[k : k + LINE]) for k in range(0, len(many), LINE)]
        parts: list[bytes] = []
        for found in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end)).tolist()
            parts += [data[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        if len(many) < len(units):
            word, single = iter(parts), iter(self.tokenizer.encode_batch_fast([u for u, a in zip(units, alone, strict=True) if a], add_special_tokens=False))
            parts = [np.array(next(single).ids, "<u4").tobytes() if a else next(word) for a in alone]
        return parts

    def _learn(self, missing: set[str]) -> None:
        """Makes units known; keys are a spaced word as the word alone, a word after a line end with it, other units after a zero sign."""
        if len(self.units) + len(missing) > MOST_CACHED // 2:
            self.old, self.units = self.units, {}
        units, old = self.units, self.old
        moved = missing & old.keys()
        units.update(zip(moved, map(old.__getitem__, moved), strict=True))
        missing = missing - moved
        spaced = [k for k in missing if k[0] != "\n" and k[0] != "\0"]
        units.update(zip(spaced, self._tokenize([" " + k for k in spaced]), strict=True))
        rest = list(missing.difference(spaced))
        for key, data in zip(rest, self._tokenize([k[1:] for k in rest]), strict=True):
            units[key] = self.end + data if key[0] == "\n" else data

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, as the tokenizer gives them for the whole text.

        Tokens that the file adds to its vocabulary are found before anything else; what stands between them is encoded by itself.
        """
        split = {k: self._parts.split(text) for k, text in enumerate(texts) if any(token in text for token in self.added)}
        if not split:
            return self._plain(texts)
        done = iter(self._plain([x for k, text in enumerate(texts) for x in (split[k][::2] if k in split else (text,))]))
        return [b"".join(self.added[x] if j % 2 else next(done) for j, x in enumerate(split[k])) if k in split else next(done) for k in range(len(texts))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        plans, missing, get = [], set(), self.units.get
        for text in texts:
            keys = text.replace("\n", " \n").split(" ")
            if "" in keys or "\n" in keys or keys[0][0] == "\n" or "\0" in text or (_other_ascii(text) if text.isascii() else _OTHER.search(text) is not None):
                keys = ["\0" + u for u in _UNITS.findall(text)]
            else:
                keys[0] = "\0" + keys[0]
            found = list(map(get, keys))
            if None in found:
                missing.update(k for k, f in zip(keys, found, strict=True) if f is None)
                plans.append((keys, None))
            else:
                plans.append((None, b"".join(found)))
        if missing:
            full = len(self.units) + len(missing) > MOST_CACHED // 2
            if full:
                missing.update(*(keys for keys, _ in plans if keys))
            self._learn(missing)
        known = self.units.__getitem__
        return [done if keys is None else b"".join(map(known, keys)) for keys, done in plans]


def _other_ascii(text: str) -> bool:
    return "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text


def stretches(text: bytes, most: int) -> list[bytes]:
    """A long text in parts of about ``most`` bytes, cut only where a word ends and a single space or line end begins the next unit."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        parts.append(text[at : cut.start() + 1])
        at = cut.start() + 1
    return [*parts, text[at:]]


#: A plain letter or digit, one space, another: no unit and no added token spans the place after the first.
_CUT = re.compile(rb"[0-9A-Za-z] (?=[0-9A-Za-z])")


def encoder(path: str) -> UnitEncoder:
    """One for each Python worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would each hold memory
    encoders = held(__name__)
    if path not in encoders:
        encoders[path] = UnitEncoder(path)
    return encoders[path]


def _encoded(encode: UnitEncoder, texts: list[bytes]) -> list[bytes]:
    """Ids of each text; a long one is encoded part by part, so that only its ids are held whole."""
    if max(map(len, texts)) <= 2 * CHUNK:
        return encode.encode([t.decode() for t in texts])
    return [b"".join(encode.encode([part.decode()])[0] for part in stretches(t, CHUNK)) for t in texts]


def lengths(n: int, most: int) -> list[int]:
    """Powers of two that sum to n, falling: as many of ``most`` as fit, then the bits of the rest."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if (n % most) >> b & 1]


def document_pieces(docs: DataFrame, path: str, most: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece, and with ``with_ids`` its ids as little-endian 32-bit numbers.

    A narrow map of ``docs``. Null or empty text is the single id 0, so every row gives a piece; rows with null or repeated ids are like any others.
    """
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in kinds]
        all_ids = (ids for chunk in chunks_of(batch.column("text"), CHUNK) for ids in _encoded(encoder(path), chunk))
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), all_ids, strict=True):
            data, total, at = ids + b"\0\0\0\0", len(ids) // 4 + 1, 0
            for n in lengths(total, most):
                piece = data[4 * at : 4 * (at + n)]
                for column, value in zip(columns, (doc_id, at, n, zlib.crc32(piece), total, piece), strict=False):
                    column.append(value)
                at += n
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_arrow(pick(docs, doc_id="long", text="string"), cut, schema)


def pack_documents(docs: DataFrame, path: str, most: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset (0: a piece is its sequence).

    Sequences are numbered without gaps, bucket after bucket from the longest, within a bucket by a hash of the piece; equal pieces (same id,
    place and content) are counted before the shuffle. Pieces are stored once, so texts are tokenized once; buckets are numbered in slices.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    stored = Store(docs.sparkSession, "packing").keep(document_pieces(docs, path, most, with_ids))  # the result reads it
    keys = stored.columns
    counted = stored.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_h", hash60(F.col("doc_id"), F.col("start"), F.col("ids_crc32")))
    totals = stored.groupBy("length").count().collect()  # at most one row for each power of two up to ``most``
    firsts, at = {}, 0
    for row in sorted(totals, key=lambda r: -r["length"]):
        firsts[row["length"]], at = at, at + row["count"]
    cuts = slices_for(max((r["count"] for r in totals), default=0))
    order = ["_h", F.col("doc_id").asc_nulls_first(), "start", "ids_crc32", "doc_tokens"]
    numbered = running_before(counted, ["length"], order, "_n", "_before", F.shiftright("_h", 60 - cuts.bit_length() + 1))
    first = F.lit(0).cast("long")
    for length, start in firsts.items():
        first = F.when(F.col("length") == length, F.lit(start).cast("long")).otherwise(first)
    each = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    return each.select(*keys, (first + F.col("_before") + F.col("_k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
