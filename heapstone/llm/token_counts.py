"""Token counts under a unigram model by dynamic programming over a trie.

Distinct pre-tokens (words, with the vocabulary's word-start sign before them) go into a trie. A node's forward score is the best sum of
piece scores over all cuts of the path to it, so it is computed once however many words share the prefix; a terminal stores its number of pieces.
Words of LONG characters and more, which share prefixes with no others, get the same scores from a ring of the last places, without nodes.

The pieces are those of a public sentencepiece vocabulary; its order stands for frequency, so by Zipf's law the piece of rank r scores
-ln(r + 2). A character that no piece covers is its UTF-8 bytes, one token each, at the score of a piece after the last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heapstone.llm.common import held, map_arrow, pick, spans_of

START = "▁"
#: Nodes and words held by one Python worker before it starts afresh; characters from which on a word is scored without nodes.
MOST_NODES, MOST_WORDS, LONG = 1_500_000, 1 << 19, 256


def piece_scores(path: str) -> dict[str, float]:
    """Score of each ordinary piece: control, unknown and byte pieces are left out, the rest is ranked by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(pieces)}


class PrefixTrie:
    """Forward scores and token counts by prefix. Ties go to fewer tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = -math.log(len(scores) + 2)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def insert(self, word: str) -> int:
        """Tokens of the word. Nodes that exist are walked; only new ones are scored."""
        if len(word) >= LONG:
            return self.count_long(word)
        if len(self.best) + len(word) > MOST_NODES:
            self.clear()
        node, path = 0, [0]
        for end, letter in enumerate(word, 1):
            child = self.children[node].get(letter)
            if child is None:
                size = len(letter.encode())
                score, count = self.best[node] + size * self.byte, self.tokens[node] + size
                for start in range(max(0, end - self.longest), end):
                    piece = self.scores.get(word[start:end])
                    if piece is not None:
                        at = path[start]
                        total, n = self.best[at] + piece, self.tokens[at] + 1
                        if total > score or total == score and n < count:
                            score, count = total, n
                child = self.children[node][letter] = len(self.best)
                self.children.append({})
                self.best.append(score)
                self.tokens.append(count)
            node = child
            path.append(node)
        return self.tokens[node]

    def count_long(self, word: str) -> int:
        """The same forward scores without nodes: only those of the last ``longest`` places are held, so any length takes little memory."""
        ring = [(0.0, 0)] * (self.longest + 1)
        get, byte, longest, places = self.scores.get, self.byte, self.longest, self.longest + 1
        for end, letter in enumerate(word, 1):
            before = ring[(end - 1) % places]
            size = len(letter.encode())
            score, count = before[0] + size * byte, before[1] + size
            for start in range(max(0, end - longest), end):
                piece = get(word[start:end])
                if piece is not None:
                    at = ring[start % places]
                    total, n = at[0] + piece, at[1] + 1
                    if total > score or total == score and n < count:
                        score, count = total, n
            ring[end % places] = score, count
        return ring[len(word) % places][1]


class WordCounts(dict):
    """Token count of each word (bytes), by the trie when it is new."""

    def __init__(self, path: str):
        super().__init__()
        self.trie = PrefixTrie(piece_scores(path))

    def __missing__(self, word: bytes) -> int:
        if len(word) >= LONG:
            return self.trie.insert(START + word.decode())
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = n = self.trie.insert(START + word.decode())
        return n


def word_counts(path: str) -> WordCounts:
    """One for each Python worker and file."""
    counts = held(__name__)
    if path not in counts:
        counts[path] = WordCounts(path)
    return counts[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row, from the whole text: a narrow map, no shuffle. Null or empty text has none; ids are passed on."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = word_counts(path)
        words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            for span in spans_of(text or b""):
                split = span.split()
                words[row] += len(split)
                tokens[row] += sum(map(known.__getitem__, split))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return map_arrow(pick(docs, doc_id="long", text="string"), count, "doc_id long, n_words long, n_tokens long")
