"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; learned filters slide over the whole text in steps of STEP bytes; every chunk of CHUNK positions, each overlapping the
next by half, keeps each filter's maximum; the maximum and the mean over all chunks go into one logistic unit.
Training (back-propagation, Adam) runs on the driver over a bounded sample of labelled texts; scoring is a narrow map.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import Store, chunks_of, map_arrow, pick

#: Bytes a filter sees, bytes it moves on, positions of a chunk, filters, embedding size.
WIDTH, STEP, CHUNK, FILTERS, DIM = 12, 3, 64, 24, 8
TAPS = WIDTH // STEP
#: Chunks begin at every half of one; the network works on halves, a chunk being two neighbours.
HALF = CHUNK // 2
#: A text is worked on in spans of so many halves, so its length doesn't bound memory.
SPAN = 8192
#: Bounds of the training sample: texts of each label, bytes of a text. Steps of training, texts of a step.
PER_LABEL, LONGEST, STEPS, BATCH = 600, 1 << 16, 300, 32
#: Documents in this fold (crc32 of the id as text, modulo 5) are held out from training.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass
class Model:
    embedding: np.ndarray  # (256, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def taps(self) -> np.ndarray:
        """(STEP * DIM, TAPS * FILTERS): the filters' parts side by side, for one product over cells of STEP bytes."""
        return self.filters.reshape(TAPS, STEP * DIM, FILTERS).transpose(1, 0, 2).reshape(STEP * DIM, TAPS * FILTERS).copy()


def _cells(spans: list[bytes], follow: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte buffer in which each span fills whole halves, its number of halves, and each span's last cells with what follows it."""
    size = HALF * STEP
    chunks = np.array([max(1, -(-len(s) // size)) for s in spans])
    buffer = b"".join(s.ljust(n * size, b"\0") for s, n in zip(spans, chunks.tolist(), strict=True))
    tail = (TAPS - 1) * STEP
    ends = b"".join(s.ljust(n * size, b"\0")[-tail:] + f[:tail].ljust(tail, b"\0") for s, f, n in zip(spans, follow, chunks.tolist(), strict=True))
    return np.frombuffer(buffer, np.uint8), chunks, np.frombuffer(ends, np.uint8)


def _slide(model: Model, taps: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Filter sums at every cell that TAPS cells start from. data: (..., cells * STEP) bytes."""
    cells = model.embedding[data].reshape(-1, STEP * DIM)
    parts = (cells @ taps).reshape(*data.shape[:-1], -1, TAPS, FILTERS)
    n = parts.shape[-3] - TAPS + 1
    return sum(parts[..., k : k + n, k, :] for k in range(TAPS))


def activations(model: Model, spans: list[bytes], follow: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(halves, HALF, FILTERS) sums before the maximum, the number of halves of each span, the buffer."""
    buffer, chunks, ends = _cells(spans, follow)
    taps = model.taps()
    tail = TAPS - 1
    sums = _slide(model, taps, np.concatenate((buffer, np.zeros(tail * STEP, np.uint8))))
    last = np.cumsum(chunks) * HALF
    fixed = _slide(model, taps, ends.reshape(len(spans), 2 * tail * STEP))
    for k in range(tail):
        sums[last - tail + k] = fixed[:, k]
    return sums.reshape(-1, HALF, FILTERS), chunks, buffer


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, 2 * FILTERS): each filter's maximum and mean over the chunks of the whole text. A text of one half is one chunk.

    The last half of a span is carried to the span that goes on with the same text.
    """
    size = HALF * STEP * SPAN
    spans, follow, owner = [], [], []
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            spans.append(text[at : at + size])
            follow.append(text[at + size : at + size + WIDTH])
            owner.append(row)
    top, total, count = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), 1), np.float32)
    carry, carried = np.zeros((1, FILTERS), np.float32), -1
    k = 0
    while k < len(spans):
        end, held = k, 0
        while end < len(spans) and (end == k or held + len(spans[end]) <= 1 << 18):
            held += len(spans[end])
            end += 1
        sums, halves, _ = activations(model, spans[k:end], follow[k:end])
        best = np.maximum(sums.max(1) + model.bias, 0)
        of = np.repeat(owner[k:end], halves)
        starts = np.concatenate(([0], np.cumsum(halves)[:-1]))
        np.maximum.at(top, np.array(owner[k:end]), np.maximum.reduceat(best, starts))
        rows, left = np.concatenate(([carried], of[:-1])), np.concatenate((carry, best[:-1]))
        chunks = np.maximum(left, best) * (rows == of)[:, None]
        np.add.at(total, np.array(owner[k:end]), np.add.reduceat(chunks, starts))
        np.add.at(count[:, 0], of, (rows == of).astype(np.float32))
        carry, carried = best[-1:], of[-1]
        k = end
    return np.hstack((top, np.where(count > 0, total / np.maximum(count, 1), top)))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    logits = pooled(model, texts) @ model.weights + model.offset
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


def _gradients(model: Model, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    sums, chunks, buffer = activations(model, texts, [b""] * len(texts))
    where = sums.argmax(1)
    best = np.take_along_axis(sums, where[:, None, :], 1)[:, 0, :] + model.bias
    live = np.maximum(best, 0)
    starts = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(texts)), chunks)
    top = np.maximum.reduceat(live, starts)
    pairs = (doc[:-1] == doc[1:])[:, None]
    left_wins = live[:-1] >= live[1:]
    wins = np.zeros_like(live)  # chunks whose maximum stands in this half
    wins[:-1] += pairs & left_wins
    wins[1:] += pairs & ~left_wins
    wins[starts[chunks == 1]] = 1
    share = wins / np.maximum(chunks - 1, 1)[doc, None]
    mean = np.add.reduceat(live * share, starts)
    features = np.hstack((top, mean))
    error = ((1 / (1 + np.exp(-np.clip(features @ model.weights + model.offset, -40, 40)))) - labels) * weights / len(texts)
    first = np.zeros_like(live, bool)
    tied = live == top[doc]
    for f in range(FILTERS):
        rows = np.flatnonzero(tied[:, f])
        first[rows[np.unique(doc[rows], return_index=True)[1]], f] = True
    flow = error[doc, None] * (first * model.weights[:FILTERS] + model.weights[FILTERS:] * share) * (best > 0)
    at = ((np.arange(len(where)) * HALF)[:, None] + where) * STEP
    padded = np.concatenate((buffer, np.zeros(WIDTH, np.uint8)))
    seen = padded[at[:, :, None] + np.arange(WIDTH)]
    d_filters = np.einsum("cf,cfk->kf", flow, model.embedding[seen].reshape(*seen.shape[:2], -1), optimize=True)
    pull = np.einsum("cf,fkd->cfkd", flow, model.filters.T.reshape(FILTERS, WIDTH, DIM)).reshape(-1, DIM)
    d_embedding = np.stack([np.bincount(seen.ravel(), pull[:, d], 256) for d in range(DIM)], 1)
    return [d_embedding, d_filters, flow.sum(0), features.T @ error, np.array([error.sum()])]


def train(texts: list[bytes], labels: np.ndarray, prior: float, steps: int = STEPS, seed: int = 5) -> Model:
    """Fits on the sample, both labels at equal weight; the offset then moves from there to ``prior``, the share of label 1. With one label only, the score is the prior."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), np.zeros(1, np.float32),
    )
    logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    if len(set(labels.tolist())) < 2:
        model.offset[:] = logit(prior)
        return model
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    first, second = [np.zeros_like(a) for a in model.arrays()], [np.zeros_like(a) for a in model.arrays()]
    queue = np.zeros(0, int)
    for n in range(1, steps + 1):
        while len(queue) < BATCH:
            queue = np.concatenate((queue, rng.permutation(len(texts))))
        rows, queue = queue[:BATCH], queue[BATCH:]
        rate = 0.01 * (1 - 0.9 * n / steps)
        for a, g, m, v in zip(model.arrays(), _gradients(model, [texts[r] for r in rows], labels[rows], weights[rows]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            a -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.998**n)) + 1e-8)
    model.offset += np.float32(logit(prior))
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, longest: int = LONGEST) -> Model:
    """A model from at most ``per_label`` texts of each label, none over ``longest`` bytes, all outside the held-out fold; whole texts.

    Which labelled ids are used is fixed by a hash of the id, among those that ``docs`` holds. Labels without id or quality are passed over; of
    repeated ids the higher label counts, and the least of their texts. Warns where a label has no text to learn from.
    """
    asked = pick(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    store = Store(docs.sparkSession, "labels")
    known = store.keep(asked.join(pick(docs, doc_id="long"), "doc_id", "left_semi"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = {}
    for label in (0, 1):
        for r in known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect():
            chosen[r["doc_id"]] = label
    store.finish()
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    texts: dict[int, bytes] = {}
    if chosen:
        rows = pick(docs, doc_id="long", text="string").where(F.col("doc_id").isin(list(chosen))).where(F.octet_length("text") <= longest)
        texts = {r["doc_id"]: r["text"].encode() for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    for label in (0, 1):
        if not any(chosen[i] == label for i in texts):
            warnings.warn(f"no text of label {label} to learn from", stacklevel=2)
    ids = sorted(texts)
    return train([texts[i] for i in ids], np.array([chosen[i] for i in ids], np.float32), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text. Null and empty texts get the score of no bytes; a null id is not held out."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.concatenate([score_texts(model, chunk) for chunk in chunks_of(batch.column("text"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = map_arrow(pick(docs, doc_id="long", text="string"), score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.concatenate([score_texts(model, chunk) for chunk in chunks_of(batch.column("text"))])
        return batch.filter(pa.array(scores >= threshold)).drop_columns(["text"])

    return map_arrow(plain.withColumn("text", F.col(f"c{names.index('text')}").cast("string")), good, plain.schema).toDF(*names)
