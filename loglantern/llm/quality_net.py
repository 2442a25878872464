"""Document quality by a convolutional network over bytes, in numpy.

Bytes are embedded and run through learned filters at every place of a text. The text is cut
into overlapping chunks that cover all of it; in each, every filter keeps its highest answer. A small dense layer
turns these into one logit a chunk, and the mean of a document's logits is its score's. The network is trained by
Adam on the chunks of a bounded sample of labelled rows; only its weights travel to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.llm.tables import remainder, table
from loglantern.llm.words import blocks

CELL = 128
#: A chunk has so many cells, and starts so many after the one before.
CHUNK_CELLS, STEP_CELLS = 4, 2
WIDTH, EMBEDDING, FILTERS, HIDDEN = 6, 8, 32, 16
#: Labelled documents that are learned from: at most so many of each label, and of each at most so many chunks.
LEARN_DOCUMENTS, LEARN_CHUNKS = 3000, 6
EPOCHS, BATCH, RATE = 14, 128, 4e-3
THRESHOLD = 0.7
_PAD = 256
_SLAB = 64  # cells in one product, to stay in a core's cache


@dataclass
class Net:
    """The weights; the last embedding is that of no byte, and stays 0."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Net:
        dice = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape, scale: (dice.standard_normal(shape) * scale).astype(np.float32)
        embedding = normal(257, EMBEDDING, scale=0.5)
        embedding[_PAD] = 0
        return cls(
            embedding,
            normal(WIDTH * EMBEDDING, FILTERS, scale=(WIDTH * EMBEDDING) ** -0.5),
            np.zeros(FILTERS, np.float32),
            normal(FILTERS + 1, HIDDEN, scale=(FILTERS + 1) ** -0.5),
            np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, scale=HIDDEN**-0.5),
            np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """The highest answer of each filter in each cell; codes has WIDTH - 1 more places than its cells."""
        n = (len(codes) - WIDTH + 1) // CELL
        out = np.empty((n, FILTERS), np.float32)
        for at in range(0, n, _SLAB):
            stop = min(n, at + _SLAB)
            seen = self.embedding[codes[at * CELL : stop * CELL + WIDTH - 1]]
            flat = np.lib.stride_tricks.as_strided(seen, ((stop - at) * CELL, WIDTH * EMBEDDING), (seen.strides[0], seen.strides[1]))
            out[at:stop] = (np.ascontiguousarray(flat) @ self.filters).reshape(stop - at, CELL, FILTERS).max(axis=1)
        return out

    def head(self, pooled: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logits of chunks, with what the layers before them give."""
        seen = np.column_stack([np.maximum(pooled + self.bias, 0), filled]).astype(np.float32)
        hidden = np.maximum(seen @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias[0], hidden, seen

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A probability for each text of a block, whatever texts lie next to it: the windows of a text's last
        cell look on into a cell of no bytes that is not pooled."""
        size = np.diff(bounds)
        cells = -(-(size + WIDTH - 1) // CELL)
        base = np.concatenate(([0], np.cumsum(cells + 1)))
        codes = np.full(base[-1] * CELL + WIDTH - 1, _PAD, np.uint16)
        for i, n in enumerate(size):
            codes[base[i] * CELL : base[i] * CELL + n] = data[bounds[i] : bounds[i + 1]]
        best = self.cells(codes)
        chunks = np.maximum(1, -(-(cells - CHUNK_CELLS) // STEP_CELLS) + 1)
        owner = np.repeat(np.arange(len(size)), chunks)
        first = base[:-1][owner] + STEP_CELLS * (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        last = base[1:][owner] - 2
        pooled = best[first]
        for k in range(1, CHUNK_CELLS):
            pooled = np.maximum(pooled, best[np.minimum(first + k, last)])
        filled = np.clip(size[owner] - (first - base[:-1][owner]) * CELL, 0, CHUNK_CELLS * CELL) / (CHUNK_CELLS * CELL)
        logits, _, _ = self.head(pooled, filled)
        mean = np.bincount(owner, logits, len(size)) / chunks
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def chunk_codes(data: np.ndarray) -> np.ndarray:
    """All chunks of one text as rows of codes, with the places that their last windows look on to."""
    cells = max(1, -(-(len(data) + WIDTH - 1) // CELL))
    chunks = max(1, -(-(cells - CHUNK_CELLS) // STEP_CELLS) + 1)
    codes = np.full(((chunks - 1) * STEP_CELLS + CHUNK_CELLS) * CELL + WIDTH - 1, _PAD, np.uint16)
    codes[: len(data)] = data
    size = CHUNK_CELLS * CELL + WIDTH - 1
    return np.lib.stride_tricks.sliding_window_view(codes, size)[:: STEP_CELLS * CELL]


def trained(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Net:
    """A network fitted to chunks (rows of codes), their labels and the weights they count with."""
    net = Net.fresh(seed)
    values = net.weights()
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    dice, step = np.random.Generator(np.random.PCG64(seed + 1)), 0
    filled = np.minimum(1, (codes != _PAD).sum(axis=1) / (CHUNK_CELLS * CELL))
    rounds = epochs * -(-len(codes) // BATCH)
    for _ in range(epochs):
        order = dice.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - step / (rounds + 1)) ** 0.7
            for v, g, m, s in zip(values, _slopes(net, codes[pick], filled[pick], labels[pick], weights[pick]), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.embedding[_PAD] = 0
    return net


def _slopes(net: Net, codes: np.ndarray, filled: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradients of the log loss; below the pooling they pass through the highest places alone."""
    n, places = len(codes), CHUNK_CELLS * CELL
    best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
    for at in range(0, n, 16):
        seen = net.embedding[codes[at : at + 16]]
        windows = np.lib.stride_tricks.as_strided(seen, (len(seen), places, WIDTH * EMBEDDING), (seen.strides[0], seen.strides[1], seen.strides[2]))
        answer = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBEDDING) @ net.filters).reshape(len(seen), places, FILTERS)
        where[at : at + 16] = answer.argmax(axis=1)
        best[at : at + 16] = answer.max(axis=1)
    logits, hidden, seen = net.head(best, filled)
    off = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weights / n).astype(np.float32)
    d_hidden = np.outer(off, net.out) * (hidden > 0)
    d_seen = (d_hidden @ net.dense.T)[:, :FILTERS] * (seen[:, :FILTERS] > 0)
    at = codes[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place: codes
    window = net.embedding[at].reshape(n, FILTERS, -1)
    d_filters = np.einsum("nf,nfk->kf", d_seen, window)
    d_window = (d_seen[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
    flat = at.reshape(-1).astype(np.int64)
    d_embedding = np.stack([np.bincount(flat, d_window[:, e], 257) for e in range(EMBEDDING)], axis=1).astype(np.float32)
    return [d_embedding, d_filters, d_seen.sum(axis=0), seen.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ off, off.sum(keepdims=True)]


def _learn_rows(most: int):
    def rows(batches):
        for batch, texts in blocks(batches):
            label = batch.column(batch.schema.get_field_index("label")).to_pylist()
            out, of = [], []
            for i in range(len(texts)):
                chunks = chunk_codes(texts.data[texts.bounds[i] : texts.bounds[i + 1]])
                for c in np.unique(np.linspace(0, len(chunks) - 1, min(most, len(chunks))).round().astype(int)):
                    out.append(np.ascontiguousarray(chunks[c]).tobytes())
                    of.append(label[i])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(out, pa.binary())], names=["label", "codes"])

    return rows


def learned(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCUMENTS) -> Net | None:
    """A network from at most `most` documents of each label, the first by a hash of their ids; None without both labels.

    docs: doc_id, text; labels: doc_id, quality (rows to learn from only; null labels and ids are ignored)."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    some = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # twice `most` rows of two numbers
    rows = sample.select("label", "text").mapInArrow(_learn_rows(LEARN_CHUNKS), "label int, codes binary").toArrow()
    y = rows.column("label").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint16).reshape(len(y), -1)
    order = np.lexsort(codes[:, ::37].T)  # the same from run to run, in whatever order rows arrive
    share = y.mean()
    weights = np.where(y == 1, min(1.0, (1 - share) / share * 2), min(1.0, share / (1 - share) * 2)).astype(np.float32)
    return trained(codes[order], y[order], weights[order])


def _score_rows(net: Net | None, columns: int, prior: float):
    def rows(batches):
        for batch, texts in blocks(batches):
            score = net.scores(texts.data, texts.bounds) if net else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(score.astype(float))], names=[*batch.schema.names[:columns], "_score"])

    return rows


def quality(docs: DataFrame, net: Net | None, prior: float = 0.5) -> DataFrame:
    """docs with `_score`, from 0 to 1, over the whole text of each; null and empty texts score as one empty chunk.

    Without a network every score is `prior`. Other columns are kept, `_score` is replaced."""
    docs = docs.drop("_score")
    schema = T.StructType([*docs.schema, T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(_score_rows(net, len(docs.columns), prior), schema)


def op1_quality_net(spark, sf_dir) -> DataFrame:
    """Scores of all documents by a network that has not seen those held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(remainder(F.col("doc_id"), 4) != 2)
    scored = quality(docs, learned(docs, labels)).drop("text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
