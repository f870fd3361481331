"""Quality classifier: a byte-level convolutional network in numpy.

A text (null: empty) is UTF-8 bytes, cut into chunks of 256 bytes that overlap by half and cover all of it (the last one ends with the
text; texts under 256 bytes are one chunk, filled up with a padding symbol). Bytes have learned vectors; learned filters of 7 bytes
slide over each chunk, and the maximum and the mean of each filter's output describe it. A hidden layer turns a chunk into a few numbers, whose means
over the chunks give one probability by a logistic layer. Nothing but the bytes enters a score.

Labels come from rows whose crc32 of the id is not 1 modulo 3. ``MAX_TRAINING_ROWS`` bounds the rows that are learned from (those with
the least hash of their id, also where ids repeat); every chunk of their texts is used, as scores use all chunks of all texts.
Training runs on the driver over that bounded sample, with fixed seeds. Null labels and labels without a document are not used;
without labels of both kinds each score is the share of label 1 (one half without any). Repeated rows get equal scores, and very long
texts are scored in parts of bounded size. Other columns are not touched: the result has the id and the scores only. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, table

CHUNK, STEP, WIDTH = 256, 128, 7
VECTOR, FILTERS, HIDDEN = 6, 16, 8
PAD = 256
MAX_TRAINING_ROWS = 2000
EPOCHS, BATCH, RATE = 6, 24, 0.01
#: Bytes that are scored at a time, to bound memory.
AT_ONCE = 1 << 18
PLACES = CHUNK - WIDTH + 1


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Network:
    vectors: np.ndarray  # 257 x VECTOR
    filters: np.ndarray  # WIDTH x VECTOR x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(normal(0.5, 257, VECTOR), normal((WIDTH * VECTOR) ** -0.5, WIDTH, VECTOR, FILTERS), zeros(FILTERS), normal((2 * FILTERS) ** -0.5, 2 * FILTERS, HIDDEN), zeros(HIDDEN), normal(HIDDEN**-0.5, HIDDEN), zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """WIDTH x 257 x FILTERS: what a byte adds to each filter at each place."""
        return np.einsum("bv,wvf->wbf", self.vectors, self.filters)

    def after(self, features: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden numbers of chunks, their means by document, probabilities."""
        h = np.maximum(features @ self.hidden + self.hidden_bias, 0)
        mean = np.zeros((docs, HIDDEN), np.float32)
        np.add.at(mean, owner, h)
        mean /= np.bincount(owner, minlength=docs)[:, None]
        return h, mean, 1 / (1 + np.exp(-np.clip(mean @ self.out + self.out_bias[0], -30, 30)))

    def score(self, text: bytes, tables: np.ndarray) -> float:
        """Filters run once over the text, as chunks share their places."""
        b = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64), np.full(max(0, CHUNK - len(text)), PAD)])
        starts = chunk_starts(len(b))
        features = np.empty((len(starts), 2 * FILTERS), np.float32)
        for i in range(0, len(starts), AT_ONCE // STEP):
            s = starts[i : i + AT_ONCE // STEP]
            part = b[s[0] : s[-1] + CHUNK]
            n = len(part) - WIDTH + 1
            z = tables[0][part[:n]]
            for w in range(1, WIDTH):
                z += tables[w][part[w : w + n]]
            z = np.maximum(z + self.bias, 0)
            # each chunk is a run of places; what lies between two runs is left out
            first = s - s[0]
            bounds = np.stack([first, first + PLACES], axis=1).ravel()[:-1]
            features[i : i + len(s), :FILTERS] = np.maximum.reduceat(z, bounds, axis=0)[::2]
            features[i : i + len(s), FILTERS:] = np.add.reduceat(z, bounds, axis=0)[::2] / PLACES
        return float(self.after(features, np.zeros(len(starts), np.int64), 1)[2][0])


def chunk_starts(n: int) -> np.ndarray:
    starts = np.arange(0, n - CHUNK + 1, STEP)
    return starts if starts[-1] == n - CHUNK else np.append(starts, n - CHUNK)


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> Network:
    """``chunks`` (n x CHUNK symbols) of documents ``owner`` with 0/1 ``labels``: Adam on the log loss."""
    net, rng = Network.fresh(), np.random.default_rng(2)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(labels) + 1))
    step = 0
    for epoch in range(EPOCHS):
        docs = rng.permutation(len(labels))
        for i in range(0, len(docs), BATCH):
            part = docs[i : i + BATCH]
            rows = np.concatenate([order[first[d] : first[d + 1]] for d in part])
            own = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            grads = gradients(net, chunks[rows], own, labels[part])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * m / (np.sqrt(v) + 1e-8)
    return net


def gradients(net: Network, c: np.ndarray, own: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, k = len(c), np.arange(len(c))
    x = net.vectors[c]
    columns = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * PLACES, WIDTH * VECTOR)
    z = np.maximum((columns @ net.filters.reshape(-1, FILTERS) + net.bias).reshape(n, PLACES, FILTERS), 0)
    top = z.argmax(axis=1)
    features = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)
    h, mean, p = net.after(features, own, len(y))
    dz = ((p - y) / len(y)).astype(np.float32)
    d_mean = dz[:, None] * net.out
    d_h = (d_mean / np.bincount(own)[:, None])[own] * (h > 0)
    d_f = d_h @ net.hidden.T
    d_z = np.repeat((d_f[:, None, FILTERS:] / PLACES), PLACES, axis=1)
    np.add.at(d_z, (k[:, None], top, np.arange(FILTERS)), d_f[:, :FILTERS])
    d_z = (d_z * (z > 0)).reshape(n * PLACES, FILTERS)
    d_columns = (d_z @ net.filters.reshape(-1, FILTERS).T).reshape(n, PLACES, WIDTH, VECTOR)
    d_x = np.zeros_like(x)
    for w in range(WIDTH):
        d_x[:, w : w + PLACES] += d_columns[:, :, w]
    symbol = c.ravel()
    d_vectors = np.stack([np.bincount(symbol, d_x[..., v].ravel(), 257) for v in range(VECTOR)], axis=1).astype(np.float32)
    return [d_vectors, (columns.T @ d_z).reshape(WIDTH, VECTOR, FILTERS), d_z.sum(0), features.T @ d_h, d_h.sum(0), mean.T @ dz, dz.sum(keepdims=True)]


def chunks_of(text: bytes) -> np.ndarray:
    """All chunks of a text, as rows of symbols."""
    b = np.full(max(CHUNK, len(text)), PAD, np.int16)
    b[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(b, CHUNK)[chunk_starts(len(b))]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network | float:
    """The network, or the share of label 1 where there is nothing to tell apart."""
    known = labels.select(column(doc_id).alias("id"), column(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(MAX_TRAINING_ROWS)
    texts = docs.select(column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text"))
    # ids may repeat in ``docs``: the bound holds for rows
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", "text"), "id").limit(MAX_TRAINING_ROWS)
    got = [(r["label"], chunks_of(r["text"].encode())) for r in rows.select("label", "text").collect()]
    y = np.array([g[0] for g in got], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return train(np.concatenate([c for _, c in got]), np.repeat(np.arange(len(y)), [len(c) for _, c in got]), y)


def scores(docs: DataFrame, model: Network | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None if isinstance(model, float) else model.tables()
        for b in batches:
            s = [model if tables is None else model.score(t.encode(), tables) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "score": s})

    rows = docs.select(column(doc_id).alias("id"), is_held_out(column(doc_id)).alias("held_out"), F.coalesce(column(text), F.lit("")).alias("text"))
    done = rows.mapInPandas(run, f"id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, score double")
    return done.select(F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
