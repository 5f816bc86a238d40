"""Quality classifier: a byte-level convolutional network in numpy over chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import below_share
from courtlake.llm.token_memo import small_batches

CHUNK, OVERLAP = 512, 64  # bytes
WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 2, 24, 6
GRAM, FAR = 6, 40  # the repeat channel: the last GRAM bytes also ended 3 to FAR bytes before
AT_ONCE = 64  # chunks that a task evaluates together

#: Defaults of ``train``: labelled documents at most, and chunks of each, spread over the text.
SAMPLE_DOCUMENTS, SAMPLE_CHUNKS = 3000, 24
STEPS, BATCH, RATE = 500, 32, 0.01


def chunks(data: bytes) -> np.ndarray:
    """All overlapping chunks of a text, the last one filled with zero bytes; one empty chunk for no text."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def repeats(block: np.ndarray) -> np.ndarray:
    """1 where the last bytes of a chunk repeat bytes shortly before, 0 elsewhere."""
    codes = np.zeros((len(block), CHUNK - GRAM + 1), np.uint64)
    for j in range(GRAM):
        codes = (codes << np.uint64(8)) | block[:, j : CHUNK - GRAM + 1 + j]
    seen = np.zeros(codes.shape, bool)
    for lag in range(3, FAR + 1):
        seen[:, lag:] |= codes[:, lag:] == codes[:, :-lag]
    out = np.zeros(block.shape, np.float32)
    out[:, GRAM - 1 :] = seen & (block[:, GRAM - 1 :] > 0)
    return out


@dataclass
class Network:
    """Embedding, one convolution, max-pooling per chunk; mean and maximum over the chunks; a logistic unit."""

    embedding: np.ndarray  # 256 x EMBEDDING; zero bytes stay zero
    filters: np.ndarray  # WIDTH * (EMBEDDING + 1) x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
        inner = WIDTH * (EMBEDDING + 1)
        net = cls(normal(0.5, 256, EMBEDDING), normal(1 / np.sqrt(inner), inner, FILTERS), np.zeros(FILTERS, np.float32), normal(0.1, 2 * FILTERS), np.zeros(1, np.float32))
        net.embedding[0] = 0
        return net

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def _windows(self, block: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.embedding[block], repeats(block)[:, :, None]], axis=2).reshape(len(block), -1)
        depth = EMBEDDING + 1
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * depth, axis=1)[:, :: STRIDE * depth]

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per chunk and filter the largest response (0 at least) and its place; and the windows."""
        windows = self._windows(block)
        responses = (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(len(block), -1, FILTERS)
        place = responses.argmax(axis=1)
        top = np.take_along_axis(responses, place[:, None], 1)[:, 0] + self.bias
        return np.maximum(top, 0), place, windows

    def features(self, block: np.ndarray) -> np.ndarray:
        """Per chunk and filter the largest response, some chunks at a time."""
        out = np.empty((len(block), FILTERS), np.float32)
        for a in range(0, len(block), AT_ONCE):
            windows = self._windows(block[a : a + AT_ONCE])
            responses = windows.reshape(-1, windows.shape[2]) @ self.filters
            out[a : a + AT_ONCE] = responses.reshape(len(windows), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each text."""
        pieces = [chunks(t.encode()) for t in texts]
        counts = np.array([len(p) for p in pieces])
        top = self.features(np.concatenate(pieces))
        first = np.cumsum(counts) - counts
        joint = np.concatenate([np.add.reduceat(top, first) / counts[:, None], np.maximum.reduceat(top, first)], axis=1)
        return 1 / (1 + np.exp(-(joint @ self.weights + self.offset[0]).astype(np.float64)))


def _gradients(net: Network, documents: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over some documents, given as chunks."""
    counts = np.array([len(d) for d in documents])
    first, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    block = np.concatenate(documents)
    top, place, windows = net.pooled(block)
    mean, most = np.add.reduceat(top, first) / counts[:, None], np.maximum.reduceat(top, first)
    joint = np.concatenate([mean, most], axis=1)
    error = (1 / (1 + np.exp(-(joint @ net.weights + net.offset[0]))) - labels).astype(np.float32) / len(labels)

    d_mean, d_most = error[:, None] * net.weights[:FILTERS], error[:, None] * net.weights[FILTERS:]
    at_most = top == most[owner]
    d_top = d_mean[owner] / counts[owner, None] + d_most[owner] * at_most / np.maximum(np.add.reduceat(at_most.astype(np.float32), first)[owner], 1)
    d_top = (d_top * (top > 0)).astype(np.float32)
    seen = np.take_along_axis(windows, place[:, :, None], 1)  # chunk, filter, inputs
    d_filters = np.einsum("cf,cfi->if", d_top, seen)
    d_seen = (d_top[:, :, None] * net.filters.T).reshape(*d_top.shape, WIDTH, EMBEDDING + 1)[..., :EMBEDDING]
    bytes_at = np.take_along_axis(block[:, None, :], (place * STRIDE)[:, :, None] + np.arange(WIDTH), 2)
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, bytes_at, d_seen)
    d_embedding[0] = 0
    return [d_embedding, d_filters, d_top.sum(0), joint.T @ error, error.sum(keepdims=True)]


def fit(documents: list[np.ndarray], labels: np.ndarray) -> Network:
    """Adam on shuffled batches; the same sample gives the same network."""
    net, draw = Network.start(), np.random.default_rng(12)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    order = np.empty(0, int)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(documents)):
            order = draw.permutation(len(documents))
        batch, order = order[:BATCH], order[BATCH:]
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, g, (m, v) in zip(net.parts(), _gradients(net, [documents[i] for i in batch], labels[batch]), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _sample(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                whole = chunks(text.encode())
                n = len(whole) if most is None else min(most, len(whole))
                at = np.unique(np.linspace(0, len(whole) - 1, n).astype(int))
                out.append(whole[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("label")], ["chunks", "label"])

    return run


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_documents: int = SAMPLE_DOCUMENTS, sample_chunks: int | None = SAMPLE_CHUNKS,
) -> Network | None:
    """Fit on the labelled rows of least md5 of the key, ``sample_documents`` at most; None without any.

    Each gives ``sample_chunks`` chunks, spread over its text, or all of them if that is None. Rows with a
    null key, label or text are not used. The sample is cut to size on the labels alone, before any text is read; its rows are sorted, so that reruns fit the same network.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("label")).dropna().dropDuplicates(["k"])
    marked = marked.withColumn("order", F.md5(F.col("k").cast("string")))
    marked = marked.where(below_share(F.col("order"), sample_documents, labels.count())).orderBy("order", "k").limit(sample_documents)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("text")).dropna().join(marked, "k")
    sample = rows.select("text", "label").mapInArrow(_sample(sample_chunks), "chunks binary, label double").toArrow().sort_by([("chunks", "ascending"), ("label", "ascending")])
    if not len(sample):
        return None
    blocks = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c in sample.column("chunks").to_pylist()]
    return fit(blocks, sample.column("label").to_numpy().astype(np.float32))


def _scorer(net: Network | None, text: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (pa.RecordBatch.from_arrays([b.column("kept"), b.column("kept").field(text) if text else b.column("text")], ["kept", "text"]) for b in batches)
        for batch in small_batches(whole):
            texts = batch.column("text").fill_null("").to_pylist()
            score = net.scores(texts) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(score, pa.float64())], ["kept", "score"])

    return run


def quality_scores(documents: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``kept`` (a struct of the ``keep`` columns) and its score, from 0 to 1.

    The whole text is cut into overlapping chunks of bytes; learned filters over the bytes (and a mark of
    bytes that repeat) are max-pooled per chunk, and the mean and the maximum over the chunks give one
    probability. Null and empty texts are scored as one empty chunk. Without a network (no labels) every
    score is 0.5. Repeated rows have the same score.
    """
    rows = documents.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if text in keep:  # one copy of the text goes to the tasks
        rows = rows.select("kept")
    return rows.mapInArrow(_scorer(net, text if text in keep else None), f"kept {rows.schema['kept'].dataType.simpleString()}, score double")


def without_rejected(documents: DataFrame, net: Network | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, with a score of ``least`` or more; all rows without a network."""
    if net is None:
        return documents
    return quality_scores(documents, net, documents.columns, text).where(F.col("score") >= least).select("kept.*")
