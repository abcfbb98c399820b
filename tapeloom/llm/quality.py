"""Text quality by a convolutional network over bytes, in numpy.

Bytes are embedded, filters run over overlapping chunks of 16 bytes, one every 4
bytes from the first byte of the document to its last, each filter keeps its
largest response, and a small dense layer combines those into one probability.
Embedding, filters and dense layer are learnt by backpropagation: only the chunk
that won a filter's maximum carries its gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField

from tapeloom.llm.common import labelled_sample, map_texts

EMBEDDING, STEP, PARTS, FILTERS, HIDDEN = 8, 4, 4, 32, 16
CHUNK = STEP * PARTS
#: Labelled texts the network is fitted on, at most: those with the smallest hash of the id, per class.
SAMPLE = {0: 2000, 1: 2500}
EPOCHS, BATCH, RATE = 6, 32, 4e-3
#: Steps of four bytes that go through the filters at once.
AT_ONCE = 1 << 15


@dataclass
class Layout:
    """Texts one after another in zero-filled steps of four bytes, with room for the last chunk of each."""

    steps: np.ndarray  # (n, STEP) bytes
    starts: np.ndarray  # first step of each text
    counts: np.ndarray  # chunks of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.maximum(1, -(-sizes // STEP))
        ends = np.cumsum(counts + PARTS - 1)
        starts = ends - counts - PARTS + 1
        flat = b"".join(t.ljust((n + PARTS - 1) * STEP, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
        return cls(np.frombuffer(flat, np.uint8).reshape(-1, STEP), starts, counts)


class Network:
    """Parameters, in single precision, and what is computed from them."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.embedding = normal(256, EMBEDDING, scale=0.5)
        self.filters = normal(CHUNK * EMBEDDING, FILTERS, scale=(CHUNK * EMBEDDING) ** -0.5)
        self.bias = np.zeros(FILTERS, np.float32)
        self.inner = normal(FILTERS, HIDDEN, scale=FILTERS**-0.5)
        self.inner_bias = np.zeros(HIDDEN, np.float32)
        self.outer = normal(HIDDEN, scale=HIDDEN**-0.5)
        self.outer_bias = np.zeros(1, np.float32)

    def parameters(self) -> dict[str, np.ndarray]:
        return vars(self)

    def responses(self, steps: np.ndarray) -> np.ndarray:
        """Filter responses of the chunks that begin at all steps but the last PARTS - 1."""
        points = self.embedding[steps].reshape(len(steps), STEP * EMBEDDING)
        # The filters cut in four parts of one step each: one product for all, then shifted sums.
        weights = self.filters.reshape(PARTS, STEP * EMBEDDING, FILTERS).transpose(1, 0, 2).reshape(STEP * EMBEDDING, -1)
        parts = (points @ weights).reshape(len(steps), PARTS, FILTERS)
        n = len(steps) - PARTS + 1
        total = parts[:n, 0] + parts[1 : n + 1, 1]
        for i in range(2, PARTS):
            total += parts[i : n + i, i]
        return total

    def pooled(self, layout: Layout) -> np.ndarray:
        """The largest response of each filter in each text, whatever its length."""
        best = np.full((len(layout.starts), FILTERS), -np.inf, np.float32)
        ends = layout.starts + layout.counts
        for first in range(0, len(layout.steps), AT_ONCE):
            last = min(first + AT_ONCE, len(layout.steps))
            found = self.responses(layout.steps[first : last + PARTS - 1])
            a, b = np.searchsorted(ends, first, "right"), np.searchsorted(layout.starts, first + len(found), "left")
            if a >= b:
                continue
            low = np.maximum(layout.starts[a:b] - first, 0)
            high = np.minimum(ends[a:b] - first, len(found))
            # Pairs (low, high): every other segment lies between texts. The appended row lets high be the end.
            padded = np.vstack([found, np.full((1, FILTERS), -np.inf, np.float32)])
            some = np.maximum.reduceat(padded, np.stack([low, high], 1).ravel(), axis=0)[::2]
            best[a:b] = np.maximum(best[a:b], some)
        return best + self.bias

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.maximum(pooled, 0) @ self.inner + self.inner_bias, 0)
        logit = (hidden @ self.outer + self.outer_bias[0]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.probability(self.pooled(Layout.of(texts)))

    def gradients(self, layout: Layout, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log-loss of a batch."""
        found = self.responses(layout.steps)
        won = np.stack([s + found[s : s + n].argmax(axis=0) for s, n in zip(layout.starts, layout.counts, strict=True)])
        pooled = np.take_along_axis(found, won, axis=0) + self.bias
        act = np.maximum(pooled, 0)
        before = act @ self.inner + self.inner_bias
        hidden = np.maximum(before, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.outer + self.outer_bias[0], -30, 30)))
        d_logit = ((p - y) * weight / len(y)).astype(np.float32)
        d_before = np.outer(d_logit, self.outer) * (before > 0)
        d_pooled = (d_before @ self.inner.T) * (pooled > 0)
        chunks = layout.steps[won[..., None] + np.arange(PARTS)].reshape(*won.shape, CHUNK)
        points = self.embedding[chunks].reshape(*won.shape, CHUNK * EMBEDDING)
        d_points = (d_pooled[..., None] * self.filters.T).reshape(-1, EMBEDDING)
        flat = chunks.reshape(-1)
        d_embedding = np.stack([np.bincount(flat, d_points[:, k], 256) for k in range(EMBEDDING)], axis=1)
        return {
            "embedding": d_embedding.astype(np.float32), "filters": np.einsum("df,dfc->cf", d_pooled, points),
            "bias": d_pooled.sum(0), "inner": act.T @ d_before, "inner_bias": d_before.sum(0),
            "outer": hidden.T @ d_logit, "outer_bias": d_logit.sum(keepdims=True),
        }


def learn(sample: list[tuple[bytes, int]], seed: int = 5) -> Network:
    """A network fitted by Adam to (text, quality) pairs; both classes weigh the same. Without both it stays untrained."""
    network, rng = Network(seed), np.random.default_rng(seed)
    y = np.array([label for _, label in sample], np.float32)
    if not 0 < y.sum() < len(y):
        return network
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in network.parameters().items()}
    square = {k: np.zeros_like(v) for k, v in network.parameters().items()}
    turns = max(EPOCHS, -(-200 * BATCH // len(y)))
    total, t = turns * -(-len(y) // BATCH), 0
    for _ in range(turns):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            t += 1
            rate = RATE * (1 - 0.9 * t / total)
            found = network.gradients(Layout.of([sample[i][0] for i in some]), y[some], weight[some])
            for k, g in found.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                step = rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
                network.parameters()[k][...] -= step
    return network


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Network:
    """A network from the labelled documents for which `usable` holds, a bounded sample of them (SAMPLE)."""
    rows = labelled_sample(docs, labels, "quality", usable, SAMPLE).select("text", "y").toArrow()
    return learn(sorted(zip(rows["text"].to_pylist(), rows["y"].to_pylist(), strict=True)))


def score(docs: DataFrame, network: Network, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability of good quality in the place of the text.

    Whole texts are scored, of any length in bounded memory. A null or empty text is one
    chunk of zeros. Repeated rows are scored each, an empty table gives an empty table,
    other columns pass through; one named as the score is replaced.
    """
    def make():
        return lambda texts: [pa.array(network.score(texts), pa.float64())]

    return map_texts(docs.drop(name) if name != text else docs, text, [StructField(name, DoubleType())], make)
