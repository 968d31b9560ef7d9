"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of 512 that overlap by 64 and cover the whole document. In each
chunk, learned filters over 8 embedded bytes run at every second byte; their rectified maxima over the
chunk go through a small dense layer, and the mean of the chunks' outputs, through a logistic curve, is
the probability of label 1.

It is trained by plain gradient descent (Adam) on a bounded sample of labelled rows: at most `per_class`
of each class with texts up to `max_chars`, of which a step takes at most `most_chunks` chunks at random, in a
fixed number of steps from fixed seeds, so reruns agree and the cost of training doesn't grow with the corpus.
Scoring reads whole texts.

Defined results: null text counts as empty; an empty text is one chunk of padding. Without both classes
among the labelled rows every score is the labelled rows' only class (1 if there are none). Repeated rows
stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 2
EMBED, FILTERS, HIDDEN = 8, 24, 16
STEPS = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


@dataclass
class Net:
    embed: np.ndarray  # (257, EMBED), the last row for padding
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of bytes, (n, CHUNK); 256 is padding."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hop = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // hop))
    padded = np.full((n - 1) * hop + CHUNK, 256, np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::hop]


def start(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    f = np.float32
    return Net(
        (r.standard_normal((257, EMBED)) * 0.5).astype(f), (r.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED) * 2).astype(f), np.zeros(FILTERS, f),
        (r.standard_normal((FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(f), np.zeros(HIDDEN, f), (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(f), np.zeros(1, f),
    )


def pooled(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of the filters over each chunk, where they are, and the embedded chunks."""
    e = net.embed[x].reshape(len(x), CHUNK * EMBED)
    windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    a = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ net.filters
    a = a.reshape(len(x), -1, FILTERS)
    at = a.argmax(axis=1)
    return np.take_along_axis(a, at[:, None], axis=1)[:, 0] + net.bias, at, e


def chunk_outputs(net: Net, x: np.ndarray) -> np.ndarray:
    """Outputs of chunks; a few hundred at a time, so memory doesn't follow the text's length."""
    found = []
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        e = net.embed[part].reshape(len(part), CHUNK * EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        a = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(part), -1, FILTERS)
        p = np.maximum(a.max(axis=1) + net.bias, 0)
        found.append(np.maximum(p @ net.dense + net.dense_bias, 0) @ net.out + net.out_bias[0])
    return np.concatenate(found)


def logits(net: Net, texts: list[str | None]) -> np.ndarray:
    """Mean output of each text's chunks. At most 256 chunks are embedded at a time, whatever the texts' lengths."""
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    parts, owners, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owners, held
        if held:
            np.add.at(sums, np.concatenate(owners), chunk_outputs(net, np.concatenate(parts)))
        parts, owners, held = [], [], 0

    for i, t in enumerate(texts):
        c = chunks(t)
        sizes[i] = len(c)
        for at in range(0, len(c), 256):
            part = c[at : at + 256]
            if held + len(part) > 256:
                flush()
            parts.append(part)
            owners.append(np.full(len(part), i))
            held += len(part)
    flush()
    return sums / np.maximum(sizes, 1)


def train(rows: list[tuple[str, int]], steps: int = 900, batch: int = 24, most_chunks: int = 5, rate: float = 4e-3, seed: int = 11) -> Net | None:
    """Fit to (text, label) rows; each step takes whole-document chunks at random from both classes alike."""
    by = [[chunks(t) for t, y in rows if y == k] for k in (0, 1)]
    if not all(by):
        return None
    net, r = start(), np.random.default_rng(seed)
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    prior = len(by[1]) / (len(by[0]) + len(by[1]))
    for step in range(1, steps + 1):
        docs, y = [], []
        for i in range(batch):
            group = by[i % 2]
            d = group[r.integers(len(group))]
            docs.append(d if len(d) <= most_chunks else d[np.sort(r.choice(len(d), most_chunks, replace=False))])
            y.append(i % 2)
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(batch), sizes)
        x = np.concatenate(docs)
        p, at, e = pooled(net, x)
        act = np.maximum(p, 0)
        h = act @ net.dense + net.dense_bias
        hid = np.maximum(h, 0)
        o = hid @ net.out + net.out_bias[0]
        z = np.bincount(owner, o, batch) / sizes
        g_o = (((1 / (1 + np.exp(-z)) - np.array(y)) / batch) / sizes)[owner].astype(np.float32)
        g_h = g_o[:, None] * net.out * (h > 0)
        g_p = (g_h @ net.dense.T) * (p > 0)
        g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
        where = at * STRIDE  # first byte of the window that won
        offsets = (where[:, :, None] + np.arange(WIDTH)).reshape(len(x), -1)
        won = np.take_along_axis(x, offsets, axis=1).reshape(len(x), FILTERS, WIDTH)
        seen = net.embed[won].reshape(len(x), FILTERS, WIDTH * EMBED)
        g_filters = np.einsum("nf,nfk->kf", g_p, seen)
        back = (g_p[:, :, None] * net.filters.T).reshape(-1, EMBED)
        flat = won.reshape(-1)
        for k in range(EMBED):
            g_embed[:, k] = np.bincount(flat, back[:, k], 257)
        grads = [g_embed, g_filters, g_p.sum(0), act.T @ g_h, g_h.sum(0), hid.T @ g_o, g_o.sum(keepdims=True)]
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for w, g, a, b in zip(net.weights(), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.out_bias += np.float32(np.log(prior / (1 - prior)))  # training saw both classes alike
    return net


def score(df: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, only: float = 1.0) -> DataFrame:
    """One row per input row: id, score, predicted. No shuffle. `only`: the score where there is no net."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts = batch.column(1).slice(at, 200).to_pylist()
                p = 1 / (1 + np.exp(-logits(net, texts).astype(float))) if net else np.full(len(texts), only)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 200), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(work, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op10_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out fifth are not read."""
    from .common import documents, held_out, labels
    from .toxicity import sample

    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).filter(~held_out(F.col("doc_id"), 5, 0) & F.col("quality").isin(0, 1))
    rows = sample(docs, known, "quality", per_class=1500, max_chars=20_000)
    scored = score(docs, train(rows), threshold=0.3, only=float(rows[0][1]) if rows else 1.0)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
