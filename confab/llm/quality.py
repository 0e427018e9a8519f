"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are embedded and convolved at every byte (windows of 8 bytes, learned filters, ReLU), the activations
max-pooled over overlapping chunks of 512 bytes that cover the whole text, each chunk passed through a small
hidden layer, and the chunks' hidden values averaged into one logistic unit.

At prediction the windows of some blocks of bytes are laid side by side, so that the convolution is one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text

WIDTH = 8
BLOCK = 128  # bytes whose windows are pooled first
CHUNK, STEP = 4, 2  # blocks in a chunk, blocks from chunk to chunk


@dataclass
class ByteCnn:
    """embed 256 x E; conv (8 E) x F; bias F; hidden F x H with bias; out H with bias."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @staticmethod
    def start(seed: int, size: int = 8, filters: int = 24, hidden: int = 16) -> ByteCnn:
        r = np.random.default_rng(seed)
        at = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        return ByteCnn(at(256, size, by=0.5), at(WIDTH * size, filters, by=(WIDTH * size) ** -0.5), np.zeros(filters, np.float32), at(filters, hidden, by=filters**-0.5), np.zeros(hidden, np.float32), at(hidden, by=hidden**-0.5), 0.0)


class Scorer:
    """Applies a network to batches of texts."""

    RANGE = 96  # blocks at once: a few megabytes of windows

    def __init__(self, net: ByteCnn):
        self.net = net

    def score(self, texts: list[str]) -> np.ndarray:
        data = [x.encode("utf-8", "surrogatepass") for x in texts]
        sizes = np.array([len(x) for x in data], np.int64)
        blocks = np.maximum(1, -(-sizes // BLOCK))
        room = np.maximum(-(-(sizes + WIDTH) // BLOCK), blocks)  # room behind a text keeps windows from the next
        raw = np.frombuffer(b"".join(x.ljust(int(n) * BLOCK, b"\0") for x, n in zip(data, room, strict=True)) + b"\0" * WIDTH, np.uint8)
        first = np.concatenate([[0], np.cumsum(room)])
        pooled = np.empty((int(first[-1]), self.net.bias.size), np.float32)
        # places behind a text's last byte don't count (an empty text has one: all zero bytes)
        ends = first[:-1] * BLOCK + np.maximum(1, sizes)
        size = self.net.embed.shape[1]
        for b in range(0, int(first[-1]), self.RANGE):
            n = min(self.RANGE, int(first[-1]) - b)
            p, m = b * BLOCK, n * BLOCK
            e = self.net.embed[raw[p : p + m + WIDTH]].ravel()
            windows = np.lib.stride_tricks.as_strided(e, (m, WIDTH * size), (size * e.itemsize, e.itemsize))
            a = self.net.conv.T @ np.ascontiguousarray(windows).T  # filters x places
            low, high = np.searchsorted(ends, [p, p + m])
            for d in range(max(0, low - 1), min(high + 1, len(texts))):
                a[:, max(int(ends[d]) - p, 0) : max(0, min(int(first[d + 1]) * BLOCK - p, m))] = -np.inf
            pooled[b : b + n] = a.reshape(-1, n, BLOCK).max(2).T
        return self._combine(pooled, first[:-1], blocks)

    def _combine(self, pooled: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        net = self.net
        chunks = 1 + np.maximum(0, -(-(blocks - CHUNK) // STEP))
        doc = np.repeat(np.arange(len(blocks)), chunks)
        begin = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * STEP
        last = (first + blocks - 1)[doc]
        x = pooled[begin]
        for k in range(1, CHUNK):
            x = np.maximum(x, pooled[np.minimum(begin + k, last)])
        h = np.tanh(np.maximum(x + net.bias, 0) @ net.hidden + net.hidden_bias)
        z = (np.add.reduceat(h, np.cumsum(chunks) - chunks, axis=0) / chunks[:, None]) @ net.out + net.out_bias if len(blocks) else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-z.astype(np.float64)))


def gradients(net: ByteCnn, raw: np.ndarray, live: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighed mean logistic loss of chunks (raw: rows x bytes; live: which places count) and its gradients."""
    size, places = net.embed.shape[1], live.shape[1]
    idx = raw[:, np.arange(places)[:, None] + np.arange(WIDTH)]  # rows x places x WIDTH
    e = net.embed[idx].reshape(len(raw), places, WIDTH * size)
    a = e @ net.conv
    a[~live] = -np.inf
    best = a.argmax(1)  # rows x F
    x = np.take_along_axis(a, best[:, None, :], 1)[:, 0] + net.bias
    relu = np.maximum(x, 0)
    h = np.tanh(relu @ net.hidden + net.hidden_bias)
    z = h @ net.out + net.out_bias
    share = w / w.sum()
    loss = float((share * (np.logaddexp(0, z) - y * z)).sum())
    d = ((1 / (1 + np.exp(-z)) - y) * share).astype(net.out.dtype)
    g = {"out": h.T @ d, "out_bias": np.asarray(d.sum(), net.out.dtype)}
    dh = d[:, None] * net.out * (1 - h * h)
    g["hidden"], g["hidden_bias"] = relu.T @ dh, dh.sum(0)
    dx = (dh @ net.hidden.T) * (x > 0)
    g["bias"] = dx.sum(0)
    top = np.take_along_axis(e, best[:, :, None], 1)  # rows x F x (WIDTH size)
    g["conv"] = np.einsum("rfk,rf->kf", top, dx)
    de = (dx[:, :, None] * net.conv.T[None]).reshape(-1, size)
    g["embed"] = np.zeros_like(net.embed)
    np.add.at(g["embed"], np.take_along_axis(idx, best[:, :, None], 1).reshape(-1), de)
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> ByteCnn:
    """Adam on the logistic loss of single chunks: in each epoch every text gives one of its chunks, drawn evenly."""
    r = np.random.default_rng(seed)
    net = ByteCnn.start(seed)
    names = ["embed", "conv", "bias", "hidden", "hidden_bias", "out", "out_bias"]
    unit, width = BLOCK, CHUNK * BLOCK
    m = {k: np.zeros_like(np.asarray(getattr(net, k), np.float32)) for k in names}
    v = {k: x.copy() for k, x in m.items()}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            raw, live = np.zeros((len(rows), width + WIDTH), np.uint8), np.zeros((len(rows), width), bool)
            for i, k in enumerate(rows):
                t = texts[k]
                blocks = max(1, -(-len(t) // unit))
                begin = int(r.integers(0, 1 + max(0, -(-(blocks - CHUNK) // STEP)))) * STEP * unit
                part = t[begin : begin + width + WIDTH]
                raw[i, : len(part)] = np.frombuffer(part, np.uint8)
                live[i, : max(1, min(len(t) - begin, width))] = True
            _, g = gradients(net, raw, live, labels[rows], weights[rows])
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                new = getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, float(new) if k == "out_bias" else new.astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, sample: int = 2000, sample_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteCnn | None:
    """Learns from labelled rows where train_rows (over the id) holds; None if there is no such row.

    It fits on a bounded sample: up to about sample / 2 rows of each label, chosen by a hash of the id (4 * sample at most, also
    where one id has very many rows), and at most sample_bytes of them (the bound holds before texts reach the driver); the loss weighs them back to the labels' true shares. An id with several labels counts with
    each, null labels with none."""
    marked = labels.where(train_rows & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    per = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    if not per:
        return None
    mark = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, sample / 2 / n))) for y, n in sorted(per.items())])
    chosen = marked.where(mark < share * (1 << 30))
    # about sample rows, unless an id has very many labels
    chosen = F.broadcast(chosen) if chosen.count() <= 4 * sample else chosen
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b")).join(chosen, "id")
    # rows in the order of another hash, as many as sample_bytes hold; their sizes come to the driver before any text
    rows = rows.withColumn("place", F.xxhash64(F.lit("order"), "id", "y")).withColumn("size", F.length("b"))
    sizes = [(r["place"], r["size"]) for r in rows.select("place", "size").orderBy("place", "size").limit(4 * sample).collect()]
    fits = np.cumsum([0, *(n for _, n in sizes)])[1:] <= sample_bytes
    if not sizes:
        return None
    # the first row is kept however long it is, cut to the bound: what is fitted are chunks
    many = max(1, int(fits.sum()))
    first = rows.where(F.col("place") <= sizes[many - 1][0]).orderBy("place", "size").limit(many)
    found = sorted((r["place"], bytes(r["b"]), r["y"]) for r in first.select("place", F.expr(f"substring(b, 1, {sample_bytes})").alias("b"), "y").collect())
    texts, y = [b for _, b, _ in found], [k for _, _, k in found]
    y = np.array(y)
    seen, true = np.bincount(y, minlength=2), np.array([per.get(0, 0), per.get(1, 0)], float)
    weight = (true / true.sum() / np.maximum(seen, 1) * len(y))[y]
    return train(texts, y, weight)


def predict(docs: DataFrame, net: ByteCnn | None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the columns in keep, score (probability of label 1) and predicted (1 if score >= 0.5) of each row.

    Null texts count as empty, and an empty text is scored like any other (one window of zero bytes). Without a network
    every score is 0.5. Repeated rows give a row each; an empty table gives none; other columns aren't read."""
    kinds = dict(docs.dtypes)
    columns = [id_col, *keep]
    made: list[Scorer] = []

    def make(rest, found):
        if net is None:
            s = np.full(len(found), 0.5)
        else:
            if not made:
                made.append(Scorer(net))
            s = made[0].score(found)
        return rest | {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return by_text(docs, columns, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", score double, predicted int", make, text_col)
