"""Quality classifier: a small convolutional network over the bytes of a whole document, in numpy."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from hostvigil.llm.common import named, text_function, without
from hostvigil.session import materialize

CHUNK = 256  # bytes of a chunk
BLOCK = 4  # bytes that enter one matrix product; filters look at every byte all the same
WIDTH = 16  # bytes a filter sees
STEP = CHUNK - WIDTH  # chunks overlap by a filter's width, so every window lies in a chunk
EMBED, FILTERS, HIDDEN = 8, 16, 16
TRAIN_ROWS, TRAIN_BYTES = 3000, 6_000_000
TRAIN_SHARE = 100  # a text above this part of the bytes enters a sample after all others
EPOCHS, LEAST_STEPS, RATE, BATCH = 12, 400, 0.01, 32
THRESHOLD = 0.3
OUTPUT = ("score", "predicted")
_SLICE = 1024  # chunks held at a time


def chunks_of(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text in overlapping chunks, padded with 0; one empty chunk for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-max(0, data.size - WIDTH) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[: data.size] = data
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))


@dataclass
class ByteNet:
    """Byte embeddings, filters over WIDTH bytes at every offset, the maximum per chunk, and over a document the maximum and
    the mean of those, which a small layer combines into one probability."""

    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH // BLOCK, BLOCK * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (2 * FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray  # (1,)

    @staticmethod
    def start(seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return ByteNet(
            draw(256, EMBED, scale=0.5), draw(WIDTH // BLOCK, BLOCK * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), np.zeros(FILTERS, np.float32),
            draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk and filter the greatest response, cut at 0, and the offset of the window that gave it.

        Blocks of BLOCK bytes give the responses of all windows that begin at a block; as many views, each a byte further,
        give those of all others.
        """
        n, parts = chunks.shape[0], WIDTH // BLOCK
        embedded, joint = self.embed[chunks], np.concatenate(list(self.filters), axis=1)
        best, at = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
        for shift in range(BLOCK):
            size = (CHUNK - shift) // BLOCK
            blocks = embedded[:, shift : shift + size * BLOCK].reshape(n * size, BLOCK * EMBED)
            each = (blocks @ joint).reshape(n, size, parts, FILTERS)
            windows = size - parts + 1
            total = each[:, :windows, 0]
            for p in range(1, parts):
                total = total + each[:, p : p + windows, p]
            first = total.argmax(axis=1)
            most = np.take_along_axis(total, first[:, None], axis=1)[:, 0]
            at = np.where(most > best, first * BLOCK + shift, at)
            best = np.maximum(most, best)
        return np.maximum(best + self.bias, 0), at

    def combine(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(features @ self.hidden + self.hidden_bias, 0)
        return 1 / (1 + np.exp(-np.clip(inner @ self.out + self.out_bias[0], -30, 30))), inner

    def score(self, text: str) -> float:
        chunks = chunks_of(text)
        most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        for at in range(0, len(chunks), _SLICE):
            found, _ = self.pooled(chunks[at : at + _SLICE])
            most = np.maximum(most, found.max(axis=0))
            total += found.sum(axis=0)
        features = np.concatenate([most, total / len(chunks)]).astype(np.float32)
        return float(self.combine(features[None])[0][0])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, seed: int = 7) -> ByteNet:
    """Adam on the logistic loss, over whole documents; a small sample is passed more often, for LEAST_STEPS steps at least.

    Without examples of both labels the share of ones is all there is.
    """
    net, rng = ByteNet.start(seed), np.random.default_rng(seed)
    truth = np.array(labels, dtype=np.float32)
    if not len(truth) or truth.min() == truth.max():
        net.out[:] = 0
        net.out_bias[:] = 0 if not len(truth) else np.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1))
        return net
    net.out_bias[:] = np.log(truth.mean() / (1 - truth.mean()))
    docs = [chunks_of(t) for t in texts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, epochs = 0, max(epochs, -(-LEAST_STEPS // -(-len(docs) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            step += 1
            grads = _gradients(net, [docs[i] for i in chosen], truth[chosen])
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNet, docs: list[np.ndarray], truth: np.ndarray) -> list[np.ndarray]:
    chunks = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parts = [net.pooled(chunks[i : i + _SLICE]) for i in range(0, len(chunks), _SLICE)]
    best, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    most = np.maximum.reduceat(best, starts)
    mean = np.add.reduceat(best, starts) / sizes[:, None]
    features = np.concatenate([most, mean], axis=1).astype(np.float32)
    score, inner = net.combine(features)
    slope = ((score - truth) / len(truth)).astype(np.float32)
    d_out, d_out_bias = inner.T @ slope, np.array([slope.sum()], dtype=np.float32)
    d_inner = np.outer(slope, net.out) * (inner > 0)
    d_hidden, d_hidden_bias = features.T @ d_inner, d_inner.sum(axis=0)
    d_features = d_inner @ net.hidden.T
    owner = np.repeat(np.arange(len(docs)), sizes)
    top = (best == most[owner]) & (best > 0)
    ties = np.maximum(np.add.reduceat(top.astype(np.float32), starts), 1)
    d_best = d_features[owner, :FILTERS] * top / ties[owner] + d_features[owner, FILTERS:] / sizes[owner][:, None] * (best > 0)
    c, f = np.nonzero(d_best)
    g = d_best[c, f].astype(np.float32)
    seen = chunks[c[:, None], at[c, f][:, None] + np.arange(WIDTH)]  # the bytes under each winning window
    flat = net.embed[seen].reshape(len(c), WIDTH * EMBED)
    d_filters = np.zeros((WIDTH * EMBED, FILTERS), np.float32)
    d_embed = np.zeros_like(net.embed)
    weights = net.filters.reshape(WIDTH * EMBED, FILTERS)
    for k in range(FILTERS):
        own = f == k
        if own.any():
            d_filters[:, k] = flat[own].T @ g[own]
            back = np.outer(g[own], weights[:, k]).reshape(-1, EMBED)
            where = seen[own].ravel()
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(where, weights=back[:, e], minlength=256).astype(np.float32)
    d_bias = d_best.sum(axis=0).astype(np.float32)
    return [d_embed, d_filters.reshape(net.filters.shape), d_bias, d_hidden, d_hidden_bias, d_out, d_out_bias]


def _classes(rows: DataFrame) -> set[str]:
    return {"> 0" if r[0] else "<= 0" for r in rows.select(F.col("label") > 0).distinct().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """At most ``rows`` labelled rows, in the order of a hash of the key, until their texts reach ``size`` bytes, as (key, text, label).

    Texts above a TRAIN_SHARE-th of ``size`` come after all others, the shortest first, so no long text keeps out one that
    fits: behind the row that crosses the bound are only rows for which less than that part is left, or longer ones. A
    class (label above 0 or not) whose texts all stay outside is an error; labels of a class without any text are a warning.
    Both bounds are parameters of the fit alone; scoring reads every row. Rows with a null key, text or label are left out,
    as are keys for which ``learn`` is not true; a key that is labelled twice counts once, with its greater label. Keys are
    compared as text, so the columns may differ in type.
    """
    marks = labels.select(named(key).cast("string").alias("key"), named(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    chosen = marks.where(learn).orderBy(F.xxhash64("key"), "key").limit(rows)
    chosen = materialize(chosen, "labelled-keys")
    texts = docs.select(named(key).cast("string").alias("key"), named(text).cast("string").alias("text")).dropna()
    found = texts.join(F.broadcast(chosen), "key")  # at most ``rows`` short rows
    one = found.groupBy("key", "label").agg(F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("t")).select("key", "label", "t.n", "t.text")
    one = materialize(one, "labelled-texts")
    ordered = Window.orderBy(F.greatest("n", F.lit(size // TRAIN_SHARE)), F.xxhash64("key"), "key")
    upto = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    within = one.select("key", "label", "n").select("key", "label", upto.alias("upto")).where(F.col("upto") <= size)  # at most ``rows`` rows
    within = materialize(within.select("key", "label"), "labelled-within")
    taken = _classes(within)
    if len(taken) < 2:
        if lost := _classes(one) - taken:
            raise ValueError(f"no text of {size} bytes or less with {label} {'/'.join(sorted(lost))} is in the sample; allow more bytes")
        if lost := _classes(marks.where(learn)) - taken:
            warnings.warn(f"labels hold {label} {'/'.join(sorted(lost))}, but none of the {rows} sampled keys has a text of it", RuntimeWarning, stacklevel=2)
    within = within.select("key")
    return one.join(F.broadcast(within), "key", "left_semi").select("key", "text", "label")


def _scorer(shared) -> Callable[[], Callable[[str], tuple]]:
    def make():
        net = ByteNet(*shared.value)
        return lambda text: (net.score(text),)

    return make


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> ByteNet:
    """Fit on a bounded sample of labelled documents; ``learn`` is a condition on the column ``key``."""
    taken = labelled_sample(docs, labels, label, learn, key, text).toArrow().sort_by("key")  # a rerun fits the same model
    return fit(taken.column("text").to_pylist(), [int(y > 0) for y in taken.column("label").to_pylist()])


def score(docs: DataFrame, net: ByteNet, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted (1 if score >= threshold) to every row; no shuffle.

    Filters look at every byte offset of a text, and a null text counts as empty. Columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.parameters())
    rows = without(docs, *OUTPUT)
    kept = rows.columns
    scored = rows.withColumn("_hv_score", text_function(_scorer(shared), {"s": pa.float64()}, "s double")(named(text))["s"])
    return scored.select(*[named(c) for c in kept], F.col("_hv_score").alias("score"), (F.col("_hv_score") >= threshold).cast(T.IntegerType()).alias("predicted"))
