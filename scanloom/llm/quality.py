"""Quality classifier: a byte-level convolutional network in numpy.

Each byte is an 8-number embedding. Learned filters see windows of 16 bytes, 8 apart; a further channel holds how far
a window repeats what came 2 to 24 bytes before. Rectified responses are averaged over chunks of 512 bytes, 256 apart,
that cover the whole document; each channel is max-pooled over the chunks, and a logistic layer makes one probability.

Filters and embedding are trained on chunks, the last layer on whole documents. Both use a bounded sample of labelled
rows (`max_docs`, `max_bytes`); everything is seeded, so reruns agree. Scoring runs over a document in pieces, so a
very long text needs no more memory than its chunks' channels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import raw, release, runs
from .common import crc_mod, table

STEP, HALF, EMBED, FILTERS = 8, 256, 8, 24
LAGS = range(2, 25)
PIECE = 1 << 18  # bytes that are convolved at once
THRESHOLD = 0.3


class Model:
    """embed (256, 8), w (128, FILTERS), b (FILTERS,), mean and scale of the pooled channels, out and bias."""

    def __init__(self, embed, w, b, mean, scale, out, bias):
        self.embed, self.w, self.b, self.mean, self.scale, self.out, self.bias = embed, w, b, mean, scale, out, bias
        self.both = np.concatenate([w[: STEP * EMBED], w[STEP * EMBED :]], axis=1).astype(np.float32)


def _halves(model_embed, both, b, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: documents laid out in multiples of HALF bytes with 32 zeros at least after each; ends: of each half, the
    number of its windows that begin within the text. Sums of the channels over each half's windows, and that number."""
    n_half = len(data) // HALF
    sums = np.zeros((n_half, FILTERS + 1), np.float32)
    per = HALF // STEP
    for start in range(0, n_half, PIECE // HALF):
        stop = min(start + PIECE // HALF, n_half)
        lo, hi = start * HALF, stop * HALF
        tail = min(hi + STEP, len(data))
        x = data[lo:tail]
        if len(x) < hi - lo + STEP:
            x = np.concatenate([x, np.zeros(hi - lo + STEP - len(x), np.uint8)])
        e = model_embed[x].reshape(-1, STEP * EMBED)
        r = e @ both
        f = r[:-1, :FILTERS] + r[1:, FILTERS:] + b
        np.maximum(f, 0, out=f)
        before = data[max(lo - 32, 0) : lo]
        y = np.concatenate([np.zeros(32 - len(before), np.uint8), before, x])
        same = np.zeros(len(x) // STEP, np.uint64)
        best = np.zeros(len(f), np.float32)
        for lag in LAGS:
            eq = (y[32:] == y[32 - lag : len(y) - lag]).view(np.uint8).view(np.uint64)
            same = (eq * np.uint64(0x0101010101010101)) >> np.uint64(56)
            np.maximum(best, (same[:-1] + same[1:]).astype(np.float32), out=best)
        valid = (np.arange(per)[None, :] < ends[start:stop, None]).reshape(-1)
        f *= valid[:, None]
        rep = np.maximum(best / 16 - 0.5, 0) * 2 * valid
        sums[start:stop, :FILTERS] = f.reshape(-1, per, FILTERS).sum(1)
        sums[start:stop, FILTERS] = rep.reshape(-1, per).sum(1)
    return sums, ends


def _layout(data: np.ndarray, off: np.ndarray):
    """(bytes laid out, windows of each half, first half of each document)."""
    lens = np.diff(off)
    halves = (lens + 32 + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF, np.uint8)
    where = np.repeat(first[:-1] * HALF - off[:-1], lens) + np.arange(off[0], off[-1]) if len(lens) else np.zeros(0, np.int64)
    out[where] = data[off[0] : off[-1]]
    windows = (lens + STEP - 1) // STEP
    k = np.arange(int(first[-1])) - np.repeat(first[:-1], halves)
    ends = np.clip(np.repeat(windows, halves) - k * (HALF // STEP), 0, HALF // STEP)
    return out, ends, first


def pooled(embed, both, b, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Max-pooled channels of each document; an empty one has zeros."""
    out = np.zeros((len(off) - 1, FILTERS + 1), np.float32)
    for i, j in runs(np.diff(off), 4 * PIECE):
        laid, ends, first = _layout(data, off[i : j + 1])
        sums, n = _halves(embed, both, b, laid, ends)
        # A chunk is a half and the next one of the same document; the last text half alone if there is no other.
        sums = np.concatenate([sums, np.zeros((1, FILTERS + 1), np.float32)])
        n = np.append(n, 0)
        own = np.repeat(np.arange(j - i), np.diff(first))
        inner = np.append(own[1:] == own[:-1], False) if len(own) else np.zeros(0, bool)
        m = len(own)
        total = sums[:m] + np.where(inner[:, None], sums[1 : m + 1], 0)
        count = n[:m] + np.where(inner, n[1 : m + 1], 0)
        mean = total / np.maximum(count, 1)[:, None]
        # The last half's chunk lies within the one before, if there is one: a few bytes say little.
        is_first = np.ones(m, bool)
        is_first[1:] = own[1:] != own[:-1]
        short = ~is_first & (count < HALF // STEP)
        mean[short] = 0
        out[i:j] = np.maximum.reduceat(mean, first[:-1], axis=0)
    return out


def score_texts(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    z = (pooled(model.embed, model.both, model.b, data, off) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(z @ model.out + model.bias, -30, 30).astype(np.float64)))


def _adam(params, grads, state, rate, step):
    for k, g in enumerate(grads):
        m, v = state[k]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 3, seed: int = 7) -> Model:
    """Trains on labelled texts (1 is good). Without any rows, or with one label only, the model says that label's share
    for every text (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
    embed[0] = 0
    w = (rng.standard_normal((2 * STEP * EMBED, FILTERS)) / np.sqrt(2 * STEP * EMBED)).astype(np.float32)
    b, out, bias = np.zeros(FILTERS, np.float32), np.zeros(FILTERS + 1, np.float32), 0.0
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        bias = float(np.log((share * 0.98 + 0.01) / (1 - share * 0.98 - 0.01)))
        return Model(embed, w, b, out * 0, out * 0 + 1, out, bias)
    # Chunks of 512 bytes and 8 more, as many of each label.
    laid, ends, first = _layout(data, off)
    laid = np.concatenate([laid, np.zeros(3 * HALF, np.uint8)])
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    full = np.flatnonzero(ends > 0)
    of = labels[own[full]]
    size = 20_000
    pick = np.concatenate([rng.choice(full[of == v], size // 2) for v in (0, 1)])
    rng.shuffle(pick)
    span = np.arange(2 * HALF + STEP)
    per = 2 * HALF // STEP
    n_win = ends[pick] + np.where(np.append(own[1:] == own[:-1], False)[pick], np.append(ends, 0)[pick + 1], 0)
    y = labels[own[pick]]
    u, c = (rng.standard_normal(FILTERS) * 0.5).astype(np.float32), np.zeros(1, np.float32)
    params = [embed, w, b, u, c]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, batch = 0, 64
    for _ in range(epochs):
        for s in range(0, size, batch):
            step += 1
            x = laid[pick[s : s + batch, None] * HALF + span]
            m = len(x)
            blocks = embed[x].reshape(m, per + 1, STEP * EMBED)
            win = np.concatenate([blocks[:, :-1], blocks[:, 1:]], axis=2).reshape(m * per, -1)
            pre = win @ w + b
            mask = (np.arange(per)[None, :] < n_win[s : s + batch, None]).reshape(-1)
            act = np.maximum(pre, 0) * mask[:, None]
            cnt = np.maximum(n_win[s : s + batch], 1)[:, None].astype(np.float32)
            h = act.reshape(m, per, FILTERS).sum(1) / cnt
            z = h @ u + c[0]
            g = (1 / (1 + np.exp(-z)) - y[s : s + batch]) / m
            gh = np.repeat(g[:, None] * u[None, :] / cnt, per, axis=0)
            gp = (gh * (pre > 0) * mask[:, None]).astype(np.float32)
            gw = (gp @ w.T).reshape(m, per, 2, STEP * EMBED)
            gb = np.zeros((m, per + 1, STEP * EMBED), np.float32)
            gb[:, :-1] += gw[:, :, 0]
            gb[:, 1:] += gw[:, :, 1]
            flat, idx = gb.reshape(-1, EMBED), x.reshape(-1)
            ge = np.stack([np.bincount(idx, flat[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
            ge[0] = 0
            grads = [ge, win.T @ gp, gp.sum(0), h.T @ g, np.array([g.sum()], np.float32)]
            _adam(params, grads, state, 0.005 * (1 - 0.9 * step / (epochs * size / batch)), step)
    both = np.concatenate([w[: STEP * EMBED], w[STEP * EMBED :]], axis=1).astype(np.float32)
    x = pooled(embed, both, b, data, off).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    v, bias = np.zeros(FILTERS + 1), float(np.log(share / (1 - share)))
    for _ in range(60):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ v + bias, -30, 30)))
        d = np.concatenate([x, np.ones((len(x), 1))], 1)
        hess = (d * (p * (1 - p))[:, None]).T @ d + np.diag([1.0] * (FILTERS + 1) + [1e-6])
        move = np.linalg.solve(hess, d.T @ (labels - p) - np.append(v, 0))
        v, bias = v + move[:-1], bias + float(move[-1])
        if np.abs(move).max() < 1e-6:
            break
    return Model(embed, w, b, mean, scale, v, bias)


def sample_labelled(docs: DataFrame, labels: DataFrame, max_docs: int, max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most max_docs whole texts of at most max_bytes together, in order of a hash of the id; texts of more than a
    sixteenth of max_bytes come after all others, and a text that doesn't fit is skipped. Ids with two labels teach
    nothing, nor do null labels and null texts."""
    own = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    own = own.filter("q = q2").select("doc_id", "q")
    docs = docs.filter("text IS NOT NULL")
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("n")).join(own, "doc_id")
    sizes = sizes.groupBy("doc_id", "q").agg(F.max("n").alias("n")).filter(F.col("n") <= max_bytes)
    order = (F.col("n") > max_bytes // 16, F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    label, left = {}, max_bytes
    for r in sizes.orderBy(*order).limit(max_docs).collect():  # texts stay where they are
        if r.n <= left:
            label[r.doc_id] = r.q
            left -= r.n
    if not label:
        return [], np.zeros(0, np.float32)
    got = docs.filter(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r.doc_id)
    return [r.text.encode() for r in got], np.array([label[r.doc_id] for r in got], np.float32)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_bytes: int = 24 << 20) -> Model:
    return fit(*sample_labelled(docs, labels, max_docs, max_bytes))


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with one more column, `to` (replaced if there is one of that name): the probability of label 1. A null
    text is an empty one, and an empty one has a score too. Order of rows and other columns stay."""
    rows = docs.drop(to) if to in docs.columns else docs
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.DoubleType())])
    at = rows.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                s = score_texts(model, *raw(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, to])
        release()

    return rows.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = train(docs.filter("NOT held_out"), table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
