"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word comes in as the sum of two inputs: an embedding of its own (if the training rows have it often enough) and the mean of
hashed embeddings of its character n-grams. Text is cut to overlapping windows, all of which are scored; a document's score is
that of its highest window, calibrated. Training is on a bounded sample of labelled rows on the driver; scoring is one pass
over the documents, with no shuffle, in tasks that keep the inputs of words they have met.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, quoted, small_batches, strings
from .decontam import WORDS

WINDOW, STRIDE = 64, 32
HIDDEN, WIDTH = 8, 16
BUCKETS = 1 << 14
GRAMS = (3, 4, 6)
MAX_TOXIC, MAX_CLEAN = 1000, 2000  # labelled rows that the model is fitted on, at most
EPOCHS, BATCH = 6, 256
STEPS = 360  # of training at least: small samples get more epochs and smaller batches
THRESHOLD = 0.3


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(WORDS).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of bytes (with marks at both ends), one word after the other, and each word's count."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    rolled = np.zeros(len(flat), np.uint64)
    buckets, owners = [], []
    at = np.arange(len(flat))
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled * np.uint64(0x100000001B3) + np.r_[flat[n - 1 :], np.zeros(min(n - 1, len(flat)), np.uint64)][: len(flat)] + np.uint64(n)
        if n in GRAMS:
            inside = at + n <= end
            mixed = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            buckets.append(mixed[inside].astype(np.int64))
            owners.append(owner[inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owners, minlength=len(words))


def all_grams(words: list[bytes], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """grams_of in parts, in half the room."""
    parts = [grams_of(words[at : at + step]) for at in range(0, len(words), step)]
    return np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1].astype(np.int32) for p in parts])


def mean_rows(table: np.ndarray, buckets: np.ndarray, counts: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The mean of each word's rows of the table."""
    starts = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    out = np.empty((len(counts), table.shape[1]), np.float32)
    for at in range(0, len(counts), step):
        upto = min(at + step, len(counts))
        out[at:upto] = np.add.reduceat(table[buckets[starts[at] : starts[upto]]], starts[at:upto] - starts[at], axis=0) / counts[at:upto, None]
    return out


def window_starts(n: int) -> np.ndarray:
    """Of windows that cover n words, each overlapping the one before; the last ends at the last word."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.r_[np.arange(0, n - WINDOW, STRIDE), n - WINDOW]


def windows_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of ids from 1, with 0 after the end; the row of each)."""
    if not ids:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int32)
    parts, rows = [], []
    for k, x in enumerate(ids):
        starts = window_starts(len(x))
        own = np.zeros((len(starts), WINDOW), np.int32)
        if len(x) < WINDOW:
            own[0, : len(x)] = x + 1
        else:
            own[:] = x[starts[:, None] + np.arange(WINDOW)] + 1
        parts.append(own)
        rows.append(np.full(len(starts), k, np.int32))
    return np.concatenate(parts), np.concatenate(rows)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and the passes both ways. Direction 1 reads its window from the end."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.normal(0, scale, s)).astype(np.float32)
        h = HIDDEN
        self.vocabulary = vocabulary
        self.words, self.chars = f(len(vocabulary) + 1, WIDTH, scale=0.1), f(BUCKETS, WIDTH, scale=0.1)
        self.words[0] = 0  # of words that training doesn't know
        self.p = {"wx": f(2 * WIDTH, 6 * h, scale=0.3), "bx": np.zeros(6 * h, np.float32), "u": f(2, h, 3 * h, scale=0.3), "bn": np.zeros((2, 1, h), np.float32), "a": f(2 * h, scale=0.3), "w": f(2 * h, scale=0.3), "b": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]):
        """For each word: word and character input, and what they came from."""
        own = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        buckets, counts = grams_of(words)
        mean = mean_rows(self.chars, buckets, counts)
        return np.concatenate([self.words[own], mean], axis=1).astype(np.float32), own, buckets, counts

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """The input parts of all gates, a row per word; a row of zeros comes first, for what lies beyond the end."""
        return np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), inputs @ self.p["wx"] + self.p["bx"]])

    def forward(self, gates: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows (rows of gates)."""
        h, p = HIDDEN, self.p
        n, steps = len(windows), int((windows > 0).sum(axis=1).max(initial=1)) or 1
        windows = windows[:, :steps]
        x = gates[windows.T]
        xs = (x[:, :, : 3 * h], x[::-1, :, 3 * h :])
        there = (windows.T > 0).astype(np.float32)[:, None, :, None]
        there = np.concatenate([there, there[::-1]], axis=1)
        full = bool((windows > 0).all())
        state, states, kept = np.zeros((2, n, h), np.float32), np.empty((steps + 1, 2, n, h), np.float32), []
        states[0] = 0
        for t in range(steps):
            g = state @ p["u"]
            xt = np.stack([xs[0][t], xs[1][t]])
            zr = _sigmoid(xt[..., : 2 * h] + g[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            hn = g[..., 2 * h :] + p["bn"]
            new = np.tanh(xt[..., 2 * h :] + r * hn)
            nxt = new + z * (state - new)
            state = nxt if full else state + there[t] * (nxt - state)
            states[t + 1] = state
            if keep:
                kept.append((z, r, hn, new))
        both = np.concatenate([states[1:, 0], states[1:, 1][::-1]], axis=2)  # steps, windows, 2h
        e = both @ p["a"]
        e = np.where(windows.T > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[..., None] * both).sum(axis=0)
        logit = pooled @ p["w"] + p["b"][0]
        return (logit, (windows, there, states, kept, both, alpha, pooled)) if keep else logit

    def backward(self, cache, d: np.ndarray):
        """Gradients of the parameters and of the gates' input parts (step, window, 6h), for d over the logits."""
        windows, there, states, kept, both, alpha, pooled = cache
        h, p = HIDDEN, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["b"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        da = (both * dp).sum(axis=2)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", de, both)
        dboth = alpha[..., None] * dp + de[..., None] * p["a"]
        out = np.stack([dboth[..., :h], dboth[::-1, :, h:]], axis=1)  # step, direction, window, h
        dx = np.empty((len(out), 2, windows.shape[0], 3 * h), np.float32)
        dh = np.zeros_like(states[0])
        for t in range(len(out) - 1, -1, -1):
            z, r, hn, new = kept[t]
            before, m = states[t], there[t]
            dh = dh + out[t]
            through = dh * m
            dn = through * (1 - z) * (1 - new * new)
            dz = through * (before - new) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=2)
            dx[t] = np.concatenate([dz, dr, dn], axis=2)
            g["u"] += before.transpose(0, 2, 1) @ dg
            g["bn"] += dg[..., 2 * h :].sum(axis=1, keepdims=True)
            dh = through * z + dh * (1 - m) + dg @ p["u"].transpose(0, 2, 1)
        return g, np.concatenate([dx[:, 0], dx[::-1, 1]], axis=2)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits.astype(float) + self.shift)


class Scorer:
    """Scores of texts, with the gates' input parts of words already met."""

    def __init__(self, net: Network, limit: int = 120_000):
        self.net, self.limit = net, limit
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _ids(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        new = {w for r in rows for w in r if w not in self.index} if self.index else {w for r in rows for w in r}
        if len(self.index) + len(new) > self.limit and self.index:
            self._reset()
            new = {w for r in rows for w in r}
        if new:
            words = sorted(new)
            first = len(self.index) + 1
            self.index.update((w, first + k) for k, w in enumerate(words))
            need = len(self.index) + 1
            if need > len(self.table):
                bigger = np.zeros((max(need, 2 * len(self.table)), 6 * HIDDEN), np.float32)
                bigger[: len(self.table)] = self.table
                self.table = bigger
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                self.table[first + at : first + at + len(part)] = self.net.gates(self.net.inputs(part)[0])[1:]
        get = self.index.__getitem__
        return [np.fromiter(map(get, r), np.int32, len(r)) - 1 for r in rows]

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window's logit of each text; minus infinity without words."""
        rows = [words_of(t) for t in texts]
        some = [k for k, r in enumerate(rows) if r]
        out = np.full(len(texts), -np.inf)
        at = 0
        while at < len(some):
            upto, n = at, 0
            while upto < len(some) and (n == 0 or n + len(rows[some[upto]]) <= 60_000):
                n += len(rows[some[upto]])
                upto += 1
            windows, owner = windows_of(self._ids([rows[k] for k in some[at:upto]]))
            order = np.argsort(-(windows > 0).sum(axis=1), kind="stable")
            for lo in range(0, len(order), 1024):
                part = order[lo : lo + 1024]
                np.maximum.at(out, np.array(some[at:upto])[owner[part]], self.net.forward(self.table, windows[part]))
            at = upto
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        logits = self.logits(texts)
        return np.where(np.isfinite(logits), self.net.score(np.where(np.isfinite(logits), logits, 0.0)), 0.0)


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit on documents with label 1 or 0. A clean document's windows are all clean; of a toxic one, the highest so far (at
    first, all) counts as toxic. weights: how many rows a clean and a toxic one stand for, used in the calibration."""
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    rows = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int32) for t in texts]
    used = [k for k, r in enumerate(rows) if len(r)]
    rows, labels = [rows[k] for k in used], np.array([labels[k] for k in used], np.int64)
    if not len(rows) or labels.min() == labels.max():
        net = Network({}, seed)
        net.slope, net.shift = 0.0, 4.0 if len(rows) and labels.min() == 1 else -4.0
        return net
    words = list(index)
    seen = np.zeros(len(words), np.int32)
    for r in rows:
        seen[np.unique(r)] += 1
    net = Network({w: k + 1 for k, w in enumerate(sorted(w for w, n in zip(words, seen, strict=True) if n >= 5))}, seed)
    windows, owner = windows_of(rows)
    n_rows = len(rows)
    del index, rows
    own = np.fromiter((net.vocabulary.get(w, 0) for w in words), np.int64, len(words))
    buckets, counts = all_grams(words)
    starts = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    del words
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares = [np.full(len(net.words), 1e-6, np.float32), np.full(BUCKETS, 1e-6, np.float32)]
    step, best = 0, rng.random(len(windows))
    toxic = labels[owner] == 1
    batch = int(np.clip(len(windows) // 16, 32, BATCH))
    epochs = max(epochs, min(40, -(-STEPS * batch // len(windows))))
    for epoch in range(epochs):
        # some windows of each document, the highest first
        order = np.lexsort((-best - 1e-3 * rng.random(len(best)), owner))
        place = np.arange(len(order)) - np.r_[0, np.cumsum(np.bincount(owner))][owner[order]]
        chosen = order[place < np.where(toxic[order], 3 if epoch == 0 else 1, 2)]
        extra = np.flatnonzero(~toxic)
        chosen = np.unique(np.r_[chosen, rng.choice(extra, min(len(extra), 3 * int((~toxic[chosen]).sum())))])
        rng.shuffle(chosen)
        balance = (~toxic[chosen]).sum() / max(1, toxic[chosen].sum())
        for lo in range(0, len(chosen), batch):
            part = chosen[lo : lo + batch]
            uniq, inverse = np.unique(windows[part], return_inverse=True)
            inverse = inverse.reshape(windows[part].shape)
            if uniq[0] != 0:
                uniq, inverse = np.r_[0, uniq], inverse + 1
            ids = uniq[1:] - 1
            n = counts[ids]
            mine = np.repeat(starts[ids] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            bucket = buckets[mine]
            mean = mean_rows(net.chars, bucket, n)
            inputs = np.concatenate([net.words[own[ids]], mean], axis=1).astype(np.float32)
            logit, cache = net.forward(net.gates(inputs), inverse, keep=True)
            y = toxic[part].astype(np.float32)
            d = (_sigmoid(logit) - y) * np.where(y == 1, min(balance, 6.0) ** 0.5, 1.0)
            g, dx = net.backward(cache, (d / len(part)).astype(np.float32))
            width = dx.shape[0]
            flat, at = dx.transpose(1, 0, 2).reshape(-1, 6 * HIDDEN), inverse[:, :width].ravel()
            by = np.argsort(at, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(at[by]) > 0])
            dgates = np.zeros((len(uniq), 6 * HIDDEN), np.float32)
            dgates[at[by][firsts]] = np.add.reduceat(flat[by], firsts, axis=0)
            dgates = dgates[1:]
            g["wx"], g["bx"] = inputs.T @ dgates, dgates.sum(axis=0)
            din = dgates @ net.p["wx"].T
            # only rows that the batch touched change; row 0 stays zero
            known = np.flatnonzero(own[ids])
            spread = np.repeat(din[:, WIDTH:] / n[:, None], n, axis=0)
            for table, at, grad, sq in ((net.words, own[ids][known], din[known, :WIDTH], squares[0]), (net.chars, bucket, spread, squares[1])):
                rows_, where = np.unique(at, return_inverse=True)
                total = np.stack([np.bincount(where, grad[:, k], len(rows_)) for k in range(WIDTH)], axis=1)
                sq[rows_] += (total * total).sum(axis=1)
                table[rows_] -= (0.15 * total / np.sqrt(sq[rows_])[:, None]).astype(np.float32)
            step += 1
            for k, v in net.p.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] * g[k] - b)
                v -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        gates = net.gates(np.concatenate([net.words[own], mean_rows(net.chars, buckets, counts)], axis=1))
        for lo in range(0, len(windows), 1024):
            best[lo : lo + 1024] = net.forward(gates, windows[lo : lo + 1024])
    top = np.full(n_rows, -np.inf)
    np.maximum.at(top, owner, best)
    net.slope, net.shift = calibrate(top, labels, np.where(labels == 1, weights[1], weights[0]))
    return net


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit by Newton steps, with a little shrinkage."""
    a, b = 1.0, 0.0
    x, w = np.clip(x, -30, 30), w / w.sum()
    for _ in range(50):
        p = _sigmoid(a * x + b)
        r, s = w * (p - y), w * p * (1 - p)
        g = np.array([(r * x).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network:
    """Fit on at most max_toxic and max_clean labelled rows (those with the smallest hashes of their ids), usable ones (a condition on the
    column "id") only. Rows of labels without a label, or with ids that docs don't have, are passed over."""
    rows = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64(F.col("id").cast("string"))
    chosen = rows.filter("y = 1").orderBy(key, "id").limit(max_toxic).unionByName(rows.filter("y = 0").orderBy(key, "id").limit(max_clean))
    got = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y").collect()
    got = sorted({r.id: r for r in got}.values(), key=lambda r: zlib.crc32(str(r.id).encode()))
    n = {y: sum(r.y == y for r in got) for y in (0, 1)}
    weights = tuple(counts.get(y, 0) / max(1, n[y]) or 1.0 for y in (0, 1))
    return fit([r.text or "" for r in got], [r.y for r in got], weights)


def _score(text_at: int, sent, names: list[str]):
    def run(batches):
        tag, net = sent.value
        scorer = held(tag, lambda: Scorer(net))
        for b in small_batches(batches, 2.0, keep=True):
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != text_at), pa.array(scorer.scores(strings(b, text_at)), pa.float64())], names)

    return run


def score_toxicity(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id and score, 0 to 1.

    All windows of the whole text are scored. Null or empty text, or one without words: score 0. Null and repeated ids each give a row. An
    empty table gives an empty one. Extra columns are ignored.
    """
    name = fresh([id_col], "score")
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, net))
    slim = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_score(1, sent, [id_col, name]), T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(name, T.DoubleType())]))


def drop_toxic(df: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df with a score below the threshold, in one pass (rows go through the tasks that score them)."""
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, net))
    at = df.columns.index(text_col)

    def run(batches):
        tag, net_ = sent.value
        scorer = held(tag, lambda: Scorer(net_))
        for b in small_batches(batches, 2.0, keep=True):
            yield b.filter(pa.array(scorer.scores(strings(b, at)) < threshold))

    return df.mapInArrow(run, df.schema)
