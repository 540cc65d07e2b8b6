"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs of a word are its hashed word embedding and the mean of its hashed
character n-gram embeddings. A window of words runs through a forward and a
backward gated recurrent layer; attention pools the states into one logit. All
overlapping windows of the whole text are scored and the highest logit is the
text's. The network is trained in numpy on a bounded sample of labelled rows
(multiple-instance: a toxic text counts by its strongest window). The logit is
turned into a probability by a logistic scale fitted on the logit histogram of
all labelled training rows.

Defined results: null or empty text is one window without words and gets the
score of the bias; repeated rows are scored one by one; without labels of both
kinds every score is 0; a null id counts as empty text when its fold is taken;
an empty table gives no rows; extra columns are ignored, whatever their names.
Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import documents, give_back, lower_ascii, materialize, remainder, row_key, without_rows

WINDOW, STRIDE = 32, 16  # half a window: a passage of up to 17 words lies whole in some window
BUCKETS, DIM, HID, ATT = 1 << 14, 8, 8, 8
EDGE = b".,;:!?\"'()[]{}<>"
BIN = 0.05


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without surrounding punctuation (kept if nothing else is left)."""
    return [w.strip(EDGE) or w for w in lower_ascii(text.lower()).split()]


def hashed_inputs(words: list[bytes], step: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, n-gram buckets, n-grams per word): hashed character 3- and 4-grams of ``<word>``, ``step`` words at a time."""
    parts = [_hashed(words[a:a + step]) for a in range(0, max(len(words), 1), step)]
    return tuple(map(np.concatenate, zip(*parts)))


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(b"<" + b"><".join(words) + b">" + b"\0" * 4, np.uint8).astype(np.uint32)
    n = int(size.sum())
    room = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters left in the word
    word = np.repeat(np.arange(len(words)), size)
    three = (text[:n] * 0x9E3779B1 + text[1:n + 1] * 0x85EBCA6B + text[2:n + 2] * 0xC2B2AE35).astype(np.uint32)
    four = (three ^ (text[3:n + 3] * 0x27D4EB2F + 0x165667B1)).astype(np.uint32)
    a, b = room >= 3, room >= 4
    flat = np.concatenate([three[a], four[b]])
    flat = ((flat ^ (flat >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    owner = np.concatenate([word[a], word[b]])
    order = np.argsort(owner, kind="stable")
    return bucket, flat[order].astype(np.int32), np.bincount(owner, minlength=len(words))


class Lexicon(dict):
    """word -> row number from 1 (row 0 is padding); ``fresh`` lists words not fetched yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        self.fresh.append(word)
        self[word] = k = len(self) + 1
        return k

    def add(self, words: list[bytes]) -> list[int]:
        return list(map(self.__getitem__, words))

    def fetch(self):
        words, self.fresh = self.fresh, []
        return hashed_inputs(words)


def segment_mean(table: np.ndarray, flat: np.ndarray, counts: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """Mean of the rows ``flat`` of ``table`` over consecutive groups (zero for empty groups), ``step`` groups at a time."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    ends = np.cumsum(counts)
    for a in range(0, len(counts), step):
        n, end = counts[a:a + step], ends[a:a + step]
        low = end[0] - n[0]
        total = np.zeros((end[-1] - low + 1, table.shape[1]))
        np.cumsum(table[flat[low:end[-1]]], 0, out=total[1:])
        out[a:a + step] = (total[end - low] - total[end - n - low]) / np.maximum(n, 1)[:, None]
    return out


def windows(ids: list[int]) -> np.ndarray:
    """Rows of WINDOW word numbers at every STRIDE, zero-padded; at least one row."""
    n = len(ids)
    k = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
    flat = np.zeros((k - 1) * STRIDE + WINDOW, np.int32)
    flat[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE]


class Network:
    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"word": r(BUCKETS, DIM) * 0.1, "gram": r(BUCKETS, DIM) * 0.1, "Wx": r(2, 2 * DIM, 3 * HID),
                  "bx": np.zeros((2, 1, 3 * HID), np.float32), "U": r(2, HID, 3 * HID), "Wa": r(2 * HID, ATT),
                  "ba": np.zeros(ATT, np.float32), "va": r(ATT), "u": r(2 * HID), "c": np.float32([-1.0])}

    def inputs(self, bucket, flat, counts) -> np.ndarray:
        """Input vector of each lexicon row."""
        x = np.hstack([self.p["word"][bucket], segment_mean(self.p["gram"], flat, counts)])
        x[counts == 0] = 0
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input side of the gates for each word, per direction."""
        return x[None] @ self.p["Wx"] + self.p["bx"]

    def forward(self, gates: np.ndarray, idx: np.ndarray, keep: list | None = None):
        """Logits of windows ``idx`` (n, WINDOW); ``keep`` collects what training needs."""
        n, p = len(idx), self.p
        mask = (idx > 0).astype(np.float32)
        full = bool(mask.all())
        h = np.zeros((2, n, HID), np.float32)
        states = np.empty((n, WINDOW, 2 * HID), np.float32)
        for s in range(WINDOW):
            b = WINDOW - 1 - s
            x = np.stack([gates[0].take(idx[:, s], 0), gates[1].take(idx[:, b], 0)])
            g = h @ p["U"]
            zr = 0.5 * np.tanh(0.5 * (x[..., :2 * HID] + g[..., :2 * HID])) + 0.5
            z, r = zr[..., :HID], zr[..., HID:]
            c = np.tanh(x[..., 2 * HID:] + r * g[..., 2 * HID:])
            before, h = h, c + z * (h - c)
            m = None
            if not full:
                m = np.stack([mask[:, s], mask[:, b]])[..., None]
                h = h * m
            states[:, s, :HID], states[:, b, HID:] = h[0], h[1]
            if keep is not None:
                keep.append((before, z, r, c, g[..., 2 * HID:], m))
        att = np.tanh(states @ p["Wa"] + p["ba"])
        e = att @ p["va"]
        e = np.where(mask > 0, e, -30.0)
        a = np.exp(e - e.max(1, keepdims=True)) * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nw,nwh->nh", a, states)
        return pooled @ p["u"] + p["c"][0], (states, att, a, pooled)

    def gradients(self, x, lex, idx, y):
        """Gradients of the mean cross entropy over windows ``idx`` with labels ``y``."""
        bucket, flat, counts = lex
        p, n, keep = self.p, len(idx), []
        logit, (states, att, a, pooled) = self.forward(self.project(x), idx, keep)
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {"u": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["u"]
        ds = a[..., None] * dpool[:, None]
        da = np.einsum("nwh,nh->nw", states, dpool)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["va"] = np.einsum("nw,nwk->k", de, att)
        dt = de[..., None] * p["va"] * (1 - att ** 2)
        g["Wa"], g["ba"] = np.einsum("nwh,nwk->hk", states, dt), dt.sum((0, 1))
        ds = ds + dt @ p["Wa"].T
        gU, dgates = np.zeros_like(p["U"]), np.zeros((2, len(x), 3 * HID), np.float32)
        inner = np.empty((2, WINDOW, n, 3 * HID), np.float32)
        dh = np.zeros((2, n, HID), np.float32)
        for s in range(WINDOW - 1, -1, -1):
            b = WINDOW - 1 - s
            before, z, r, c, gc, m = keep[s]
            dh = dh + np.stack([ds[:, s, :HID], ds[:, b, HID:]])
            if m is not None:
                dh = dh * m
            dc = dh * (1 - z) * (1 - c ** 2)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            din = np.concatenate([dz, dr, dc], -1)
            dg = np.concatenate([dz, dr, dc * r], -1)
            gU += before.transpose(0, 2, 1) @ dg
            inner[0, s], inner[1, b] = din
            dh = dh * z + dg @ p["U"].transpose(0, 2, 1)
        order = np.argsort(idx.T.ravel(), kind="stable")
        rows, first = np.unique(idx.T.ravel()[order], return_index=True)
        for k in range(2):
            dgates[k, rows] = np.add.reduceat(inner[k].reshape(-1, 3 * HID)[order], first, axis=0)
        dgates[:, 0] = 0  # padding is no input
        g["U"], g["Wx"] = gU, x.T[None] @ dgates
        g["bx"] = dgates.sum(1, keepdims=True)
        dx = np.einsum("dvk,dik->vi", dgates, p["Wx"])
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], bucket, dx[:, :DIM])
        np.add.at(g["gram"], flat, np.repeat(dx[:, DIM:] / np.maximum(counts, 1)[:, None], counts, 0))
        return g


def train(texts: list[str], toxic: list[int], epochs: int = 5, batch: int = 128, rate: float = 0.01,
          seed: int = 5, least_steps: int = 100) -> Network:
    """Fit a network: each epoch takes the strongest window of every text and random windows of clean ones.

    Few texts make few steps an epoch; they get further epochs, up to ``least_steps`` in all.
    """
    rng, lex = np.random.default_rng(seed), Lexicon()
    docs = [windows(lex.add(words_of(t))) for t in texts]
    y = np.array(toxic)
    net, fresh = Network(seed), lex.fetch()
    lex.clear()
    bucket, flat, counts = arrays = np.append(0, fresh[0]), fresh[1], np.append(0, fresh[2])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    allw = np.concatenate(docs)
    start, length = np.searchsorted(owner, np.arange(len(docs))), [len(d) for d in docs]
    # The first coordinate of each embedding starts as the log odds of its bucket among the texts.
    seen = [np.unique(d) for d in docs]
    del docs
    of = np.cumsum(counts) - counts
    for table, hashed in (("word", lambda u: bucket[u]),
                          ("gram", lambda u: np.concatenate([flat[of[k]:of[k] + counts[k]] for k in u]))):
        n = np.zeros((2, BUCKETS))
        for u, label in zip(seen, y):
            u = u[u > 0]
            if len(u):
                n[label, np.unique(hashed(u))] += 1
        odds = np.log((n[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((n[0] + 0.5) / ((y == 0).sum() + 1))
        net.p[table][:, 0] = np.clip(odds, -4, 4) * 0.25
    del seen
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    a_round = max(1, (len(y) + int((y == 0).sum())) // batch)
    for epoch in range(max(epochs, -(-least_steps // a_round))):
        if epoch:
            gates = net.project(net.inputs(*arrays))
            score = np.concatenate([net.forward(gates, allw[k:k + 2048])[0] for k in range(0, len(allw), 2048)])
            del gates
        else:
            word = np.maximum(net.inputs(*arrays)[:, [0, DIM]].sum(1), 0)
            score = np.concatenate([word[allw[k:k + 2048]].max(1) for k in range(0, len(allw), 2048)])
        best = np.lexsort((-score, owner))[start]
        clean = np.flatnonzero(y == 0)
        free = start[clean] + (rng.random(len(clean)) * [length[k] for k in clean]).astype(int)
        pick = np.concatenate([best, free])
        label = np.concatenate([y, np.zeros(len(free), int)])
        for rows in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // batch)):
            idx = allw[pick[rows]]
            used, local = np.unique(np.append(idx.ravel(), 0), return_inverse=True)
            part = (bucket[used], np.concatenate([flat[of[k]:of[k] + counts[k]] for k in used]), counts[used])
            g = net.gradients(net.inputs(*part), part, local[:-1].reshape(idx.shape), label[rows])
            step += 1
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) /
                             (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores batches of whole texts; remembers the gate inputs of words between batches."""

    def __init__(self, net: Network, memory: int = 250_000):
        self.net, self.memory = net, memory
        self.reset()

    def reset(self):
        self.lex, self.gates = Lexicon(), self.net.project(np.zeros((1, 2 * DIM), np.float32))

    def __call__(self, texts: list[str], chunk: int = 2048) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        todo, owner, held = [], [], 0
        for k, t in enumerate(texts):
            w = windows(self.lex.add(words_of(t or "")))
            for a in range(0, len(w), chunk):
                todo.append(w[a:a + chunk])
                owner.append(np.full(len(todo[-1]), k))
                held += len(todo[-1])
                if held >= chunk:
                    self._run(todo, owner, out)
                    todo, owner, held = [], [], 0
            if len(self.lex) > self.memory:
                if todo:
                    self._run(todo, owner, out)
                    todo, owner, held = [], [], 0
                self.reset()
        if todo:
            self._run(todo, owner, out)
        return out

    def _run(self, todo, owner, out):
        if self.lex.fresh:
            x = self.net.inputs(*self.lex.fetch())
            self.gates = np.concatenate([self.gates, self.net.project(x)], 1)
        idx = np.concatenate(todo)
        np.maximum.at(out, np.concatenate(owner), self.net.forward(self.gates, idx)[0])


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int, max_chars: int):
    """At most ``train_rows`` texts a class, of at most ``max_chars`` characters, outside the held-out fold."""
    ids = []
    for kind in (0, 1):
        known = labels.where((F.col("toxic") == kind) & (remainder("doc_id", 5) != 0)).select("doc_id").distinct()
        ids += [(r.doc_id, kind) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()]
    kind = dict(ids)
    if len(set(kind.values())) < 2:
        return [], []
    d = documents(docs).where(F.col("doc_id").isin(list(kind)) & (F.length("text") <= max_chars))
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    return [t for _, t in rows], [kind[k] for k, _ in rows]


def fit_scale(hist: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit + b) from (logit, label, rows), by Newton steps; smoothed targets."""
    x = np.array([h[0] for h in hist])
    y = np.array([h[1] for h in hist], float)
    w = np.array([h[2] for h in hist], float)
    pos, neg = w[y == 1].sum(), w[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    # Each class weighs the same, so that 0.5 lies between the classes whatever their shares.
    w = np.where(y == 1, w / pos, w / neg)
    z, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (t - q)) - 1e-4 * beta
        beta += np.clip(np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + 1e-4 * np.eye(2), grad), -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 1000, max_chars: int = 20_000,
             **fit) -> DataFrame:
    """row, doc_id, held_out, score, predicted for every row of ``docs``.

    The network is fitted on at most 2 * ``train_rows`` labelled texts of at most
    ``max_chars`` characters; the probability scale on all labelled rows outside the fold.
    """
    texts, kinds = training_rows(docs, labels, train_rows, max_chars)
    held = (remainder("doc_id", 5) == 0).alias("held_out")
    if len(set(kinds)) < 2:
        d = documents(docs)
        return d.select(row_key(d).alias("row"), "doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    d = documents(docs)
    net = d.sparkSession.sparkContext.broadcast(train(texts, kinds, **fit))
    del texts, kinds
    give_back()

    def run(batches):
        score = Scorer(net.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(score(b.column("text").to_pylist()), pa.float64())],
                ["row", "doc_id", "logit"])

    raw = materialize(d.select(row_key(d).alias("row"), "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {d.schema['doc_id'].dataType.simpleString()}, logit double"), "toxicity-logits")
    known = (labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(remainder("doc_id", 5) != 0))
    # logits lie in a fixed range, so the histogram has a fixed number of bins
    bins = (raw.join(known, "doc_id")
            .groupBy(F.round(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), "logit")) / BIN).alias("b"), "toxic").count())
    a, b = fit_scale([(r.b * BIN, r.toxic, r["count"]) for r in bins.collect()])
    score = 1 / (1 + F.exp(-(F.lit(a) * F.col("logit") + F.lit(b))))
    out = raw.select("row", "doc_id", held, score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    return without_rows(docs, toxicity(docs, labels, **fit).where("predicted = 1").select("row"))
