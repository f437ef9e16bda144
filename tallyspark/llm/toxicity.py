"""Toxicity of documents by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a window, and how far the next one begins after it; the last one ends with the text.
WINDOW, STRIDE = 64, 48
#: Buckets of hashed words and of hashed runs of six characters, buckets of hashed trigrams, learned dimensions of words
#: and of characters, hidden units each way.
WORDS, TRIGRAMS, LEARNED, HIDDEN = 1 << 16, 1 << 12, 12, 12
#: A word or a run of six characters that fewer training rows hold has no vector of its own.
LEAST_ROWS = 3
#: Labelled rows that the network is fitted on, at most: those with the smallest hashes.
ROWS = 5000
#: Bytes of a word that are one input, and characters that the pieces of a longer word share.
PIECE, OVERLAP = 64, 5
#: A document is rejected from this score on.
LIMIT = 0.3
#: Words kept in a worker's memo before it starts anew, and windows that are scored at once.
MEMO, AT_ONCE = 250_000, 2048
#: Damps the log odds by which training windows are picked at first.
CALM = 6.0
#: Share of words hidden from the network while it is fitted, and the weight of the squares of learned vectors in the loss.
HIDDEN_SHARE, SQUARES = 0.1, 1e-5
#: Punctuation that is no part of a word.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def buckets(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of words less their outer punctuation: each one's bucket; the buckets of the trigrams and of the runs of six
    characters (bytes, in a frame that marks begin and end) from each place of each word; where each word's begin."""
    bare = [(w.strip(MARKS) or w[:1]).encode("utf-8", "surrogatepass")[:PIECE] for w in words]
    own = np.fromiter((zlib.crc32(w) for w in bare), np.int64, len(bare)) % WORDS
    data = np.frombuffer(b"<" + b"><".join(bare) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))  # as many trigrams as bytes, with both frames
    code = ((data[:-2] * 961 + data[1:-1] * 31 + data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.repeat(2 * np.arange(len(bare)), sizes) + np.arange(sizes.sum())
    last = np.repeat(np.cumsum(sizes + 2) - 1, sizes)
    long = np.zeros(len(at), np.uint32)
    for k in range(6):
        long = (long * np.uint32(16777619)) ^ np.where(at + k <= last, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint32)
    long = (long * np.uint32(2654435761)) >> np.uint32(8)
    return own, (code[at] % TRIGRAMS).astype(np.int64), (long % WORDS).astype(np.int64), starts


def _all_buckets(words: list[str], step: int = 20_000) -> tuple[np.ndarray, ...]:
    """buckets() of many words, in steps, as what it holds meanwhile is several times its result."""
    parts, end = [(np.zeros(0, np.int32),) * 4], 0
    for at in range(0, len(words), step):
        own, grams, longs, starts = buckets(words[at : at + step])
        parts.append((own.astype(np.int32), grams.astype(np.int32), longs.astype(np.int32), starts + end))
        end += len(grams)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def split(text: str | None) -> list[str]:
    """Words; one of more than PIECE bytes in successive pieces of at most so many that overlap by OVERLAP characters."""
    words = (text or "").lower().split()
    if all(len(w) * 4 <= PIECE or len(w.encode("utf-8", "surrogatepass")) <= PIECE for w in words):
        return words
    return [p for w in words for p in _pieces(w)]


def _fits(word: str) -> int:
    """How many of its first characters have at most PIECE bytes."""
    sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
    return int(np.searchsorted(sizes, PIECE, "right"))


def _pieces(word: str) -> Iterator[str]:
    at = 0
    while len(word) - at > PIECE // 4:
        end = at + _fits(word[at : at + PIECE])
        yield word[at:end]
        if end == len(word):
            return
        at = end - OVERLAP
    yield word[at:]


def windows(n: int) -> list[int]:
    """Where the overlapping windows of n words begin; one for an empty text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def odds(hits: np.ndarray, misses: np.ndarray, n_hits: int, n_misses: int) -> np.ndarray:
    """Damped log odds that a row with this bucket is labelled 1."""
    return np.log((hits + CALM * n_hits / (n_hits + n_misses)) / (n_hits + CALM)) - np.log((misses + CALM * n_misses / (n_hits + n_misses)) / (n_misses + CALM))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over all places of the products of their rows."""
    return a.reshape(-1, a.shape[2]).T @ b.reshape(-1, b.shape[2])


@dataclass
class Network:
    """The weights.  A word's input is its learned vector and the sum, over the root of their number, of the learned
    vectors of its characters: of its trigrams and of its runs of six."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 42) -> Network:
        rng, d, h = np.random.default_rng(seed), 2 * LEARNED, HIDDEN
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"word": np.zeros((WORDS, LEARNED), np.float32), "run": np.zeros((WORDS, LEARNED), np.float32), "gram": (rng.standard_normal((TRIGRAMS, LEARNED)) * 0.05).astype(np.float32)}
        for way in "fb":
            p |= {f"W{way}": normal(d, 3 * h), f"U{way}": normal(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        p |= {"A": normal(2 * h, h), "a": np.zeros(h, np.float32), "v": normal(h), "w": normal(2 * h), "b": np.full(1, -2, np.float32)}
        return cls(p)

    def inputs(self, words: np.ndarray, grams: np.ndarray, runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The input rows of words; what has starts[i] as its first place is word i's."""
        n = np.diff(np.append(starts, len(grams)))[:, None]
        letters = np.add.reduceat(self.p["gram"][grams] + self.p["run"][runs], starts) / np.sqrt(n)
        return np.hstack((self.p["word"][words], letters)).astype(np.float32)

    def run(self, gates: list[np.ndarray], mask: np.ndarray) -> tuple[list[np.ndarray], list[list]]:
        """Hidden states (T, B, h) of each way; gates: (T, B, 3h) input parts; also what the backward pass needs."""
        t, b = mask.shape
        out, kept = [], []
        for way, x in zip("fb", gates, strict=True):
            u, h, states, saved = self.p[f"U{way}"], np.zeros((b, HIDDEN), np.float32), np.empty((t, b, HIDDEN), np.float32), [None] * t
            for k in range(t) if way == "f" else range(t - 1, -1, -1):
                g = h @ u
                zr = sigmoid(x[k][:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
                n = np.tanh(x[k][:, 2 * HIDDEN :] + r * gn)
                saved[k] = (h, z, r, gn, n)
                h = np.where(mask[k][:, None], n + z * (h - n), h)
                states[k] = h
            out.append(states)
            kept.append(saved)
        return out, kept

    def attend(self, states: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits (B,): the states weighted by what attention gives each place."""
        s = np.concatenate(states, 2)
        e = np.tanh(s @ self.p["A"] + self.p["a"])
        score = np.where(mask, e @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * s).sum(0)
        return pooled @ self.p["w"] + self.p["b"], (s, e, weight, pooled)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean cross entropy, by the weights and by the inputs x (T, B, d); and the loss."""
        p, h, g = self.p, HIDDEN, {}
        states, kept = self.run([x @ p[f"W{w}"] + p[f"c{w}"] for w in "fb"], mask)
        logit, (s, e, weight, pooled) = self.attend(states, mask)
        prob = sigmoid(logit)
        loss = float(-(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)).mean())
        dl = ((prob - label) / len(label)).astype(np.float32)
        g["w"], g["b"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["w"]
        dweight = (s * dpool).sum(2)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        de = dscore[:, :, None] * p["v"] * (1 - e * e)
        g["v"] = (e * dscore[:, :, None]).sum((0, 1))
        g["A"], g["a"] = _outer(s, de), de.sum((0, 1))
        ds = weight[:, :, None] * dpool + de @ p["A"].T
        dx = np.zeros_like(x)
        t = len(mask)
        for way, saved, part in zip("fb", kept, (ds[:, :, :h], ds[:, :, h:]), strict=True):
            u, w = p[f"U{way}"], p[f"W{way}"]
            dgates, du, dh = np.zeros((t, x.shape[1], 3 * h), np.float32), np.zeros_like(u), np.zeros((x.shape[1], h), np.float32)
            for k in range(t - 1, -1, -1) if way == "f" else range(t):
                before, z, r, gn, n = saved[k]
                dh = dh + part[k]
                live = dh * mask[k][:, None]
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (before - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dgates[k] = np.concatenate((dz, dr, dn), 1)
                inner = np.concatenate((dz, dr, dn * r), 1)
                du += before.T @ inner
                dh = np.where(mask[k][:, None], live * z + inner @ u.T, dh)
            g[f"U{way}"], g[f"W{way}"], g[f"c{way}"] = du, _outer(x, dgates), dgates.sum((0, 1))
            dx += dgates @ w.T
        return g, dx, loss


class Rows:
    """Training rows as numbers of their distinct words, and what each of these is made of."""

    def __init__(self, texts: list[str | None]) -> None:
        number: dict[str, int] = {}
        self.rows = [np.fromiter((number.setdefault(w, len(number)) for w in split(t)), np.int32) for t in texts]
        self.own, self.grams, self.runs, self.starts = _all_buckets(list(number))
        self.ends = np.append(self.starts[1:], len(self.grams))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of these words stand, word after word, and how many each has."""
        sizes = self.ends[ids] - self.starts[ids]
        return np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def held_by(self, y: np.ndarray) -> dict[str, np.ndarray]:
        """For words and runs (2, WORDS): how many rows of each label hold a bucket."""
        out = {"word": np.zeros((2, WORDS)), "run": np.zeros((2, WORDS))}
        for r, label in zip(self.rows, y, strict=True):
            distinct = np.unique(r)
            out["word"][label, np.unique(self.own[distinct])] += 1
            out["run"][label, np.unique(self.runs[self.places(distinct)[0]])] += 1
        return out

    def likely(self, y: np.ndarray, held: dict[str, np.ndarray], rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
        """Of each row the window whose words' log odds are largest, of rows labelled 0 another at random.

        The odds leave the row itself out, so that words of one row alone tell nothing of it.
        """
        n1, n0 = int(y.sum()), int(len(y) - y.sum())
        without = {k: [odds(np.maximum(h[1] - c, 0), np.maximum(h[0] - (1 - c), 0), n1 - c, n0 - (1 - c)) for c in (0, 1)] for k, h in held.items()}
        out: list[tuple[np.ndarray, int]] = []
        for r, label in zip(self.rows, y, strict=True):
            value = np.zeros(0)
            if len(r):
                at, sizes = self.places(r)
                value = np.maximum(without["word"][label][self.own[r]], np.maximum.reduceat(without["run"][label][self.runs[at]], np.concatenate(([0], np.cumsum(sizes)[:-1]))))
            total = np.concatenate(([0], np.cumsum(np.maximum(value, 0) ** 3)))
            begins = windows(len(r))
            best = max(begins, key=lambda a: total[min(len(r), a + WINDOW)] - total[a])
            out.append((r[best : best + WINDOW], int(label)))
            if not label and len(begins) > 1:
                a = begins[rng.integers(len(begins))]
                out.append((r[a : a + WINDOW], 0))
        return out


def fit(texts: list[str | None], labels: list[int], epochs: int = 4, steps: int = 300, rate: float = 0.01, seed: int = 42) -> Network:
    """Adam on windows of each row: first those with the largest log odds, and from the middle on also the one that
    the network itself scores highest, picked anew in each epoch.

    Without rows of both labels the network knows nothing and gives every text
    one score, low unless all labels are 1.  Few rows are gone through more
    often, in smaller batches, for `steps` steps.
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        net.p["w"][:] = 0
        net.p["b"][:] = 4 * (y.mean() - 0.5) if len(y) else -2
        return net
    data = Rows(texts)
    held = data.held_by(y)
    known = {k: (h.sum(0) >= LEAST_ROWS)[:, None] for k, h in held.items()}
    for k in known:
        net.p[k] = (rng.standard_normal(net.p[k].shape) * 0.05 * known[k]).astype(np.float32)
    likely = data.likely(y, held, rng)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, batch, picked = 0, min(128, max(16, len(likely) // 20)), likely
    epochs = max(epochs, -(-steps * batch // len(likely)))
    for epoch in range(epochs):
        if epoch in (epochs // 2, epochs * 3 // 4):
            picked = likely + [(r[a : a + WINDOW], int(c)) for r, c, (_, a) in zip(data.rows, y, Scorer(net).found(texts), strict=True)]
        order = rng.permutation(len(picked))
        for k in range(0, len(order), batch):
            g = _batch_gradients(net, data, [picked[i] for i in order[k : k + batch]], known, rng)
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, (at, d) in g.items():  # moments of vectors that are not in the batch rest
                first[name][at] += 0.1 * (d - first[name][at])
                second[name][at] += 0.001 * (d * d - second[name][at])
                net.p[name][at] -= (pace * first[name][at] / (np.sqrt(second[name][at]) + 1e-6)).astype(np.float32)
    return net


def _batch_gradients(net: Network, data: Rows, chosen: list[tuple[np.ndarray, int]], known: dict[str, np.ndarray], rng: np.random.Generator) -> dict[str, tuple]:
    """For each of the weights which of its rows have a gradient, and this."""
    label = np.array([c for _, c in chosen], np.float32)
    mask = np.arange(max(1, max(len(f) for f, _ in chosen)))[:, None] < np.array([len(f) for f, _ in chosen])
    x = np.zeros((*mask.shape, 2 * LEARNED), np.float32)
    j, t = np.nonzero(mask.T)
    ids, back = np.unique(np.concatenate([f for f, _ in chosen]), return_inverse=True)
    seen = (rng.random(len(back)) >= HIDDEN_SHARE)[:, None]
    if len(ids):
        at, sizes = data.places(ids)
        x[t, j] = net.inputs(data.own[ids], data.grams[at], data.runs[at], np.concatenate(([0], np.cumsum(sizes)[:-1])))[back] * seen
    mask[0] = True
    g, dx, _ = net.gradients(x, mask, label)
    out = {k: (slice(None), v) for k, v in g.items()}
    if len(ids):
        d = dx[t, j] * seen
        d = np.stack([np.bincount(back, d[:, i], len(ids)) for i in range(2 * LEARNED)], 1)
        spread = np.repeat(d[:, LEARNED:] / np.sqrt(sizes)[:, None], sizes, 0)
        for name, where, what in (("word", data.own[ids], d[:, :LEARNED]), ("run", data.runs[at], spread), ("gram", data.grams[at], spread)):
            rows, place = np.unique(where, return_inverse=True)
            total = np.stack([np.bincount(place, what[:, i], len(rows)) for i in range(LEARNED)], 1) + SQUARES * net.p[name][rows]
            if name in known:
                rows, total = rows[known[name][rows, 0]], total[known[name][rows, 0]]
            out[name] = rows, total.astype(np.float32)
    return out


class Scorer:
    """A fitted network with the input parts of the gates kept for each word that it has met."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        """Row 0 of the tables is that of an empty place."""
        self.row: dict[str, int] = {}
        self.used = 1
        empty = np.zeros((1, 2 * LEARNED), np.float32)
        self.gates = [np.repeat(self._gates(empty, w), 4096, 0) for w in "fb"]

    def _gates(self, x: np.ndarray, way: str) -> np.ndarray:
        return x @ self.net.p[f"W{way}"] + self.net.p[f"c{way}"]

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            new = words[at : at + 50_000]
            x = self.net.inputs(*buckets(new))
            end = self.used + len(new)
            if end > len(self.gates[0]):
                self.gates = [np.resize(g, (2 * end, g.shape[1])) for g in self.gates]
            for table, way in zip(self.gates, "fb", strict=True):
                table[self.used : end] = self._gates(x, way)
            self.row.update(zip(new, range(self.used, end), strict=True))
            self.used = end

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        return [x for x, _ in self.found(texts)]

    def found(self, texts: Iterable[str | None]) -> list[tuple[float, int]]:
        """The largest window probability of each text and where that window begins.

        Texts are gathered until their windows fill a batch.
        """
        out: list[tuple[float, int]] = []
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(split(text))
            n += len(held[-1]) // STRIDE + 1
            if n >= AT_ONCE:
                out += self._flush(held)
                held, n = [], 0
        return out + self._flush(held)

    def _flush(self, held: list[list[str]]) -> list[tuple[float, int]]:
        if not held:
            return []
        if len(self.row) > MEMO:
            self.forget()
        if new := [w for w in dict.fromkeys(w for r in held for w in r) if w not in self.row]:
            self.learn(new)
        rows = [np.fromiter(map(self.row.__getitem__, r), np.int64, len(r)) for r in held]
        places = [windows(len(r)) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in places])
        logits = np.empty(len(owner), np.float32)
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        start = np.concatenate([f + np.asarray(p) for f, p in zip(first, places, strict=True)]).astype(np.int64)
        length = np.array([min(len(rows[o]), WINDOW) for o in owner])
        by_length = np.argsort(-length, kind="stable")
        for at in range(0, len(start), AT_ONCE):
            some = by_length[at : at + AT_ONCE]
            steps = np.arange(max(1, int(length[some].max())))[:, None]
            mask = steps < length[some]
            index = np.where(mask, flat[start[some] + steps], 0)
            mask[0] = True
            logits[some] = self.net.attend(self._states(index, mask), mask)[0]
        begins = np.concatenate(([0], np.cumsum([len(p) for p in places])[:-1]))
        best = np.maximum.reduceat(logits, begins)
        worst = [int(p[np.argmax(logits[b : b + len(p)])]) for p, b in zip(places, begins, strict=True)]
        return list(zip(sigmoid(best.astype(np.float64)).tolist(), worst, strict=True))

    def _states(self, index: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        t, b = index.shape
        out, whole = [], mask.all(1)
        for way, table in zip("fb", self.gates, strict=True):
            u, h, states = self.net.p[f"U{way}"], np.zeros((b, HIDDEN), np.float32), np.empty((t, b, HIDDEN), np.float32)
            for k in range(t) if way == "f" else range(t - 1, -1, -1):
                x, g = table[index[k]], h @ u
                x[:, : 2 * HIDDEN] += g[:, : 2 * HIDDEN]
                zr = sigmoid(x[:, : 2 * HIDDEN])
                n = np.tanh(x[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * g[:, 2 * HIDDEN :])
                new = n + zr[:, :HIDDEN] * (h - n)
                h = new if whole[k] else np.where(mask[k][:, None], new, h)
                states[k] = h
            out.append(states)
        return out


def held_out(doc_id: str) -> F.Column:
    """Rows whose labels no model may see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Network:
    """A network fitted on at most `rows` labelled documents that are not held out, those with the smallest hashes.

    Null labels and ids are no labels; of several labels of a document the largest counts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id").collect()  # at most `rows` ids
    pairs = sorted(((r[2], r[0], r[1]) for r in found), key=lambda r: (r[0], r[1] or ""))
    return fit([p[1] for p in pairs], [p[2] for p in pairs])


def scored(docs: DataFrame, net: Network, out: str = "toxicity") -> DataFrame:
    """docs with `out`, the largest probability of all overlapping windows of the whole text.

    A null or empty text has one empty window and so a score as well.  All
    columns of docs pass through; one named as `out` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop(out)
    at = [f.name.lower() for f in docs.schema].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            found = scorer.scores(x.as_py() for x in b.column(at))
            yield pa.record_batch([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
