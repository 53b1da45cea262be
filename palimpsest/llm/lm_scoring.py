"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside an exact unigram score over words.

Model: one head of causal self-attention with relative positions over subword embeddings, a tanh layer, and a next-id
distribution in steps of 32 (ids ordered by frequency are numbers of two digits in base 32, rare ones of a third and wider one too;
each digit's logits are a linear map of the state plus a bias that depends on the digits before). The order of ids and the first biases are counted on all
learning documents. STEPS steps of Adam on about FIT_DOCS of them give common weights to start from; from these every partition
trains on all its learning documents, each id once, and the weights are averaged by ids. Scoring cuts a text's ids into strides of STRIDE; each stride sees itself and the stride
before it, so windows of 2 * STRIDE overlap by half and every id is scored once, in batched masked attention.

Texts are read, hashed and encoded once: a scan turns them into blocks of about BLOCK_BYTES, which hold their distinct words with
learning counts and subword ids, and each text as numbers of words. Training and scoring work on blocks alone.

Unigram part: counts of all words of all learning documents. A block deals its distinct words (64-bit hashes) with their learning
counts over parts of the hashes, a packed row each, and gets back a row of sums from every part; so words travel once, what travels
is in proportion to distinct words per block, and no vocabulary is gathered anywhere.

Null and empty texts are one end token. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .sentencepiece_codec import codec, model_path

FIT_DOCS, BLOCK_BYTES = 1_500, 4 << 20
STRIDE, DIM, BASE = 16, 16, 32
STEPS, BATCH = 1_000, 64
#: Of the training of partitions: sequences in a step, rate, strips that weights travel in, and tasks averaged at once.
PART_BATCH, PART_RATE, STRIPS, TOGETHER_TASKS = 1_024, 0.005, 16, 16
#: Blocks in a file (Spark's reader holds a file's rows at once), bytes of words in a part, and units in a worker's cache.
FILE_BLOCKS, PART_BYTES, CACHE_UNITS = 8, 16 << 20, 500_000
#: Sequences whose gradients are made at once, logits from which a row's maximum is taken off (exp of a float32 holds up to 88), and rows
#: of a matrix that are multiplied at once.
CHUNK, TALL, SLAB = 128, 80, 256
_LOG10 = float(np.log(10))


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to `out` at their places, several to one where they meet."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # places are under BASE**3
    x = at[order]
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    out[x[cuts]] += np.add.reduceat(np.take(rows, order, axis=0), cuts)


def split(counts: np.ndarray) -> tuple[int, int]:
    """For falling counts of ids, how many first digits lead to ids of two digits only, and how many third digits there are below the others.

    Frequent ids then take two steps; the numbers are those with the fewest logits in third steps, over all counts.
    """
    two = np.arange(BASE + 1) * BASE
    left = np.maximum(len(counts) - two, 0)
    wide = np.where(two < BASE**2, -(-left // np.maximum(BASE**2 - two, 1)), np.where(left > 0, BASE**3, 0))
    after = np.concatenate(([0.0], np.cumsum(counts + 0.05)))
    cost = (after[-1] - after[np.minimum(two, len(counts))]) * wide
    best = int(np.argmin(np.where(left > 0, cost, 0)))
    return best, max(1, int(wide[best]))


def lowered(z: np.ndarray) -> None:
    """Takes the maximum of each row off logits that exp would not hold."""
    if z.max() > TALL:
        z -= z.max(axis=-1, keepdims=True)


def by_slabs(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for many rows and few columns, SLAB rows at a time where they come out even: BLAS has faster kernels for small matrices."""
    if len(x) % SLAB:
        return x @ w
    return (x.reshape(-1, SLAB, x.shape[1]) @ w).reshape(len(x), w.shape[1])


def slab_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows, by slabs as above."""
    if len(x) % SLAB:
        return x.T @ y
    return (x.reshape(-1, SLAB, x.shape[1]).transpose(0, 2, 1) @ y.reshape(-1, SLAB, y.shape[1])).sum(axis=0)


def less_targets(z: np.ndarray, digit: np.ndarray) -> float:
    """Turns rows of logits into the gradients of the summed loss, probabilities less 1 at the target; gives that loss."""
    lowered(z)
    np.exp(z, out=z)
    z *= (1 / np.maximum(z @ np.ones(z.shape[1], z.dtype), 1e-30))[:, None]
    at = np.arange(len(z)) * z.shape[1] + digit
    flat = z.reshape(-1)
    p = np.take(flat, at)
    flat[at] = p - 1
    return -float(np.log(p + 1e-30).sum())


class Model:
    """Weights and both directions of the network. Arrays are float32."""

    def __init__(self, vocab: int, start: int, end: int):
        self.start, self.end = start, end
        r = np.random.default_rng(3)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.digits, self.short, self.wide = np.zeros((vocab, 3), np.int64), BASE, 1
        self.seen = np.arange(vocab)
        self.w = {"e": (r.standard_normal((vocab, DIM)) * 0.3).astype(np.float32), "q": g(DIM, DIM), "k": g(DIM, DIM), "v": g(DIM, DIM), "x": g(DIM, DIM), "o": g(DIM, DIM), "b": np.zeros(DIM, np.float32), "r": np.zeros(2 * STRIDE, np.float32)}
        self.w |= {f"w{i}": (g(DIM, BASE) * 0.1).astype(np.float32) for i in range(3)}
        self.w |= {f"b{i}": np.zeros((BASE**i, BASE), np.float32) for i in range(3)}

    def start_from(self, counts: np.ndarray) -> None:
        """Digits by falling frequency; biases are the logarithms of the counts. Only ids with counts may be learnt from."""
        self.seen = np.union1d(np.flatnonzero(counts), (self.start, self.end))
        self.place = np.zeros(len(counts), np.int64)
        self.place[self.seen] = np.arange(len(self.seen))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.short, self.wide = split(counts[order])
        rest = np.maximum(rank - self.short * BASE, 0)
        self.digits = np.stack([rank // BASE, rank % BASE, np.zeros_like(rank)], axis=1)
        long = rank >= self.short * BASE
        self.digits[long] = np.stack([self.short + rest // (BASE * self.wide), rest // self.wide % BASE, rest % self.wide], axis=1)[long]
        self.rank = rank.astype(np.uint16)
        self.w["w2"] = np.resize(self.w["w2"], (DIM, self.wide))
        cube = np.zeros((BASE, BASE, self.wide))
        cube[tuple(self.digits.T)] = counts + 0.05
        for i, x in enumerate((cube.sum(axis=(1, 2))[None], cube.sum(axis=2), cube.reshape(-1, self.wide))):
            self.w[f"b{i}"] = np.log(np.maximum(x, 1e-3) / np.maximum(x.sum(axis=1, keepdims=True), 1e-3)).astype(np.float32)

    def context(self, d: np.ndarray) -> list[np.ndarray]:
        """Rows of the three bias tables for digits d (n x 3)."""
        return [np.zeros(len(d), np.int64), d[:, 0], d[:, 0] * BASE + d[:, 1]]

    def zeros(self) -> dict[str, np.ndarray]:
        """Zeros for all that is learnt: of the embeddings the rows of ids seen, of the last biases the rows of long ids."""
        return {k: np.zeros_like(self.learnt(k)) for k in self.w}

    def learnt(self, k: str) -> np.ndarray:
        """The part of weights k that changes; a view but for the embeddings."""
        w = self.w[k]
        return w[self.seen] if k == "e" else w[self.short * BASE :] if k == "b2" else w

    def train_step(self, ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss in nats and gradients for sequences ids -> target (batch x 2 STRIDE)."""
        g = self.zeros()
        loss = self.add_gradients(ids, target, g, self.joined(ids.shape[1]))
        return loss / ids.size, {k: x / ids.size for k, x in g.items()}

    def joined(self, t: int) -> dict[str, np.ndarray]:
        """What all chunks of a step on sequences of t ids share: the weights side by side, and of each distance between two ids its place."""
        w = self.w
        back = np.arange(t)[:, None] - np.arange(t)
        ready = {"in": np.concatenate((w["q"] * float(1 / np.sqrt(DIM)), w["k"], w["v"], w["x"]), axis=1), "far": np.where(back >= 0, w["r"][np.maximum(back, 0)], np.float32(-1e9)), "back": (back.ravel()[:, None] == np.arange(2 * STRIDE)).astype(np.float32)}
        ready["two"], ready["bias"] = self.two_steps()
        return ready | {f"{k} across": np.ascontiguousarray(ready[k].T) for k in ("in", "two")}

    def two_steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the first two digits side by side, and their biases for each first digit: both steps are then made at once."""
        w = self.w
        return np.concatenate((w["w0"], w["w1"]), axis=1), np.concatenate((np.repeat(w["b0"], BASE, axis=0), w["b1"]), axis=1)

    def add_gradients(self, ids: np.ndarray, target: np.ndarray, g: dict[str, np.ndarray], ready: dict[str, np.ndarray]) -> float:
        """Adds the gradients of the summed loss to g, and gives that loss."""
        w, (n, t) = self.w, ids.shape
        m = n * t
        ids, target, ones = ids.ravel(), target.ravel(), np.ones(max(m, t, BASE), w["q"].dtype)
        x = np.take(w["e"], ids, axis=0)
        y = by_slabs(x, ready["in"]).reshape(n, t, 4 * DIM)
        q, k, v, u = (y[..., i * DIM : (i + 1) * DIM] for i in range(4))
        across = np.ascontiguousarray(y[..., DIM : 3 * DIM].transpose(0, 2, 1))  # keys and values; BLAS is slow on small matrices that it has to transpose
        a = q @ across[:, :DIM]
        a += ready["far"]
        lowered(a)
        np.exp(a, out=a)
        a *= (1 / np.maximum(a.reshape(m, t) @ ones[:t], 1e-30)).reshape(n, t, 1)
        c = (a @ v).reshape(m, DIM)
        h = by_slabs(c, w["o"])
        h += w["b"]
        h += u.reshape(m, DIM)
        np.tanh(h, out=h)
        d = np.take(self.digits, target, axis=0)
        z = by_slabs(h, ready["two"])
        z += np.take(ready["bias"], d[:, 0], axis=0)
        loss = less_targets(z.reshape(2 * m, BASE), d[:, :2].ravel())
        gw = slab_sums(h, z)
        g["w0"] += gw[:, :BASE]
        g["w1"] += gw[:, BASE:]
        g["b0"] += ones[None, :m] @ z[:, :BASE]
        g["b1"] += slab_sums(np.take(np.eye(BASE, dtype=z.dtype), d[:, 0], axis=0), z[:, BASE:])
        du = by_slabs(z, ready["two across"])
        long = np.flatnonzero(d[:, 0] >= self.short)
        if len(long):
            mine, row = h[long], self.context(d[long])[2] - self.short * BASE
            z = mine @ w["w2"]
            z += np.take(self.learnt("b2"), row, axis=0)
            loss += less_targets(z, d[long, 2])
            g["w2"] += mine.T @ z
            add_rows(g["b2"], row, z)
            du[long] += z @ w["w2"].T
        du *= 1 - h * h
        g["b"] += ones[:m] @ du
        g["o"] += slab_sums(c, du)
        dc = by_slabs(du, w["o"].T)
        ds = dc.reshape(n, t, DIM) @ across[:, DIM:]
        ds -= ((dc * c) @ ones[:DIM]).reshape(n, t, 1)
        ds *= a
        g["r"] += (ones[:n] @ ds.reshape(n, t * t)) @ ready["back"]
        dy = np.empty((n, t, 4 * DIM), x.dtype)
        np.matmul(ds, k, out=dy[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dy[..., DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), dc.reshape(n, t, DIM), out=dy[..., 2 * DIM : 3 * DIM])
        dy[..., 3 * DIM :] = du.reshape(n, t, DIM)
        dy = dy.reshape(m, 4 * DIM)
        gm = slab_sums(x, dy)
        gm[:, :DIM] *= float(1 / np.sqrt(DIM))
        for i, name in enumerate("qkvx"):
            g[name] += gm[:, i * DIM : (i + 1) * DIM]
        add_rows(g["e"], np.take(self.place, ids), by_slabs(dy, ready["in across"]))
        return loss

    def train(self, docs: list[np.ndarray], steps: int = STEPS, counts: np.ndarray | None = None) -> list[float]:
        """docs: ids of each document without start and end; counts: of all ids, else those of docs. Returns the loss of every step."""
        parts = [np.concatenate(([self.start], d, [self.end])) for d in docs if len(d)] or [np.array([self.start, self.end])]
        stream = np.concatenate(parts)
        self.start_from(np.bincount(stream, minlength=len(self.digits)).astype(float) if counts is None else counts)
        span = 2 * STRIDE
        if len(stream) <= span + 1:
            stream = np.tile(stream, span + 2)
        r = np.random.default_rng(4)
        adam, losses = Adam(self), []
        for step in range(1, steps + 1):
            at = r.integers(0, len(stream) - span, BATCH)[:, None] + np.arange(span)
            losses.append(adam.step(stream[at], stream[at + 1], 0.01 * min(1, step / 20) * (1 - 0.9 * step / steps)))
        return losses

    def freeze(self) -> None:
        """What scoring looks up per id."""
        w = self.w
        self.kv = np.concatenate([w["e"] @ w["q"] / np.float32(np.sqrt(DIM)), w["e"] @ w["k"], w["e"] @ w["v"] @ w["o"], w["e"] @ w["x"] + w["b"]], axis=1)
        bound = max(float(np.abs(w[f"w{i}"]).sum(axis=0).max() + w[f"b{i}"].max()) for i in range(3))
        reach = float(np.linalg.norm(self.kv[:, :DIM], axis=1).max() * np.linalg.norm(self.kv[:, DIM : 2 * DIM], axis=1).max() + np.abs(w["r"]).max())
        self.tall = max(bound, reach) > TALL  # then scoring takes off each row's maximum
        self.both, self.bias = self.two_steps()
        back = np.arange(STRIDE, 2 * STRIDE)[:, None] - np.arange(2 * STRIDE)
        self.rel = np.where(back >= 0, w["r"][np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)

    def logs(self, z: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Natural logarithm of each row's probability of its digit; z, the logits, are written over."""
        if self.tall:
            z -= z.max(axis=1, keepdims=True)
        p = np.take(z.reshape(-1), np.arange(len(z)) * z.shape[1] + digit)
        np.exp(z, out=z)
        p -= np.log(z @ np.ones(z.shape[1], z.dtype))
        return p

    def score(self, ids: np.ndarray, offsets: np.ndarray, block: int = 128) -> np.ndarray:
        """log10 probability of each document, its end included; ids stand document by document."""
        n = np.diff(offsets) + 1  # predictions: every id and the end
        strides = -(-n // STRIDE)
        at = np.concatenate(([0], np.cumsum(strides))) * STRIDE
        doc = np.repeat(np.arange(len(n)), strides)
        inp, out = np.full(at[-1], self.end, np.int32), np.full(at[-1], -1, np.int32)
        place = common.ragged(at[:-1], np.diff(offsets))
        out[place] = ids
        out[at[:-1] + n - 1] = self.end
        inp[at[:-1]] = self.start
        inp[place + 1] = ids  # a document has one more input than ids, so this stays within it
        first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        got, ones = np.zeros(len(doc)), np.ones(max(BASE, 2 * STRIDE), np.float32)
        inp, out = inp.reshape(-1, STRIDE), out.reshape(-1, STRIDE)
        for lo in range(0, len(doc), block):
            hi = min(lo + block, len(doc))
            own = np.take(self.kv, inp[max(0, lo - 1) : hi], axis=0)  # with the stride before
            if lo == 0:
                own = np.concatenate((own[:1], own))
            both = np.ndarray((hi - lo, 2 * STRIDE, 4 * DIM), own.dtype, own, strides=own.strides)  # strides stand end to end
            q, u, vals = own[1:, :, :DIM], own[1:, :, 3 * DIM :], both[..., 2 * DIM : 3 * DIM]
            across = np.ascontiguousarray(own.reshape(-1, 4 * DIM)[:, DIM : 2 * DIM].T)  # BLAS is slow on small matrices that it has to transpose
            keys = np.ndarray((hi - lo, DIM, 2 * STRIDE), across.dtype, across, strides=(STRIDE * across.itemsize, *across.strides))
            s = q @ keys
            s += self.rel
            s[first[lo:hi], :, :STRIDE] = -1e9
            if self.tall:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)  # scores and logits stay small after most trainings
            c = s @ vals
            c *= (1 / (s.reshape(-1, 2 * STRIDE) @ ones[: 2 * STRIDE])).reshape(*s.shape[:2], 1)
            c += u
            h = np.tanh(c, out=c).reshape(-1, DIM)
            target = out[lo:hi].ravel()
            real = target >= 0  # the last stride of a document may be longer than its rest, by a few rows that count for nothing
            d = np.take(self.digits, target, axis=0, mode="wrap")
            z = by_slabs(h, self.both)
            z += np.take(self.bias, d[:, 0], axis=0)
            z = z.reshape(-1, BASE)
            logp = self.logs(z, d[:, :2].ravel()).reshape(-1, 2) @ ones[:2]
            long = np.flatnonzero((d[:, 0] >= self.short) & real)
            if len(long):
                z = h[long] @ self.w["w2"]
                z += np.take(self.w["b2"], self.context(d[long])[2], axis=0)
                logp[long] += self.logs(z, d[long, 2])
            logp[~real] = 0
            got[lo:hi] = logp.reshape(-1, STRIDE) @ ones[:STRIDE]
        return np.bincount(doc, got, len(n)) / _LOG10


class Adam:
    """State of the training of a model."""

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.m, self.u, self.g = model.zeros(), model.zeros(), model.zeros()

    def step(self, ids: np.ndarray, target: np.ndarray, rate: float) -> float:
        """One step on all sequences; gradients are added up chunk by chunk, so that a chunk's arrays stay in cache."""
        self.n += 1
        w, m, u = self.model.w, self.m, self.u
        ready = self.model.joined(ids.shape[1])
        loss = sum(self.model.add_gradients(ids[i : i + CHUNK], target[i : i + CHUNK], self.g, ready) for i in range(0, len(ids), CHUNK)) / ids.size
        fix, fair = rate / (1 - 0.9**self.n), float(1 / (1 - 0.99**self.n))
        for k, x in self.g.items():
            x /= ids.size
            m[k] += 0.1 * (x - m[k])
            x *= x
            x -= u[k]
            x *= 0.01
            u[k] += x
            np.multiply(u[k], fair, out=x)
            np.sqrt(x, out=x)
            x += 1e-8
            np.divide(m[k], x, out=x)
            x *= fix
            if k == "e":
                w[k][self.model.seen] -= x
            else:
                part = self.model.learnt(k)
                part -= x
            x[...] = 0
        return loss

    def epoch(self, stream: np.ndarray) -> int:
        """One pass over a stream of documents' ids, every id but the first a target once. Gives the number of targets."""
        span, n = 2 * STRIDE, len(stream) - 1
        whole = np.random.default_rng(self.n).permutation(n // span) * span
        for lo in range(0, len(whole), PART_BATCH):
            at = whole[lo : lo + PART_BATCH, None] + np.arange(span)
            self.step(stream[at], stream[at + 1], PART_RATE * min(1, (self.n + 1) / 20))
        if n % span:  # the rest, shorter than a sequence
            rest = stream[n - n % span :]
            self.step(rest[None, :-1], rest[None, 1:], PART_RATE * min(1, (self.n + 1) / 20) / PART_BATCH)
        return max(0, n)


def _hashed(texts: pa.ChunkedArray):
    """The texts in steps: lower-cased bytes, word spans, word hashes, documents' offsets into words."""
    batch = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], names=["text"])
    for part in common.slices(batch):
        data, offsets = common.buffers(part.column(0))
        data = common.lower(data)
        a, b, at = common.word_spans(data, offsets)
        yield data, a, b, common.span_hash(common.prefix_hash(data), a, b), at


def around(flat: np.ndarray, per: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids of documents end to end (per: the n + 1 offsets), a start and an end around every document."""
    docs = len(per) - 1
    x = np.empty(int(per[-1] - per[0]) + 2 * docs, np.int64)
    x[per[:-1] - per[0] + 2 * np.arange(docs)] = start
    x[per[1:] - per[0] + 2 * np.arange(docs) + 1] = end
    x[np.arange(len(flat)) + np.repeat(2 * np.arange(docs) + 1, np.diff(per))] = flat
    return x


def subwords(words: list[str], path: str, step: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words end to end, and how many each has, by the library itself: it takes half the time of the codec's merging in numpy."""
    flat, count = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
    for lo in range(0, len(words), step):
        got = codec(path).lib.encode(words[lo : lo + step], num_threads=1)
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat.append(np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n.sum())))
        count[lo : lo + step] = n
    return np.concatenate(flat), count


class Units:
    """Subword ids of words by hash, at most CACHE_UNITS and one block's kept by a worker: sorted arrays, made anew when full."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known, self.start, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, u: np.ndarray, letters, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has. u: their sorted hashes; letters: gives the words at places of u."""
        if len(self.known) + len(u) > CACHE_UNITS:
            self.forget()
        at = np.searchsorted(self.known, u)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            flat, count = subwords(letters(new), path)
            start = np.cumsum(count) - count + len(self.flat)
            self.known, self.start, self.count = (np.insert(x, at[new], y) for x, y in ((self.known, u[new]), (self.start, start), (self.count, count)))
            self.flat = np.concatenate((self.flat, flat))
        at = np.searchsorted(self.known, u)
        return self.flat[common.ragged(self.start[at], self.count[at])], self.count[at]


_UNITS: dict[str, Units] = {}


def _block(steps: list, path: str):
    """Of hashed steps: documents' numbers of words, distinct words (sorted hashes), each word's number, ids by distinct word."""
    h = np.concatenate([x[3] for x in steps])
    lens = np.concatenate([np.diff(x[4]) for x in steps])
    order = np.argsort(h)
    x = np.take(h, order)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    u, first, inv = x[new], order[new], np.empty(len(x), np.int64)
    inv[order] = np.cumsum(new) - 1

    def letters(new: np.ndarray) -> list[str]:
        """Of distinct words, the letters where each stands."""
        names, done, own = [""] * len(new), 0, first[new]
        for data, a, b, _, _ in steps:
            mine = np.flatnonzero((own >= done) & (own < done + len(a)))
            raw = data.tobytes()
            for k, i, j in zip(mine.tolist(), a[own[mine] - done].tolist(), b[own[mine] - done].tolist(), strict=True):
                names[k] = raw[i:j].decode()
            done += len(a)
        return names

    flat, n = _UNITS.setdefault(path, Units()).ids(u, letters, path)
    return lens, u, inv, flat, n

def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed: their lowest bytes, then their second ones, as many as the largest needs."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    raw = b"".join((x >> 8 * i).astype(np.uint8).tobytes() for i in range(planes))
    return len(x).to_bytes(8, "little") + planes.to_bytes(1, "little") + pa.compress(raw, "zstd", asbytes=True)


def whole(x: pa.Scalar) -> np.ndarray:
    raw = x.as_buffer()
    n, planes = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros(n, np.int64)
    for i, plane in enumerate(np.frombuffer(pa.decompress(raw[9:], n * planes, "zstd"), np.uint8).reshape(planes, n)):
        out |= plane.astype(np.int64) << 8 * i
    return out


BLOCK = "block long, doc_id array<long>, held array<boolean>, lens array<long>, word binary, top binary, c binary, inv binary, n binary, ids binary"


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """The texts of docs (doc_id, text, held) as blocks of ids: a row for some BLOCK_BYTES of text, without a shuffle.

    block, the documents' ids, folds and numbers of words; the block's distinct words (hashes, and their upper 16 bits by themselves)
    with their learning counts; for each word of the texts the number of its distinct word; and each distinct word's number of subword
    ids and those ids.
    """
    if codec(path).lib.vocab_size() > BASE**3:
        raise ValueError(f"over {BASE**3} subwords")

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        steps, ids, held, size = [], [], [], 0

        def row():
            lens, word, inv, flat, n = _block(steps, path)
            order = np.argsort(-np.bincount(inv), kind="stable")  # frequent words get small numbers
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            flat = flat[common.ragged((np.cumsum(n) - n)[order], n[order])]
            word, inv, n = word[order], number[inv], n[order]
            held_out = pa.chunked_array(held).to_numpy()
            c = np.bincount(inv, np.repeat(~held_out, lens), len(word)).astype(np.int64)
            one = lambda x: pa.array([x])
            cols = [one(part << 32 | made), pa.ListArray.from_arrays([0, len(lens)], pa.concat_arrays(ids)), one(held_out), one(lens)]
            top = (word >> np.uint64(48)).astype(np.uint16)
            cols += [pa.array([x], pa.binary()) for x in (word.tobytes(), top.tobytes(), packed(c), packed(inv), packed(n), packed(flat))]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for piece in common.slices(batch):
                got = list(_hashed(piece.column(1)))
                steps += got
                ids.append(piece.column(0).cast(pa.int64()))
                held.append(piece.column(2))
                size += sum(len(x[0]) for x in got)
                if size >= BLOCK_BYTES:
                    yield row()
                    made += 1
                    steps, ids, held, size = [], [], [], 0
        if steps:
            yield row()

    return docs.select("doc_id", "text", "held").mapInArrow(common.task(run), BLOCK)


def _unpacked(t: pa.RecordBatch | pa.Table, i: int):
    """Of row i: numbers of words, number of each word's distinct word, ids of distinct words end to end, and how many each has."""
    lens = t["lens"][i].values.to_numpy(zero_copy_only=False)
    return lens, whole(t["inv"][i]), whole(t["ids"][i]), whole(t["n"][i])


def _learning(batches, start: int, end: int):
    """The ids of each block's learning documents, a start and an end around each."""
    for batch in batches:
        for i in range(batch.num_rows):
            lens, inv, flat, n = _unpacked(batch, i)
            own = ~batch["held"][i].values.to_numpy(zero_copy_only=False)
            w = inv[np.repeat(own, lens)]
            k = n[w]
            per = np.concatenate(([0], np.cumsum(k)))[np.concatenate(([0], np.cumsum(lens[own])))]
            if own.any():
                yield around(flat[common.ragged((np.cumsum(n) - n)[w], k)], per, start, end)


WEIGHTS = "part long, strip long, n long, w binary"


def averaged(weights: DataFrame) -> DataFrame:
    """Weights of tasks (part, strip, n, w) averaged by n, strip by strip: TOGETHER_TASKS tasks first, then all of a strip."""

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # sums do not depend on who came first
        n = t["n"].to_pylist()
        w = sum(k * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for k, x in zip(n, t["w"], strict=True)) / sum(n)
        return pa.table({"part": t["part"].slice(0, 1), "strip": t["strip"].slice(0, 1), "n": pa.array([sum(n)]), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    some = weights.groupBy(F.floor(F.col("part") / TOGETHER_TASKS).alias("some"), "strip").applyInArrow(mean, WEIGHTS)
    return some.groupBy("strip").applyInArrow(mean, WEIGHTS)


def _stored(made: DataFrame) -> DataFrame:
    """Blocks, written in files of FILE_BLOCKS at most: a reader of Parquet holds a whole batch of rows, which these would overfill."""
    return common.written(made, maxRecordsPerFile=FILE_BLOCKS)


def train(learn: DataFrame, path: str, share: float, made: DataFrame | None = None) -> Model:
    """A model of all learning documents, from a start on about FIT_DOCS, those of the lowest hashes of doc_id.

    made: blocks that hold them, where these are there already.
    """
    c = codec(path)
    vocab, start, end = c.lib.vocab_size(), c.lib.bos_id(), c.lib.eos_id()
    made = _stored(blocks(learn.withColumn("held", F.lit(False)), path)) if made is None else made

    def count(batches):
        n = np.zeros(vocab, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own = ~batch["held"][i].values.to_numpy(zero_copy_only=False)
                by_word = np.repeat(whole(batch["c"][i]), whole(batch["n"][i]))
                n += np.bincount(whole(batch["ids"][i]), by_word, vocab).astype(np.int64)
                n[start] += own.sum()
                n[end] += own.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(vocab)), pa.array(n)], names=["id", "n"])

    counted = made.select("held", "c", "n", "ids").mapInArrow(common.task(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row an id
    counts = np.zeros(vocab)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    some = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    docs = []
    for x in _sample(some, path, start, end).toArrow()["ids"].to_pylist():
        x = np.frombuffer(x, np.int64)
        docs += [d[1:-1] for d in np.split(x, np.flatnonzero(x == start)[1:])]
    m = Model(vocab, start, end)
    m.train(sorted(docs, key=lambda x: (len(x), x.tobytes())), counts=counts)
    names = sorted(m.w)
    sent = learn.sparkSession.sparkContext.broadcast(m)

    def learnt(batches):
        own = pickle.loads(pickle.dumps(sent.value))
        adam, n = Adam(own), 0
        for stream in _learning(batches, start, end):
            n += adam.epoch(stream)
        if n:
            flat = np.concatenate([own.learnt(k).ravel() for k in names])
            part = TaskContext.get().partitionId()
            for i, x in enumerate(np.array_split(flat, STRIPS)):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([i]), pa.array([n]), pa.array([x.tobytes()], pa.binary())], names=["part", "strip", "n", "w"])

    weights = made.select("held", "lens", "inv", "n", "ids").mapInArrow(common.task(learnt), WEIGHTS)
    strips = sorted(averaged(weights).collect(), key=lambda r: r.strip)  # the weights of one model
    sent.destroy()
    if strips:
        flat, lo = np.concatenate([np.frombuffer(r.w, np.float32) for r in strips]), 0
        for k in names:
            part = m.learnt(k)
            new = flat[lo : lo + part.size].reshape(part.shape)
            if k == "e":
                m.w[k][m.seen] = new
            else:
                part[...] = new
            lo += part.size
    m.freeze()
    return m


def _sample(texts: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """ids: of each step of texts the 64-bit ids, a start and an end around every document."""

    def run(batches):
        for batch in batches:
            for piece in common.slices(batch):
                lens, _, inv, flat, n = _block(list(_hashed(piece.column(0))), path)
                k = n[inv]
                per = np.concatenate(([0], np.cumsum(k)))[np.concatenate(([0], np.cumsum(lens)))]
                x = around(flat[common.ragged((np.cumsum(n) - n)[inv], k)], per, start, end)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["ids"])

    return texts.mapInArrow(common.task(run), "ids binary")


def part_bits(n_bytes: int) -> int:
    """Upper bits of a word's hash that name its part, by the bytes of all blocks' words: parts of about PART_BYTES."""
    return min(16, max(0, -(-n_bytes // PART_BYTES) - 1).bit_length())


def word_sums(made: DataFrame, bits: int) -> DataFrame:
    """block, part, all, n, v: for every block the counts over all blocks of its words in a part, by their numbers; n and v, the sum of
    a part's counts and the number of its words with any, stand in one row of each part."""

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                word, c = np.frombuffer(batch["word"][i].as_buffer(), np.uint64), whole(batch["c"][i])
                part = np.frombuffer(batch["top"][i].as_buffer(), np.uint16) >> (16 - bits)
                order = np.argsort(part, kind="stable")
                parts, first = np.unique(part[order], return_index=True)
                cuts = np.append(first, len(part))
                cols = [pa.array(parts.astype(np.int64)), pa.array(np.full(len(parts), batch["block"][i].as_py(), np.int64))]
                for x, size in ((word[order], 8), (c[order].astype(np.uint32), 4)):
                    cols.append(pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(x.tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "word", "c"])

    def add(t: pa.Table) -> pa.Table:
        raw, at = common.buffers(t["word"])
        c = common.buffers(t["c"])[0].view(np.uint32).astype(np.int64)
        u, inv = np.unique(raw.view(np.uint64), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inv, c)
        rows = pa.Array.from_buffers(pa.large_binary(), t.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(total[inv].tobytes())])
        once = lambda x: pa.array(np.append(x, np.zeros(t.num_rows - 1, np.int64)))
        return pa.table({"block": t["block"], "part": t["part"], "all": rows.cast(pa.binary()), "n": once(int(total.sum())), "v": once(int((total > 0).sum()))})

    dealt = made.select("block", "word", "top", "c").mapInArrow(common.task(deal), "part long, block long, word binary, c binary")
    return dealt.groupBy("part").applyInArrow(add, "block long, part long, all binary, n long, v long")


def lm_score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns outside the held-out fold, scores all."""
    path = path or model_path()
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.coalesce(common.bucket_of(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held"))
    made = _stored(blocks(own, path))
    size = made.agg(F.sum(F.octet_length("inv") + F.octet_length("ids")).alias("b"), F.sum(F.octet_length("word")).alias("words"), F.sum(F.size("lens")).alias("n"), F.sum(F.size(F.filter("held", lambda x: ~x))).alias("ends")).first()
    model = train(own.filter("not held").select("doc_id", "text"), path, min(1.0, FIT_DOCS * 1.25 / max(1, size.n or 0)), made)
    sent = spark.sparkContext.broadcast(model)
    bits = part_bits(size.words or 0)
    summed = common.written(word_sums(made, bits))
    total = summed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    ends = int(size.ends or 0)  # the end token: one of each learning document
    n_train, v_train = int(total.n) + ends, int(total.v) + (ends > 0)

    def score(t: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = sent.value
        lens, word, flat, n_ids = _unpacked(t, 0)
        known = known.sort_by("part")
        c = np.empty(len(n_ids), np.int64)
        c[np.argsort(np.frombuffer(t["top"][0].as_buffer(), np.uint16) >> (16 - bits), kind="stable")] = common.buffers(known["all"])[0].view(np.int64)
        log = np.log10((c + 0.5) / (n_train + 0.5 * (v_train + 1)))
        end = np.log10((ends + 0.5) / (n_train + 0.5 * (v_train + 1)))
        doc = np.repeat(np.arange(len(lens)), lens)
        base = np.bincount(doc, log[word], len(lens)) + end
        n_known = np.bincount(doc, c[word] > 0, len(lens)).astype(np.int64) + (ends > 0)
        starts = np.cumsum(n_ids) - n_ids
        out = np.empty(len(lens))
        ends_of = np.cumsum(lens)
        lo = 0
        while lo < len(lens):  # documents in runs of some 200 thousand words
            hi = max(lo + 1, int(np.searchsorted(ends_of, (ends_of[lo - 1] if lo else 0) + 200_000, side="right")))
            w = word[ends_of[lo] - lens[lo] : ends_of[hi - 1]]
            k = n_ids[w]
            per = np.concatenate(([0], np.cumsum(k)))[np.concatenate(([0], np.cumsum(lens[lo:hi])))]
            out[lo:hi] = m.score(flat[common.ragged(starts[w], k)], per)
            lo = hi
        return pa.table({"doc_id": t["doc_id"][0].values, "held_out": t["held"][0].values, "n_tokens": pa.array(lens + 1), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(lens), n_train)), "base_score": pa.array(base), "score": pa.array(out)})

    parts = common.partitions(spark, size.b or 0, 4 * BLOCK_BYTES)
    own, known = (x.repartition(parts, "block").groupBy("block") for x in (made.drop("word", "c"), summed.select("block", "part", "all")))
    return own.cogroup(known).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
