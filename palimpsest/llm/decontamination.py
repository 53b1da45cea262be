"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of PASSAGE words at every half of that; words are hashed into DIMS buckets and weighted by the square of
the logarithm of inverse passage frequency (a factor for either side of the cosine), counted over all documents. A randomised singular value decomposition of the TF-IDF passages of the
benchmark, with the passages of all documents at a small weight, gives latent directions, RANK and more with the
benchmark's passages: a product with the benchmark alone gives directions to start from, one with both the final ones, whose
corpus part is summed on executors in a pass over all documents. Every passage of every document is then compared by
latent cosine with every benchmark passage, in blocks. Each pair at COSINE or more goes to the exact checks: the longest common
subsequence of words between the item and the text around the passage, over the item's words, must reach LCS; or reach LCS_ANSWER
where the item's last words (its answer) also stand there in a row.

A cosine can miss what would pass the checks (an item that two passages share, many words replaced). So places that must be looked
at whatever their cosine go to the checks too: where the item's answer stands in a row, and where TOGETHER of the item's rarest
words stand as in the item, give or take PASSAGE words. Of an item of n words with m in common, at most n - m are not, so any
n - m + TOGETHER words hold TOGETHER common ones: nothing within that shift is missed, and the cosine decides no result.

The benchmark is the stated query set: it is searched in sets of SET_WORDS words, a pass over the documents each, and one set at a
time is broadcast. Items and documents that are null or
have no word match nothing. Long texts are searched whole. Repeated rows give repeated answers. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PASSAGE, DIMS, RANK, OVERSAMPLE = 24, 1 << 13, 96, 16
COSINE, LCS, LCS_ANSWER, ANSWER = 0.7, 0.7, 0.5, 4
#: The weight of the corpus in the fit against the benchmark's, and tasks of its pass to a core (each sends its sums once).
CORPUS_WEIGHT, PER_CORE = 0.1, 4
#: Words of the benchmark searched in one pass: its broadcast stays below some 200 MB (a vector of up to 1,024 numbers for 12 words).
SET_WORDS = 400_000
#: Passages of the benchmark in a block of the fit and in one of the search, parts that the fit's sums travel in, and tasks summed at once.
ROWS, COLUMNS, STRIPS, TOGETHER_TASKS = 512, 4_096, 16, 16
#: Words of one bucket that are added one by one in the fit; more are summed first, in pieces.
FEW, PIECE = 24, 4_096
#: Common words that call for the exact checks, bits of a word in the table of items' words, benchmark passages to a latent direction.
TOGETHER, CODE, PER_DIRECTION = 3, 20, 8
#: Places whose words are compared with their items' at once, before the exact checks.
PLACES = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w.strip(".,;:!?\"'()[]{}") or w for w in _WORD.findall((text or "").translate(_FOLD))]


_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,;:!?\"'()[]{}"]] = True


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, less the signs at either end, and documents' offsets into them."""
    a, b, at = common.word_spans(data, offsets)
    more = len(a) > 0
    while more:
        off = (b - a > 1) & _STRIP[data[b - 1]]
        b = b - off
        on = (b - a > 1) & _STRIP[data[a]]
        a = a + on
        more = off.any() or on.any()
    return common.span_hash(common.prefix_hash(common.lower(data)), a, b), at


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and documents' offsets into them."""
    h, at = hashes(data, offsets)
    return (h >> np.uint64(51)).astype(np.int64), at


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each on; one for each place that has as many."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return out


def halves(at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all half passages, and their documents."""
    n = -(-np.diff(at) // half)
    doc = np.repeat(np.arange(len(n)), n)
    return common.ragged(np.zeros(len(n), np.int64), n) * half + at[:-1][doc], doc


def _grown(sums: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Passages from half passages: each with the next of its document."""
    out = sums.copy()
    same = doc[1:] == doc[:-1]
    out[:-1][same] += sums[1:][same]
    return out


def _half_sums(v: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each half passage, of which `first` gives the first words, the sum of its words' rows of v."""
    n = np.diff(np.append(first, len(b)))
    out = np.zeros((len(first), v.shape[1]), np.float32)
    for lo in range(0, len(first), ROWS):
        own = slice(lo, lo + ROWS)
        least = int(n[own].min())
        for i in range(int(n[own].max())):
            x = np.take(v, np.take(b, first[own] + i, mode="clip"), axis=0)
            if i >= least:
                x[n[own] <= i] = 0
            out[own] += x
    return out


def _add_by_bucket(out: np.ndarray, b: np.ndarray, p: np.ndarray, own: np.ndarray) -> None:
    """Adds to row b[i] of out the row own[i] of p, for every word i."""
    order = np.argsort(b.astype(np.uint16), kind="stable")
    x = b[order]
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    n = np.diff(np.append(cuts, len(x)))
    row = own[order]
    for i in range(min(FEW, int(n.max(initial=0)))):  # the i-th words of rare buckets, no bucket twice
        at = cuts[(n > i) & (n <= FEW)]
        out[x[at]] += np.take(p, row[at + i], axis=0)
    for c, k in zip(cuts[n > FEW].tolist(), n[n > FEW].tolist(), strict=True):
        for lo in range(c, c + k, PIECE):
            out[x[c]] += np.take(p, row[lo : min(lo + PIECE, c + k)], axis=0).sum(axis=0)


def _holders(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each bucket the half passages that hold it; `first` gives their first words, of PASSAGE // 2 words at most each."""
    n = np.diff(np.append(first, len(b)))
    x = np.full((PASSAGE // 2, len(first)), DIMS, np.uint16)  # a half a column; DIMS where it has no word
    x[common.ragged(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)] = b
    new = np.ones(x.shape, bool)
    for i in range(len(x)):
        for j in range(i):
            new[i] &= x[j] != x[i]
    return np.bincount(x[new], minlength=DIMS + 1)[:DIMS]


def passage_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket the half passages that hold it, over all documents; and their number."""

    def run(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part in common.slices(batch):
                b, at = buckets(*common.buffers(part.column(0)))
                first, _ = halves(at, PASSAGE // 2)
                df += _holders(b, first)
                n += len(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(df, n))], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(common.task(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    df[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return df[:DIMS], int(df[DIMS])


class Space:
    """Latent directions of word buckets."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray):
        self.items = [(i, words_of(t)) for i, t in items]
        self.idf = idf
        texts = [t or "" for _, t in items]
        h, self.at = hashes(*common.buffers(pa.array(texts, pa.string())))
        self.b = (h >> np.uint64(51)).astype(np.int64)
        self.index(h)
        self.first, self.doc = halves(self.at, PASSAGE // 2)
        self.numbers = [self.b[i:j].tolist() for i, j in zip(self.at[:-1], self.at[1:], strict=True)]

    def index(self, h: np.ndarray) -> None:
        """Where the items' rarest words and answers stand: what places() looks up."""
        n = np.diff(self.at)
        lcs = np.array([next((m for m in range(k) if m / k >= LCS), k) for k in n.tolist()], np.int64)  # words in common at least
        self.together = np.minimum(TOGETHER, lcs)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((-self.idf[self.b], doc))  # item by item, rarest words first
        place = np.arange(len(h)) - self.at[:-1][doc]
        mine = order[place < (n - lcs + self.together)[doc]]
        mine = mine[np.argsort(h[mine] >> np.uint64(64 - CODE), kind="stable")]
        self.rare_item, self.rare_place = doc[mine], place[mine]
        self.rare_at = np.searchsorted(h[mine] >> np.uint64(64 - CODE), np.arange((1 << CODE) + 1, dtype=np.uint64)).astype(np.int32)
        self.answers = []  # by length: sorted hashes and their items
        for k in np.unique(np.minimum(n, ANSWER)).tolist():
            its = np.flatnonzero(np.minimum(n, ANSWER) == k)
            x = runs(h, k)[self.at[1:][its] - k]
            by = np.argsort(x, kind="stable")
            few = np.zeros(1 << CODE, bool)
            few[x >> np.uint64(64 - CODE)] = True
            self.answers.append((k, few, x[by], its[by]))

    def places(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (document, item, first word) that the exact checks must see, whatever their cosine."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        code = (h >> np.uint64(64 - CODE)).astype(np.int64)
        n = self.rare_at[code + 1] - self.rare_at[code]
        w = np.flatnonzero(n)
        k = common.ragged(self.rare_at[code[w]].astype(np.int64), n[w].astype(np.int64))
        w = np.repeat(w, n[w])
        d, it, start = doc[w], self.rare_item[k], w - at[:-1][doc[w]] - self.rare_place[k]
        # sorted by document, item and first word; items lie further apart than any shift
        longest = int(np.diff(self.at).max(initial=1))
        wide = longest + int(np.diff(at).max(initial=1)) + PASSAGE + 1
        key = np.sort((d * len(self.items) + it) * wide + start + longest)
        need = self.together[key // wide % len(self.items)] - 1
        i = np.arange(len(key)) + need
        ok = np.flatnonzero(i < len(key))
        key = key[ok[key[i[ok]] - key[ok] <= PASSAGE]]
        found = [np.stack([key // wide // len(self.items), key // wide % len(self.items), key % wide - longest], axis=1)]
        for size, few, x, its in self.answers:
            r = runs(h, size)
            w = np.flatnonzero(few[r >> np.uint64(64 - CODE)])
            w = w[doc[w] == doc[w + size - 1]]
            lo, hi = np.searchsorted(x, r[w]), np.searchsorted(x, r[w], side="right")
            it = its[common.ragged(lo, hi - lo)]
            w = np.repeat(w, hi - lo)
            found.append(np.stack([doc[w], it, w - at[:-1][doc[w]] - (np.diff(self.at)[it] - size)], axis=1))
        return np.concatenate(found)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """TF-IDF rows of length one of the benchmark's passages lo to hi."""
        end = min(hi + 1, len(self.first))  # a passage is a half and the next
        first, last = self.first[lo:end], np.append(self.first, len(self.b))[end]
        x = np.zeros((len(first), DIMS), np.float32)
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, last)))
        b = self.b[first[0] : last]
        np.add.at(x, (own, b), self.idf[b])
        x = _grown(x, self.doc[lo:end])[: hi - lo]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def fit(self, docs: DataFrame) -> Space:
        """The randomised decomposition: a pass over all `docs` (text) for their part of the second product, the benchmark's parts here.

        Products of executors are summed there, in STRIPS of buckets, so the driver gets one matrix.
        """
        rng = np.random.default_rng(5)
        rank = max(RANK, min(len(self.first) // PER_DIRECTION, DIMS // 8))
        k = rank + OVERSAMPLE
        y = np.linalg.qr(rng.standard_normal((DIMS, k)).astype(np.float32))[0]
        spark = docs.sparkSession
        docs = docs.coalesce(PER_CORE * max(16, spark.sparkContext.defaultParallelism))
        wide = DIMS // STRIPS

        def total(t: pa.Table) -> pa.Table:
            z = np.zeros((wide, k), np.float32)
            for x in t["z"]:
                z += np.frombuffer(x.as_buffer(), np.float32).reshape(wide, k)
            return pa.table({"part": pa.array([0], pa.int64()), "strip": t["strip"].slice(0, 1).cast(pa.int64()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "z": pa.array([z.tobytes()], pa.binary())})

        for corpus in (False, True):
            z = np.zeros((DIMS, k), np.float32)
            for lo in range(0, len(self.first), ROWS):
                x = self.rows(lo, min(lo + ROWS, len(self.first)))
                z += x.T @ (x @ y)
            if not corpus:
                y = np.linalg.qr(z)[0]
                continue
            sent = spark.sparkContext.broadcast((y, self.idf))

            def run(batches, sent=sent):
                y, idf = sent.value
                total, n = np.zeros((DIMS, k), np.float32), 0
                weighted = y * idf[:, None]
                for batch in batches:
                    for part in common.slices(batch, step=1 << 18):
                        b, at = buckets(*common.buffers(part.column(0)))
                        first, doc = halves(at, PASSAGE // 2)
                        if not len(first):
                            continue
                        p = _grown(_half_sums(weighted, b, first), doc)
                        _add_by_bucket(total, b, p, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(b)))))
                        n += len(first)
                if n:
                    total *= idf[:, None]
                    part = TaskContext.get().partitionId() // TOGETHER_TASKS
                    for i in range(STRIPS):
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([i], pa.int64()), pa.array([n], pa.int64()), pa.array([total[i * wide : (i + 1) * wide].tobytes()], pa.binary())], names=["part", "strip", "n", "z"])

            kind = "part long, strip long, n long, z binary"
            sums = docs.mapInArrow(common.task(run), kind).groupBy("part", "strip").applyInArrow(total, kind)
            parts = sums.groupBy("strip").applyInArrow(total, kind).toArrow()  # STRIPS rows
            sent.destroy()
            n = parts["n"][0].as_py() if parts.num_rows else 0
            for i, x in zip(parts["strip"].to_pylist(), parts["z"], strict=True):
                c = np.frombuffer(x.as_buffer(), np.float32).reshape(wide, k)
                z[i * wide : (i + 1) * wide] += np.float32(CORPUS_WEIGHT * len(self.first) / n / max(1e-9, float(self.idf.mean()) ** 2 * PASSAGE)) * c
            y = np.linalg.svd(z, full_matrices=False)[0]
        self.v = np.ascontiguousarray(y[:, :rank] * self.idf[:, None])  # a word's latent vector, weighted
        p = np.zeros((len(self.first), rank), np.float32)
        ends = np.append(self.first[1:], len(self.b))
        for lo in range(0, len(self.first), ROWS):
            hi = min(lo + ROWS, len(self.first))
            p[lo:hi] = np.add.reduceat(self.v[self.b[self.first[lo] : ends[hi - 1]]], self.first[lo:hi] - self.first[lo])
        p = _grown(p, self.doc)
        self.q = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        return self


def _close_pairs(p: np.ndarray, qt: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of p and columns of qt whose product is `cosine` at least, and the product; by blocks of columns, then row by row."""
    near = []
    for q in range(0, qt.shape[1], COLUMNS):
        cos = (p @ qt[:, q : q + COLUMNS]).ravel()
        hit = np.flatnonzero(cos >= cosine)
        i, j = np.divmod(hit, min(COLUMNS, qt.shape[1] - q))
        near.append((i, j + q, cos[hit]))
    return tuple(np.concatenate(x) for x in zip(*near, strict=True))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of a machine number of any size."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def has_run(run: list, words: list) -> bool:
    n = len(run)
    return any(words[i : i + n] == run for i in range(len(words) - n + 1) if words[i] == run[0])


def may_pass(space: Space, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, it: np.ndarray) -> np.ndarray:
    """Whether enough words of item it[i] have their bucket among b[lo[i]:hi[i]] for the exact checks to pass, in any order; never falls short."""
    out = np.zeros(len(it), bool)
    for at in range(0, len(it), PLACES):
        own = slice(at, at + PLACES)
        k = hi[own] - lo[own]
        there = np.zeros((len(k), DIMS), bool)
        there[np.repeat(np.arange(len(k)), k), b[common.ragged(lo[own], k)]] = True
        n = np.diff(space.at)[it[own]]
        hit = there[np.repeat(np.arange(len(n)), n), space.b[common.ragged(space.at[it[own]], n)]]
        sums = np.concatenate(([0], np.cumsum(hit)))
        end = np.cumsum(n)
        m, last = (sums[end] - sums[end - n]) / n, np.minimum(n, ANSWER)
        out[own] = (m >= LCS) | (m >= LCS_ANSWER) & (sums[end] - sums[end - last] == last)
    return out


SCHEMA = "doc_id long, item_id long, word_start long, cosine double, lcs double, answer boolean"


def search(docs: DataFrame, space: Space, cosine: float = COSINE) -> DataFrame:
    """A row for each document and item that passes the exact checks, at its best passage."""
    spread = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        s = spread.value
        half = PASSAGE // 2
        qt = np.ascontiguousarray(s.q.T)
        for batch in batches:
            for part in common.slices(batch, step=1 << 18):
                out: dict[tuple[int, int], tuple] = {}
                h, at = hashes(*common.buffers(part.column(1)))
                b = (h >> np.uint64(51)).astype(np.int64)
                first, doc = halves(at, half)
                if len(first) and qt.shape[1]:
                    p = _grown(_half_sums(s.v, b, first), doc)
                    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                    pi, qi, close_by = _close_pairs(p, qt, cosine)
                    texts: dict[int, list[str]] = {}
                    must = s.places(h, at)
                    wanted = np.concatenate((np.stack([doc[pi], s.doc[qi], first[pi] - at[doc[pi]] - (s.first[qi] - s.at[s.doc[qi]])], axis=1), must))
                    near_by = np.append(close_by, np.full(len(must), np.nan))
                    d, it, start = wanted[:, 0], wanted[:, 1], np.maximum(0, wanted[:, 2])
                    once = np.unique((d * len(s.items) + it) * (int(start.max(initial=0)) // half + 1) + start // half, return_index=True)[1]
                    d, it, start, near_by = d[once], it[once], start[once], near_by[once]
                    n = np.diff(s.at)[it]
                    low = np.minimum(at[d] + np.maximum(0, start - PASSAGE), at[d + 1])
                    good = np.flatnonzero(may_pass(s, b, low, np.minimum(at[d] + start + n + PASSAGE + n // 2, at[d + 1]), it))
                    for d, it, start, close in zip(d[good].tolist(), it[good].tolist(), start[good].tolist(), near_by[good].tolist(), strict=True):
                        item = s.items[it][1]
                        lo, hi = max(0, start - PASSAGE), start + len(item) + PASSAGE + len(item) // 2
                        # first over buckets: equal words have equal ones, so this never falls short
                        near = b[at[d] + lo : min(at[d] + hi, at[d + 1])].tolist()
                        if lcs(s.numbers[it], near) < LCS_ANSWER * len(item):
                            continue
                        if d not in texts:
                            texts[d] = words_of(part.column(1)[d].as_py())
                        near = texts[d][lo:hi]
                        ratio = lcs(item, near) / len(item)
                        if ratio < LCS_ANSWER:
                            continue
                        answer = has_run(item[-ANSWER:], near)
                        if ratio >= LCS or answer:
                            old = out.get((d, it))
                            if close != close:  # none: the best of the passages there
                                x = np.searchsorted(first, (at[d] + max(0, start - half), min(at[d] + start + len(item), at[d + 1])))
                                q = np.searchsorted(s.first, (s.at[it], s.at[it + 1]))
                                close = (p[x[0] : x[1]] @ qt[:, q[0] : q[1]]).max()
                            new = (ratio, float(close), -start, answer)
                            if old is None or new > old:
                                out[d, it] = new
                ids = part.column(0).to_pylist()
                rows = [(ids[d], s.items[it][0], -n, c, r, a) for (d, it), (r, c, n, a) in sorted(out.items())]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Contaminated (doc_id, item_id) with the place, latent cosine, share of the item in order, and whether its answer is there."""
    bench = benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text")
    df, n = passage_frequency(docs)
    idf = (np.log((n + 1) / (df + 1)) ** 2).astype(np.float32) + np.float32(0.01)
    out = None
    for items in _sets(bench):
        found = search(docs, Space(items, idf).fit(docs.select("text")), cosine)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _sets(bench: DataFrame):
    """The items (item_id, text) that have words, in sets of SET_WORDS words (a longer item is a set of its own)."""
    own, size = [], 0
    for r in bench.toLocalIterator():  # the query set, a partition at a time
        n = len(words_of(r.text))
        if n and own and size + n > SET_WORDS:
            yield own
            own, size = [], 0
        if n:
            own.append((r.item_id, r.text))
            size += n
    if own:
        yield own
