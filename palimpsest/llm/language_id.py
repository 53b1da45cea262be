"""Language identification by prediction by partial matching.

Every language has a byte context tree of variable order, up to ORDER bytes of context. A symbol seen c times after a context
that was followed by T bytes of D distinct kinds costs -log2(c / (T + D)) bits there; an unseen one costs the escape,
-log2(D / (T + D)), and is coded after the next shorter context, last uniformly over 256 bytes. Statistics are frozen, so the
code length of a text is an exact sum. All languages' trees share one table: a row for each (context, symbol) seen in any
language holds its full cost in each of them, a row for each context its escape; a byte takes the longest row that is seen.

Learning takes about FIT_ROWS documents of each language (all of a smaller one), those of the lowest hashes of doc_id; this
bound is a parameter. Texts
are lower-cased (A-Z). Prediction is the language of the least code length; its score is the posterior under equal priors, with
lengths tempered by TEMPER bits a nat. Null texts and texts without a letter are `und` with score 0. Ties go to the smaller
name. Without any labelled text all is `und`. Extra columns of the input are ignored; very long texts are scored in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
FIT_ROWS = 1500
TEMPER = 8.0
_BLOCK = 1 << 17


def keys_of(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each position as one number, with k itself on top. `data` has ORDER zero bytes in front."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = (out << np.uint64(8)) | data[at + (ORDER - k + j)]
    return out | (np.uint64(k + 1) << np.uint64(56))


class Table:
    """Open addressing from 64-bit keys to row numbers, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        size = 1 << self.bits
        self.key = np.zeros(size, np.uint64)
        self.row = np.full(size, -1, np.int32)
        at, left, step = self._home(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            slot = (at[left] + step) & (size - 1)
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # of several for one slot the last stays
            won = self.row[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left = left[~won]
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        at, mask = self._home(keys), len(self.key) - 1
        row, same = np.take(self.row, at), np.take(self.key, at) == keys
        out = np.where(same, row, -1)
        left = np.flatnonzero(~same & (row >= 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            slot = (at[left] + step) & mask
            hit = self.key[slot] == keys[left]
            out[left[hit]] = self.row[slot[hit]]
            left = left[~hit & (self.row[slot] >= 0)]
        return out


class Trees:
    """The context trees of all languages. counts: for each order k, keys of k + 1 bytes, their language and count."""

    def __init__(self, langs: list[str], grams: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]):
        self.langs = langs
        n = len(langs)
        self.sym: dict[int, tuple[Table, np.ndarray]] = {}
        self.esc: dict[int, tuple[Table, np.ndarray]] = {}
        for k in range(ORDER + 1):
            union = np.unique(np.concatenate([grams[k][x][0] for x in langs]))
            ctx_of = (union & np.uint64((1 << 56) - 1)) >> np.uint64(8) | (np.uint64(k + 1) << np.uint64(56))
            ctx = np.unique(ctx_of)
            where = np.searchsorted(ctx, ctx_of)
            cost, esc = np.zeros((len(union), n), np.float32), np.zeros((len(ctx), n), np.float32)
            lower = np.full((len(union), n), 8.0, np.float32)
            if k:
                short = self._shorter(union, k)
                lower = self._costs(short, k - 1)
            for j, x in enumerate(langs):
                own, c = grams[k][x]
                c_all = np.zeros(len(union))
                c_all[np.searchsorted(union, own)] = c
                t = np.bincount(where, c_all, len(ctx))
                d = np.bincount(where, c_all > 0, len(ctx))
                seen = t > 0
                esc[seen, j] = -np.log2(d[seen] / (t[seen] + d[seen]))
                here = c_all > 0
                cost[here, j] = -np.log2(c_all[here] / (t + d)[where[here]])
                cost[~here, j] = esc[where[~here], j] + lower[~here, j]
            self.sym[k], self.esc[k] = (Table(union), cost), (Table(ctx), esc)

    @staticmethod
    def _shorter(keys: np.ndarray, k: int) -> np.ndarray:
        """Keys of k + 1 bytes without their first byte."""
        return (keys & np.uint64((1 << (8 * k)) - 1)) | (np.uint64(k + 1) << np.uint64(56))

    def _costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Cost rows of keys of k + 1 bytes (marked k + 2 on top), escaping to shorter contexts where unseen."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for order in range(k, -1, -1):
            row = self.sym[order][0].find(keys)
            hit = row >= 0
            out[left[hit]] += self.sym[order][1][row[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            ctx = (keys & np.uint64((1 << 56) - 1)) >> np.uint64(8) | (np.uint64(order + 1) << np.uint64(56))
            row = self.esc[order][0].find(ctx)
            hit = row >= 0
            out[left[hit]] += self.esc[order][1][row[hit]]
            if order:
                keys = self._shorter(keys, order)
        out[left] += 8.0
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document in each language: documents x languages."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.langs)))
        doc = np.repeat(np.arange(n), np.diff(offsets))
        left = np.arange(len(data)) - offsets[doc]
        padded = np.concatenate((np.zeros(ORDER, np.uint8), data)).astype(np.uint64)
        for a in range(0, len(data), _BLOCK):
            at = np.arange(a, min(len(data), a + _BLOCK))
            keys = (keys_of(padded, at, ORDER) << np.uint64(8)) | padded[at + ORDER]
            near = np.minimum(left[at], ORDER)  # contexts do not reach over the start of a document
            for k in range(ORDER + 1):
                own = np.flatnonzero(near == k)
                if not len(own):
                    continue
                x = (keys[own] & np.uint64((1 << (8 * (k + 1))) - 1)) | (np.uint64(k + 2) << np.uint64(56))
                rows = self._costs(x, k)
                d = doc[at[own]]
                cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                out[d[cuts]] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
        return out


def _grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of k context bytes and a symbol, with counts."""
    left = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    at = np.flatnonzero(left >= k)
    padded = np.concatenate((np.zeros(ORDER, np.uint8), data)).astype(np.uint64)
    keys = np.zeros(len(at), np.uint64)
    for j in range(k + 1):
        keys = (keys << np.uint64(8)) | padded[at + ORDER - k + j]
    return np.unique(keys | (np.uint64(k + 2) << np.uint64(56)), return_counts=True)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees of the languages of `labelled` (doc_id, text, lang). Counting runs on executors; the driver gets distinct grams."""
    named = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = named.groupBy("lang").count().select("lang", (F.lit(float(fit_rows)) / F.col("count")).alias("share"))
    # rows of the lowest hashes: of every language about fit_rows, found without gathering a language in one place
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = named.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("doc_id", "text", "lang")

    def count(batches):
        for batch in batches:
            names = batch.column(2).to_pylist()
            for x in sorted(set(names)):
                own = batch.filter(pa.array([y == x for y in names]))
                for part in common.slices(own, step=_BLOCK):
                    data, offsets = common.buffers(part.column(1))
                    data = common.lower(data)
                    got = [_grams(data, offsets, k) for k in range(ORDER + 1)]
                    keys, c = (np.concatenate(y) for y in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(common.task(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = counted["lang"].to_numpy(zero_copy_only=False), counted["gram"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    langs = sorted(set(lang))
    if not langs:
        return None
    order = (gram >> np.uint64(56)).astype(int) - 2
    grams: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(ORDER + 1):
        grams[k] = {}
        for x in langs:
            at = np.flatnonzero((order == k) & (lang == x))
            at = at[np.argsort(gram[at])]
            grams[k][x] = gram[at], n[at]
    return Trees(langs, grams)


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score, bits (code length in the predicted language) for every document."""
    spread = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        t = spread.value
        for batch in batches:
            for part in common.slices(batch, step=_BLOCK):
                data, offsets = common.buffers(part.column(1))
                lettered = np.array([any(c.isalpha() for c in x) for x in common.texts(part.column(1))], bool)
                n = part.num_rows
                pred, score, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if t is not None and n:
                    all_bits = t.lengths(common.lower(data), offsets)
                    best = all_bits.argmin(axis=1)
                    low = all_bits[np.arange(n), best]
                    post = 1 / np.exp2(np.maximum(-60, (low[:, None] - all_bits) / TEMPER)).sum(axis=1)
                    pred = np.where(lettered, np.array(t.langs, object)[best], "und")
                    score, bits = np.where(lettered, post, 0.0), np.where(lettered, low, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(list(pred), pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "doc_id long, lang_pred string, score double, bits double")


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learns from documents outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score, bits."""
    learn = docs.select("doc_id", "text", "lang").filter(common.bucket_of(F.col("doc_id"), 4) != 2)
    out = predict(docs, fit(learn, fit_rows))
    return out.select("doc_id", (common.bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits")
