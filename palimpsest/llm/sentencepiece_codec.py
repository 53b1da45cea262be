"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs ordered by the score of the piece they would form, leftmost first
among equals; the best pair merges, its new neighbours join the agenda, until no pair forms a piece. Symbols without a piece
fall back to bytes. No piece holds a character after which a word mark follows, so a text falls into units at word marks and
at characters that no longer piece holds; each distinct unit is merged once per worker and kept in a bounded cache.

Each Arrow batch is checked against the sentencepiece library's own encode: every distinct unit that the batch adds, in one call,
and its first text as a whole. A unit that differed would get the library's ids and be counted in `n_fixed`; were the whole text to
differ, the library would encode all texts of the step. Decoding is the library's decode(ids). Null counts as empty; the empty text has no ids. Rows do not
depend on each other: one scan, no shuffle. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Units and ids kept by a worker; when full, the cache starts anew.
CACHE_UNITS, CACHE_IDS = 500_000, 4_000_000
#: Units up to so many symbols are merged many at a time; longer ones by a heap each.
SHORT = 32
_NONE = 1 << 30
SEP = "\n"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder of one merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {names[i]: (-sp.get_score(i), i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        joined = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        alone = "".join(c for c in "\n\t|,.!?:;0123456789" if c not in joined)
        if SEP not in alone or any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces of this model reach over line ends or from one word into the next")
        self.alone = np.zeros(256, bool)  # by byte
        self.alone[list(alone.encode())] = True
        self.forget()

    def merged(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda."""
        pieces = self.pieces
        whole = pieces.get(unit)
        sym: list[str | None] = list(unit)
        n = len(sym)
        if n == 1:
            return [whole[1]] if whole else self.fallback(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if p := pieces.get(sym[i] + sym[i + 1]):
                agenda.append((p[0], i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, made = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or len(sym[i]) + len(sym[j]) != len(made):
                continue  # one side has merged elsewhere since
            sym[i], sym[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pieces.get(made + sym[k]):
                    heapq.heappush(agenda, (p[0], i, k, made + sym[k]))
            if (k := before[i]) >= 0 and (p := pieces.get(sym[k] + made)):
                heapq.heappush(agenda, (p[0], k, i, sym[k] + made))
        out: list[int] = []
        i = 0
        while i < n:
            p = pieces.get(sym[i])
            if p:
                out.append(p[1])
            else:
                out += self.fallback(sym[i])
            i = after[i]
        return out

    def fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unk]

    def _pairs(self) -> None:
        """Numbers for symbols, and a table from pairs of symbols to the piece they form and its place in the order of scores."""
        from .language_id import Table

        chars = {c for x in self.pieces for c in x}
        self.symbols = sorted({*self.pieces, *chars})
        number = {x: i for i, x in enumerate(self.symbols)}
        self.pad = len(self.symbols)  # also for characters of no piece
        ranks = {c: i for i, c in enumerate(sorted({p[0] for p in self.pieces.values()}))}
        left, right, made, rank = [], [], [], []
        for x, (cost, _) in self.pieces.items():
            for k in range(1, len(x)):
                if x[:k] in number and x[k:] in number:
                    left.append(number[x[:k]])
                    right.append(number[x[k:]])
                    made.append(number[x])
                    rank.append(ranks[cost])
        self.table = Table(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64))
        self.made, self.rank = np.array([*made, -1], np.int32), np.array([*rank, _NONE], np.int32)
        self.of_point = np.full(0x110000, self.pad, np.int32)  # by code point
        self.of_point[[ord(c) for c in chars]] = [number[c] for c in chars]
        self.ids = [[self.pieces[x][1]] if x in self.pieces else self.fallback(x) for x in self.symbols]
        self.id_count = np.array([len(x) for x in self.ids], np.int64)
        self.id_start = np.cumsum(self.id_count) - self.id_count
        self.id_flat = np.array(list(itertools.chain.from_iterable(self.ids)), np.int32)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def _merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of many short units after merging, padded; how many; and units with a character that no piece has.

        One agenda a row, all rows take their best pair in the same step.
        """
        if not hasattr(self, "table"):
            self._pairs()
        long = np.array([len(u) for u in units])
        width = int(long.max())
        codes = self.of_point[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        sym = np.full((len(units), width + 1), self.pad, np.int32)
        sym[np.arange(width + 1) < long[:, None]] = codes
        start = np.full((len(units), width), -1, np.int32)
        inner = np.arange(width) < long[:, None] - 1
        start[inner] = self._find(sym[:, :-1][inner], sym[:, 1:][inner])
        pair, out, rows = start, sym, np.arange(len(units))
        while True:  # every live row has merged as often as the others, so all have one width
            agenda = np.take(self.rank, pair)
            best = agenda.argmin(axis=1)
            going = np.take_along_axis(agenda, best[:, None], axis=1)[:, 0] < _NONE
            if not going.all():
                out[rows[~going], : sym.shape[1]] = sym[~going]
                out[rows[~going], sym.shape[1] :] = self.pad
                rows, sym, pair, best = rows[going], sym[going], pair[going], best[going]
            if not len(rows):
                break
            r = np.arange(len(rows))
            new = self.made[pair[r, best]]
            stay = np.ones(sym.shape, bool)
            stay[r, best + 1] = False  # a pair's right side; the last symbol is padding, so a pair stands there too
            sym, pair = sym[stay].reshape(len(rows), -1), pair[stay[:, :-1]].reshape(len(rows), -1)
            sym[r, best] = new
            pair[r, best] = self._find(new, sym[r, best + 1])
            back = np.flatnonzero(best > 0)
            pair[back, best[back] - 1] = self._find(sym[back, best[back] - 1], new[back])
        odd = np.bincount(np.repeat(np.arange(len(units)), long), codes == self.pad, len(units)) > 0
        return out, (out != self.pad).sum(axis=1), odd

    def merged_many(self, units: list[str]) -> list[list[int]]:
        """Ids of many units, each as a list."""
        flat, count = self.merged_flat(units)
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if units else []

    def merged_flat(self, units: list[str], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units end to end, and how many each has."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(n, kind="stable")
        short = order[: int(np.searchsorted(n[order], SHORT, side="right"))]
        count = np.zeros(len(units), np.int64)
        parts: list[np.ndarray] = []
        left: list[int] = []
        for lo in range(0, len(short), step):
            own = short[lo : lo + step]
            out, k, odd = self._merge([units[i] for i in own])
            sym = out[(np.arange(out.shape[1]) < k[:, None]) & ~odd[:, None]]
            each = np.repeat(np.arange(len(own)), np.where(odd, 0, k))
            parts.append(self.id_flat[common.ragged(self.id_start[sym], self.id_count[sym])])
            count[own] = np.bincount(each, self.id_count[sym], len(own)).astype(np.int64)
            left += own[odd].tolist()
        starts = np.cumsum(count[short]) - count[short]
        where = np.zeros(len(units), np.int64)
        where[short] = starts
        at = int(count[short].sum())
        for i in (*left, *order[len(short) :].tolist()):  # long units and unknown characters, by a heap each
            ids = np.array(self.merged(units[i]), np.int32)
            parts.append(ids)
            where[i], count[i] = at, len(ids)
            at += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return flat[common.ragged(where, count)], count

    def checked(self, units: list[str], flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers as the library has them, and which units differed: it encodes all units of a step at once, held
        apart by a symbol that never merges."""
        wrong = np.zeros(len(units), bool)
        if not units:
            return flat, count, wrong
        sep = np.array(self.merged(SEP), np.int32)
        at = np.cumsum(count + len(sep)) - count  # of each unit's ids behind its separator
        want = np.empty(int(at[-1] + count[-1]), np.int32)
        want[common.ragged(at, count)] = flat
        for k, x in enumerate(sep):
            want[at - len(sep) + k] = x
        theirs = np.array(self.lib.encode("".join([SEP + u for u in units]), num_threads=1), np.int32)
        if np.array_equal(theirs, np.concatenate((np.array(self.merged(MARK), np.int32), want))):
            return flat, count, wrong
        parts = np.split(flat, np.cumsum(count)[:-1])
        for i, u in enumerate(units):
            own = np.array(self.lib.encode(SEP + u)[len(sep) + 1 :], np.int32)
            if not np.array_equal(own, parts[i]):
                parts[i], count[i], wrong[i] = own, len(own), True
        return np.concatenate(parts), count, wrong

    def encode_step(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a column of whole texts end to end, the n + 1 offsets of texts into them, and for each text its units set right.

        Units are told apart by 64-bit hashes; only those new to the worker are merged and checked.
        """
        col = pc.replace_substring(pc.fill_null(col, ""), MARK, " ")  # both are the word mark
        data, offsets = common.buffers(pc.if_else(pc.equal(col, ""), col, pc.binary_join_element_wise(" ", col, "")))
        mark, alone = data == 32, self.alone[data]
        start = alone | mark
        start[1:] &= alone[1:] | ~mark[:-1]
        start[1:] |= alone[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        a = np.flatnonzero(start)
        b = np.append(a[1:], len(data))
        u, first, inv = np.unique(common.span_hash(common.prefix_hash(data), a, b), return_index=True, return_inverse=True)
        if len(self.known) >= CACHE_UNITS or len(self.flat) >= CACHE_IDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != u) if len(self.known) else np.arange(len(u))
        raw = data.tobytes()
        units = [raw[i:j].decode().replace(" ", MARK) for i, j in zip(a[first[new]].tolist(), b[first[new]].tolist(), strict=True)]
        flat, count, wrong = self.checked(units, *self.merged_flat(units))
        self.learn(u[new], flat, count, wrong)
        at = np.searchsorted(self.known, u)[inv]
        n = self.count[at]
        units_at = np.searchsorted(a, offsets)
        ids = self.flat[common.ragged(self.start[at], n)]
        ids_at = np.concatenate(([0], np.cumsum(n)))[units_at]
        fixed = np.concatenate(([0], np.cumsum(self.wrong[at])))[units_at]
        return ids, ids_at, np.diff(fixed)

    def forget(self) -> None:
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.wrong = np.zeros(0, np.int32), np.zeros(0, bool)

    def learn(self, h: np.ndarray, flat: np.ndarray, count: np.ndarray, wrong: np.ndarray) -> None:
        """Adds units to the cache: arrays sorted by hash, some 30 bytes a unit."""
        start = np.cumsum(count) - count + len(self.flat)
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start, self.count, self.wrong = (np.concatenate(x)[order] for x in ((self.start, start), (self.count, count), (self.wrong, wrong)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each whole text its ids, and the same as decimal numbers joined by commas."""
        ids, at, _ = self.encode_step(pa.array(texts, pa.string()))
        parts = [ids[i:j].tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [(x, ",".join(map(str, x))) for x in parts]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """doc_id, number of ids, digests of ids and of the decoded text, units set right by the library's check.

    keep_ids: also return the ids themselves (`ids`); keep_decoded: and with them the decoded text (`decoded`).
    """
    path = path or model_path()
    keep_decoded = keep_ids and keep_decoded
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_fixed long" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in common.slices(batch):
                ids, at, fixed = c.encode_step(part.column(1))
                text = part.column(1)[0].as_py() or ""
                if ids[: at[1]].tolist() != (whole := c.lib.encode(text)):  # the first text as a whole; where it differs, all as the library has them
                    whole = [whole, *(c.lib.encode(x.as_py() or "") for x in part.column(1)[1:])]
                    own = [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]
                    fixed = np.array([max(int(f), int(x != y)) for f, x, y in zip(fixed, own, whole, strict=True)])
                    at = np.cumsum([0, *map(len, whole)])
                    ids = np.fromiter(itertools.chain.from_iterable(whole), np.int32, int(at[-1]))
                ids_sha, out_sha, decoded = [], [], []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[i:j].tolist()
                    back = c.lib.decode(own)
                    ids_sha.append(hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep_decoded:
                        decoded.append(back)
                cols = [part.column(0).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha), pa.array(out_sha), pa.array(fixed, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                if keep_decoded:
                    cols.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that the library decodes from `ids`; null ids count as none."""
    path = path or model_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            out = [c.lib.decode(x or []) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
