"""Suffix dedup by a run-length index: every byte covered by a repeated LENGTH-byte string is marked.

Sharding: the GRAM-byte string with the least hash among those in a LENGTH-byte window (leftmost of equals) is the window's
anchor. Equal windows have equal anchors at equal places, so comparing windows within an anchor's shard loses nothing. Runs of
windows with one anchor are segments, some 70 bytes apart; only their hashes and places are shuffled. Segments that are equal
whole need no text. Where an anchor has different segments, one copy of each goes to the shard's index.

Index: the suffix array of the shard's segments is made by prefix doubling, its Burrows-Wheeler transform is compressed to runs,
and suffix-array samples are kept at run ends only. A suffix's longest match with a neighbour is computed at those samples alone;
streaming through the text from left to right carries it on, a byte less at each step, to all other suffixes (a permuted LCP
value that is not at a run's end is that of the suffix before less one). Suffixes that match LENGTH bytes or more start repeated
windows. Anchors with over HOT different segments (a passage whose surroundings differ in very many documents) do not fit one
index; their windows are compared by hash, in shards by the anchor's offset within the window.

Null and empty texts have no bytes. Matches never cross documents; overlapping ones and those within one document count. Equal
strings are found by 64-bit hashes with the anchor's hash beside them. Extra columns are ignored; repeated rows match each other.
Rows need distinct doc_id; of rows with one doc_id each is cut by the spans found in all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 64
#: Bits of a position in a packed minimum; longer texts are taken in pieces.
_POS = 22
PIECE = (1 << _POS) - 4 * LENGTH
INDEX_BYTES, HOT = 1 << 17, 6_000
BROADCAST_IDS = 2_000_000


def anchors(data: np.ndarray, offsets: np.ndarray, c: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of all documents: document, first and last window, place and hash of the anchor.

    data is at most PIECE bytes; c are its prefix hashes.
    """
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    h = common.span_hash(c, at, at + gram)
    low = np.uint64((1 << _POS) - 1)
    packed = (h & ~low) | at.astype(np.uint64)
    rows = -(-len(packed) // w)
    grid = np.full(rows * w, ~np.uint64(0))
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    least = np.minimum(tail[p], head[p + w - 1])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[p]
    own = np.flatnonzero(p + length <= offsets[1:][doc])
    if not len(own):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = (least[own] & low).astype(np.int64)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (own[1:] != own[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return doc[own[first]], own[first], own[last], a[first], h[a[first]]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(document base, data, offsets, place of the first byte): the whole step, or pieces of one very long document."""
    if len(data) <= PIECE:
        yield 0, data, offsets, 0
        return
    for d in range(len(offsets) - 1):
        for a in range(int(offsets[d]), int(offsets[d + 1]), PIECE - LENGTH + 1):
            x = data[a : min(a + PIECE, int(offsets[d + 1]))]
            yield d, x, np.array([0, len(x)]), a - int(offsets[d])


def segments(docs: DataFrame) -> DataFrame:
    """fp, sh, doc_id, lo, n, o: anchor hash, hash of the segment's bytes, its first byte and length, the anchor's offset in it."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                ids = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                for base, data, offsets, start in _pieces(*common.buffers(part.column(1))):
                    c = common.prefix_hash(data)
                    doc, lo, hi, a, fp = anchors(data, offsets, c)
                    sh = common.span_hash(c, lo, hi + LENGTH)
                    cols = [fp.view(np.int64), sh.view(np.int64), ids[doc + base], (lo - offsets[doc] + start), hi - lo + LENGTH, a - lo]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["fp", "sh", "doc_id", "lo", "n", "o"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(common.task(run), "fp long, sh long, doc_id long, lo long, n long, o long")


class RunIndex:
    """Run-compressed index over pieces of text, told apart by `ends`; equal suffixes stand in the order of the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, need: int = LENGTH):
        self.n, self.need = len(data), need
        self.end = np.repeat(offsets[1:], np.diff(offsets))  # of each byte's piece
        self.first = np.zeros(self.n, bool)
        self.first[offsets[:-1]] = True
        self.c = common.prefix_hash(data)
        sa = self._suffixes(data)
        before = np.where(self.first[sa], 256 + np.arange(self.n), np.append(data, np.uint8(0))[sa - 1].astype(np.int64))
        cut = before[1:] != before[:-1]
        self.heads = np.flatnonzero(np.concatenate(([True], cut)))  # first rank of each run
        # samples at run ends: all that stays of the suffix array. A head's neighbour is the tail before it, a tail's the head after it
        self.at_heads, self.at_tails = sa[self.heads], sa[np.append(self.heads[1:], self.n) - 1]

    def _suffixes(self, data: np.ndarray) -> np.ndarray:
        n, k = self.n, 7
        pad = np.concatenate((data.astype(np.int64) + 1, np.zeros(k, np.int64)))
        at = np.arange(n)
        longest = int((self.end - at).max(initial=0))
        key = np.zeros(n, np.int64)
        for j in range(k):
            key = (key << 9) | np.where(at + j < self.end, pad[j : n + j], 0)
        order = np.argsort(key, kind="stable")
        while True:
            x = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], x[1:] != x[:-1])))
            if k >= longest or rank[order[-1]] == n - 1:
                return order
            after = np.where(at + k < self.end, np.append(rank, np.zeros(k, np.int64))[at + k] + 1, 0)
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            k *= 2

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes in common from x and y on, by bisection over hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.end[x] - x, self.end[y] - y)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = common.span_hash(self.c, x, x + mid) == common.span_hash(self.c, y, y + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def matching_statistics(self) -> np.ndarray:
        """For each byte the length (exact below `need`, else at least that) of its suffix's longest match that starts elsewhere."""
        out = np.zeros(self.n, np.int64)
        for x, y in ((self.at_heads[1:], self.at_tails[:-1]), (self.at_tails[:-1], self.at_heads[1:])):
            reach = np.zeros(self.n, np.int64)
            reach[x] = x + self._common(x, y)
            # a piece's first suffix is sampled unless it has no neighbour; it carries on nothing of the piece before
            reach = np.maximum.accumulate(np.maximum(reach, np.where(self.first, np.arange(self.n), 0)))
            out = np.maximum(out, reach - np.arange(self.n))
        return np.minimum(out, self.end - np.arange(self.n))


def _ranges(starts: np.ndarray, of: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows [start, start + length) that touch, by owner: owner, first byte, end. Sorted by owner and start."""
    if not len(starts):
        return of, starts, starts
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (starts[1:] > starts[:-1] + length)))
    first = np.flatnonzero(new)
    return of[first], starts[first], starts[np.append(first[1:], len(starts)) - 1] + length


COVER = "doc_id long, a long, b long"


def _covers(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "a", "b"])


def _indexed(pieces: DataFrame) -> DataFrame:
    """Covers of single segments by the index of their shard. pieces: fp, cnt, doc_id, lo, piece; an anchor's rows stand together."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "fp").sortWithinPartitions("fp")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def found(t: pa.Table) -> pa.RecordBatch:
            data, offsets = common.buffers(t["piece"])
            ms = RunIndex(data, offsets).matching_statistics()
            p = np.flatnonzero(ms >= LENGTH)
            row = np.searchsorted(offsets, p, side="right") - 1
            once = t["cnt"].to_numpy()[row] == 1
            p, row = p[once], row[once]
            own, a, b = _ranges(p - offsets[row], row)
            lo = t["lo"].to_numpy()[own]
            return _covers(t["doc_id"].to_numpy()[own], lo + a, lo + b)

        def cut(whole: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held)
            end = t.num_rows
            if not whole:  # the last anchor may go on
                fp = t["fp"].to_numpy()
                end = int(np.searchsorted(fp, fp[-1]))
            start = 0
            if end:
                fp = t["fp"].to_numpy()[:end]
                lens = np.cumsum(np.diff(common.buffers(t["piece"])[1])[:end])
                while start < end:
                    stop = int(np.searchsorted(lens, (lens[start - 1] if start else 0) + INDEX_BYTES, side="right"))
                    stop = int(np.searchsorted(fp, fp[min(max(stop, start), end - 1)], side="left")) if stop < end else end
                    if stop <= start:  # one anchor alone is larger
                        stop = int(np.searchsorted(fp, fp[start], side="right"))
                    yield found(t.slice(start, stop - start))
                    start = stop
            held = t.slice(end).to_batches()
            size = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size > 2 * INDEX_BYTES:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return dealt.mapInArrow(common.task(run), COVER)


def _hashed(pieces: DataFrame) -> DataFrame:
    """Covers of single segments of anchors with very many segments, by window hashes in shards of (anchor, half of offsets, part).

    Rows travel packed: one per anchor, shard and batch. A shard's parts are by hash, so that none grows with the anchor's copies.
    """
    kind = "fp long, half int, part int, wh array<long>, doc array<long>, p array<long>, single array<boolean>"

    def pack(batches):
        for batch in batches:
            for part in common.slices(batch, "piece", 1 << 19):
                fp, cnt, doc, lo, o = (part.column(part.schema.get_field_index(x)).to_numpy() for x in ("fp", "cnt", "doc_id", "lo", "o"))
                data, offsets = common.buffers(part.column(part.schema.get_field_index("piece")))
                c = common.prefix_hash(data)
                n = np.diff(offsets) - LENGTH + 1
                at = common.ragged(offsets[:-1], n)
                row = np.repeat(np.arange(len(n)), n)
                off = at - offsets[row]
                wh = common.span_hash(c, at, at + LENGTH)
                half = (o[row] - off > (LENGTH - GRAM) // 2).astype(np.int64)
                share = part.column(part.schema.get_field_index("parts")).to_numpy()[row]
                which = (wh % share.astype(np.uint64)).astype(np.int64)
                order = np.lexsort((which, half, fp[row]))
                g = np.stack([fp[row][order], half[order], which[order]])
                cuts = np.flatnonzero(np.concatenate(([True], (g[:, 1:] != g[:, :-1]).any(axis=0)))) if len(order) else np.zeros(0, np.int64)
                ends = np.append(cuts, len(order)).astype(np.int32)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(g[0][cuts]), pa.array(g[1][cuts].astype(np.int32)), pa.array(g[2][cuts].astype(np.int32)), lists(wh[order].view(np.int64), pa.int64()), lists(doc[row][order], pa.int64()), lists((lo[row] + off)[order], pa.int64()), lists((cnt[row] == 1)[order], pa.bool_())], names=["fp", "half", "part", "wh", "doc", "p", "single"])

    def compare(t: pa.Table) -> pa.Table:
        wh, doc, p, single = (t[x].combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("wh", "doc", "p", "single"))
        _, inv, c = np.unique(wh, return_inverse=True, return_counts=True)
        keep = np.flatnonzero((c[inv] > 1) & single)
        keep = keep[np.lexsort((p[keep], doc[keep]))]
        own, a, b = _ranges(p[keep], doc[keep])
        return pa.Table.from_batches([_covers(own, a, b)])

    return pieces.mapInArrow(common.task(pack), kind).groupBy("fp", "half", "part").applyInArrow(compare, COVER)


def covers(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): byte ranges that repeated windows cover, possibly overlapping."""
    seg = common.written(segments(docs))
    # counts are combined before a shuffle, and joins deal a hot anchor's segments to several tasks
    several = F.min("sh") < F.max("sh")
    fps = common.written(seg.groupBy("fp").agg(F.count("*").alias("n"), several.alias("several")).filter("n > 1"))
    seen = common.written(common.spread_join(seg, fps.drop("n"), ["fp"], fps, ["doc_id", "lo"]))
    alike = seen.filter("not several")  # all segments of the anchor are equal
    mixed = seen.filter("several")
    kinds = common.written(mixed.groupBy("fp", "sh").agg(F.count("*").alias("cnt"), *(F.first(c).alias(c) for c in ("doc_id", "lo", "n", "o"))))
    again = common.spread_join(mixed, kinds.filter("cnt > 1").select("fp", "sh"), ["fp", "sh"], kinds.select("fp", "sh", F.col("cnt").alias("n")), ["doc_id", "lo"])
    whole = alike.unionByName(again).select("doc_id", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    number = common.written(kinds.groupBy("fp").agg(F.count("*").alias("kinds")))
    wanted = common.spread_join(kinds, number, ["fp"], number.select("fp", F.col("kinds").alias("n")), ["sh"]).withColumn("hot", F.col("kinds") > HOT).withColumn("parts", F.ceil(F.col("kinds") * 70 / 1_000_000).cast("long"))
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "cnt", "lo", "n", "o", "hot", "parts")).alias("w"))

    def clip(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, w = (batch.column(1)[i].as_py() or "").encode(), batch.column(2)[i].as_py()
                k = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in w], t) for c, t in (("fp", pa.int64()), ("cnt", pa.int64()))] + [pa.array([batch.column(0)[i].as_py()] * k, pa.int64()), pa.array([x["lo"] for x in w], pa.int64()), pa.array([x["o"] for x in w], pa.int64()), pa.array([x["hot"] for x in w]), pa.array([x["parts"] for x in w], pa.int64()), pa.array([raw[x["lo"] : x["lo"] + x["n"]] for x in w], pa.binary())], names=["fp", "cnt", "doc_id", "lo", "o", "hot", "parts", "piece"])

    pieces = _with_text(docs, asked).mapInArrow(common.task(clip), "fp long, cnt long, doc_id long, lo long, o long, hot boolean, parts long, piece binary")
    pieces = common.written(pieces)
    return whole.unionByName(_indexed(pieces.filter("not hot"))).unionByName(_hashed(pieces.filter("hot")))


def _with_text(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """doc_id, text and the third column of per_doc for its documents; few documents are found without shuffling all texts."""
    own = docs.select("doc_id", "text")
    ids = per_doc.select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(ids), "doc_id", "left_semi")
    return own.join(per_doc, "doc_id").select("doc_id", "text", per_doc.columns[1])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = common.written(covers(docs).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(common.texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                cut = merged([(x["a"], x["b"]) for x in spans or ()])
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), pa.int64()) for c in cols[:3]), pa.array(list(cols[3]), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select("doc_id", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if found.count() <= BROADCAST_IDS:
        ids = F.broadcast(found.select("doc_id"))
        hit = own.join(ids, "doc_id", "left_semi").join(found, "doc_id", "left")
        free = own.join(ids, "doc_id", "left_anti").withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
        return hit.select("doc_id", "text", "spans").mapInArrow(common.task(run), schema).unionByName(free.select("doc_id", "text", "spans").mapInArrow(common.task(run), schema))
    return own.join(found, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(common.task(run), schema)
