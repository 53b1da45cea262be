"""Line dedup: sharded cuckoo filters over exact reference counts, kept reversible.

State of a `LineStore` is an exact table of references, a row (k1, k2, doc_id) for each document and distinct line key (the
128-bit hash of the key). Reference counts and first holders are aggregates of it, so a key that most documents hold is counted
map-side first. Keys held by two documents or more go into cuckoo filters, one per shard of keys; shards grow in number with the
keys. A scan asks the filters first and only lines that may be shared travel to the exact table, which decides. Filters are
broadcast only while their measured size is below FILTER_BYTES; beyond it every eligible line travels, with the same result.
Inserting documents appends their references, deleting them takes these away, and the filters of the shards that are touched take
and give back the keys that cross two holders.

Null and empty texts are one empty line. Keys under MIN_CHARS code points are never dropped. A key repeated within one document
only is kept. Extra columns of the input are ignored by the report and kept by `deduplicated`. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
#: Shared keys per filter shard, bits of a fingerprint, slots of a bucket, fill at most.
SHARD_KEYS, SLOTS, FILL = 1 << 17, 4, 0.8
#: Filters above this many bytes in all are not broadcast.
FILTER_BYTES = 48 << 20
_STRIP = " \t\n\v\f\r"
_FOLD = {c: c + 32 for c in range(65, 91)}


def key_of(line: str) -> str:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    line = line.strip(_STRIP)
    return line.lower() if line.isascii() else line.translate(_FOLD)


def hash_of(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key.encode())
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; works on arrays of 64-bit key halves.

    `fallback` holds the keys that found no slot, so an answer is never falsely negative.
    """

    def __init__(self, keys: int):
        self.mask = (1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS / FILL))))) - 1
        self.slots = np.zeros((self.mask + 1, SLOTS), np.uint16)
        self.fallback: set[int] = set()

    @staticmethod
    def _print(k2: np.ndarray) -> np.ndarray:
        f = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def _places(self, k1: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = k1.astype(np.uint64) & np.uint64(self.mask)
        return a.astype(np.int64), ((a ^ common.mix(f.astype(np.uint64))) & np.uint64(self.mask)).astype(np.int64)

    def may_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        f = self._print(k2)
        a, b = self._places(k1, f)
        hit = (self.slots[a] == f[:, None]).any(axis=1) | (self.slots[b] == f[:, None]).any(axis=1)
        if self.fallback:
            hit |= np.isin(k1, np.fromiter(self.fallback, np.int64))
        return hit

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        f = self._print(k2)
        rng = np.random.default_rng(1)
        for key, x, *ij in zip(k1.tolist(), f.tolist(), *(p.tolist() for p in self._places(k1, f)), strict=True):
            if not self._put(x, ij, rng):
                self.fallback.add(key)

    def _put(self, x: int, places: list[int], rng: np.random.Generator) -> bool:
        moved: list[tuple[int, int, int]] = []
        for _ in range(100):
            for i in places:
                free = np.flatnonzero(self.slots[i] == 0)
                if len(free):
                    self.slots[i, free[0]] = x
                    return True
            i, s = places[-1], int(rng.integers(SLOTS))
            moved.append((i, s, int(self.slots[i, s])))
            x, self.slots[i, s] = int(self.slots[i, s]), x  # the evicted print goes to its other bucket
            places = [(i ^ int(common.mix(np.array([x], np.uint64))[0])) & self.mask]
        for i, s, old in reversed(moved):  # no place: all goes back where it was
            self.slots[i, s] = old
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Gives back one fingerprint of each key; the keys must have been inserted."""
        f = self._print(k2)
        for key, x, *ij in zip(k1.tolist(), f.tolist(), *(p.tolist() for p in self._places(k1, f)), strict=True):
            if key in self.fallback:
                self.fallback.discard(key)
                continue
            for i in ij:
                hit = np.flatnonzero(self.slots[i] == x)
                if len(hit):
                    self.slots[i, hit[0]] = 0
                    break

    def packed(self) -> tuple[bytes, list[int]]:
        return self.slots.tobytes(), sorted(self.fallback)

    @classmethod
    def unpacked(cls, slots: bytes, fallback: list[int]) -> Cuckoo:
        out = cls(0)
        out.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        out.mask, out.fallback = len(out.slots) - 1, set(fallback)
        return out


def _hashes(text: str) -> list[tuple[int, int] | None]:
    """For each line the hash of its key, None for keys that are too short."""
    return [hash_of(k) if len(k) >= MIN_CHARS else None for k in map(key_of, text.split("\n"))]


def references(docs: DataFrame, filters: dict[int, tuple[bytes, list[int]]] | None = None) -> DataFrame:
    """(k1, k2, doc_id) for each document and distinct eligible key; with filters, only for keys that they may hold."""
    spread = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def run(batches):
        cuckoos = {k: Cuckoo.unpacked(*v) for k, v in spread.value.items()} if spread else None
        for batch in batches:
            for part in common.slices(batch):
                k1, k2, ids = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), common.texts(part.column(1)), strict=True):
                    keys = {h for h in _hashes(text) if h}
                    k1 += [a for a, _ in keys]
                    k2 += [b for _, b in keys]
                    ids += [doc] * len(keys)
                a, b = np.array(k1, np.int64), np.array(k2, np.int64)
                ids = pa.array(ids, pa.int64())
                if cuckoos is not None and len(a):
                    hit, shard = np.zeros(len(a), bool), a.astype(np.uint64) >> np.uint64(44)
                    shard = (shard % np.uint64(len(cuckoos))).astype(np.int64) if cuckoos else shard
                    for s in np.unique(shard) if cuckoos else ():
                        at = np.flatnonzero(shard == s)
                        hit[at] = cuckoos[int(s)].may_hold(a[at], b[at])
                    a, b, ids = a[hit], b[hit], ids.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), ids], names=["k1", "k2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "k1 long, k2 long, doc_id long").filter("doc_id is not null")


def counts(refs: DataFrame) -> DataFrame:
    """The exact table of shared keys: key, number of references, smallest holder; only keys of two documents or more."""
    return refs.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("refs")).filter("first_doc < last_doc")


FILTER = "shard long, slots binary, fallback array<long>"


def shard_of(n: int):
    return F.expr(f"cast(pmod(shiftrightunsigned(k1, 44), {n}) as long)")


def build_filters(shared: DataFrame, n_keys: int) -> DataFrame:
    """A packed cuckoo filter for each shard of the shared keys: shard, slots, fallback."""
    n = max(1, -(-n_keys // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
        c = Cuckoo(len(k1))
        c.insert(k1, k2)
        slots, fallback = c.packed()
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "slots": pa.array([slots], pa.binary()), "fallback": pa.array([fallback], pa.list_(pa.int64()))})

    return shared.select("k1", "k2", shard_of(n).alias("shard")).groupBy("shard").applyInArrow(build, FILTER)


def _spread(shared: DataFrame) -> dict[int, tuple[bytes, list[int]]] | None:
    """The filters on the driver, or None where they would be too large to broadcast."""
    n_keys = shared.count()
    if n_keys * 2 / FILL * 2 > FILTER_BYTES:  # the number of buckets is rounded up to a power of two
        return None
    n = max(1, -(-n_keys // SHARD_KEYS))
    got = {r.shard: (bytes(r.slots), list(r.fallback)) for r in build_filters(shared, n_keys).collect()}
    return {s: got.get(s) or Cuckoo(0).packed() for s in range(n)}


def drops(docs: DataFrame) -> DataFrame:
    """doc_id and the keys (k1s, k2s) whose lines it loses."""
    shared = common.written(counts(references(docs)))
    probable = references(docs, _spread(shared))
    hit = probable.join(shared, ["k1", "k2"]).filter("doc_id > first_doc")
    return hit.groupBy("doc_id").agg(F.collect_list("k1").alias("_k1s"), F.collect_list("k2").alias("_k2s"))


def _kept(text: str, k1s, k2s) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not k1s:
        return text, len(lines), 0
    lost = set(zip(k1s, k2s, strict=True))
    kept = [x for x, h in zip(lines, _hashes(text), strict=True) if h not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: lines before dropping, lines dropped, digest of the kept text."""
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            got = [_kept(t, a, b) for t, a, b in zip(common.texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([common.sha_hex(x[0].encode()) for x in got], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    d = docs.select("doc_id", "text")
    return d.join(drops(docs), "doc_id", "left").select("doc_id", "text", "_k1s", "_k2s").mapInArrow(common.task(run), schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines; all columns stay, in place."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        at = names.index("text")
        for batch in batches:
            cols = batch.columns[: len(names)]
            raw = batch.column(at).to_pylist()
            new = [None if t is None else _kept(t, a, b)[0] for t, a, b in zip(raw, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            cols[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = [common.free_name(names, x) for x in ("doc", "k1s", "k2s")]
    lost = drops(docs).toDF(*own)
    joined = docs.join(lost, docs["doc_id"] == lost[own[0]], "left").select(*(docs[c] for c in names), *own[1:])
    return joined.mapInArrow(common.task(run), schema)


class LineStore:
    """An incremental line index. Every change gives a new store; the old one stays as it was.

    refs: written parts of references and, between them, of deleted documents, in the order of the changes. filters: the cuckoo
    filters by shard. A change counts only the keys that it touches, before and after; keys that now have two holders, or no longer
    have, are inserted into or deleted from the filters of their shards, and no other filter is rewritten. Documents that are
    inserted again add nothing, unknown ones delete nothing. Where shared keys outgrow the shards, filters are built anew.
    """

    def __init__(self, refs: DataFrame, filters: DataFrame | None = None, shards: int = 1):
        self.refs, self.shards = refs, shards
        self._filters = filters

    @classmethod
    def build(cls, docs: DataFrame) -> LineStore:
        store = cls(common.written(references(docs).distinct()))
        store._build()
        return store

    def _build(self) -> None:
        shared = common.written(self.shared())
        n = shared.count()
        self.shards = max(1, -(-n // SHARD_KEYS))
        self._filters = common.written(build_filters(shared, n))

    def shared(self) -> DataFrame:
        return counts(self.refs)

    def filters(self) -> DataFrame:
        """shard, slots, fallback of shards that hold a key."""
        if self._filters is None:
            self._build()
        return self._filters.filter(F.expr("exists(sequence(1, length(slots)), i -> substring(slots, i, 1) <> x'00') or size(fallback) > 0"))

    def _changed(self, refs: DataFrame, keys: DataFrame) -> LineStore:
        """The store with other references, whose filters follow the keys (k1, k2) that were touched."""
        if self._filters is None:
            self._build()
        keys = common.written(keys.select("k1", "k2").distinct())
        had = counts(self.refs.join(keys, ["k1", "k2"], "left_semi")).select("k1", "k2", F.lit(-1).alias("by"))
        has = counts(refs.join(keys, ["k1", "k2"], "left_semi")).select("k1", "k2", F.lit(1).alias("by"))
        crossed = common.written(had.unionByName(has).groupBy("k1", "k2").agg(F.sum("by").alias("by")).filter("by <> 0").withColumn("shard", shard_of(self.shards)))
        old = self._filters

        def change(filters: pa.Table, keys: pa.Table) -> pa.Table:
            k1, k2, by = (keys[x].to_numpy() for x in ("k1", "k2", "by"))
            c = Cuckoo.unpacked(filters["slots"][0].as_py(), filters["fallback"][0].as_py()) if filters.num_rows else Cuckoo(max(1024, len(k1)))
            c.delete(k1[by < 0], k2[by < 0])
            c.insert(k1[by > 0], k2[by > 0])
            slots, fallback = c.packed()
            own = (filters if filters.num_rows else keys)["shard"][0].as_py()
            return pa.table({"shard": pa.array([own], pa.int64()), "slots": pa.array([slots], pa.binary()), "fallback": pa.array([fallback], pa.list_(pa.int64()))})

        touched = crossed.select("shard").distinct()
        changed = old.join(touched, "shard", "left_semi").groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, FILTER)
        filters = common.written(old.join(touched, "shard", "left_anti").select("shard", "slots", "fallback").unionByName(changed))
        out = LineStore(refs, filters, self.shards)
        full = filters.agg(F.max(F.size("fallback")).alias("x")).first().x
        if (full or 0) > SHARD_KEYS // 8:  # the shards are outgrown
            out._build()
        return out

    def insert(self, docs: DataFrame) -> LineStore:
        new = common.written(references(docs).distinct().join(self.refs, ["k1", "k2", "doc_id"], "left_anti"))
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        gone = common.written(doc_ids.select("doc_id").distinct())
        lost = self.refs.join(gone, "doc_id", "left_semi")
        return self._changed(self.refs.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), lost)

    def compacted(self) -> LineStore:
        """The same with its references in one written part, once many changes have gathered."""
        return LineStore(common.written(self.refs), self._filters, self.shards)

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc_id and the keys (k1s, k2s) that new documents (not yet in the store) lose: those that an earlier document holds.

        The filters of shared keys cannot speak for keys with one holder, so what is asked of the references is all keys of docs.
        """
        new = references(docs).distinct()
        held = self.refs.join(new.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").unionByName(new)
        first = held.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"))
        return new.join(first, ["k1", "k2"]).filter("doc_id > first_doc").groupBy("doc_id").agg(F.collect_list("k1").alias("k1s"), F.collect_list("k2").alias("k2s"))
