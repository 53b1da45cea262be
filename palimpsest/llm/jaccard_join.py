"""N-gram Jaccard join by count-vector R-trees.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets are one class from the start. Two
classes link when their sets have a Jaccard index of THRESHOLD or more. The forest of R-trees is sharded without loss: two sets
that link share a shingle among the first n - ceil(t n) + 1 of each in any one order of all shingles, so a shard is a shingle and
its members are the classes with it that far in front. The order puts shingles last that are frequent in a sample; it
decides how large shards get, never what links. In a shard the tokens of each set are hashed into GROUPS groups, their counts are
a point, and an R-tree over the points bounds the overlap of a query with a node by the sum of coordinate minima; pairs that
survive are bounded once more by the parities of the counts of far smaller groups, and what is left is verified on whole sets.

Large groups of near copies are contracted first: every class is verified against one anchor of one of its shards, linked classes
become components, and again with other anchors. After that only shards that still hold several components go to their trees,
which skip pairs within a component. So links that decide components are all found, and no group's pairs are all formed. Shards
over CHUNK members are cut into chunks that are searched pairwise.

Null, empty and blank texts have the empty set, link with nothing and are their own component. Texts of fewer words than a shingle
have one shingle. Repeated rows are members of one class. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import joined

WORDS, PERCENT = 5, 80
GROUPS, LEAF, CHUNK = 32, 16, 512
#: One in so many documents is sampled for the order of shingles; sample count from which a shingle is frequent.
ORDER_SHARE, FREQUENT = 8, 4
#: Frequent shingles listed at most, and ids broadcast at most; both bound a broadcast and neither changes a result.
ORDER_LIST, BROADCAST_IDS = 4_000_000, 2_000_000
#: Contraction ends when fewer than one in so many of the pairs that its bound left were links.
FEW = 10
#: Rows of shards with one least member that meet in one task; more are dealt by shard.
HOME_ROWS = 2_048
_MUL = np.random.default_rng(11).integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words the one of all its words."""
    w, at = common.word_hashes(data, offsets)
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += w[j : j + n] * _MUL[j]
    h = common.mix(h)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(common.mix((w[a:b] * _MUL[k : k + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(items: bytes) -> int:
    """The signed 64-bit hash of a set."""
    c = xxhash.xxh3_64_intdigest(items)
    return c - (c >> 63 << 64)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=GROUPS)


def fine_vector(s: np.ndarray) -> bytes:
    """The counts modulo two of many small groups, four to eight a hash: a bit a group, a power of two of them."""
    bits = max(8, int(len(s)).bit_length() + 2)
    c = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((c & 1).astype(bool)).tobytes()


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest intersection with which sets of n and m elements link: 100 x >= percent (n + m - x)."""
    return -(-percent * (n + m) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed bottom-up in the order of size and of the heaviest groups."""

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray):
        top = np.argsort(-vecs.var(axis=0), kind="stable")[:3] if len(vecs) > 1 else [0, 0, 0]
        self.order = np.lexsort((vecs[:, top[2]], vecs[:, top[1]], vecs[:, top[0]], (np.log2(sizes) * 4).astype(int)))
        self.vecs, self.sizes = vecs[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hi, lo_n, hi_n = self.vecs, self.sizes, self.sizes
        while len(hi) > 1 or not self.levels:
            cuts = np.arange(0, len(hi), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cuts), np.minimum.reduceat(lo_n, cuts), np.maximum.reduceat(hi_n, cuts)
            self.levels.append((hi, lo_n, hi_n))

    def search(self, vecs: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) that the bound cannot exclude."""
        q = np.arange(len(vecs))
        node = np.zeros(len(vecs), np.int64)
        for hi, lo_n, hi_n in reversed(self.levels):
            keep = self._may(vecs[q], sizes[q], hi, lo_n, hi_n, node, percent)
            q, node = q[keep], node[keep]
            width = len(self.vecs) if hi is self.levels[0][0] else len(self.levels[[x[0] is hi for x in self.levels].index(True) - 1][0])
            first = node * LEAF
            n = np.minimum(LEAF, width - first)
            q, node = np.repeat(q, n), common.ragged(first, n)
        keep = self._may(vecs[q], sizes[q], self.vecs, self.sizes, self.sizes, node, percent)
        return q[keep], self.order[node[keep]]

    @staticmethod
    def _may(v, n, hi, lo_n, hi_n, node, percent):
        fits = (100 * lo_n[node] * percent <= 10_000 * n) & (10_000 * hi_n[node] >= 100 * percent * n)
        out = np.zeros(len(node), bool)
        at = np.flatnonzero(fits)
        for i in range(0, len(at), 4096):
            x = at[i : i + 4096]
            bound = np.minimum(v[x], hi[node[x]]).sum(axis=1)
            out[x] = bound >= least_overlap(n[x], lo_n[node[x]], percent)
        return out


def _order(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles frequent in a sample; they come last in the order."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SHARE)) == 0)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                s = np.concatenate([np.zeros(0, np.uint64), *shingles(*common.buffers(part.column(1)), k)])
                u, c = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    counted = some.select("doc_id", "text").mapInArrow(common.task(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    counted = common.written(counted)
    few = counted.count() <= ORDER_LIST
    got = (counted if few else counted.orderBy(F.desc("c"), "h").limit(ORDER_LIST)).select("h").toArrow()["h"].to_numpy()
    return np.sort(got.view(np.uint64))


def signatures(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (size of the set), cls (hash of the set); at the first document of a class in each task keys (its shards), vec and fine."""
    last = docs.sparkSession.sparkContext.broadcast(_order(docs, k))

    def run(batches):
        frequent = last.value
        seen: set[int] = set()
        for batch in batches:
            for part in common.slices(batch):
                n, cls, keys, vecs, fine = [], [], [], [], []
                for s in shingles(*common.buffers(part.column(1)), k):
                    c = class_of(s.tobytes())
                    n.append(len(s))
                    cls.append(c)
                    if not len(s) or c in seen:
                        keys.append(None)
                        vecs.append(None)
                        fine.append(None)
                        continue
                    vecs.append(count_vector(s).astype(np.uint32).tobytes())
                    fine.append(fine_vector(s))
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    p = prefix_size(len(s), percent)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        common_ones = frequent[at] == s
                        keys.append(np.concatenate((s[~common_ones], s[common_ones]))[:p].view(np.int64))
                    else:
                        keys.append(s[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(vecs, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "cls", "keys", "vec", "fine"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "doc_id long, n long, cls long, keys array<long>, vec binary, fine binary")


def _sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """cls and items of the classes in reps (doc_id, cls), from the texts of those documents."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                rows = [s.tobytes() for s in shingles(*common.buffers(part.column(1)), k)]
                own = pa.array([class_of(s) == c for s, c in zip(rows, part.column(2).to_pylist(), strict=True)], pa.bool_())  # of one doc_id other texts too
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(rows, pa.binary())], names=["cls", "items"]).filter(own)

    few = reps.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(reps) if few else reps, "doc_id").select("doc_id", "text", "cls").mapInArrow(common.task(run), "cls long, items binary")


def _fine_bound(x, xo, n, y, yo, m, i, j, percent: int, step: int = 1 << 21) -> np.ndarray:
    """Whether the fine vectors i of (x, xo) and j of (y, yo) leave a pair possible; n, m are the sizes of the sets.

    Sets differ in at least as many elements as groups whose counts differ in parity. A finer vector folds into the other's
    groups, which are its own modulo their number.
    """
    g, h = np.diff(xo)[i], np.diff(yo)[j]
    n, m = n[i], m[j]
    most = n + m - 2 * least_overlap(n, m, percent)
    keep = np.zeros(len(i), bool)
    for code in np.unique(g << 32 | h):
        u, v = int(code) >> 32, int(code) & 0xFFFFFFFF
        all_at, k = np.flatnonzero((g == u) & (h == v)), min(u, v)
        rows = max(1, step // max(u, v))
        for lo in range(0, len(all_at), rows):
            at = all_at[lo : lo + rows]
            a = np.bitwise_xor.reduce(x[common.ragged(xo[i[at]], g[at])].reshape(len(at), -1, k), axis=1)
            b = np.bitwise_xor.reduce(y[common.ragged(yo[j[at]], h[at])].reshape(len(at), -1, k), axis=1)
            keep[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most[at]
    return keep


def _bounded(pairs: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the fine vectors do not exclude."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "x"):
                n, m = part.column(4).to_numpy(), part.column(5).to_numpy()
                (x, xo), (y, yo) = common.buffers(part.column(2)), common.buffers(part.column(3))
                own = np.arange(part.num_rows)
                yield part.select(["a", "b"]).filter(pa.array(_fine_bound(x, xo, n, y, yo, m, own, own, percent)))

    x = vecs.select(F.col("cls").alias("a"), F.col("fine").alias("x"), F.col("n"))
    y = vecs.select(F.col("cls").alias("b"), F.col("fine").alias("y"), F.col("n").alias("m"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(common.task(run), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. Sets are made anew from the texts of the pairs' classes alone."""
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = common.written(_sets(docs, common.written(reps.join(named, "cls").select("doc_id", "cls")), k))

    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            ok = []
            for s, t in zip(x, y, strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                if 100 * len(s) < percent * len(t):
                    ok.append(False)
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int(np.count_nonzero(t[at] == s))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    items = sets.select("cls", "items")
    x = items.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    y = items.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(common.task(run), "a long, b long")


def _pairs_within(size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each run of a few rows."""
    x = np.repeat(start, size) + common.ragged(np.zeros(len(size), np.int64), size)
    end = np.repeat(start + size, size)
    n = end - x - 1
    return np.repeat(x, n), common.ragged(x + 1, n)


def _search_shards(key, p, q, i, cls, comp, n, vecs, percent) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that the bound leaves, in shards whose rows stand together."""
    cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
    size = np.diff(np.append(cuts, len(key)))
    small = (size <= LEAF) & (p[cuts] == q[cuts])
    x, y = _pairs_within(size[small], cuts[small])  # a tree of one leaf
    keep = comp[x] != comp[y]
    x, y = x[keep], y[keep]
    keep = np.zeros(len(x), bool)
    for a in range(0, len(x), 8192):
        u, v = x[a : a + 8192], y[a : a + 8192]
        fits = 100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v])
        keep[a : a + 8192] = fits & (np.minimum(vecs[u], vecs[v]).sum(axis=1) >= least_overlap(n[u], n[v], percent))
    out = [(x[keep], y[keep])]
    for a, m in zip(cuts[~small].tolist(), size[~small].tolist(), strict=True):
        own = np.arange(a, a + m)
        same = p[a] == q[a]
        left, right = (own, own) if same else (own[i[own] == p[a]], own[i[own] == q[a]])
        if len(left) and len(right):
            u, v = CountTree(vecs[right], n[right]).search(vecs[left], n[left], percent)
            u, v = left[u], right[v]
            keep = (comp[u] != comp[v]) & ((u < v) | (not same))
            out.append((u[keep], v[keep]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components within a shard that neither the shard's tree nor the fine bound excludes.

    rows: key, cls, n, comp, vec, fine, c (chunks of the shard), home (by the least hash of its members, and of the shard where
    many shards have that least member).
    """
    cut = rows.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("c")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))))
    cut = cut.select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "cls", "comp", "n", "vec", "fine", "home")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # shards with one least member have most pairs in common, so they meet in one task, chunk by chunk
    cut = cut.repartition(parts, "home", "p", "q").sortWithinPartitions("home", "p", "q", "key")

    def run(batches):
        held: pa.Table | None = None  # the last shard of a batch may go on in the next
        told: set[tuple[int, int]] = set()  # pairs that have left this task; only spares repeats

        def found(t: pa.Table) -> pa.RecordBatch:
            c = [t[x].to_numpy() for x in ("key", "p", "q", "i", "cls", "comp", "n")]
            vecs = np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint32).reshape(-1, GROUPS).astype(np.int64)
            x, y = _search_shards(*c, vecs, percent)
            fine, at = common.buffers(t["fine"])
            keep = _fine_bound(fine, at, c[6], fine, at, c[6], x, y, percent)
            x, y = x[keep], y[keep]
            a, b = c[4][x], c[4][y]
            new = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - told
            if len(told) > 500_000:
                told.clear()
            told.update(new)
            ab = np.array(sorted(new), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            key, p, q = (t[x].to_numpy() for x in ("key", "p", "q"))
            end = int(np.flatnonzero((key != key[-1]) | (p != p[-1]) | (q != q[-1]))[-1]) + 1 if (key[0], p[0], q[0]) != (key[-1], p[-1], q[-1]) else 0
            if end:
                yield found(t.slice(0, end))
            held = t.slice(end)
        if held is not None and held.num_rows:
            yield found(held)

    return cut.mapInArrow(common.task(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, contractions: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document.

    Null and blank texts, an empty table: see the module. Of rows with one doc_id and different texts each row is placed by its own
    set, and a component's id is the smallest doc_id of its rows. Rows without doc_id join their equals; a class of such rows alone
    links with nothing else and its component_id is null.
    """
    spark = docs.sparkSession
    base = common.written(signatures(docs, k, percent))
    classes = base.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    reps = common.written(classes.select(F.col("rep").alias("doc_id"), "cls"))
    vecs = base.filter("fine is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("fine").alias("fine"))
    keys = base.filter("keys is not null").select(F.explode("keys").alias("key"), "cls", "n")
    dealt = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").dropDuplicates(["key", "cls"])
    # shards of several classes; of shards with the same members one is enough
    members = dealt.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.bit_xor(F.xxhash64("cls")).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("t"))
    several = members.filter("lo < hi").groupBy("s", "t", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    multi = common.written(dealt.join(several, "key"))
    comp, open_ = None, multi.withColumn("comp", F.col("cls")).withColumn("members", F.lit(0).cast("long"))
    for turn in range(contractions):
        # other anchors at each turn; a class asks for the three anchors that most of its shards have, of those it is not yet linked with
        best = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("s"), F.col("cls").alias("anchor"), F.col("n").alias("m"), F.col("comp").alias("other"))).alias("x")
        asked = open_.join(open_.groupBy("key").agg(best).select("key", "x.anchor", "x.m", "x.other"), "key")
        asked = asked.filter(f"comp <> other and 100 * least(n, m) >= {percent} * greatest(n, m)")
        often = asked.groupBy("cls", "anchor").agg(F.count("*").alias("c"))
        three = F.slice(F.sort_array(F.collect_list(F.struct("c", F.xxhash64("anchor", F.lit(turn)).alias("s"), "anchor")), asc=False), 1, 3)
        pairs = often.groupBy("cls").agg(three.alias("x")).select("cls", F.explode("x.anchor").alias("anchor")).select(F.least("cls", "anchor").alias("a"), F.greatest("cls", "anchor").alias("b")).distinct()
        bounded = common.written(_bounded(pairs, vecs, percent))
        asked_pairs = bounded.count()
        found = common.written(_verified(docs, bounded, reps, k, percent))
        comp = joined(comp, found)
        labelled = multi.join(comp, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("comp"))
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.min(F.xxhash64("cls")).alias("home")).filter("lo < hi").select("key", "members", "home")
        full = mixed.groupBy("home").agg(F.ceil(F.sum("members") / HOME_ROWS).alias("deals"))
        mixed = mixed.join(full, "home").withColumn("home", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("deals")))).drop("deals")
        open_ = common.written(labelled.join(mixed, "key"))
        if turn and found.count() * FEW < asked_pairs:  # further turns would link little
            break
    rows = open_.join(vecs.drop("n"), "cls").withColumn("c", F.ceil(F.col("members") / CHUNK).cast("long"))
    left = common.written(_searched(rows.select("key", "cls", "n", "comp", "vec", "fine", "c", "home"), percent))
    comp = joined(comp, _verified(docs, left, reps, k, percent))
    named = common.written(classes.join(comp, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    where = common.written(named.join(least, "root").select("cls", "component_id"))
    linked = base.select("doc_id", "n", "cls").join(where, "cls", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
