"""Vectors: blocked nearest neighbours, centroids, k-means splits, communities, complete linkage, batch packing.

All-pairs work runs in blocks of a matrix product inside tasks; each row goes to every block of its group, and only its best leave
one. Community search runs per user group, of which MAX_GROUP bounds one task: larger groups are first cut by k-means. Linkage takes
a user's active decisions in one task without a bound; it keeps pairs nearer than its limit only, or the matrix of those it cannot part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

NEIGHBOURS, BLOCK, MAX_GROUP = 15, 1024, 20_000


def matrix(column) -> np.ndarray:
    """Rows of length one; null and zero vectors become zero rows."""
    width = max((len(v) for v in column if v is not None), default=1)
    x = np.array([np.zeros(width) if v is None else v for v in column], np.float64).reshape(-1, width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def knn(vectors: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(key, other, sim, rank): exact cosine neighbours. by: only among rows of one value of that column."""
    own = F.lit(0) if by is None else F.col(by)
    n = vectors.count()
    c = max(1, -(-n // block))
    rows = vectors.select(own.alias("_by"), F.col(key).cast("bigint").alias("_id"), F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), F.lit(c)).cast("int").alias("_i"))
    cut = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(c - 1)))).select("_by", F.least("_i", "_j").alias("_p"), F.greatest("_i", "_j").alias("_q"), "_i", "_id", "_v")

    def best(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_id")
        p, q = g["_p"].iloc[0], g["_q"].iloc[0]
        x, ids, i = matrix(g["_v"]), g["_id"].to_numpy(), g["_i"].to_numpy()
        out = []
        for a, b in {(p, q), (q, p)}:
            left, right = np.flatnonzero(i == a), np.flatnonzero(i == b)
            if not len(left) or not len(right):
                continue
            s = np.round(x[left] @ x[right].T, 9)
            s[ids[left][:, None] == ids[right]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids[right], s.shape), -s), axis=1)[:, : k + 1]
            take = np.take_along_axis(s, order, axis=1)
            r = np.repeat(left, order.shape[1])
            keep = take.ravel() > -np.inf
            out.append(pd.DataFrame({"_by": g["_by"].iloc[0], "_id": ids[r][keep], "other": ids[right][order.ravel()][keep], "sim": take.ravel()[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"_by": [], "_id": [], "other": [], "sim": []})

    kind = vectors.schema[by].dataType.simpleString() if by else "int"
    near = cut.groupBy("_by", "_p", "_q").applyInPandas(best, f"_by {kind}, _id bigint, other bigint, sim double")
    w = Window.partitionBy("_id").orderBy(F.desc("sim"), "other")
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select(F.col("_id").alias(key), "other", "sim", "rank")


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, centroid): the mean of each group's vectors, at length one."""
    c = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = c.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("c"))
    return c.select(by, X.unit(F.col("c")).alias("centroid"))


def nearest(rows: DataFrame, targets: DataFrame, key: str, vector: str, target_key: str, target_vector: str) -> DataFrame:
    """(key, target_key, sim): the most similar target of each row. Targets are centroids or topics of one tree, so bounded."""
    s = rows.select(key, X.unit(F.col(vector)).alias("_a")).crossJoin(F.broadcast(targets.select(target_key, X.unit(F.col(target_vector)).alias("_b"))))
    s = s.withColumn("sim", F.round(X.dot(F.col("_a"), F.col("_b")), 9))
    w = Window.partitionBy(key).orderBy(F.desc("sim"), target_key)
    return s.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, target_key, "sim")


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of Lloyd's algorithm from a seeded spread start; numbered by first member."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[[rng.integers(len(x))]]
    while len(centre) < k:
        d = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
        centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        centre = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centre[j] for j in range(k)])
    order = list(dict.fromkeys(label.tolist()))
    number = {old: i for i, old in enumerate(order)}
    return np.array([number[j] for j in label]), centre[order]


def split_overloaded(memories: DataFrame, by: str = "topic", key: str = "vec_id", vector: str = "embedding", limit: int = 100, per: int = 30) -> DataFrame:
    """(by, key, cluster, representative): k-means of every leaf over `limit` memories; up to eight nearest stand for a cluster."""

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        if len(g) <= limit:
            return pd.DataFrame({by: [], key: [], "cluster": [], "representative": []})
        x = matrix(g[vector])
        label, centre = kmeans(x, int(np.clip(len(g) // per, 2, 5)))
        d = ((x - centre[label]) ** 2).sum(axis=1)
        place = pd.Series(d).groupby(label).rank(method="first")
        return pd.DataFrame({by: g[by].to_numpy(), key: g[key].to_numpy(), "cluster": label, "representative": place.to_numpy() <= 8})

    kind = memories.schema[by].dataType.simpleString()
    return memories.select(by, key, vector).groupBy(by).applyInPandas(split, f"`{by}` {kind}, `{key}` bigint, cluster int, representative boolean")


def local_moving(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, rounds: int = 20) -> np.ndarray:
    """Communities by greedy moves under the constant Potts model, deterministic; numbered by first member."""
    label, size = np.arange(n), np.ones(n)
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    cut = np.searchsorted(a, np.arange(n + 1))
    for _ in range(rounds):
        moved = False
        for i in range(n):
            near = label[b[cut[i] : cut[i + 1]]]
            if not len(near):
                continue
            own = label[i]
            u, inv = np.unique(near, return_inverse=True)
            gain = np.bincount(inv, w[cut[i] : cut[i + 1]]) - resolution * (size[u] - (u == own))
            j = int(gain.argmax())
            here = gain[u == own][0] if (u == own).any() else 0.0
            if gain[j] > here + 1e-12 and u[j] != own:
                size[own] -= 1
                size[u[j]] += 1
                label[i] = u[j]
                moved = True
        if not moved:
            break
    number = {old: i for i, old in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([number[x] for x in label])


def sized_communities(x: np.ndarray, k: int = NEIGHBOURS, target: int = 300, largest: int = 500) -> np.ndarray:
    """Communities of a k-NN graph whose resolution is bisected until the largest has about `target` members.

    Those over `largest` are cut by k-means, and their parts again, until none is (parts of equal vectors are halved).
    """
    n = len(x)
    if n <= 2:
        return np.zeros(n, int)
    k = min(k, n - 1)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    a, b = np.repeat(np.arange(n), k), near.ravel()
    w = np.maximum(0, s[a, b])
    a, b, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
    low, high, best = 1e-4, 1.0, None
    for _ in range(8):
        mid = (low * high) ** 0.5
        label = local_moving(n, a, b, w, mid)
        size = int(np.bincount(label).max())
        if best is None or abs(size - target) < abs(best[0] - target):
            best = (size, label)
        low, high = (mid, high) if size > target else (low, mid)
    label = best[1].copy()
    large = [own for c in range(int(label.max()) + 1) if len(own := np.flatnonzero(label == c)) > largest]
    while large:
        own = large.pop()
        part, _ = kmeans(x[own], -(-len(own) // largest) + 1)
        if not part.any():
            part = np.arange(len(own)) * 2 // len(own)
        for p in range(1, int(part.max()) + 1):
            label[own[part == p]] = label.max() + 1
        large += [own[part == p] for p in range(int(part.max()) + 1) if (part == p).sum() > largest]
    number = {old: i for i, old in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([number[v] for v in label])


def communities(vectors: DataFrame, by: str = "user_id", key: str = "vec_id", vector: str = "embedding", target: int = 300, largest: int = 500) -> DataFrame:
    """(by, key, community) within each user."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        x = matrix(g[vector])
        part = kmeans(x, -(-len(g) // MAX_GROUP))[0] if len(g) > MAX_GROUP else np.zeros(len(g), int)
        label, top = np.zeros(len(g), int), 0
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            label[own] = sized_communities(x[own], target=target, largest=largest) + top
            top = label.max() + 1
        return pd.DataFrame({by: g[by].to_numpy(), key: g[key].to_numpy(), "community": label})

    kind = vectors.schema[by].dataType.simpleString()
    return vectors.select(by, key, vector).groupBy(by).applyInPandas(run, f"`{by}` {kind}, `{key}` bigint, community int")


def complete_linkage(x: np.ndarray, limit: float) -> np.ndarray:
    """Clusters whose every pair is nearer than `limit` in cosine distance, merged nearest first, ties by first members.

    Pairs at the limit or beyond never merge, so only nearer ones are kept, each set that they connect is merged by itself, and copies
    of a vector are one from the start. A set whose pairs are few is merged by pairs, another by its matrix.
    """
    label = np.arange(len(x))
    if limit > 0 and len(x):
        _, first, inv = np.unique(x, axis=0, return_index=True, return_inverse=True)
        label = np.where(x.any(axis=1), first[inv.ravel()], label)  # zero vectors are as far from each other as from any
    rows = np.flatnonzero(label == np.arange(len(x)))
    y, found = x[rows], []
    for lo in range(0, len(y), BLOCK):
        d = 1 - y[lo : lo + BLOCK] @ y[lo:].T
        i, j = np.nonzero(np.triu(d < limit, 1))
        found.append((i + lo, j + lo, d[i, j]))
    a, b, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    part = np.arange(len(y))
    while len(a):  # sets that pairs connect, by their least member
        new = part.copy()
        least = np.minimum(part[a], part[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == part).all():
            break
        part = new
    order, of = np.argsort(part, kind="stable"), np.argsort(part[a], kind="stable")
    to = np.arange(len(y))
    for head in np.unique(part[a]).tolist():
        own = order[slice(*np.searchsorted(part, (head, head + 1), sorter=order))]
        e = of[slice(*np.searchsorted(part[a], (head, head + 1), sorter=of))]
        if len(e) * 40 < len(own) ** 2:
            merged = _merge_pairs(len(own), np.searchsorted(own, a[e]), np.searchsorted(own, b[e]), d[e])
        else:
            merged = _merge_matrix(1 - y[own] @ y[own].T, limit)
        to[own] = own[merged]
    kept = np.zeros(len(x), int)
    kept[rows] = rows[to]
    label = kept[label]
    number = {old: k for k, old in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([number[v] for v in label.tolist()], int)


def _heads(up: list[int]) -> np.ndarray:
    """Of items that merged into earlier ones, the last each went to."""
    for i, j in enumerate(up):
        up[i] = up[j]
    return np.array(up, int)


def _merge_pairs(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The first member of each item's cluster; pairs a < b that are not given never merge. Every pair goes once, so this is E log E."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    heap = list(zip(d.tolist(), a.tolist(), b.tolist(), strict=True))
    for v, i, j in heap:
        near[i][j] = near[j][i] = v
    heapq.heapify(heap)
    up = list(range(n))
    while heap:
        v, i, j = heapq.heappop(heap)
        if near[i].get(j) != v:
            continue  # merged, forbidden or further apart by now
        up[j] = i
        mine, other = near[i], near[j]
        del mine[j], other[i]
        near[j] = {}
        for k in [k for k in mine if k not in other]:
            del mine[k], near[k][i]
        for k, w in other.items():
            del near[k][j]
            if k in mine and w > mine[k]:
                mine[k] = near[k][i] = w
                heapq.heappush(heap, (w, min(i, k), max(i, k)))
    return _heads(up)


def _merge_matrix(d: np.ndarray, limit: float) -> np.ndarray:
    """The first member of each item's cluster by a symmetric matrix, which is overwritten. Each row keeps its nearest; few change at a merge."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    up = list(range(n))
    while True:
        i = int(best.argmin())
        if not best[i] < limit:
            break
        i, j = sorted((i, int(near[i])))
        up[j] = i
        np.maximum(d[i], d[j], out=d[i])
        d[i, i] = d[i, j] = np.inf
        d[:, i] = d[i]
        d[j] = d[:, j] = np.inf
        best[j] = np.inf
        stale = (best < np.inf) & ((near == j) | ((near == i) & (d[i] != best)))
        stale[i] = True
        for k in np.flatnonzero(stale).tolist():
            near[k] = d[k].argmin()
            best[k] = d[k, near[k]]
    return _heads(up)


def decision_clusters(decisions: DataFrame, by: str = "user_id", key: str = "id", vector: str = "embedding", similarity: float = 0.75) -> DataFrame:
    """(by, key, cluster) of active decisions of each user, by complete linkage."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        return pd.DataFrame({by: g[by].to_numpy(), key: g[key].to_numpy(), "cluster": complete_linkage(matrix(g[vector]), 1 - similarity)})

    kind = decisions.schema[by].dataType.simpleString()
    return decisions.select(by, key, vector).groupBy(by).applyInPandas(run, f"`{by}` {kind}, `{key}` bigint, cluster int")


def pack_batches(centre: np.ndarray, tokens: np.ndarray, budget: int) -> list[list[int]]:
    """Batches of clusters: the larger member of the closest pair starts one, the cluster of most average similarity joins while it fits."""
    left, out = set(range(len(centre))), []
    s = centre @ centre.T
    while left:
        ids = sorted(left)
        if len(ids) == 1:
            out.append(ids)
            break
        sub = s[np.ix_(ids, ids)].copy()
        np.fill_diagonal(sub, -np.inf)
        i, j = divmod(int(sub.argmax()), len(ids))
        seed = max(ids[i], ids[j], key=lambda c: (tokens[c], -c))
        batch, total = [seed], tokens[seed]
        left.discard(seed)
        while left:
            nxt = max(sorted(left), key=lambda c: s[c, batch].mean())
            if total + tokens[nxt] > budget:
                break
            batch.append(nxt)
            total += tokens[nxt]
            left.discard(nxt)
        out.append(batch)
    return out
