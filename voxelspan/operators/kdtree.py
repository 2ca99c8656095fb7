"""Lloyd's iterations over stored k-d trees: whole boxes of points go to a centroid at once (the filtering algorithm of
Kanungo et al., IEEE PAMI 2002).

Each part of a cloud becomes a tree of its own: halves by the median of the longest side, and for every node the box,
the count, the sums and the spread of its points. Trees are rows of a table in the shared folder. A pass goes down each
tree with the centroids that can be nearest to some point of a node; where one is left, the node's sums are that
centroid's. Spark adds the sums of all trees, so a pass moves k rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.sources.storage import stored

Centroids = list[tuple[float, float, float]]
#: Points of a tree, and of a leaf.
BLOCK, LEAF = 1 << 16, 64
NODE = np.dtype([("low", "f8", 3), ("high", "f8", 3), ("sums", "f8", 3), ("spread", "f8"), ("start", "i8"), ("stop", "i8"), ("left", "i8"), ("right", "i8")])


def grow(p: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, order): node i holds p[order[start:stop]]; a leaf has no children (-1). The root is node 0."""
    order, nodes = np.arange(len(p)), []
    waiting = [(0, len(p), -1, "left")]
    while waiting:
        start, stop, above, side = waiting.pop()
        own = p[order[start:stop]]
        low, high, mean = own.min(0), own.max(0), own.mean(0)
        if above >= 0:
            nodes[above][side] = len(nodes)
        nodes.append({"low": low, "high": high, "sums": own.sum(0), "spread": float(((own - mean) ** 2).sum()), "start": start, "stop": stop, "left": -1, "right": -1})
        if stop - start > leaf and (high > low).any():
            half = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(own[:, int((high - low).argmax())], half)]
            here = len(nodes) - 1
            waiting += [(start + half, stop, here, "right"), (start, start + half, here, "left")]
    out = np.zeros(len(nodes), NODE)
    for name in NODE.names:
        out[name] = [n[name] for n in nodes]
    return out, order


def trees(points: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A table of trees over points in the order they are read; n, nodes, points. Cut best where neighbours lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made(p: np.ndarray) -> pa.RecordBatch:
            nodes, order = grow(p, leaf)
            return pa.RecordBatch.from_pydict({"n": [len(p)], "nodes": [nodes.tobytes()], "points": [p[order].tobytes()]})

        for batch in batches:
            held.append(np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"], 1))
            n += batch.num_rows
            if n >= block:
                p = np.concatenate(held)
                for a in range(0, len(p) - block + 1, block):
                    yield made(p[a : a + block])
                held, n = [p[len(p) // block * block :]], len(p) % block
        if n:
            yield made(np.concatenate(held))

    return stored(points.select("x", "y", "z").where("x is not null and y is not null and z is not null").mapInArrow(run, "n bigint, nodes binary, points binary"))


def assign(nodes: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each centroid the count, sums and squared distances of the points nearest to it; distances computed to points.

    Of equally near centroids the first is taken.
    """
    count, sums, sse, computed = np.zeros(len(c), np.int64), np.zeros((len(c), 3)), np.zeros(len(c)), 0
    at, able = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(at):
        box = nodes[at]
        middle = (box["low"] + box["high"]) / 2
        d = ((middle[:, None] - c[None]) ** 2).sum(2)
        d[~able] = np.inf
        best = d.argmin(1)
        # a centroid is left where even the corner that lies farthest towards it is nearer to the best one
        toward = np.where(c[None] > c[best][:, None], box["high"][:, None], box["low"][:, None])
        own, mine = ((toward - c[None]) ** 2).sum(2), ((toward - c[best][:, None]) ** 2).sum(2)
        able &= own <= mine * (1 + 1e-9) + 1e-300
        able[np.arange(len(at)), best] = True
        single = able.sum(1) == 1
        done = box[single]
        if len(done):
            n = done["stop"] - done["start"]
            near = best[single]
            away = ((done["sums"] / n[:, None] - c[near]) ** 2).sum(1)
            np.add.at(count, near, n)
            np.add.at(sums, near, done["sums"])
            np.add.at(sse, near, done["spread"] + n * away)
        leaf = ~single & (box["left"] < 0)
        for i in np.flatnonzero(leaf).tolist():
            some, which = p[box["start"][i] : box["stop"][i]], np.flatnonzero(able[i])
            w = some[:, None] - c[which][None]
            d2 = w[:, :, 0] * w[:, :, 0] + w[:, :, 1] * w[:, :, 1] + w[:, :, 2] * w[:, :, 2]
            computed += d2.size
            label = d2.argmin(1)
            count += np.bincount(which[label], minlength=len(c))
            for a in range(3):
                sums[:, a] += np.bincount(which[label], some[:, a], len(c))
            sse += np.bincount(which[label], d2[np.arange(len(some)), label], len(c))
        inner = ~single & ~leaf
        at, able = np.concatenate([box["left"][inner], box["right"][inner]]), np.concatenate([able[inner], able[inner]])
    return count, sums, sse, computed


def labels(nodes: np.ndarray, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of c, the first of equals, for each point of a tree: depth-first, with the candidates that are left.

    A node looks at what its parent left, so with many centroids the work is near to points times log of centroids.
    """
    out = np.zeros(len(p), np.int64)
    waiting = [(0, np.arange(len(c)))] if len(p) else []
    while waiting:
        i, able = waiting.pop()
        node, some = nodes[i], c[able]
        near = some[((some - (node["low"] + node["high"]) / 2) ** 2).sum(1).argmin()]
        toward = np.where(some > near, node["high"], node["low"])
        able = able[((toward - some) ** 2).sum(1) <= ((toward - near) ** 2).sum(1) * (1 + 1e-9) + 1e-300]
        if len(able) == 1:
            out[node["start"] : node["stop"]] = able[0]
        elif node["left"] >= 0:
            waiting += [(node["left"], able), (node["right"], able)]
        else:
            w = p[node["start"] : node["stop"], None] - c[able][None]
            out[node["start"] : node["stop"]] = able[(w[:, :, 0] * w[:, :, 0] + w[:, :, 1] * w[:, :, 1] + w[:, :, 2] * w[:, :, 2]).argmin(1)]
    return out


def totals(forest: DataFrame, centroids: Centroids) -> DataFrame:
    """cluster_id, n_points, x, y, z (means), sse and computed (distances to points) of each centroid that has points."""
    c = np.array(centroids, float).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, p in zip(batch.column("nodes").to_pylist(), batch.column("points").to_pylist()):
                count, sums, sse, computed = assign(np.frombuffer(nodes, NODE), np.frombuffer(p, np.float64).reshape(-1, 3), c)
                own = np.flatnonzero(count)
                share = np.zeros(len(own), np.int64)
                share[0] = computed
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), *[pa.array(sums[own, a]) for a in range(3)], pa.array(sse[own]), pa.array(share)], ["cluster_id", "n", "sx", "sy", "sz", "e", "computed"])

    each = forest.select("nodes", "points").mapInArrow(run, "cluster_id int, n bigint, sx double, sy double, sz double, e double, computed bigint")
    n = F.sum("n")
    return each.groupBy("cluster_id").agg(n.alias("n_points"), *[(F.sum(f"s{a}") / n).alias(a) for a in "xyz"], F.sum("e").alias("sse"), F.sum("computed").alias("computed"))


def lloyd(forest: DataFrame, start: Centroids, iterations: int = 10) -> Centroids:
    """cluster.lloyd() over trees(): the same centroids, but for the order of additions; the driver holds k rows."""
    centroids = list(start)
    for _ in range(iterations):
        moved = list(centroids)
        for r in totals(forest, centroids).collect():
            moved[r["cluster_id"]] = (r["x"], r["y"], r["z"])
        if moved == centroids:
            break
        centroids = moved
    return centroids
