"""Lloyd's centroid clustering over two trees, exact in integers.

Vectors lie in blocks; each block has a cover tree, built once: a node's vectors lie within its radius of its centre
vector, children's centres lie within the parent's reach and at least half a radius from each other, and a node's first
child has its own centre. Each round builds a tree of the same kind over the centroids, which are few and travel with the
tasks, and walks pairs of nodes, all pairs of a level in one step: a pair is pruned if even its nearest vectors and
centroids lie farther apart than the farthest vector from the centroid nearest to the node's centre. A node with one
centroid left is settled as a whole; leaves compare their vectors with what is left exactly, ties to the smaller number.
What reaches the driver in a round is one sum and one count for each centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import cut

#: Production parameters: components, centroids, rounds, seed of the first centroids, and what a component is scaled by.
DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, "3", 1024
#: Vectors of a block, and of a leaf of its tree.
BLOCK, LEAF = 2048, 8
#: Integer components up to this keep squared distances of 64 components within 63 bits.
LARGEST = 1 << 27
#: Bounds are widened by this share, so that rounding of square roots prunes nothing that could tie.
SLACK = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of two integer matrices."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= 1 << 22:  # then products fit the 53 bits of a double
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * x @ y.T
    return np.stack([np.square(b - row).sum(1) for row in a]) if len(a) else np.zeros((0, len(b)), np.int64)


@dataclass
class Tree:
    """Nodes by number, the root first: place of the centre vector, radius, first and one past the last place of the
    vectors, first child and number of children. `order` has the vectors' indices by place."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def cover_tree(x: np.ndarray, leaf: int) -> Tree:
    apart = squares(x, x)
    order = np.arange(len(x))
    rows: list[list] = [[0, 0.0, 0, len(x), 0, 0]]
    k = 0
    while k < len(rows):
        centre, _, first, end, *_ = rows[k]
        own = order[first:end]  # its first is the centre
        near = apart[own[0], own]
        rows[k][0], rows[k][1] = first, float(np.sqrt(near.max()))
        if len(own) > leaf and near.max() > 0:
            reach, groups = near.max() / 4, []  # squared: half the radius
            while len(own):
                inside = near <= reach
                groups.append(own[inside])
                own = own[~inside]
                if len(own):
                    far = int(near[~inside].argmax())
                    own = np.r_[own[far], np.delete(own, far)]
                    near = apart[own[0], own]
            order[first:end] = np.concatenate(groups)
            rows[k][4], rows[k][5] = len(rows), len(groups)
            for g in groups:
                rows.append([0, 0.0, first, first + len(g), 0, 0])
                first += len(g)
        k += 1
    columns = [np.array(c) for c in zip(*rows)]
    return Tree(order, *columns)


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), then the same from first[1], and so on."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - first, many)


def nearest(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """For each vector (x in the tree's order) the number of its nearest centroid, and how many distances between vectors
    and centroids that took at the leaves."""
    different, number = np.unique(centroids, axis=0, return_index=True)  # of equal centroids, the smaller number
    other = cover_tree(different, 1)
    c, number = different[other.order], number[other.order]
    out, compared = np.full(len(x), -1), 0
    node, far = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, ordered by node
    while len(node):
        d = np.sqrt(np.square(x[tree.centre[node]] - c[other.centre[far]]).sum(1).astype(np.float64))
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.cumsum(np.r_[0, node[1:] != node[:-1]])
        most = np.minimum.reduceat(d, begins)[group] + tree.radius[node]
        keep = (d - tree.radius[node] - other.radius[far]) * (1 - SLACK) <= most * (1 + SLACK)
        node, far = node[keep], far[keep]
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        many = np.diff(np.r_[begins, len(node)])
        inner, leaf = other.children[far] > 0, tree.children[node] == 0
        wide = inner & (leaf | (other.radius[far] >= tree.radius[node]))
        waits = np.repeat(np.logical_or.reduceat(wide, begins), many)  # nodes whose centroids are split first
        alone = np.repeat(many == 1, many) & ~inner
        for n, m in zip(node[alone].tolist(), number[other.first[far[alone]]].tolist()):
            out[tree.first[n] : tree.end[n]] = m
        last = leaf & ~waits & ~alone
        if last.any():
            n, f = node[last], far[last]
            size = tree.end[n] - tree.first[n]
            at, m = spread(tree.first[n], size), np.repeat(other.first[f], size)
            exact = np.square(x[at] - c[m]).sum(1)
            compared += len(at)
            by = np.lexsort((number[m], exact, at))
            best = by[np.r_[True, at[by][1:] != at[by][:-1]]]
            out[at[best]] = number[m[best]]
        splits, deeper = waits & wide, ~waits & ~alone & ~leaf
        kept, n = waits & ~wide, other.children[far[splits]]
        new = [(node[kept], far[kept]), (np.repeat(node[splits], n), spread(other.child[far[splits]], n))]
        n = tree.children[node[deeper]]
        new.append((spread(tree.child[node[deeper]], n), np.repeat(far[deeper], n)))
        node, far = (np.concatenate(part) for part in zip(*new))
        by = np.argsort(node, kind="stable")
        node, far = node[by], far[by]
    return out, compared


NODES = ("centre", "radius", "first", "end", "child", "children")


def kept_vectors(table: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """vec_id and v (double) of the vectors that take part."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE <= LARGEST))
    return table.select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("v")).where((F.size(v) == dimensions) & whole)


def grow(vectors: DataFrame, dimensions: int, block: int, leaf: int) -> DataFrame:
    """A row for each block: ids and integer vectors in their tree's order, and the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                x = np.floor(SCALE * part["v"].flatten().to_numpy().reshape(len(part), dimensions)).astype(np.int64)
                tree = cover_tree(x, leaf)
                ids = part["vec_id"].take(pa.array(tree.order))
                arrays = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x[tree.order].astype("<i4").tobytes()])]
                arrays += [pa.array([getattr(tree, n).astype("<f8" if n == "radius" else "<i4").tobytes()]) for n in NODES]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "x", *NODES])

    return cut(vectors.mapInArrow(run, "ids array<long>, x binary, " + ", ".join(f"{n} binary" for n in NODES)))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = {n: batch[n][k] for n in ("ids", "x", *NODES)}
            x = np.frombuffer(one["x"].as_py(), "<i4").astype(np.int64).reshape(-1, dimensions)
            tree = Tree(np.arange(len(x)), *(np.frombuffer(one[n].as_py(), "<f8" if n == "radius" else "<i4") for n in NODES))
            yield one["ids"].values, x, tree


def _sums(centroids: np.ndarray):
    """Over blocks: for each centroid of the task, how many vectors are its own, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, x, tree in _blocks(batches, centroids.shape[1]):
            own, _ = nearest(tree, x, centroids)
            by = np.argsort(own, kind="stable")
            begins = np.flatnonzero(np.r_[True, own[by][1:] != own[by][:-1]])
            total[own[by][begins]] += np.add.reduceat(x[by], begins)
            n += np.bincount(own, minlength=len(n))
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _blocks(batches, centroids.shape[1]):
            own, _ = nearest(tree, x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(np.square(x - centroids[own]).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def clusters(table: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each vector that takes part.

    Vectors that are null, have another number of components, null or non-finite ones, or ones whose integer lies beyond
    LARGEST (squared distances would not fit a long) take no part. Ids may be null or repeat: each row is a vector of its
    own; of rows with one hash, the smaller vector comes first among the first centroids, null ids last. Fewer vectors than
    centroids give fewer centroids. Other columns, whatever their names, are ignored; an empty table gives an empty
    result. Inertia beyond a long is null.
    """
    spark = table.sparkSession
    vectors = kept_vectors(table, vector, dimensions)
    first = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.floor(SCALE * np.array([r.v for r in first])).astype(np.int64)
    blocks = grow(vectors, dimensions, block, leaf)
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
        found = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(exact(F.col("total")[i]) for i in range(dimensions))).alias("total")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [int(t) // r.n for t in r.total]
    rows = cut(blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(exact(F.col("distance")).alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    named = [(i, fits(n), fits(sum(inertia.values())), sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in inertia.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(*(part.split()[0] for part in schema.split(", ")))
