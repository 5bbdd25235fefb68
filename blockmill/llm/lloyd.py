"""Centroid clustering in exact integers: Lloyd's rounds by two trees, one over vectors and one over centroids.

Vectors become integers, floor(SCALE * x) of each component, and are cut into blocks of BLOCK. Each block gets a cover tree once: a node
covers its points within a radius, its children's centres are points of it that lie further apart than the next scale and cover the others
within that. Children of less than LEAF points share one leaf, so points that keep apart from all others are compared at once, not one by
one. Blocks are written to the shared folder with their trees.

In each round a task descends its blocks' trees against a cover tree over the centroids. A pair of nodes is pruned when another
centroid node is nearer for certain: the distance of the two centres, less both radii, exceeds the least upper bound of any. A node that one
centroid alone may own gives it its whole count and sum without looking at its points; leaves compare their points with what centroids
are left exactly, in 64-bit integers. Bounds are floating-point and widened by SLACK, and pairs that they cannot part go on, so ties and
roundings are settled by the exact comparison. Of a block a round gives one row for each centroid that owns something; Spark adds those, and
only the centroids, K rows, come to the driver.

Means are exact: floor(sum / count) of 64-bit sums by whole-number division.

Defined cases: vectors that are null, have another number of components than DIMS or hold null or non-finite ones are left out; repeated
rows are vectors of their own; null ids are clustered, but become first centroids only after all others; with fewer vectors than K there are as many
centroids; of equal distances the centroid of the smaller number wins; a centroid that owns nothing stays; an empty table gives no
rows. Integers of 2 ** 27 or more fail the query, since squared distances of 64 components may then exceed a long. Columns other than
the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import batches_of, release, staged, table

SCALE = 1024
DIMS = 64
K = 8
ROUNDS = 10
SEED = 3
BLOCK = 2048
LEAF = 16
SLACK = 1e-9  # relative, of squared lengths in double precision
LIMIT = 1 << 27


@dataclass
class Tree:
    """Nodes in preorder over points in the order of the tree: node k covers points first[k] to last[k] - 1, and its subtree ends before node after[k]."""

    points: np.ndarray  # n x d, int64
    order: np.ndarray  # places of the points in the order they were given
    centre: np.ndarray  # of each node its centre's place in points
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    after: np.ndarray

    @classmethod
    def build(cls, given: np.ndarray, leaf: int = LEAF) -> Tree:
        real = given.astype(np.float64)
        order: list[np.ndarray] = []
        centre, radius, first, last, after = [], [], [], [], []
        done = 0
        # (number of a node that is to be closed, or -1, places, centre, whether it is a leaf in any case)
        work: list[tuple[int, np.ndarray, int, bool]] = [(-1, np.arange(len(given)), 0, False)] if len(given) else []
        while work:
            closes, places, c, ends = work.pop()
            if closes >= 0:
                last[closes], after[closes] = done, len(centre)
                continue
            node = len(centre)
            d = np.sqrt(((real[places] - real[c]) ** 2).sum(axis=1))
            r = float(d.max())
            centre.append(c)
            radius.append(r)
            first.append(done)
            last.append(0)
            after.append(0)
            work.append((node, places, c, True))
            if ends or r == 0 or len(places) <= leaf:
                order.append(places)
                done += len(places)
                continue
            # the next scale below the radius; a child's centre is further than that from the centres of its siblings
            scale = 2.0 ** (np.ceil(np.log2(r)) - 1)
            scale = scale if scale < r else scale / 2
            sub = real[places]
            norm = (sub * sub).sum(axis=1)
            open_, near, few, at = np.ones(len(places), bool), d * d, [], c
            while True:
                own = open_ & (near <= scale * scale)
                n_own = int(own.sum())
                if n_own < leaf:
                    few.append(places[own])
                else:
                    work.append((-1, places[own], at, False))
                open_ &= ~own
                k = int(open_.argmax())
                if not open_[k]:
                    break
                at, near = int(places[k]), norm + norm[k] - 2 * (sub @ sub[k])
                near[k] = 0
            if few:
                work.append((-1, np.concatenate(few), c, True))
        found = np.concatenate(order) if order else np.empty(0, np.int64)
        back = np.empty(len(found), np.int64)
        back[found] = np.arange(len(found))
        return cls(given[found], found, back[np.array(centre, np.int64)] if centre else found, np.array(radius), np.array(first, np.int64), np.array(last, np.int64), np.array(after, np.int64))

    def children(self, node: int) -> list[int]:
        out, k = [], node + 1
        while k < self.after[node]:
            out.append(k)
            k = int(self.after[k])
        return out


def nearest(points: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of each point the nearest of the centroids `among` (ascending), the smaller number of equal ones; exact."""
    best = np.zeros(len(points), np.int64)
    least = None
    for k, c in enumerate(among):
        d = ((points - centroids[c]) ** 2).sum(axis=1)
        if least is None:
            least = d
        else:
            nearer = d < least
            best[nearer] = k
            least = np.where(nearer, d, least)
    return among[best]


def assign(tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    """Whole nodes and their centroids, the centroid of every point (in the tree's order, -1 below such a node), and how many points were compared."""
    whole: list[tuple[int, int]] = []
    of = np.full(len(tree.points), -1, np.int64)
    if not len(tree.points):
        return whole, of, 0
    real, heart = tree.points[tree.centre].astype(np.float64), over.points[over.centre].astype(np.float64)
    inner = over.after - np.arange(len(over.after)) > 1
    child = [np.array(over.children(k), np.int64) for k in range(len(over.after))]
    compared = 0
    work: list[tuple[int, np.ndarray]] = [(0, np.zeros(1, np.int64))]
    while work:
        node, left = work.pop()
        reach = tree.radius[node]
        while True:
            d = np.sqrt(((heart[left] - real[node]) ** 2).sum(axis=1))
            margin = SLACK * (d + reach + over.radius[left])
            upper, lower = (d + reach + over.radius[left] + margin).min(), d - reach - over.radius[left] - margin
            left = left[lower <= upper]
            open_ = inner[left]
            if not open_.any():
                break
            left = np.concatenate([left[~open_], *(child[k] for k in left[open_])])
        first, last = tree.first[node], tree.last[node]
        # a leaf of the centroids' tree may hold several equal ones
        among = np.sort(np.concatenate([over.order[over.first[k] : over.last[k]] for k in left]))
        if len(among) == 1 or len(left) == 1 and over.radius[left[0]] == 0:
            whole.append((node, int(among[0])))
        elif tree.radius[node] == 0:
            compared += 1
            whole.append((node, int(nearest(tree.points[first : first + 1], centroids, among)[0])))
        elif tree.after[node] == node + 1:
            compared += last - first
            of[first:last] = nearest(tree.points[first:last], centroids, among)
        else:
            work += [(k, left) for k in tree.children(node)]
    return whole, of, compared


def totals(tree: Tree, sums: np.ndarray, whole: list[tuple[int, int]], of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of each of k centroids, given the sums of the tree's nodes."""
    n, total = np.zeros(k, np.int64), np.zeros((k, tree.points.shape[1]), np.int64)
    for node, c in whole:
        n[c] += tree.last[node] - tree.first[node]
        total[c] += sums[node]
    for c in np.unique(of[of >= 0]):
        own = of == c
        n[c] += own.sum()
        total[c] += tree.points[own].sum(axis=0)
    return n, total


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """id_col long and v array<long>, of the vectors that count."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    small = F.forall("v", lambda v: F.abs(v) < LIMIT)
    made = vectors.where((F.size(vector_col) == dims) & finite).select(F.col(id_col).cast("long").alias(id_col), F.transform(x, lambda v: F.floor(v * SCALE)).alias("v"))
    return made.select(id_col, F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component's integer is {LIMIT} or more"))).alias("v"))


BLOCKS = "ids binary, nulls binary, points binary, place binary, centre binary, radius binary, first binary, last binary, after binary"


def _rows(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    flat = batch[column].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, dims)


def _blocked(integers_: DataFrame, dims: int, size: int) -> DataFrame:
    id_col = integers_.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                tree = Tree.build(_rows(part, "v", dims))
                ids = part[id_col].fill_null(0).to_numpy()[tree.order]
                nulls = part[id_col].is_null().to_numpy(zero_copy_only=False)[tree.order]
                row = [ids.astype("<i8"), nulls.astype("u1"), tree.points.astype("<i4"), tree.order.astype("<i4"), tree.centre.astype("<i4"), tree.radius.astype("<f8"), *(x.astype("<i4") for x in (tree.first, tree.last, tree.after))]
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in row], names=["ids", "nulls", "points", "place", "centre", "radius", "first", "last", "after"])

    with batches_of(integers_.sparkSession, size):
        return staged(integers_.mapInArrow(run, BLOCKS), "lloyd-blocks", size)


def _tree(row: dict, dims: int) -> Tree:
    ints = lambda c: np.frombuffer(row[c], "<i4").astype(np.int64)
    return Tree(ints("points").reshape(-1, dims), ints("place"), ints("centre"), np.frombuffer(row["radius"], "<f8"), ints("first"), ints("last"), ints("after"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def first_centroids(integers_: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:id`."""
    id_col = integers_.columns[0]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = integers_.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def _round(blocks: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """cluster, n, sums of all blocks, a row a cluster."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.build(centroids, 1)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for row in _each(batches):
            tree = _tree(row, dims)
            running = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(tree.points, axis=0)])
            whole, of, _ = assign(tree, centroids, over)
            n, add = totals(tree, running[tree.last] - running[tree.first], whole, of, k)
            count += n
            total += add
        own = np.flatnonzero(count)
        yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    part = blocks.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    floor = lambda s: F.expr(f"({s} - pmod({s}, n)) div n")
    summed = part.groupBy("cluster").agg(F.sum("n").alias("n"), *total)
    return summed.select("cluster", "n", F.array(*(floor(f"s{i}") for i in range(dims))).alias("mean"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """id_col, cluster int and distance long (squared, to its centroid) of every vector that counts, and the centroids."""
    spark = vectors.sparkSession
    whole = staged(integers(vectors, id_col, vector_col, dims), "lloyd-integers")
    centroids = first_centroids(whole, k, seed)
    blocks = _blocked(whole, dims, block)
    release(whole)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long"), centroids
    for _ in range(rounds):
        after = centroids.copy()
        for r in _round(blocks, centroids, dims).collect():  # k rows
            after[r["cluster"]] = r["mean"]
        if (after == centroids).all():
            break  # no later round would change it
        centroids = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.build(centroids, 1)
        for row in _each(batches):
            tree = _tree(row, dims)
            owned, of, _ = assign(tree, centroids, over)
            for node, c in owned:
                of[tree.first[node] : tree.last[node]] = c
            d = ((tree.points - centroids[of]) ** 2).sum(axis=1)
            ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], "u1").astype(bool))
            yield pa.record_batch([ids, pa.array(of.astype(np.int32)), pa.array(d)], names=[id_col, "cluster", "distance"])

    out = staged(blocks.mapInArrow(last, f"`{id_col}` long, cluster int, distance long"), "lloyd-assigned")
    release(blocks)
    return out, centroids


def _sha256(numbers: np.ndarray) -> Column:
    return F.sha2(F.lit(",".join(map(str, numbers.tolist()))), 256)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = own.agg(F.sum("cluster_inertia")).first()[0]
    digest = F.element_at(F.array(*map(_sha256, centroids)), F.col("cluster") + 1) if len(centroids) else F.lit(None).cast("string")
    # a row for each of at most K clusters
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
