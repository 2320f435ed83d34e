"""Clustering around centroids: each vector's nearest centroid by best-first search of a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: Components are floor(SCALE * x) and at most LIMIT either way, so that squared distances and a task's sums fit 64 bits.
SCALE, LIMIT = 256, 1 << 27
#: Centroids of a leaf at most, and vectors that a task searches at once.
LEAF, ROWS = 4, 4096


class Node(NamedTuple):
    """members: numbers of the centroids compared here, a vantage point or a leaf's; below: (node, nearest, farthest
    distance from the vantage point) of each child."""

    members: np.ndarray
    below: list[tuple[int, float, float]]


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers from one row."""
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def vantage_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """The root first. Of a node's centroids the lowest number is the vantage point; the rest is halved by distance from it."""
    nodes: list[Node] = []

    def grow(own: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(own, []))
        if len(own) > leaf:
            rest, far = own[1:], squares(centroids[own[1:]], centroids[own[0]])
            order = np.argsort(far, kind="stable")
            nodes[at] = Node(own[:1], [])
            for half in np.array_split(order, 2):
                nodes[at].below.append((grow(rest[half]), float(np.sqrt(far[half[0]])), float(np.sqrt(far[half[-1]]))))
        return at

    if len(centroids):
        grow(np.arange(len(centroids)))
    return nodes


def nearest(nodes: list[Node], centroids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the number of the nearest centroid (ties: the smaller number) and its squared distance.

    Each vector opens the node of its own lowest bound next, until no bound is within its best distance. That radius is
    inclusive, and bounds are lowered by more than their rounding, so a tie in another branch is still seen; distances
    at nodes are exact integers. Vectors that open the same node are compared together."""
    n = len(points)
    best, label = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int32)
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    left = np.arange(n)
    while left.size:
        node = bound[left].argmin(1)
        low = bound[left, node]
        going = (low <= np.sqrt(best[left])) & (low < np.inf)
        left, node, low = left[going], node[going], low[going]
        for k in np.unique(node):
            own = np.flatnonzero(node == k)
            rows = left[own]
            bound[rows, k] = np.inf
            for member in nodes[k].members:
                far = squares(points[rows], centroids[member])
                better = (far < best[rows]) | ((far == best[rows]) & (member < label[rows]))
                best[rows[better]], label[rows[better]] = far[better], member
            if nodes[k].below:
                away = np.sqrt(far)  # a node with children has its vantage point alone
                for child, first, last in nodes[k].below:
                    gap = np.maximum(away - last, first - away) - 1e-9 * (1 + away + last)
                    bound[rows, child] = np.maximum(gap, low[own])
    return label, best


def integer_vectors(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_id, embedding, ...) -> (vec_id, v array of longs): vectors of exactly `dims` components, none null or not
    finite, as floor(SCALE * x); components beyond LIMIT count as LIMIT."""
    x = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("x")).filter(F.size("x") == dims)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.greatest(F.least(F.floor(SCALE * c.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT))
    # the bounds are put to x before floor, so that the largest doubles don't overflow a long
    bounded = F.transform("x", lambda c: F.greatest(F.least(c, F.lit(float(LIMIT))), F.lit(float(-LIMIT))))
    return x.filter(finite).select("vec_id", F.transform(bounded, whole).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """A task's vectors by cluster: how many, and the sum of each component. One row a cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, count, total = vantage_tree(centroids), np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                points = _matrix(b.column(0).slice(k, ROWS), centroids.shape[1])
                label, _ = nearest(nodes, centroids, points)
                order = np.argsort(label, kind="stable")
                own, first = np.unique(label[order], return_index=True)
                total[own] += np.add.reduceat(points[order], first, axis=0)
                count += np.bincount(label, minlength=len(count))
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = vantage_tree(centroids)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                label, far = nearest(nodes, centroids, _matrix(part.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of the mean of its vectors; those without vectors stay. Tasks combine their
    own vectors first, so a cluster with a third of all vectors is one row a task; clusters times components reach the driver."""
    parts = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    out = centroids.copy()
    for row in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[row["cluster"], row["at"]] = int(row["x"]) // row["n"]
    return out


def cluster(vectors: DataFrame, seeds: DataFrame, rounds: int, dims: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v) and the starting rows (v) in order -> (vec_id, cluster, distance) of each vector and the centroids.

    Each round's tree is rebuilt in every task from the centroids in its closure: `seeds` times `dims` integers, however
    many vectors there are. `vectors` is read once a round, so it should be a written table. Repeated vectors are so many
    vectors; without any, there are no centroids and no rows."""
    centroids = np.array([row["v"] for row in seeds.collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return vectors.select("vec_id", "v").mapInArrow(_labels(centroids), "vec_id long, cluster int, distance long"), centroids


def op12(spark, sf_dir: str, k: int = 40, rounds: int = 5) -> DataFrame:
    """Clusters of `embeddings`. Vectors with a null id are kept, and start after ids as if theirs were empty; of ids that
    repeat, all rows are vectors of their own, the componentwise lowest first; fewer than `k` vectors are so many
    centroids; an empty table gives no rows; other columns are not read. An inertia past 64 bits is null."""
    vectors = stage(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found, centroids = cluster(vectors, vectors.orderBy(key, "v").select("v").limit(k), rounds)
    found = stage(found, "clusters")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = stage(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")), "inertia")
    # a row for each centroid: at most k
    about = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(inertia, "cluster")
    whole = F.lit(inertia.agg(F.sum("own").alias("whole")).first()["whole"]).cast("decimal(38,0)")
    out = found.join(F.broadcast(about), "cluster")
    return out.select("vec_id", "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"), whole.try_cast("long").alias("inertia"), "centroid_sha256")


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    near = "SELECT n, vec_id, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT n, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {cents}) GROUP BY n, vec_id, v"
    parts = [
        f"""WITH raw AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64),
kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(x, lambda c: greatest(least(floor({SCALE} * greatest(least(c, {LIMIT}.0::DOUBLE), -{LIMIT}.0::DOUBLE)), {LIMIT}), -{LIMIT})::BIGINT) AS v FROM raw WHERE len(list_filter(x, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM kept QUALIFY c < {k})"""
    ]
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(cents=f'c{r}')})")
        parts.append(f"e{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM n{r}, range(1, 65) AS r(i) GROUP BY c, i)")
        parts.append(f"g{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM e{r} GROUP BY c)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(g{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN g{r} USING (c))")
    parts.append(f"z AS MATERIALIZED ({near.format(cents=f'c{rounds}')})")
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (c)"""
    )


OP12_SQL = _op12_sql()
