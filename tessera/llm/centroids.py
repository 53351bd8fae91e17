"""Exact centroid clustering by filtering over kd-trees.

Each task cuts its rows into blocks and builds a balanced kd-tree over each: a node holds the box
around its points, their number (from its place in the tree) and their sum. The trees are written
once and read in every round. A round goes down each tree with the set of centroids that can still
be nearest: of a node's candidates, one that is strictly farther than another from every point of
the box goes; a node with one candidate left is taken whole, by its count and sum; leaves with
several compare their points with those left. A centroid that ties anywhere in the box stays, so
ties are settled by number among all that could win.

Only sums leave a task: one number for each centroid and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import Tables, pick
from .integers import LIMIT, decimals, exact, finite, floor_mean, floors, gathered, in_range, nearest_row, slots, sums_of, vector_column

#: Points of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 32


class Tree:
    """A balanced kd-tree; node i has the children 2i+1 and 2i+2, its points are a run of ``points``."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.low, self.high, self.sums = points, low, high, sums
        self.bounds = self.runs(len(points))

    @staticmethod
    def runs(n: int) -> np.ndarray:
        """First and end row of every node: halves of halves, down to leaves."""
        levels = [np.array([[0, n]])]
        while (levels[-1][:, 1] - levels[-1][:, 0]).max(initial=0) > LEAF_ROWS:
            a, b = levels[-1].T
            mid = (a + b) // 2
            levels.append(np.stack([np.stack([a, mid], axis=1), np.stack([mid, b], axis=1)], axis=1).reshape(-1, 2))
        return np.concatenate(levels)

    @classmethod
    def grow(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree over rows ``x``, and their order in it."""
        bounds, order = cls.runs(len(x)), np.arange(len(x))
        low, high, sums = (np.zeros((len(bounds), x.shape[1]), np.int64) for _ in range(3))
        for i, (a, b) in enumerate(bounds.tolist()):
            some = x[order[a:b]]
            low[i], high[i], sums[i] = some.min(axis=0), some.max(axis=0), some.sum(axis=0)
            if 2 * i + 1 < len(bounds):
                order[a:b] = order[a:b][np.argpartition(some[:, (high[i] - low[i]).argmax()], (b - a) // 2)]
        return cls(x[order], low, high, sums), order

    def filtered(self, cents: np.ndarray):
        """Yields (node, candidates): nodes that have one candidate left, and leaves that have several."""
        kind = exact(self.low, self.high, cents)
        c, low, high = cents.astype(kind), self.low.astype(kind), self.high.astype(kind)
        square, nodes, left = (c * c).sum(axis=1), np.zeros(1, np.int64), np.ones((1, len(cents)), bool)
        while len(nodes):
            twice = low[nodes] + high[nodes]
            far = np.where(left, (square[None] - twice @ c.T).astype(np.float64), np.inf)
            near = far.argmin(axis=1)  # any candidate may be the one to compare with
            for z in np.unique(near).tolist():
                some = np.flatnonzero(near == z)
                d = c - c[z]
                # the box's point that is best for each centroid against z
                best = high[nodes[some]] @ np.maximum(d, 0).T + low[nodes[some]] @ np.minimum(d, 0).T
                left[some] &= ~(square[None] - square[z] - 2 * best > 0)
            one, inner = left.sum(axis=1) == 1, 2 * nodes + 1 < len(self.bounds)
            for i in np.flatnonzero(one | ~inner).tolist():
                yield int(nodes[i]), np.flatnonzero(left[i])
            down = np.flatnonzero(~one & inner)
            nodes = np.stack([2 * nodes[down] + 1, 2 * nodes[down] + 2], axis=1).reshape(-1)
            left = np.repeat(left[down], 2, axis=0)

    def totals(self, cents: np.ndarray) -> tuple[np.ndarray, int]:
        """Sums and counts for each centroid, and how many points were compared with single centroids."""
        out, seen = np.zeros((len(cents), cents.shape[1] + 1), np.int64), 0
        for node, some in self.filtered(cents):
            a, b = self.bounds[node].tolist()
            if len(some) == 1:
                out[some[0], :-1] += self.sums[node]
                out[some[0], -1] += b - a
            else:
                seen += (b - a) * len(some)
                at, _ = nearest_row(self.points[a:b], cents[some])
                out[some] += sums_of(self.points[a:b], at, len(some))
        return out, seen

    def nearest(self, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's centroid and squared distance, in tree order."""
        which, far = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        for node, some in self.filtered(cents):
            a, b = self.bounds[node].tolist()
            at, far[a:b] = nearest_row(self.points[a:b], cents[some])
            which[a:b] = some[at]
        return which, far


_TREES = "ids array<bigint>, n int, points binary, low binary, high binary, sums binary"


def _grown(dims: int):
    def block(ids: pa.Array, x: np.ndarray):
        tree, order = Tree.grow(x)
        cols = [a.astype("<i4").tobytes() for a in (tree.points, tree.low, tree.high)] + [tree.sums.astype("<i8").tobytes()]
        kinds = [pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 4]
        names = ["ids", "n", "points", "low", "high", "sums"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([ids.take(pa.array(order)).to_pylist(), len(x), *cols], kinds)], names=names)

    def run(batches):
        ids, rows, n = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, TREE_ROWS):
                part = b.slice(lo, TREE_ROWS)
                if n + part.num_rows > TREE_ROWS:
                    yield block(pa.concat_arrays(ids), np.concatenate(rows))
                    ids, rows, n = [], [], 0
                ids.append(part.column("id"))
                rows.append(floors(part.column("v")))
                n += part.num_rows
        if n:
            yield block(pa.concat_arrays(ids), np.concatenate(rows))

    return run


def _trees(batches, dims: int):
    for b in batches:
        for i in range(b.num_rows):
            part = [np.frombuffer(b.column(c)[i].as_buffer(), t).reshape(-1, dims).astype(np.int64) for c, t in (("points", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]
            yield Tree(*part), b.column("ids")[i]


def _summed(cents: np.ndarray):
    def run(batches):
        total, seen, points = np.zeros((len(cents), cents.shape[1] + 1), np.int64), 0, 0
        for tree, _ in _trees(batches, cents.shape[1]):
            got, compared = tree.totals(cents)
            total, seen, points = total + got, seen + compared, points + len(tree.points)
        if points:
            yield slots(np.append(total.reshape(-1), seen))

    return run


def _assigned(cents: np.ndarray):
    def run(batches):
        for tree, ids in _trees(batches, cents.shape[1]):
            which, far = tree.nearest(cents)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(which.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def fit(trees: DataFrame, cents: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """The centroids after ``rounds`` rounds, and the comparisons of points with centroids in each."""
    k, dims = cents.shape
    work = []
    for _ in range(rounds):
        got = gathered(trees.mapInArrow(_summed(cents), "slot int, total bigint"), (k * (dims + 1) + 1,))
        cents = floor_mean(cents, got[:-1].reshape(k, dims + 1))
        work.append(int(got[-1]))
    return cents, work


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` finite components.

    Components become floor(256 * x). The first centroids are the ``k`` rows with the smallest
    SHA-256 of ``salt:id``, fewer if there are fewer rows; rows without an id come last, equal ids
    by their vectors. Each round assigns every vector to the nearest centroid (ties: smaller
    number) and moves the non-empty ones to floor(sum / count).

    Null vectors, those of another length and those with null or non-finite components give no row.
    Vectors with a component of 2**18 or more in size, whose sums may not fit 64 bits, take no part and have null
    results. Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    v, kind = vector_column(vectors, vec_col)
    rows = pick(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(finite("v") & (F.size("v") == dims))
    fits = rows.where(in_range("v"))
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = fits.select("id", "v", name.alias("h")).orderBy(F.asc_nulls_last("h"), F.asc_nulls_last("id"), "v").limit(k).collect()
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if first:
        cents = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64())))
        trees = tables.write(fits.mapInArrow(_grown(dims), _TREES), "trees")
        cents, _ = fit(trees, cents, rounds)
        given = tables.write(trees.mapInArrow(_assigned(cents), "vec_id bigint, cluster int, distance bigint"), "given")
        tables.drop("trees")
    else:
        cents, given = np.zeros((0, dims), np.int64), spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint")
    given = given.unionByName(rows.where(~in_range("v")).select(F.col("id").alias("vec_id"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")))
    per = {r["cluster"]: int(r["s"]) for r in given.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    whole = sum(per.values())
    facts = [(c, per.get(c, 0), hashlib.sha256(decimals(cents[c]).encode()).hexdigest()) for c in range(len(cents))]
    facts = spark.createDataFrame([(c, s, whole, h) for c, s, h in facts], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return given.join(F.broadcast(facts), "cluster", "left").select(*[x.split()[0] for x in out.split(", ")])  # k rows


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(spread(table(spark, sf_dir, "embeddings")))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{r} AS (SELECT x.vec_id, x.v, min(CAST({far} AS BIGINT) * {k} + c.c) AS m FROM kept x, c{r} c GROUP BY x.vec_id, x.v)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT m % {k} AS c, i, floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS w FROM a{r}, range(1, {dims} + 1) t(i) GROUP BY ALL)")
            steps.append(f"u{r} AS (SELECT c, list(CAST(w AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u ON u.c = c.c)")
    return (
        "WITH " + ",\n".join(steps) + f""" SELECT vec_id, CAST(a.m % {k} AS INTEGER) AS cluster, CAST(a.m // {k} AS BIGINT) AS distance, CAST(sum(a.m // {k}) OVER (PARTITION BY a.m % {k}) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m % {k}"""
    )


OP13_SQL = _sql()
