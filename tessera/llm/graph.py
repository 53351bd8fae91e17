"""Connected components of an edge table by star contraction, with nothing on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

MOST_ROUNDS = 60


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component; nodes are 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new[label] if (new[label] != new).any() else new


def _contract(batches):
    """Star edges of the components within a task's own edges."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_labels(at[: len(a)], at[len(a) :], len(nodes))
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node on the left has one edge and is no node on the right: each right node then is its component's smallest."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("left")), F.struct(F.col("b").alias("x"), F.lit(0).alias("left")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("left").alias("l"), F.min("left").alias("r")).where("l > 1 OR (l > 0 AND r = 0)").isEmpty()


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component): the smallest reachable node of each node in the edges (a, b) of bigint.

    Each task first contracts its own edges; then large-star and small-star rounds run until only
    stars are left. Hubs meet their edges in plain joins, which split where they are skewed.
    """
    now = tables.write(edges.mapInArrow(_contract, "a bigint, b bigint").distinct(), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written, so that both sides of the joins are plain exchanges, which split where a hub is large
        low = tables.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-low")
        large = tables.write(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), f"{name}-large")
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = tables.write(small, f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}", f"{name}-low", f"{name}-large", f"{name}-least")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("a")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
