"""Clustering and model selection (C rows of the survey).

Models are a few arrays of clusters x dimensions; data stays in executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit, vector_mean
from .sampling import split_by_key

REG = 1e-3
#: Rows that meet the drawn rows of a silhouette at once: one array of rows x drawn x dimensions.
PIECE = 16


@dataclass
class Gmm:
    """A mixture of Gaussians with diagonal covariance."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean[None]
        return np.log(self.weight) - 0.5 * (np.log(2 * np.pi * self.var).sum(axis=1) + (d * d / self.var[None]).sum(axis=2))


def fixed(weight: list[float], mean: list[float], var: list[float], dims: int) -> Gmm:
    return Gmm(np.array(weight), np.repeat(np.array(mean)[:, None], dims, axis=1), np.repeat(np.array(var)[:, None], dims, axis=1))


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _log_sum(j: np.ndarray) -> np.ndarray:
    top = j.max(axis=1)
    return top + np.log(np.exp(j - top[:, None]).sum(axis=1))


def _em_step(df: DataFrame, vec: str, model: Gmm) -> tuple[Gmm, float]:
    """One round: partial sums of clusters x (1 + 2 dims) numbers in each task, added on the driver."""

    def run(batches):
        total, ll, n = None, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            j = model.log_joint(x)
            s = _log_sum(j)
            r = np.exp(j - s[:, None])
            part = np.hstack([r.sum(axis=0)[:, None], r.T @ x, r.T @ (x * x)])
            total, ll, n = part if total is None else total + part, ll + s.sum(), n + len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([float(ll)]), pa.array([n])], names=["sums", "ll", "n"])

    rows = df.select(vec).mapInArrow(run, "sums binary, ll double, n bigint").collect()
    k, d = model.mean.shape
    s = sum(np.frombuffer(r["sums"]).reshape(k, 1 + 2 * d) for r in rows)
    n, size = sum(r["n"] for r in rows), np.maximum(s[:, :1], 1e-10)
    mean = s[:, 1 : 1 + d] / size
    return Gmm((s[:, 0] + 1e-10) / (s[:, 0] + 1e-10).sum(), mean, np.maximum(s[:, 1 + d :] / size - mean**2, 0) + REG), sum(r["ll"] for r in rows) / n


def fit_gmm(df: DataFrame, vec: str, k: int, n_init: int = 5, max_iter: int = 300, tol: float = 1e-3, seed: int = 0, normalise: bool = True) -> Gmm:
    """The best of ``n_init`` EM fits from rows drawn by hash; REG is added to variances."""
    df = df.select((unit(F.col(vec)) if normalise else F.col(vec)).alias(vec)).persist()
    best, top = None, -np.inf
    try:
        for run in range(n_init):
            rows = df.orderBy(F.xxhash64(F.lit(seed + run), vec)).limit(k).collect()
            x = np.array([r[vec] for r in rows])
            model, before = Gmm(np.full(k, 1 / k), x, np.full(x.shape, max(x.var(), REG))), -np.inf
            for _ in range(max_iter):
                new, ll = _em_step(df, vec, model)
                if abs(ll - before) < tol:
                    break
                model, before = new, ll
            if ll > top:
                best, top = model, ll
    finally:
        df.unpersist()
    return best


def predict(df: DataFrame, vec: str, model: Gmm) -> DataFrame:
    """Adds ``cluster_id`` (largest responsibility, first on ties) and the row's log-likelihood ``ll``."""

    def run(batches):
        for b in batches:
            j = model.log_joint(_matrix(b.column(b.schema.get_field_index(vec)))) if b.num_rows else np.zeros((0, len(model.weight)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(j.argmax(axis=1).astype(np.int32)), pa.array(_log_sum(j) if len(j) else np.zeros(0))], names=[*b.schema.names, "cluster_id", "ll"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, cluster_id int, ll double")


def bic(df: DataFrame, vec: str, model: Gmm) -> float:
    """-2 LL + p ln n with p = K - 1 + 2 K d."""
    row = predict(df.select(vec), vec, model).agg(F.sum("ll").alias("ll"), F.count("*").alias("n")).first()
    k, d = model.mean.shape
    return float(-2 * row["ll"] + (k - 1 + 2 * k * d) * np.log(row["n"])) if row["n"] else float("inf")


def sweep(df: DataFrame, key: str, question: str, vec: str, ks: list[int], spark: SparkSession, n_init: int = 1, max_iter: int = 15) -> DataFrame:
    """C4: (k, val_bic, best) on a held-out tenth of the questions; a failed fit counts as infinite, all failing raises."""
    parts = split_by_key(df.withColumn(vec, unit(F.col(vec))), question, 0.1).select(vec, "split").persist()
    rows = []
    for k in ks:
        try:
            model = fit_gmm(parts.where("split = 'train'"), vec, k, n_init, max_iter, normalise=False)
            rows.append((k, bic(parts.where("split = 'test'"), vec, model)))
        except (np.linalg.LinAlgError, FloatingPointError):
            rows.append((k, float("inf")))
    parts.unpersist()
    if all(np.isinf(b) for _, b in rows):
        raise ValueError("no model could be fitted")
    low = min(b for _, b in rows)
    return spark.createDataFrame([(k, b, b == low) for k, b in rows], "k int, val_bic double, best boolean")


def select_and_refit(df: DataFrame, key: str, question: str, vec: str, ks: list[int], spark: SparkSession, n_init: int = 1, max_iter: int = 15) -> tuple[Gmm, DataFrame]:
    """The size with the least BIC on the held-out questions, fitted again on all rows: the model and every row's cluster."""
    k = sweep(df, key, question, vec, ks, spark, n_init, max_iter).where("best").orderBy("k").first()["k"]
    model = fit_gmm(df, vec, k, n_init, max_iter)
    return model, predict(df.withColumn(vec, unit(F.col(vec))), vec, model).drop("ll")


def full_sweep(df: DataFrame, key: str, vec: str, ks: list[int], spark: SparkSession, n_init: int = 1, max_iter: int = 15, sample: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Every size fitted on all rows.

    Returns (k, bic, mean_ll, silhouette, n_empty, best_bic, best_silhouette) and the assignments
    (k, key, cluster_id) of all sizes. Empty components are counted, not dropped; the silhouette is that
    of at most ``sample`` rows; ties go to the smaller size.
    """
    rows, parts = [], []
    units = df.select(key, unit(F.col(vec)).alias(vec))
    for k in ks:
        model = fit_gmm(units, vec, k, n_init, max_iter, normalise=False)  # holds its rows while it runs
        given = predict(units, vec, model)
        a = given.agg(F.sum("ll").alias("ll"), F.count("*").alias("n"), F.countDistinct("cluster_id").alias("used")).first()
        d = model.mean.shape[1]
        sil = silhouette(given, key, "cluster_id", vec, sample).first()[0] if a["used"] > 1 else None
        rows.append((k, float(-2 * a["ll"] + (k - 1 + 2 * k * d) * np.log(a["n"])), float(a["ll"] / a["n"]), sil, k - a["used"]))
        parts.append(given.select(F.lit(k).alias("k"), key, "cluster_id"))
    least = min(rows, key=lambda r: r[1])[0]
    most = max((r for r in rows if r[3] is not None), key=lambda r: r[3], default=(None,))[0]
    table = spark.createDataFrame([(*r, r[0] == least, r[0] == most) for r in rows], "k int, bic double, mean_ll double, silhouette double, n_empty int, best_bic boolean, best_silhouette boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return table, out


def save_gmm(spark: SparkSession, model: Gmm, path: str) -> None:
    """K6: the parameters as Parquet, one row for each component."""
    rows = [(k, float(model.weight[k]), model.mean[k].tolist(), model.var[k].tolist()) for k in range(len(model.weight))]
    spark.createDataFrame(rows, "component int, weight double, mean array<double>, var array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_gmm(spark: SparkSession, path: str) -> Gmm:
    rows = spark.read.parquet(path).orderBy("component").collect()  # one row for each component
    return Gmm(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["var"] for r in rows]))


def kmeans(df: DataFrame, vec: str, k: int, n_init: int = 10, seed: int = 0) -> DataFrame:
    """The run with the least cost of ``n_init`` seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_f", array_to_vector(F.col(vec))).persist()
    try:
        runs = [KMeans(featuresCol="_f", predictionCol="cluster_id", k=k, seed=seed + i).fit(data) for i in range(n_init)]
        best = min(runs, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()
    return best.transform(df.withColumn("_f", array_to_vector(F.col(vec)))).drop("_f")


def silhouette(df: DataFrame, key: str, label: str, vec: str, most: int = 5000) -> DataFrame:
    """Mean Euclidean silhouette over at most ``most`` rows drawn by hash; noise (-1) is left out.

    Each row meets the drawn rows in its own task, ``PIECE`` at once; the drawn rows have a fixed bound.
    """
    drawn = df.where(F.col(label) != -1).orderBy(F.xxhash64(key), key).limit(most).select(key, label, vec)
    rows = drawn.collect()
    lab, x = np.array([r[label] for r in rows]), np.array([r[vec] for r in rows])
    names = np.unique(lab)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")

    def run(batches):
        for b in (whole.slice(lo, PIECE) for whole in batches for lo in range(0, whole.num_rows, PIECE)):
            mine = b.column(0).to_numpy()
            d = np.sqrt(np.maximum(((_matrix(b.column(1))[:, None, :] - x[None]) ** 2).sum(axis=2), 0))
            sums = np.stack([d[:, lab == n].sum(axis=1) for n in names], axis=1)
            size = np.array([(lab == n).sum() for n in names])
            own = np.searchsorted(names, mine)
            at = np.arange(len(mine))
            a = sums[at, own] / np.maximum(size[own] - 1, 1)
            other = sums / size
            other[at, own] = np.inf
            near = other.min(axis=1)
            s = np.where(size[own] > 1, (near - a) / np.maximum(np.maximum(near, a), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    return drawn.select(F.col(label).cast("long"), vec).mapInArrow(run, "s double").agg(F.avg("s").alias("silhouette"))


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean of unit vectors for each label; noise is left out."""
    return vector_mean(df.where(F.col(label) != -1).withColumn("_u", unit(F.col(vec))), [label], "_u")
