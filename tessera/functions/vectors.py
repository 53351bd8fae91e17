"""Vector functions over array<double> columns, all inside the JVM (V rows of the survey)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """V1: x / max(|x|, eps); a zero vector stays zero."""
    size = F.greatest(norm(a), F.lit(eps))
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(size, F.size(a)).alias("n")), lambda z: z["x"] / z["n"])


def cosine(a: Column, b: Column, eps: float = 1e-7) -> Column:
    """V2: cosine with eps under the fraction bar."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def concat(a: Column, b: Column) -> Column:
    """V24."""
    return F.concat(a, b)


def heads(a: Column, n: int, size: int) -> list[Column]:
    """N equal parts."""
    return [F.slice(a, i * size + 1, size) for i in range(n)]


def long_form(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, pos, x)."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "x"))


def vector_mean(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """The mean vector of each group, assembled in order."""
    m = long_form(df, by, vec).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def variance_hinge(df: DataFrame, vec: str, gamma: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """V4: mean over dimensions of max(0, gamma - std + eps), with the sample deviation; 0 for under two rows."""
    d = long_form(df, [], vec).groupBy("pos").agg(F.stddev_samp("x").alias("s"), F.count("*").alias("n"))
    return d.agg(F.avg(F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), gamma - F.col("s") + eps))).alias("value"))


def cross_moments(df: DataFrame, a: str, b: str) -> DataFrame:
    """(i, n, row): for each dimension i of ``a`` the number of rows and the sums of centred products with all dimensions of ``b``.

    Tasks add up whole blocks; only their sums, one row for each task and dimension, are shuffled and
    merged with the means they were centred by.
    """
    import numpy as np
    import pyarrow as pa

    def merge(x, y):  # (n, mean of a, mean of b, sums of centred products)
        n = x[0] + y[0]
        da, db = y[1] - x[1], y[2] - x[2]
        return n, x[1] + da * (y[0] / n), x[2] + db * (y[0] / n), x[3] + y[3] + (da[:, None] * db[None, :] if np.ndim(da) else da * db) * (x[0] * y[0] / n)

    def matrix(col):
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)

    def parts(batches):
        held = None
        for t in batches:
            if t.num_rows:
                x, y = matrix(t.column(0)), matrix(t.column(1))
                mx, my = x.mean(axis=0), y.mean(axis=0)
                now = (len(x), mx, my, (x - mx).T @ (y - my))
                held = now if held is None else merge(held, now)
        if held is not None:
            n, mx, my, m = held
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mx))), pa.array(np.full(len(mx), n)), pa.array(mx), pa.array([my.tolist()] * len(mx), lists), pa.array(m.tolist(), lists)], names=["i", "n", "mean", "means", "row"])

    def sums(batches):
        now, held = None, None
        for t in batches:
            for i, n, mean, means, row in zip(*(c.to_pylist() for c in t.columns)):
                part = (n, mean, np.array(means), np.array(row))
                if i != now and held is not None:
                    yield out(now, held)
                held = part if i != now else merge(held, part)
                now = i
        if held is not None:
            yield out(now, held)

    def out(i, held):
        return pa.RecordBatch.from_arrays([pa.array([i]), pa.array([held[0]]), pa.array([held[3].tolist()], pa.list_(pa.float64()))], names=["i", "n", "row"])

    blocks = df.select(a, F.col(b).alias("_b")).where(F.col(a).isNotNull() & F.col("_b").isNotNull()).mapInArrow(parts, "i bigint, n bigint, mean double, means array<double>, row array<double>")
    return blocks.repartition("i").sortWithinPartitions("i").mapInArrow(sums, "i bigint, n bigint, row array<double>")


def covariance(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(i, j, cov_samp, cov_pop) of all pairs of dimensions."""
    m = cross_moments(df, vec, vec).select(F.col("i").cast("int").alias("i"), "n", F.posexplode("row").alias("j", "s"))
    return m.select("i", "j", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("cov_samp"), (F.col("s") / F.col("n")).alias("cov_pop"))


def covariance_penalty(cov: DataFrame) -> DataFrame:
    """V5: the sum of squared off-diagonal sample covariances over the number of dimensions."""
    return cov.agg((F.sum(F.when(F.col("i") != F.col("j"), F.pow("cov_samp", 2)).otherwise(0.0)) / F.countDistinct("i")).alias("value"))


def effective_rank(cov: DataFrame) -> DataFrame:
    """(trace C)**2 / |C|**2 of the population covariance; no eigenvalues are needed."""
    return cov.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov_pop"))), 2) / F.sum(F.pow("cov_pop", 2))).alias("value"))


def length_decorrelation(df: DataFrame, vec: str, length: str, eps: float = 1e-6) -> DataFrame:
    """V6: the sum over dimensions of squared correlation with length; 1/n covariance over sample deviations plus eps."""
    d = df.select(F.col(length).cast("double").alias("l"), F.posexplode(vec).alias("pos", "x"))
    c = d.groupBy("pos").agg((F.covar_pop("x", "l") / ((F.stddev_samp("x") + eps) * (F.stddev_samp("l") + eps))).alias("c"))
    return c.agg(F.sum(F.pow("c", 2)).alias("value"))


def mean_pair_cosine(df: DataFrame, by: str, vec: str) -> DataFrame:
    """The mean cosine over all pairs of a group, as (|sum u|**2 - n) / (n (n - 1)) of unit vectors: no pairs are made."""
    s = long_form(df.withColumn("_u", unit(F.col(vec))), [by], "_u").groupBy(by, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return s.groupBy(by).agg(((F.sum(F.pow("s", 2)) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("mean_cosine"), F.max("n").alias("n")).where("n > 1")


def within_pairs(df: DataFrame, by: str, key: str, vec: str) -> DataFrame:
    """Cosine of the pairs of rows of a group; groups hold few rows."""
    a = df.select(by, F.col(key).alias("a"), unit(F.col(vec)).alias("u"))
    b = df.select(by, F.col(key).alias("b"), unit(F.col(vec)).alias("w"))
    return a.join(b, by).where("a < b").select(by, "a", "b", dot(F.col("u"), F.col("w")).alias("cosine"))


def contrastive(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """V3, V9: InfoNCE over batches of (batch, pair, side, v): every row against all others of its batch, the partner as the answer.

    A batch has a bounded number of rows; all its rows meet each other. The value is the mean over all
    rows; without the column all rows are one batch.
    """
    pairs = pairs if "batch" in pairs.columns else pairs.withColumn("batch", F.lit(0))
    u = pairs.select("batch", F.concat_ws("/", "pair", "side").alias("id"), "pair", unit(F.col("v")).alias("u"))
    b = u.select("batch", F.col("id").alias("oid"), F.col("pair").alias("opair"), F.col("u").alias("w"))
    sims = u.join(b, "batch").where("id <> oid").select("batch", "id", (F.col("pair") == F.col("opair")).alias("mate"), (dot(F.col("u"), F.col("w")) / temperature).alias("s"))
    loss = sims.groupBy("batch", "id").agg((F.log(F.sum(F.exp("s"))) - F.max(F.when(F.col("mate"), F.col("s")))).alias("l"))
    return loss.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("value"))


def similarity_entropy(rows: DataFrame, key: str, vec: str, temperature: float = 0.1, batch: str | None = None) -> DataFrame:
    """V7: minus the mean entropy of each row's softmax over the others of its batch."""
    u = rows.select((F.col(batch) if batch else F.lit(0)).alias("batch"), F.col(key).alias("id"), unit(F.col(vec)).alias("u"))
    b = u.select("batch", F.col("id").alias("oid"), F.col("u").alias("w"))
    s = u.join(b, "batch").where("id <> oid").select("batch", "id", (dot(F.col("u"), F.col("w")) / temperature).alias("s"))
    z = s.groupBy("batch", "id").agg(F.log(F.sum(F.exp("s"))).alias("lz"), (F.sum(F.exp("s") * F.col("s")) / F.sum(F.exp("s"))).alias("m"))
    return z.agg((-F.avg(F.col("lz") - F.col("m"))).alias("value"))


def separation(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean cosine distance of rows to their own centroid, of centroids to each other, and their ratio."""
    c = vector_mean(df, [label], vec).withColumn("cu", unit(F.col("centroid"))).select(label, "cu")
    within = df.join(c, label).agg(F.avg(1 - dot(unit(F.col(vec)), F.col("cu"))).alias("within"))
    other = c.select(F.col(label).alias("_o"), F.col("cu").alias("ou"))
    between = c.join(other, F.expr(f"{label} < _o")).agg(F.avg(1 - dot(F.col("cu"), F.col("ou"))).alias("between"))
    return within.crossJoin(between).withColumn("ratio", F.col("between") / F.col("within"))  # one row each


def cosine_gap(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean cosine within labels, labels weighted alike, minus the mean between labels, exact from label sums."""
    s = long_form(df.withColumn("_u", unit(F.col(vec))), [label], "_u").groupBy(label, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    within = s.groupBy(label).agg(((F.sum(F.pow("s", 2)) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("w"), F.max("n").alias("m")).where("m > 1").agg(F.avg("w").alias("within"))
    means = s.select(label, "pos", (F.col("s") / F.col("n")).alias("x"))
    both = means.groupBy("pos").agg(F.sum("x").alias("t"), F.sum(F.pow("x", 2)).alias("q"), F.count("*").alias("k"))
    between = both.agg((F.sum(F.pow("t", 2) - F.col("q")) / (F.max("k") * (F.max("k") - 1))).alias("between"))
    return within.crossJoin(between).select("within", "between", (F.col("within") - F.col("between")).alias("gap"))  # one row each


def linear_cka(df: DataFrame, a: str, b: str) -> DataFrame:
    """|A'B|**2 / (|A'A| |B'B|) of centred columns."""

    def block(x, y):
        square = F.aggregate("row", F.lit(0.0), lambda t, c: t + (c / F.col("n")) * (c / F.col("n")))
        return cross_moments(df, x, y).agg(F.sum(square).alias("s"))

    ab, aa, bb = block(a, b), block(a, a), block(b, b)
    return ab.select(F.col("s").alias("ab")).crossJoin(aa.select(F.col("s").alias("aa"))).crossJoin(bb.select(F.col("s").alias("bb"))).select((F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cka"))  # one row each


def principal(df: DataFrame, vec: str, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading principal axes of a vector column (dims x components) and their variances, from its summed Gram blocks.

    Only the dims x dims matrix reaches the driver. An axis points where its largest part is positive.
    """
    rows = cross_moments(df, vec, vec).orderBy("i").collect()
    values, axes = np.linalg.eigh(np.array([r["row"] for r in rows]) / rows[0]["n"])
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]), np.maximum(values[order], 0)


def procrustes(df: DataFrame, a: str, b: str, components: int = 64) -> float:
    """Disparity 2 - 2 * (sum of singular values) between the leading ``components`` principal parts of two tables, centred and of unit norm.

    The cross product of the reduced columns is that of the whole ones between both sets of axes, so
    no row is projected; three dims x dims matrices reach the driver.
    """
    rows = cross_moments(df, a, b).orderBy("i").collect()
    ab = np.array([r["row"] for r in rows]) / rows[0]["n"]
    (pa, va), (pb, vb) = (principal(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), x, components) for x in (a, b))
    return float(2 - 2 * np.linalg.svd(pa.T @ ab @ pb / np.sqrt(va.sum() * vb.sum()), compute_uv=False).sum())


def nearest_centroid(df: DataFrame, centroids: DataFrame, vec: str, name: str, how: str = "dot") -> DataFrame:
    """The label of the nearest row of ``centroids`` (label, centroid) by dot product, cosine or squared distance.

    Centroids are one row for each label; they join as one array, so rows are not multiplied.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))
    j = df.crossJoin(F.broadcast(table))  # one row
    v = F.col(vec)
    score = {"dot": lambda c: -dot(v, c), "cosine": lambda c: -dot(unit(v), unit(c)), "euclidean": lambda c: total(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)))}[how]
    far = F.transform("_c", lambda s: F.struct(score(s["centroid"]).alias("far"), s["label"].alias("label")))
    best = F.array_min(far)
    return j.withColumns({name: best["label"], f"{name}_far": best["far"]}).drop("_c")


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Minus the mean, over the population deviation of at least 1e-9."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(s))  # one row
    return j.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}).select(*df.columns)
