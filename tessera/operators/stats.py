"""Grouped statistics over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_rank


def contingency(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def _margins(c: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return c.groupBy(*by, "a").agg(F.sum("n").alias("na")), c.groupBy(*by, "b").agg(F.sum("n").alias("nb")), c.groupBy(*by).agg(F.sum("n").alias("t"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """C14, from the contingency table only."""
    c = contingency(df, a, b)
    ma, mb, t = _margins(c)
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    s = c.agg(F.sum(pairs("n")).alias("s")).crossJoin(ma.agg(F.sum(pairs("na")).alias("sa"))).crossJoin(mb.agg(F.sum(pairs("nb")).alias("sb"))).crossJoin(t)  # one row each
    expected = F.col("sa") * F.col("sb") / pairs("t")
    return s.select(((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def entropy(df: DataFrame, col: str, base2: bool = True, *by: str) -> DataFrame:
    """Entropy of a column, in bits or nats."""
    c = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    log = F.log2 if base2 else F.log
    # H = log t - (1/t) sum n log n, one aggregate of the counts
    return c.groupBy(*by).agg((log(F.sum("n").cast("double")) - F.sum(F.col("n") * log(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"))


def mutual_information(df: DataFrame, a: str, b: str, base2: bool = False, *by: str) -> DataFrame:
    """M14 in nats, M15 in bits and for each group: the information two columns share."""
    c = contingency(df, a, b, *by)
    ma, mb, t = _margins(c, *by)
    j = c.join(ma, [*by, "a"]).join(mb, [*by, "b"])
    j = j.join(t, list(by)) if by else j.crossJoin(F.broadcast(t))  # one row
    log = F.log2 if base2 else F.log
    term = F.col("n") / F.col("t") * log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    return j.groupBy(*by).agg(F.sum(term).alias("mi"))


def normalised_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of both entropies."""
    mi = mutual_information(df, a, b)
    ha, hb = entropy(df, a, False).withColumnRenamed("entropy", "ha"), entropy(df, b, False).withColumnRenamed("entropy", "hb")
    return mi.crossJoin(ha).crossJoin(hb).select((F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))  # one row each


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """The share of rows that carry their cluster's most common label."""
    c = contingency(df, cluster, label)
    return c.groupBy("a").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg((F.sum("m") / F.sum("t")).alias("purity"))


def classification(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """M6: accuracy, and F1 averaged over all labels seen on either side, 0 where undefined."""
    c = contingency(df, truth, guess)
    names = c.select(F.col("a").alias("l")).union(c.select("b")).distinct()
    ma, mb, _ = _margins(c)
    hit = c.where("a = b").select(F.col("a").alias("l"), F.col("n").alias("hit"))
    j = names.join(ma.withColumnRenamed("a", "l"), "l", "left").join(mb.withColumnRenamed("b", "l"), "l", "left").join(hit, "l", "left").na.fill(0.0)
    f1 = F.when(F.col("na") + F.col("nb") > 0, 2 * F.col("hit") / (F.col("na") + F.col("nb"))).otherwise(0.0)
    return j.agg((F.sum("hit") / F.sum("na")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12), r)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of ranks with ties averaged."""
    r = average_rank(average_rank(df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")), [], "x", "rx"), [], "y", "ry")
    return r.agg(safe_corr("rx", "ry").alias("rho"))


def eta_squared(df: DataFrame, label: str, features: list[str], *by: str) -> DataFrame:
    """The share of each feature's variance between labels, for all features at once."""
    wide = df.select(*by, F.col(label).alias("_l"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(*by, "_l", "s.*")
    g = wide.groupBy(*by, "feature", "_l").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    t = g.groupBy(*by, "feature").agg(mean.alias("gm"))
    j = g.join(t, [*by, "feature"])
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)), F.sum(F.col("n") * F.col("v"))
    return j.groupBy(*by, "feature").agg(F.when(between + within > 0, between / (between + within)).otherwise(0.0).alias("eta2"))


def total_variation(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Half the sum of |p - q| over two tables (key, p)."""
    j = p.select(key, F.col("p").alias("_p")).join(q.select(key, F.col("p").alias("_q")), key, "full")
    return j.agg((F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2).alias("tv"))


def jaccard_pairs(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """Jaccard of all pairs of owners of (owner, member) rows, from one count of members' owner pairs."""
    owned = sets.select(owner, member).distinct()
    per = owned.groupBy(member).agg(F.array_sort(F.collect_list(owner)).alias("o"))  # owners are few
    pair = per.select(F.explode("o").alias("a"), "o").select("a", F.explode("o").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("inter"))
    size = owned.groupBy(F.col(owner).alias("a")).agg(F.count("*").alias("sa"))
    other = size.select(F.col("a").alias("b"), F.col("sa").alias("sb"))
    grid = size.join(other, F.expr("a < b"))
    return grid.join(pair, ["a", "b"], "left").select("a", "b", (F.coalesce("inter", F.lit(0)) / (F.col("sa") + F.col("sb") - F.coalesce("inter", F.lit(0)))).alias("jaccard"))
