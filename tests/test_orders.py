"""Orders, quantiles, splits and permutations that no task holds whole."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import vectors as V
from tessera.operators import ranks as K
from tessera.operators import sampling as R


def frame(spark, n=3000):
    """A third of all rows in one group, groups of one row, and a null group."""
    group = lambda i: "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{i % 40}" if i % 7 else f"lone{i}"
    return spark.createDataFrame([(i, group(i), None if i % 17 == 0 else float(i * 7919 % 211) / 4) for i in range(n)], "k long, g string, x double").repartition(5)


def test_places_are_those_of_one_sort(spark):
    df = frame(spark)
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(R.draw(4, F.col("k")), "k")).cast("long"))
    got = R.hash_order(df, ["g"], "k", 4, "r")
    assert sorted((r["k"], r["r"]) for r in got.collect()) == sorted((r["k"], r["r"]) for r in want.collect())
    halves = {(r["k"], r["split"]): r["half"] for r in R.random_halves(df, ["g"], "k", 2).collect()}
    placed = {r["k"]: r["i"] for r in df.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("k"))).collect()}
    by = {}
    for (k, split), half in halves.items():
        assert by.setdefault((split, placed[k]), half) == half  # rows at one place share a split's half
    assert len(halves) == 6000


@pytest.mark.parametrize("pieces", [2, 256])
def test_quantiles_are_exact(spark, monkeypatch, pieces):
    monkeypatch.setattr(K, "PIECES", pieces)
    df = frame(spark)
    at = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "top": 1.0}
    rows = df.collect()
    for by in ([], ["g"]):
        groups = {}
        for r in rows:
            if r["x"] is not None:
                groups.setdefault(r["g"] if by else None, []).append(r["x"])
        got = {(r["g"] if by else None): [r[n] for n in at] for r in K.quantiles(df, by, "x", at).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert np.allclose(got[g], np.quantile(xs, list(at.values())), rtol=0, atol=1e-12)
    assert K.quantiles(df.where("x IS NULL"), ["g"], "x", at).collect() == []


def test_permuted_labels_go_all_over_the_table(spark):
    n = 4000
    df = spark.createDataFrame([(i, f"l{i * 4 // n}") for i in range(n)], "k long, label string").repartition(6)
    out = {r["k"]: r["new"] for r in R.permuted(df, "k", "label", "new", 5).collect()}
    assert len(out) == n and Counter(out.values()) == Counter(f"l{i * 4 // n}" for i in range(n))
    table = np.zeros((8, 4))
    for k, v in out.items():
        table[k * 8 // n, int(v[1])] += 1  # eight stretches of keys
    assert (np.abs(table - n / 32) < 5 * np.sqrt(n / 32)).all()
    assert out != {r["k"]: r["new"] for r in R.permuted(df, "k", "label", "new", 6).collect()}


def test_stratified_split_keeps_shares(spark):
    df = frame(spark)
    got = R.stratified_split(df, "g", "k", 0.2).groupBy("g").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t")).collect()
    assert sum(r["n"] for r in got) == 3000 and all(abs(r["t"] - 0.2 * r["n"]) <= 0.5 for r in got)


@pytest.mark.parametrize("components", [3, 64])
def test_procrustes_after_principal_components(spark, components):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(90, 8)) * np.arange(1, 9)
    b = a[:, :6] @ rng.normal(size=(6, 5)) + rng.normal(size=(90, 5))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>").repartition(4)

    def reduced(m):
        m = m - m.mean(axis=0)
        u, s, v = np.linalg.svd(m, full_matrices=False)
        m = m @ v[:components].T
        return m / np.linalg.norm(m)

    x, y = reduced(a), reduced(b)
    s = np.linalg.svd(x.T @ y)
    turned = y @ (s[2][: x.shape[1]].T[:, : min(x.shape[1], y.shape[1])] @ s[0][:, : min(x.shape[1], y.shape[1])].T)
    assert abs(V.procrustes(df, "a", "b", components) - ((x - turned) ** 2).sum()) < 1e-9
    axes, variances = V.principal(df, "a", components)
    assert np.allclose(variances, np.linalg.svd(a - a.mean(axis=0))[1][:components] ** 2 / 90)
