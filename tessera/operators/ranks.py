"""Ranks, quantile bins, modes and winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest_rank(df: DataFrame, by: list[str], col: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The value at a place (from 0, as a function of the count) in sorted order, from counts of values."""
    hist = df.groupBy(*by, col).agg(F.count("*").alias("_m"))
    run = hist.withColumns({"_upto": F.sum("_m").over(W.partitionBy(*by).orderBy(col)), "_n": F.sum("_m").over(W.partitionBy(*by))})
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > place(F.col("_n")), F.col(col))).alias(name) for name, place in at.items()])


def mode(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The most common value and its share; ties go to the first value in order."""
    c = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    best = F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col)))
    return c.groupBy(*by).agg(best.alias("mode"), (F.max("_n") / F.sum("_n")).alias("share"))


def row_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of two columns and each count's share of its row."""
    c = df.groupBy(row, col).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(row)))


def name_clusters(df: DataFrame, cluster: str, length: str) -> DataFrame:
    """Clusters as ``style_1``.. by mean length; ties by cluster. Only one row for each cluster is ranked."""
    m = df.groupBy(cluster).agg(F.avg(length).alias("_m"), F.count("*").alias("n"))
    return m.select(cluster, F.concat(F.lit("style_"), F.row_number().over(W.orderBy("_m", cluster)).cast("string")).alias("style"), "n")


def average_rank(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """Ranks from 1, ties averaged. Ranks are made over distinct values and joined back."""
    c = df.groupBy(*by, col).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = c.withColumn(name, before + 1 + (F.col("_c") - 1) / 2.0).drop("_c")
    return df.join(ranks, [*by, col])


#: Rows of one bin of a running sum, and how many rows are drawn to choose the bins' edges.
BIN_ROWS, EDGE_ROWS = 1 << 18, 1 << 14


def running(df: DataFrame, order: list[str], add: Column, name: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Adds the sum of ``add`` over all rows up to the row itself in ``order``, without bringing all rows together.

    Bins of the order are cut at rows drawn by hash, so a common value is split by the columns after
    it. Each bin sums its own rows; the sums of the bins before it, one row for each bin, are joined.
    """
    n = df.count()
    bins, key = min(4096, -(-n // bin_rows)), F.struct(*order)
    held = df.withColumn("_b", F.lit(0))
    if bins > 1:
        drawn = df.where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < int(min(1.0, EDGE_ROWS / n) * (1 << 30))).select(*order).distinct().orderBy(*order).collect()
        edges = drawn[:: max(1, len(drawn) // bins)]
        cuts = F.array(*[F.struct(*[F.lit(r[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for r in edges])
        held = df.withColumn("_b", F.size(F.filter(cuts, lambda c: c <= key)) if edges else F.lit(0))
    total = held.groupBy("_b").agg(F.sum(add).alias("_t"))
    before = total.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row for each bin
    own = F.sum(add).over(W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return held.withColumn("_own", own).join(before, "_b").withColumn(name, F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def ecdf(df: DataFrame, order: list[str]) -> DataFrame:
    """The place of each row in ``order`` as a share of all rows."""
    n = df.agg(F.count("*").alias("_n"))
    return running(df, order, F.lit(1), "_r").crossJoin(F.broadcast(n)).withColumn("ecdf", F.col("_r") / F.col("_n")).drop("_r", "_n")  # one row


def rank_quartile(df: DataFrame, col: str, tie: str) -> DataFrame:
    """Adds ``bucket`` 0..3 of equal frequency after ranking by (col, tie), as cuts at 1 + (n - 1) j / 4."""
    n = df.agg(F.count("*").alias("_n"))
    r = running(df, [col, tie], F.lit(1), "_r").crossJoin(F.broadcast(n))  # one row
    cuts = [(F.col("_r") > 1 + (F.col("_n") - 1) * (j / 4)).cast("int") for j in (1, 2, 3)]
    return r.withColumn("bucket", cuts[0] + cuts[1] + cuts[2]).drop("_r", "_n")


#: Pieces that an order of values is cut into for exact quantiles, and bytes of input below which one piece is enough.
PIECES, ONE_PIECE = 256, 32 << 20


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``a`` with the columns that ``b`` has for its group, null groups included; rows without a group there get nulls."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    right = b.withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(right, on, "left").drop(*[f"_{c}" for c in by])


def quantiles(df: DataFrame, by: list[str], col: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group, one column for each name in ``at``; nulls are left out.

    Values are counted first, then cut into pieces at approximate quantiles of all of them; a piece
    sorts its own values and begins after the counts of those before. So no task holds a group's values.
    """
    hist = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_m"))
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < ONE_PIECE
    if small:
        group = W.partitionBy(*by)
        return _between(hist.withColumns({"_upto": F.sum("_m").over(group.orderBy(col).rowsBetween(W.unboundedPreceding, 0)), "_n": F.sum("_m").over(group)}), by, col, at)
    edges = hist.agg(F.percentile_approx(col, F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)]), 10_000).alias("e")).first()["e"] or []
    cuts = F.array(*[F.lit(e) for e in sorted(set(edges))])
    held = hist.withColumn("_piece", F.size(F.filter(cuts, lambda e: e < F.col(col))) if edges else F.lit(0))
    totals = held.groupBy(*by, "_piece").agg(F.sum("_m").alias("_t"))
    run = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*by, "_piece", F.coalesce(F.sum("_t").over(run), F.lit(0)).alias("_before"), F.sum("_t").over(W.partitionBy(*by)).alias("_n"))  # PIECES rows for each group
    upto = beside(held, before, [*by, "_piece"]).withColumn("_upto", F.col("_before") + F.sum("_m").over(W.partitionBy(*by, "_piece").orderBy(col).rowsBetween(W.unboundedPreceding, 0)))
    return _between(upto, by, col, at)


def _between(upto: DataFrame, by: list[str], col: str, at: dict[str, float]) -> DataFrame:
    """Quantiles from values with the number of rows up to them (``_upto``) and of their group (``_n``)."""
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col(col)))
    place = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in at.items()}
    ends = [x for name, p in place.items() for x in (first(F.floor(p)).cast("double").alias(f"_lo_{name}"), first(F.ceil(p)).cast("double").alias(f"_hi_{name}"))]
    got = upto.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    between = lambda n: F.when(F.floor(place[n]) == F.ceil(place[n]), F.col(f"_lo_{n}")).otherwise((F.ceil(place[n]) - place[n]) * F.col(f"_lo_{n}") + (place[n] - F.floor(place[n])) * F.col(f"_hi_{n}"))
    return got.select(*by, *[between(n).alias(n) for n in at])


def digitise(df: DataFrame, col: str, at: list[float], name: str) -> DataFrame:
    """How many exact quantiles lie at or below the value."""
    j = beside(df, quantiles(df, [], col, {f"_q{i}": q for i, q in enumerate(at)}), [])
    return j.withColumn(name, sum(((F.col(col) >= F.col(f"_q{i}")).cast("int") for i in range(len(at))), F.lit(0))).drop(*[f"_q{i}" for i in range(len(at))])


def winners(df: DataFrame, by: str, style: str, value: str) -> DataFrame:
    """How many share the best value, the first of them, and its lead over the second place."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(style).alias("s")))), 1, 2)  # a row for each style
    agg = df.groupBy(by).agg(best.alias("b"), F.collect_list(value).alias("all"))
    return agg.select(by, F.size(F.filter("all", lambda x: x == -F.col("b")[0]["v"])).cast("long").alias("winners"), F.col("b")[0]["s"].alias("best"), (F.get("b", F.lit(1))["v"] - F.col("b")[0]["v"]).alias("gap"))
