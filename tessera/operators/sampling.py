"""Seeded sampling and splits by hashes of keys: the same under any partitioning (R rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(seed: int | Column, *keys: Column) -> Column:
    """A whole number of 52 bits from a seed and keys: the leading digits of an MD5, which other engines have too."""
    text = F.concat_ws(":", (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """``draw`` in DuckDB; the first part is the seed."""
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


#: Pieces that a group's order is cut into: a group of any size is sorted by so many tasks.
PIECES = 256


def _placed(df: DataFrame, by: list[str], order: list[Column], piece: Column, name: str) -> DataFrame:
    """Adds the row's place within its group, where ``piece`` cuts the order: pieces are sorted alone and begin after the counts of those before."""
    held = df.withColumn("_piece", piece)
    counts = held.groupBy(*by, "_piece").agg(F.count("*").alias("_m"))
    before = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_piece").alias("_p"), F.coalesce(F.sum("_m").over(W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    on = F.col("_piece") == F.col("_p")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = held.join(before, on)
    own = F.row_number().over(W.partitionBy(*by, "_piece").orderBy(*order))
    return joined.withColumn(name, F.col("_before") + own).select(*df.columns, name)


def hash_order(df: DataFrame, by: list[str], key: str, seed: int, name: str) -> DataFrame:
    """Adds the row's place within its group in the order of a hash of (seed, key). Pieces are the hash's leading bits, so they are even."""
    d = draw(seed, F.col(key))
    return _placed(df, by, [d, F.col(key)], F.shiftright(d, 52 - (PIECES.bit_length() - 1)), name)


def permuted(df: DataFrame, key: str, label: str, name: str, seed: int = 0) -> DataFrame:
    """(key, name): the labels of all rows dealt out again among all rows, by a permutation of the whole table.

    Rows and labels are placed in two independent orders by hash, and meet at equal places; an order is cut
    at drawn rows, so no task holds it whole. Every label keeps its count.
    """
    from .ranks import running

    place = lambda cols, n: running(df.select(*cols).withColumn("_h", draw(seed + n, F.col(key))), ["_h", key], F.lit(1), "_place")
    rows = place([key], 1).select(key, "_place")
    labels = place([key, label], 2).select(F.col(label).alias(name), "_place")
    return rows.join(labels, "_place").select(key, name)


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """M2, M4: adds ``split``: of each class round(fraction * rows) rows, the first by hash, are ``test``; nulls are a class of their own."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.round(F.count("*") * fraction).cast("long").alias("_test"))
    placed = hash_order(df, [label], key, seed, "_r").join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return placed.withColumn("split", F.when(F.col("_r") <= F.col("_test"), "test").otherwise("train")).select(*df.columns, "split")


def per_group_cap(df: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group."""
    return hash_order(df, by, key, seed, "_r").where(F.col("_r") <= most).drop("_r")


def random_label(key: Column, k: int, seed: int) -> Column:
    """An even label 0..k-1 from the key; each k has a stream of its own."""
    return (draw(seed, F.lit(k), key) % k).cast("int")


def split_by_key(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds ``split``; whole keys go to ``test``, max(1, round(fraction * keys)) of them, by hash."""
    keys = df.select(key).distinct()
    n = max(1, round(fraction * keys.count()))
    test = keys.orderBy(draw(seed, F.col(key)), key).limit(n).withColumn("split", F.lit("test"))
    return df.join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def tail_split(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """The last max(1, round(fraction * keys)) keys in code-point order are ``validation``; a lone key stays in both.

    Only distinct keys are ranked.
    """
    keys = df.select(key).distinct()
    total = keys.count()
    n = min(max(1, round(fraction * total)), max(1, total - 1))
    held = keys.orderBy(F.desc(key)).limit(n).withColumn("split", F.lit("validation"))
    return df.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def placed(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds ``i``, the row's place in its group. Keys are numbers; pieces of a group's order end at quantiles of the key."""
    edges = [e for e in df.agg(F.percentile_approx(key, F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)]), 10_000).alias("e")).first()["e"] or []]
    piece = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(key))) if edges else F.lit(0)
    return _placed(df, by, [F.col(key)], piece, "i")


def half(split: Column, place: Column, seed: int = 0) -> Column:
    """0 or 1 for a split and a place in the group."""
    return (draw(seed, split, place) % 2).cast("int")


def random_halves(df: DataFrame, by: list[str], key: str, splits: int, seed: int = 0) -> DataFrame:
    """Every row once for each of ``splits`` (``split`` 1..splits) with ``half`` 0 or 1.

    The halves come from a hash of (split, place ``i`` of the row in its group), so all groups share
    a split's halves, as they would share one permutation.
    """
    return placed(df, by, key).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("half", half(F.col("split"), F.col("i"), seed))


def shard_ranges(n: int, shards: int) -> list[tuple[int, int]]:
    """floor(n i / S) .. floor(n (i + 1) / S)."""
    return [(n * i // shards, n * (i + 1) // shards) for i in range(shards)]


#: Rows of a question that one block holds where its pairs are made, and pairs that a task makes on average.
PAIR_BLOCK, TASK_PAIRS = 2048, 1 << 25


def block_pairs(df: DataFrame, group: str, key: str, block: int = PAIR_BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """Both sides of the pairs of a group: rows dealt to blocks of about ``block`` rows by a hash of the key, each block once for every pair of blocks (``_i`` <= ``_j``) it is in.

    Also the number of tasks the pairs are for. A pair of blocks is bounded, so a group of any size is spread.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n") * F.col("_n") / 2)).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 13, int(pairs // TASK_PAIRS)))
    counts = sizes.select("_g", F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    dealt = df.join(counts, F.col(group) == F.col("_g")).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_m")).cast("int"))
    left = dealt.withColumn("_j", F.explode(F.sequence("_b", F.col("_m") - 1))).withColumnRenamed("_b", "_i").drop("_g", "_m")
    right = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), "_b"))).withColumnRenamed("_b", "_j").drop("_g", "_m")
    return left, right, parts


def same_question_pairs(df: DataFrame, question: str, key: str) -> DataFrame:
    """The unordered pairs of rows of a question, each once. All pairs are made, in tasks of bounded blocks."""
    left, right, parts = block_pairs(df.select(question, key), question, key)
    on = [question, "_i", "_j"]
    a, b = left.select(*on, F.col(key).alias("_a")).repartition(parts, *on), right.select(*on, F.col(key).alias("_b")).repartition(parts, *on)
    met = a.join(b, on).where("_i < _j OR _a < _b")  # equal keys are in one block
    return met.select(question, F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
