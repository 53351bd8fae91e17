"""Importance weights and data-set variants (I rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import one_to_one
from ..functions.parse import with_prefix, without_prefix
from .ranks import beside, name_clusters, quantiles, running
from .sampling import draw, hash_order, tail_split

EPS = 0.01


def importance(df: DataFrame, n_styles: int, target: str = "uniform", eps: float = EPS, mean_one: bool = True, question: str = "question_id", style: str = "style") -> DataFrame:
    """Weight p/q of each row, with its audit columns.

    q is the smoothed share of the style on the question, or with ``global`` in all rows; p is
    uniform over all styles or, with ``observed``, over those on the question. Counts come from
    aggregates joined back, so no window holds a whole question or all rows.
    """
    if target not in ("uniform", "observed", "global"):
        raise ValueError(f"unknown target {target!r}")
    cells = df.groupBy(question, style).agg(F.count("*").cast("double").alias("is_n_c"))
    per_q = cells.groupBy(question).agg(F.sum("is_n_c").alias("is_K"), F.count("*").cast("double").alias("is_n_styles_on_q"))
    cells = cells.join(per_q, question)
    if target == "global":
        per_s = cells.groupBy(style).agg(F.sum("is_n_c").alias("_s"))
        total = cells.agg(F.sum("is_n_c").alias("_n"))
        cells = cells.join(per_s, style).crossJoin(F.broadcast(total))  # one row
        cells = cells.withColumn("is_q", (F.col("_s") + eps) / (F.col("_n") + n_styles * eps)).drop("_s", "_n")
    else:
        z = (1 + n_styles * eps) / (1 + eps)
        cells = cells.withColumn("is_q", (F.col("is_n_c") + F.col("is_K") * eps) / (F.col("is_K") * (1 + eps)) / z)
    p = F.lit(1.0) / F.col("is_n_styles_on_q") if target == "observed" else F.lit(1.0 / n_styles)
    cells = cells.withColumn("is_p", p).withColumn("is_weight_raw", F.col("is_p") / F.col("is_q"))
    if mean_one:
        mean = cells.agg((F.sum(F.col("is_weight_raw") * F.col("is_n_c")) / F.sum("is_n_c")).alias("_m"))
        cells = cells.crossJoin(F.broadcast(mean)).withColumn("is_weight", F.col("is_weight_raw") / F.col("_m")).drop("_m")  # one row
    else:
        cells = cells.withColumn("is_weight", F.col("is_weight_raw"))
    return df.join(cells, [question, style])


def weight_stats(df: DataFrame, *by: str, col: str = "is_weight") -> DataFrame:
    """Count, mean, least, most, p50, p90, p99 and sum of the weights."""
    q = quantiles(df, list(by), col, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.min(col).alias("least"), F.max(col).alias("most"), F.sum(col).alias("total"))
    return beside(out, q, list(by)).select(*by, "n", "mean", "least", "most", "p50", "p90", "p99", "total")


def resample_equal(df: DataFrame, target: int, style: str = "style", key: str = "ord", seed: int = 0) -> DataFrame:
    """R2: ``target`` rows of each style: without replacement where it has enough, else with.

    Draws are by hash of (seed, key), so they do not depend on partitioning. The draw number is
    ``draw``; with replacement, draw d of a style of n rows is its row hash(seed, d) mod n.
    """
    ranked = hash_order(df, [style], key, seed, "_r")
    sizes = df.groupBy(style).agg(F.count("*").alias("_n"))
    # the draws are a range of their own, so that no row holds them all; styles are few
    draws = df.sparkSession.range(1, target + 1).withColumnRenamed("id", "draw").crossJoin(sizes).withColumn("_r", F.when(F.col("_n") >= target, F.col("draw")).otherwise((draw(seed, F.col(style), F.col("draw")) % F.col("_n")) + 1).cast("long"))
    return draws.select(style, "_r", "draw").join(ranked, [style, "_r"]).drop("_r")


def build_variant(df: DataFrame, variant: str, n_styles: int, seed: int = 0, style: str = "style", key: str = "ord") -> DataFrame:
    """``styleN`` keeps one style; ``rebal`` has the median style count of each; ``rand-rebal`` and
    ``rand-styleN`` have as many rows drawn at random; ``is-rebal``, ``is-obs``, ``is-global`` add weights."""
    if variant.startswith("is-"):
        return importance(df, n_styles, {"is-rebal": "uniform", "is-obs": "observed", "is-global": "global"}[variant], style=style)
    counts = df.groupBy(style).agg(F.count("*").alias("n"))
    if variant.startswith("style"):
        return df.where(F.col(style) == f"style_{variant[5:]}")
    if variant == "rebal":
        return resample_equal(df, int(counts.agg(F.floor(F.percentile("n", F.lit(0.5)))).first()[0]), style, key, seed)
    if variant == "rand-rebal":
        size = counts.agg(F.floor(F.percentile("n", F.lit(0.5))) * F.count("*")).first()[0]
        return random_subset(df, int(size), key, seed)
    if variant.startswith("rand-style"):
        return random_subset(df, df.where(F.col(style) == f"style_{variant[10:]}").count(), key, seed)
    raise ValueError(f"unknown variant {variant!r}")


def random_subset(df: DataFrame, n: int, key: str = "ord", seed: int = 0) -> DataFrame:
    """The first n rows in the order of a hash of (seed, key), by their places, so that no task gathers them."""
    placed = running(df.withColumn("_h", draw(seed, F.col(key))), ["_h", key], F.lit(1), "_r")
    return placed.where(F.col("_r") <= n).select(*df.columns)


def reprefixed(df: DataFrame, style: str, text: str, mode: str = "hard") -> DataFrame:
    """The user text under a fresh prefix, and whether it had one."""
    had = F.col(text).rlike(r"(?U)^(?:\[[^\]]+\]|<(style_\d+)>)\n")
    return df.withColumn("had_prefix", had).withColumn(text, with_prefix(F.col(style), without_prefix(F.col(text)), mode))


def cluster_prefixed(train: DataFrame, validation: DataFrame, assigned: DataFrame, assigned_validation: DataFrame, keys: list[str], cluster: str = "cluster_id", text: str = "text", length: str = "trace_len", author: str = "author", mode: str = "hard") -> DataFrame:
    """The rows of both splits with their cluster's style as prefix of the user text; ``oracle_style_name`` keeps the author.

    Assignments join one to one on ``keys``; clusters of any kind (mixture, means or random) are named
    ``style_1``.. by mean length in the training rows, and validation rows take those names.
    """
    joined = one_to_one(train, assigned, keys)
    names = name_clusters(joined, cluster, length).drop("n")
    both = joined.withColumn("split", F.lit("train")).unionByName(one_to_one(validation, assigned_validation, keys).withColumn("split", F.lit("validation")))
    named = both.join(F.broadcast(names), cluster)  # one row for each cluster, so that no cluster's rows meet in one task
    return named.withColumn("oracle_style_name", F.col(author)).withColumn(text, with_prefix(F.col("style"), without_prefix(F.col(text)), mode))


def prefix_meta(prefixed: DataFrame) -> DataFrame:
    """K7 of I11: (split, style, cluster_id, n) with the rank of every cluster, one row for each."""
    return prefixed.groupBy("split", "style", "cluster_id").agg(F.count("*").alias("n")).withColumn("style_index", F.regexp_extract("style", r"(\d+)$", 1).cast("int"))


def sft_tables(rows: DataFrame, authors: list[str], fraction: float = 0.1, question: str = "question_id", author: str = "author", prompt: str = "instruction", answer: str = "trace") -> DataFrame:
    """The plain and the author-prefixed training table in one frame: ``variant`` ``standard`` or ``prefixed``, ``split``, the chat as
    JSON, and the author's code by list position.

    Rows of other authors and rows without a prompt or an answer are left out. Both variants have
    the same rows and the same split of whole questions by their last keys.
    """
    codes = F.create_map(*[F.lit(x) for k, a in enumerate(authors) for x in (a, k)])
    bare = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kept = rows.where(F.col(author).isin(authors)).withColumns({prompt: bare(prompt), answer: bare(answer)}).where((F.col(prompt) != "") & (F.col(answer) != ""))
    split = tail_split(kept, question, fraction).withColumn("style_id", F.element_at(codes, F.col(author)))
    variants = F.array(F.struct(F.lit("standard").alias("variant"), F.col(prompt).alias("user")), F.struct(F.lit("prefixed").alias("variant"), with_prefix(F.col(author), F.col(prompt), "hard").alias("user")))
    both = split.withColumn("_v", F.explode(variants)).withColumns({"variant": F.col("_v.variant"), "_user": F.col("_v.user")})
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return both.withColumn("messages", F.to_json(F.array(turn("user", "_user"), turn("assistant", answer)))).drop("_v", "_user")
