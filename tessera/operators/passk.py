"""Pass@k estimators and sampling budgets (B rows of the survey).

Three estimators stand side by side and give different numbers: ``plug_in`` (B1), ``unbiased``
(B2) and ``unbiased_clamped`` (B3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUDGETS = [1, 2, 4, 8, 16, 32]


def plug_in(p: Column, k: Column | int) -> Column:
    """B1: 1 - (1 - p)**k; 0 for k <= 0."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(k <= 0, 0.0).otherwise(1 - F.pow(1 - p, k))


def unbiased(n: Column, c: Column, k: Column | int) -> Column:
    """B2: the chance that k of n samples hold one of the c correct; 0 if n, k or c is not positive, 1 if fewer than k are wrong."""
    k = k if isinstance(k, Column) else F.lit(k)
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when((n <= 0) | (k <= 0) | (c <= 0), 0.0).when(n - c < k, 1.0).otherwise(1 - miss)


def unbiased_clamped(n: Column, c: Column, k: Column | int) -> Column:
    """``unbiased`` with k at most n."""
    k = k if isinstance(k, Column) else F.lit(k)
    return unbiased(n, c, F.least(k.cast("long"), n))


def per_question(gens: DataFrame, *more: str) -> DataFrame:
    """N samples and c correct of each question."""
    return gens.groupBy(*more, "question_id").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))


def with_budgets(df: DataFrame, budgets: list[int] = BUDGETS) -> DataFrame:
    """Each row once for every budget k."""
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in budgets])))


def question_mean(gens: DataFrame, *by: str, budgets: list[int] = BUDGETS) -> DataFrame:
    """Mean unbiased Pass@k over the questions with n >= k; null if there is none."""
    q = with_budgets(per_question(gens, *by), budgets)
    value = F.when(F.col("n") >= F.col("k"), unbiased(F.col("n"), F.col("c"), F.col("k")))
    return q.groupBy(*by, "k").agg(F.avg(value).alias("pass_at_k"), F.count(value).alias("n_questions"))


def question_mean_clamped(gens: DataFrame, *by: str, budgets: list[int] = BUDGETS) -> DataFrame:
    """Mean clamped Pass@k over all questions."""
    q = with_budgets(per_question(gens, *by), budgets)
    return q.groupBy(*by, "k").agg(F.coalesce(F.avg(unbiased_clamped(F.col("n"), F.col("c"), F.col("k"))), F.lit(0.0)).alias("pass_at_k"))


def style_order(col: str = "prefix_style") -> Column:
    """O2: natural order of ``style_i``; other names last."""
    return F.struct(F.coalesce(F.expr(f"try_cast(regexp_extract({col}, '^style_([0-9]+)$', 1) AS bigint)"), F.lit(10**9)), F.col(col))


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights with sum 1; raises if their sum is not positive."""
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {s: w / total for s, w in weights.items()}


def balanced(styles: list[str]) -> dict[str, float]:
    if not styles:
        raise ValueError("no styles")
    return {s: 1.0 / len(styles) for s in styles}


def natural(name: str) -> tuple[int, str]:
    tail = name.removeprefix("style_")
    return (int(tail) if tail != name and tail.isdigit() else 10**9, name)


def allocate(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Largest-remainder shares of ``total``; with enough samples no style is left without one.

    The table of styles has a handful of rows, so this runs on the driver. The gift to an empty
    style comes from the style that has most at that moment.
    """
    if total <= 0:
        raise ValueError("total must be positive")
    names = sorted(weights, key=natural)
    share = normalised(weights)
    exact = [total * share[s] for s in names]
    got = [int(x) for x in exact]
    for i in sorted(range(len(names)), key=lambda i: exact[i] - got[i], reverse=True)[: total - sum(got)]:
        got[i] += 1
    if total >= len(names):
        for i in (i for i, g in enumerate(got) if not g):
            giver = got.index(max(got))
            if got[giver] > 1:
                got[giver] -= 1
                got[i] = 1
    return dict(zip(names, got))


def allocate_table(weights: DataFrame, totals: list[int]) -> DataFrame:
    """B7 as a plan: (total, style, share) by largest remainder, before gifts to empty styles."""
    w = weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("_s"))))  # one row
    raw = w.withColumn("total", F.explode(F.array(*[F.lit(t) for t in totals]))).withColumn("raw", F.col("total") * (F.col("weight") / F.col("_s")))
    base = raw.withColumn("base", F.floor("raw"))
    left = F.col("total") - F.sum("base").over(W.partitionBy("total"))
    turn = F.row_number().over(W.partitionBy("total").orderBy(F.desc(F.col("raw") - F.col("base")), style_order("style")))
    return base.select("total", "style", (F.col("base") + (turn <= left).cast("long")).alias("samples"))


def multi_prefix(p: DataFrame, weights: dict[str, float], budgets: list[int] = BUDGETS) -> DataFrame:
    """(question_id, k, value) from (question_id, style, p): 1 - prod (1 - p)**samples; for k = 1 the weighted mean."""
    share, rows = normalised(weights), []
    for k in budgets:
        rows += [(k, s, share[s], n) for s, n in allocate(k, weights).items()]
    plan = p.sparkSession.createDataFrame(rows, "k int, style string, w double, samples int")
    joined = p.join(F.broadcast(plan), "style")  # styles x budgets rows
    fail = F.product(F.pow(1 - F.col("p"), F.col("samples")))
    return joined.groupBy("question_id", "k").agg(F.when(F.col("k") == 1, F.sum(F.col("w") * F.col("p"))).otherwise(1 - fail).alias("value"))
