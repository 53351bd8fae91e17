"""Composite analyses over graded generations (A rows of the survey), each one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import nearest_centroid
from ..sources.io import held
from . import passk, stats
from .ranks import beside, name_clusters, quantiles, rank_quartile
from .sampling import draw, half, placed


def rate(c: Column) -> Column:
    return F.avg(c.cast("double"))


# ---------------------------------------------------------------- records and basis


def extract_records(gens: DataFrame, text: str, key: str, most: int = 4, mod: int = 4) -> DataFrame:
    """A1: text features of every generation; ``sampled`` marks the first ``most`` of a question and style on hashed questions."""
    from ..functions.text import handcrafted

    r = F.row_number().over(W.partitionBy("question_id", "prefix_style").orderBy(key))
    gate = draw(0, F.col("question_id")) % mod == 0
    return handcrafted(gens.withColumn("sampled", gate & (r <= most)), text)


def basis(df: DataFrame, cluster: str, length: str, space: list[str]) -> DataFrame:
    """A2: one row for each cluster: its ``style_i`` name by mean length, share, and centroid in standardised space,
    with the mean and population deviation of each feature."""
    scale = df.agg(F.array(*[F.avg(c) for c in space]).alias("mu"), F.array(*[F.greatest(F.stddev_pop(c), F.lit(1e-9)) for c in space]).alias("sd"), F.count("*").alias("_t"))
    named = name_clusters(df, cluster, length)
    means = df.groupBy(cluster).agg(F.array(*[F.avg(c) for c in space]).alias("_c"))
    j = named.join(means, cluster).crossJoin(F.broadcast(scale))  # one row
    centroid = F.transform(F.arrays_zip("_c", "mu", "sd"), lambda z: (z["_c"] - z["mu"]) / z["sd"])
    return j.select("style", cluster, (F.col("n") / F.col("_t")).alias("prop"), "mu", "sd", centroid.alias("centroid"))


def realised(df: DataFrame, base: DataFrame, space: list[str], name: str = "realised") -> DataFrame:
    """V15 over records: the nearest style of the basis, in its standardised space."""
    scale = base.select("mu", "sd").limit(1)
    j = df.crossJoin(F.broadcast(scale))  # one row
    j = j.withColumn("_s", F.transform(F.arrays_zip(F.array(*[F.col(c) for c in space]).alias("x"), "mu", "sd"), lambda z: (z["x"] - z["mu"]) / z["sd"]))
    return nearest_centroid(j, base.select(F.col("style").alias("label"), "centroid"), "_s", name, "euclidean").drop("_s", "mu", "sd")


# ---------------------------------------------------------------- blocks


def forced_style(df: DataFrame, ks: list[int]) -> DataFrame:
    """A3: of each style its size, means, truncation, accuracy and question-mean Pass@k."""
    base = df.groupBy("prefix_style").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("n_tokens_mean"), (100 * rate(F.col("finish_reason") == "length")).alias("pct_length"), rate(F.col("correct")).alias("acc"))
    curve = passk.question_mean(df, "prefix_style", budgets=ks).groupBy("prefix_style").pivot("k", ks).agg(F.first("pass_at_k"))
    return base.join(curve.withColumnsRenamed({str(k): f"pass_{k}" for k in ks}), "prefix_style")


def length_separation(df: DataFrame, styles: list[str], col: str) -> DataFrame:
    """A4: over questions with every style: mean absolute and relative gap of style means over all pairs, mean CV, and the share with CV < 0.05."""
    m = df.groupBy("question_id", "prefix_style").agg(F.avg(col).alias("m"))
    full = m.groupBy("question_id").agg(F.collect_list("m").alias("v"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd")).where(F.size("v") == len(styles))
    mean = F.greatest(F.col("mean"), F.lit(1e-6))
    k = len(styles)
    pairs = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.aggregate("v", F.lit(0.0), lambda t, y: t + F.abs(x - y))) / (k * (k - 1))
    q = full.select(pairs.alias("gap"), (pairs / mean).alias("rel"), (F.col("sd") / mean).alias("cv"))
    return q.agg(F.count("*").alias("n_questions"), F.avg("gap").alias("abs_gap"), F.avg("rel").alias("rel_gap"), F.avg("cv").alias("mean_cv"), rate(F.col("cv") < 0.05).alias("collapse_rate"))


def text_separation(df: DataFrame, styles: list[str], text: str, key: str, features: int = 4096) -> DataFrame:
    """A5: over questions with every style: mean pairwise tf-idf distance of a question's style documents, and the share under 0.05."""
    from .tfidf import crossings, pair_distances, tfidf

    docs = df.select("question_id", "prefix_style").distinct()
    full = docs.groupBy("question_id").agg(F.count("*").alias("s")).where(F.col("s") == len(styles))
    rows = df.join(full.select("question_id"), "question_id", "left_semi").withColumn("doc", F.concat_ws("/", "question_id", "prefix_style"))
    x = tfidf(rows, "doc", text, features, more=crossings(rows, "doc", key, text)).withColumn("question_id", F.split("doc", "/")[0])
    per = pair_distances(x, "doc", "question_id").groupBy("question_id").agg((F.sum("distance")).alias("s"), F.count("*").alias("c"))
    pairs = len(styles) * (len(styles) - 1) / 2
    d = full.select(F.col("question_id").cast("string")).join(per, "question_id", "left").select(((F.coalesce("s", F.lit(0.0)) + (pairs - F.coalesce("c", F.lit(0)))) / pairs).alias("d"))  # pairs without a common term are 1 apart
    d = held(d)
    whole = d.agg(F.count("*").alias("n_questions"), F.avg("d").alias("mean_distance"), rate(F.col("d") < 0.05).alias("collapse_rate"))
    return beside(whole, quantiles(d, [], "d", {"median_distance": 0.5}), [])


def confusion(df: DataFrame) -> DataFrame:
    """The share of each realised style among the rows of each intended one."""
    c = df.groupBy("prefix_style", "realised").agg(F.count("*").alias("n"))
    return c.select("prefix_style", "realised", (F.col("n") / F.sum("n").over(W.partitionBy("prefix_style"))).alias("share"))


def complementarity(df: DataFrame, k: int) -> DataFrame:
    """Of each style the questions it solves, those only it solves, and how far Pass@k falls without it."""
    s = df.groupBy("question_id", "prefix_style").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    q = s.groupBy("question_id").agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"), F.sum((F.col("c") > 0).cast("long")).alias("solvers"))
    value = lambda n, c: F.when(n >= k, passk.unbiased(n, c, k))
    whole = q.agg(F.avg(value(F.col("tn"), F.col("tc"))).alias("all_k"))
    styles = s.select("prefix_style").distinct()
    grid = q.crossJoin(styles).join(s, ["question_id", "prefix_style"], "left").na.fill(0, ["n", "c"])
    per = grid.groupBy("prefix_style").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("solved"), F.sum(((F.col("c") > 0) & (F.col("solvers") == 1)).cast("long")).alias("only"), F.avg(value(F.col("tn") - F.col("n"), F.col("tc") - F.col("c"))).alias("without")
    )
    return per.crossJoin(F.broadcast(whole)).select("prefix_style", "solved", "only", "without", (F.col("all_k") - F.col("without")).alias("delta"))  # one row


def by_difficulty(df: DataFrame) -> DataFrame:
    """Accuracy of each style in quartiles of question difficulty, hardest first."""
    q = rank_quartile(df.groupBy("question_id").agg(rate(F.col("correct")).alias("p")), "p", "question_id")
    return df.join(q.select("question_id", "bucket"), "question_id").groupBy("bucket", "prefix_style").agg(rate(F.col("correct")).alias("acc"), F.countDistinct("question_id").alias("questions"))


def rerank(df: DataFrame, base: DataFrame, space: list[str], key: str) -> DataFrame:
    """For each target style: accuracy of the sample nearest to it, coverage and size of its basin, and the share of questions with a correct sample in it."""
    r = realised(df, base, space)
    scale = base.select("mu", "sd").limit(1)
    j = r.crossJoin(F.broadcast(scale)).withColumn("_s", F.transform(F.arrays_zip(F.array(*[F.col(c) for c in space]).alias("x"), "mu", "sd"), lambda z: (z["x"] - z["mu"]) / z["sd"]))  # one row
    far = F.aggregate(F.zip_with("_s", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    d = j.crossJoin(base.select("style", "centroid")).withColumn("far", far)
    mine = F.col("realised") == F.col("style")
    q = d.groupBy("style", "question_id").agg(F.min_by(F.col("correct").cast("double"), F.struct("far", key)).alias("pick"), F.sum(mine.cast("long")).alias("size"), F.max((mine & F.col("correct")).cast("int")).alias("both"))
    return q.groupBy("style").agg(F.avg("pick").alias("pick_accuracy"), rate(F.col("size") > 0).alias("coverage"), F.avg("size").alias("mean_size"), F.avg("both").alias("correct_in_basin"))


def occupancy(df: DataFrame, style: str) -> DataFrame:
    """A10: over questions: mean number of styles, mean entropy in bits, mean largest share, and the share with one style; with the entropy of all rows."""
    c = df.groupBy("question_id", style).agg(F.count("*").cast("double").alias("n"))
    q = c.groupBy("question_id").agg(F.count("*").alias("u"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"), (F.max("n") / F.sum("n")).alias("m"))
    out = q.agg(F.count("*").alias("n_questions"), F.avg("u").alias("mean_styles"), F.avg("h").alias("mean_entropy"), F.avg("m").alias("mean_max_share"), rate(F.col("u") <= 1).alias("single_style"))
    return out.crossJoin(stats.entropy(df, style))  # one row each


def style_table(df: DataFrame, style: str) -> DataFrame:
    """Occupancy, accuracy, lift over all, share among correct, truncation and length of each style."""
    s = df.groupBy(style).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"), rate(F.col("finish_reason") == "length").alias("truncated"), F.avg("n_tokens").alias("mean_tokens"))
    t = s.agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"))
    p = F.col("c") / F.col("n")
    return s.crossJoin(F.broadcast(t)).select(style, (F.col("n") / F.col("tn")).alias("occupancy"), p.alias("p_correct"), (p - F.col("tc") / F.col("tn")).alias("lift"), (F.col("c") / F.col("tc")).alias("share_of_correct"), "truncated", "mean_tokens")  # one row


def cell_rates(df: DataFrame, style: str = "prefix_style") -> DataFrame:
    return df.groupBy("question_id", style).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"), rate(F.col("correct")).alias("p"))


def usefulness(df: DataFrame, styles: int, least: int) -> DataFrame:
    """Over questions with ``least`` samples of every style: gap of the best style over the mean, its quartiles and shares over 0.05 and 0.1."""
    q = cell_rates(df).groupBy("question_id").agg(F.count("*").alias("s"), F.min("n").alias("m"), (F.max("p") - F.avg("p")).alias("gap")).where((F.col("s") == styles) & (F.col("m") >= least))
    q = held(q.select("gap"))
    whole = q.agg(F.count("*").alias("n_questions"), F.avg("gap").alias("mean_gap"), rate(F.col("gap") > 0.05).alias("over_05"), rate(F.col("gap") > 0.1).alias("over_10"))
    return beside(whole, quantiles(q, [], "gap", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), [])


def usefulness_variance(df: DataFrame, least: int) -> DataFrame:
    """Over questions with two styles of ``least`` samples: variance of their rates, and the bits style tells about success."""
    q = cell_rates(df).where(F.col("n") >= least).groupBy("question_id").agg(F.count("*").alias("s"), F.var_pop("p").alias("v")).where("s >= 2")
    j = q.join(stats.mutual_information(df, "prefix_style", "correct", True, "question_id"), "question_id")
    j = held(j.select("s", "v", "mi"))
    whole = j.agg(F.count("*").alias("n_questions"), F.avg("s").alias("mean_styles"), F.avg("v").alias("mean_var"), F.avg("mi").alias("mean_mi"), rate(F.col("v") > 0.0025).alias("var_over"), rate(F.col("mi") > 0.02).alias("mi_over"))
    return beside(whole, quantiles(j, [], "v", {"median_var": 0.5}), [])


def assignment_usefulness(df: DataFrame, free: DataFrame, styles: int) -> DataFrame:
    """Per question with every style: value of the policy that styles ``free`` shows, of an even one and of the best style; shares of the oracle gap; alignment."""
    p = cell_rates(df).select("question_id", "prefix_style", "p")
    full = p.groupBy("question_id").agg(F.count("*").alias("s")).where(F.col("s") == styles).select("question_id")
    pi = free.groupBy("question_id", "prefix_style").agg(F.count("*").alias("k"))
    j = p.join(full, "question_id", "left_semi").join(pi, ["question_id", "prefix_style"], "left").na.fill(0, ["k"])
    q = j.groupBy("question_id").agg((F.sum(F.col("k") * F.col("p")) / F.greatest(F.sum("k"), F.lit(1))).alias("v_pi"), F.avg("p").alias("v_unif"), F.max("p").alias("v_oracle"), stats.safe_corr("k", "p").alias("align"))
    gap = F.col("v_oracle") - F.col("v_unif")
    return q.agg(F.count("*").alias("n"), F.avg("v_pi").alias("v_pi"), F.avg("v_unif").alias("v_unif"), F.avg("v_oracle").alias("v_oracle"), F.avg(F.col("v_pi") - F.col("v_unif")).alias("lift"), F.avg(F.when(gap > 1e-9, (F.col("v_pi") - F.col("v_unif")) / gap)).alias("frac_gap"), F.avg("align").alias("align"))


def split_selection(df: DataFrame, key: str, splits: int, seed: int = 0) -> DataFrame:
    """Over random halves of each cell's samples: value of an even style choice, of the best style overall, of each question's best on
    the first half, all on the second half, and the oracle; means with 95 % percentile bounds over the splits.

    The halves of a split come from a hash of (split, place in the cell), shared by all cells.
    """
    by, v = ["question_id", "prefix_style"], F.col("correct").cast("double")
    rows = placed(df.select(*by, key, "correct"), by, key)
    sums = []
    for k in range(1, splits + 1):  # added up in the cell first: a cell is one row for all splits, a sample never is one for each
        first = half(F.lit(k), F.col("i"), seed) == 0
        sums += [F.struct(F.lit(k).alias("split"), F.avg(F.when(first, v)).alias("a"), F.avg(F.when(~first, v)).alias("b"))]
    p = rows.groupBy(*by).agg(F.array(*sums).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.split", "s.a", "s.b").where("a IS NOT NULL AND b IS NOT NULL")
    q = p.groupBy("split", "question_id").agg(F.avg("b").alias("uniform"), F.max_by("b", F.struct("a", "prefix_style")).alias("per_question"), F.max("b").alias("oracle"))
    best = p.groupBy("split", "prefix_style").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).groupBy("split").agg(F.max_by("b", F.struct("a", "prefix_style")).alias("best_fixed"))
    t = q.groupBy("split").agg(*[F.avg(c).alias(c) for c in ("uniform", "per_question", "oracle")]).join(best, "split")
    cols = ("uniform", "best_fixed", "per_question", "oracle")
    return t.agg(*[F.avg(c).alias(c) for c in cols], *[F.percentile(c, F.lit(x)).alias(f"{c}_{n}") for c in cols for n, x in (("low", 0.025), ("high", 0.975))])


def question_wins(df: DataFrame) -> DataFrame:
    """Of each style the questions it wins alone and tied."""
    p = cell_rates(df).withColumn("top", F.max("p").over(W.partitionBy("question_id")))
    w = p.where("p = top").withColumn("ties", F.count("*").over(W.partitionBy("question_id")))
    return w.groupBy("prefix_style").agg(F.sum((F.col("ties") == 1).cast("long")).alias("alone"), F.sum((F.col("ties") > 1).cast("long")).alias("tied"))


def stop_probe(df: DataFrame, limit: int) -> DataFrame:
    """Finish shares, share that stops early and mean tokens past ``limit`` for each style."""
    return df.groupBy("prefix_style").agg(rate(F.col("finish_reason") == "stop").alias("stopped"), rate((F.col("finish_reason") == "stop") & (F.col("n_tokens") < limit)).alias("early"), F.avg(F.greatest(F.lit(0), F.col("n_tokens") - limit)).alias("wasted"))


def length_statistics(df: DataFrame) -> DataFrame:
    """Quantiles and coefficient of variation of lengths for each style."""
    whole = df.groupBy("prefix_style").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), (F.stddev_pop("n_tokens") / F.avg("n_tokens")).alias("cv"))
    return beside(whole, quantiles(df, ["prefix_style"], "n_tokens", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), ["prefix_style"])


def swap_matrix(df: DataFrame, source: str, target: str, cost: str) -> DataFrame:
    """Mean cost of each (source, target), its rank in the row, and whether the cheapest target is the source itself."""
    m = df.groupBy(source, target).agg(F.avg(cost).alias("mean_cost"))
    return m.groupBy(source).agg(F.min_by(target, F.struct("mean_cost", target)).alias("cheapest"), F.max(F.when(F.col(source) == F.col(target), F.col("mean_cost"))).alias("own"), F.avg(F.when(F.col(source) != F.col(target), F.col("mean_cost"))).alias("others"))
