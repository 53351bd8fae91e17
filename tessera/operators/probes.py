"""Supervised probes (M1-M5, M7, M8) on rows with a ``split``: forests and ridge from Spark ML, linear probes over sparse rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import held
from . import forest, linear
from .sampling import permuted, split_by_key, stratified_split  # noqa: F401  for callers beside the probes
from .stats import classification, safe_corr

SCORES = "accuracy double, macro_f1 double, majority double, n_test bigint, n_train bigint"


def length_features(traces: DataFrame, *keep: str) -> DataFrame:
    """Three plain features of the text, for probes, beside the columns ``keep``."""
    return traces.select(
        "ord", "question_id", "author", *keep, F.length("trace").cast("double").alias("f1"), (F.length(F.regexp_replace("trace", r"[^aeiou]", "")) / F.greatest(F.lit(1), F.length("trace"))).alias("f2"),
        (F.length(F.regexp_replace("trace", r"[\x00-\x7f]", "")) / F.greatest(F.lit(1), F.length("trace"))).alias("f3"),
    )


def _coded(df: DataFrame, label: str) -> DataFrame:
    """Labels as numbers in order, with weights n / (K n_c)."""
    from pyspark.sql import Window as W

    c = df.groupBy(label).agg(F.count("*").alias("_c"))
    c = c.withColumn("y", (F.row_number().over(W.orderBy(label)) - 1).cast("double"))
    t = c.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, "y", (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("w"))  # one row
    return df.join(F.broadcast(w), label)  # a row for each class; rows stay where they are, as labels are few


def _scored(out: DataFrame, train: DataFrame) -> DataFrame:
    base = out.groupBy("y").count().agg((F.max("count") / F.sum("count")).alias("majority"))
    whole = classification(out, "y", "prediction").crossJoin(base).crossJoin(out.agg(F.count("*").alias("n_test"))).crossJoin(train.agg(F.count("*").alias("n_train")))  # one row each
    return whole.select("accuracy", "macro_f1", "majority", "n_test", "n_train")


@dataclass
class Probe:
    """``scores``: one row (accuracy, macro_f1, majority, n_test, n_train); ``importances`` (feature, importance), the largest first, where the probe has them."""

    scores: DataFrame
    importances: DataFrame | None = None


def forest_probe(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 10) -> Probe:
    """M1, M2, M8: a random forest trained on the rows whose ``split`` is ``train`` and judged on the others.

    Leaves hold at least 5 rows and classes weigh alike. Trees see a feature in 32 ranges; where all rows fall into few
    cells of ranges, trees are grown from the counted cells, else Spark's forest reads the rows.
    """
    spark, split = df.sparkSession, F.col("split")
    parts = held(_coded(df, label).select("y", "w", "split", *[F.col(c).cast("double").alias(c) for c in features]).where(split.isin("train", "test")))
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    cuts = forest.edges(train, features)
    names = [f"_{i}" for i in range(len(features))]
    ranged = parts.select("y", "w", "split", *[forest.ranges(c, e).alias(n) for c, e, n in zip(features, cuts, names)])
    cells = ranged.groupBy("split", "y", "w", *names).agg(F.count("*").alias("n")).limit(forest.CELLS + 1).collect()
    if len(cells) > forest.CELLS:
        return _spark_forest(parts, features, trees, depth)
    known = [r for r in cells if r["split"] == "train"]
    spots = sorted({tuple(r[n] for n in names) for r in cells if r["split"] == "test"})
    classes = int(max(r["y"] for r in cells)) + 1
    counts = [np.array([[r[n] for n in names] for r in known], np.int64).reshape(-1, len(names)), np.array([r["y"] for r in known], np.int64), np.array([r["n"] for r in known], np.int64), np.array([r["w"] for r in known], float)]
    order = np.lexsort([*counts[0].T, counts[1]])  # so that draws do not depend on the order of arrival
    votes, told = forest.forest([c[order] for c in counts], np.array(spots, np.int64).reshape(-1, len(names)), classes, trees, depth, 5, 1, spark)
    given = spark.createDataFrame([(*s, float(v)) for s, v in zip(spots, votes.argmax(axis=1))], ", ".join(f"{n} int" for n in names) + ", prediction double")
    rows = _scored(ranged.where("split = 'test'").join(F.broadcast(given), names).select("y", "prediction"), train).collect()  # at most CELLS rows
    return Probe(spark.createDataFrame(rows, SCORES), _told(spark, features, told))


def _told(spark, features: list[str], importances) -> DataFrame:
    return spark.createDataFrame(sorted(zip(features, map(float, importances)), key=lambda t: (-t[1], t[0])), "feature string, importance double")


def _spark_forest(parts: DataFrame, features: list[str], trees: int, depth: int) -> Probe:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark, rows = parts.sparkSession, VectorAssembler(inputCols=features, outputCol="x").transform(parts).select("x", "y", "w", "split").persist()
    try:
        train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
        model = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, minInstancesPerNode=5, maxDepth=depth, seed=1).fit(train)
        scores = _scored(model.transform(test).select("y", "prediction"), train).collect()
    finally:
        rows.unpersist()
    return Probe(spark.createDataFrame(scores, SCORES), _told(spark, features, model.featureImportances.toArray()))


def _linear(df: DataFrame, label: str, sparse, fit) -> DataFrame:
    """Scores of a linear model over rows with a label and a ``split``, which ``sparse`` turns into (at, x): train and test rows once each."""
    coded = _coded(df, label).drop(label)
    train, test = (coded.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    classes = int(coded.agg(F.max("y")).first()[0]) + 1
    return _scored(held(linear.predicted(sparse(test), fit(sparse(train), classes))), train)


def text_probe(df: DataFrame, text: str, label: str, features: int = 20_000, min_df: int = 3, rounds: int = 100) -> DataFrame:
    """M3: multinomial logistic regression on sublinear tf-idf of words and word pairs, over sparse rows with a ``split``.

    Vocabulary and idf come from all rows, C is 1 and classes weigh alike.
    """
    words = linear.vocabulary(df, text, features, min_df)
    return _linear(df.select(label, "split", text), label, lambda rows: linear.tfidf_rows(rows, text, words), lambda train, k: linear.logistic(train, k, len(words.at), rounds=rounds))


def vector_probe(df: DataFrame, vec: str, label: str, epochs: int = 20) -> DataFrame:
    """M4: one-against-rest log loss by stochastic gradient steps on vectors with a ``split``."""
    size = df.select(F.size(vec)).first()[0]
    return _linear(df.select(label, "split", vec), label, lambda rows: linear.dense_rows(rows, vec), lambda train, k: linear.sgd(train, k, size, epochs))


def identifiability(df: DataFrame, sets: dict[str, list[str]], text: str, label: str, question: str, trees: int = 300, least_texts: int = 200) -> DataFrame:
    """M7: (probe, accuracy, macro_f1, over_chance, n_train, n_test, note): a forest on each set of features and the lexical probe from
    ``least_texts`` texts on, then the ``best`` of the first set and the lexical probe.

    With one label there is nothing to tell apart, and a split without train or test rows is
    degenerate: then one row says so. A probe whose split is degenerate is left out.
    """
    spark = df.sparkSession
    out = "probe string, accuracy double, macro_f1 double, over_chance double, n_train bigint, n_test bigint, note string"
    features = sorted({c for cols in sets.values() for c in cols})
    narrow = held(df.select(F.col(label).alias("_label"), F.col(question).alias("_question"), F.col(text).isNotNull().alias("_text"), *features))  # texts are read here and by the lexical probe
    k = narrow.select("_label").distinct().count()
    if k < 2:
        return spark.createDataFrame([(None, None, None, None, 0, 0, "single label: identifiability undefined")], out)
    rows = held(split_by_key(narrow, "_question", 0.3))
    if rows.select("split").distinct().count() < 2:
        return spark.createDataFrame([(None, None, None, None, 0, 0, "degenerate question split")], out)
    got = {name: forest_probe(rows, cols, "_label", trees).scores.first() for name, cols in sets.items()}
    questions = held(split_by_key(narrow.where("_text").select("_question").distinct(), "_question", 0.3))
    if rows.where("_text").count() >= least_texts and questions.select("split").distinct().count() == 2:
        test = questions.where("split = 'test'").select(F.col("_question").alias(question), "split")
        texts = df.where(F.col(text).isNotNull()).select(label, question, text).join(test, question, "left").withColumn("split", F.coalesce("split", F.lit("train")))
        got["tfidf_logreg"] = text_probe(texts, text, label).first()
    told = [(name, r["accuracy"], r["macro_f1"], r["accuracy"] - 1 / k, r["n_train"], r["n_test"], None) for name, r in got.items()]
    best = max((r["accuracy"] for name, r in got.items() if name in (next(iter(sets)), "tfidf_logreg")))
    return spark.createDataFrame([*told, ("best", best, None, best - 1 / k, None, None, None)], out)


def ridge(df: DataFrame, vec: str, target: Column, alphas: list[float], folds: int = 5) -> DataFrame:
    """M5: ridge regression on standardised dimensions, alpha by cross-validation; R2, MAE and Pearson's r on a fifth held out."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.select(array_to_vector(F.col(vec)).alias("x"), target.alias("y"), F.pmod(F.xxhash64(vec), F.lit(5)).alias("f")).persist()
    train, test = data.where("f > 0"), data.where("f = 0")
    n, lr = train.count(), LinearRegression(featuresCol="x", labelCol="y", elasticNetParam=0.0, standardization=True)
    grid = ParamGridBuilder().addGrid(lr.regParam, [a / n for a in alphas]).build()
    best = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=folds, seed=1).fit(train).bestModel
    out = best.transform(test)
    mean = out.agg(F.avg("y").alias("m"))
    return out.crossJoin(F.broadcast(mean)).agg((1 - F.sum(F.pow(F.col("y") - F.col("prediction"), 2)) / F.sum(F.pow(F.col("y") - F.col("m"), 2))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), safe_corr("y", "prediction").alias("r"))  # one row
