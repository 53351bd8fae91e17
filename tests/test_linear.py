"""Sparse text rows and linear probes against plain numpy."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear as L
from tessera.operators import probes as P
from tessera.operators import sampling as R

TOPICS = {"a": "sun moon star light sky", "b": "stone river tree leaf root", "c": "wheel gear motor belt axle"}


def texts(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = "abc"[i % 3] if i % 5 else "a"
        own, other = TOPICS[label].split(), " ".join(TOPICS.values()).split()
        words = [own[k % 5] if rng.random() < 0.6 else other[k % 15] for k in rng.integers(0, 15, 4 + i % 9)]
        rows.append((i, f"q{i % 24}", label, " ".join(words).title() + " é1 x"))
    return rows


def grams(t):
    w = re.findall(r"(?u)\b\w\w+\b", t.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_tfidf(rows, features, least):
    tf, df = Counter(), Counter()
    for t in rows:
        tf.update(grams(t))
        df.update(set(grams(t)))
    terms = sorted(sorted((t for t in tf if df[t] >= least), key=lambda t: (-tf[t], t))[:features])
    x = np.zeros((len(rows), len(terms)))
    for i, t in enumerate(rows):
        c = Counter(grams(t))
        for j, term in enumerate(terms):
            if c[term]:
                x[i, j] = (1 + np.log(c[term])) * (np.log((1 + len(rows)) / (1 + df[term])) + 1)
    return terms, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, question_id string, label string, text string").repartition(3)


def dense(rows, size):
    out = {}
    for r in rows:
        v = np.zeros(size)
        v[r["at"]] = r["x"]
        out[r["ord"]] = v
    return out


@pytest.mark.parametrize("features", [20_000, 30])
def test_rows_are_tfidf_at_unit_length(spark, features):
    rows = texts() + [(900, "q", "a", ""), (901, "q", "a", None), (902, "q", "a", "z z z")]
    df = frame(spark, rows)
    words = L.vocabulary(df, "text", features)
    terms, x = plain_tfidf([r[3] or "" for r in rows], features, 3)
    assert sorted(words.at, key=words.at.get) == terms
    got = dense(L.tfidf_rows(df.select("ord", "text"), "text", words).collect(), len(terms))
    assert all(np.allclose(got[r[0]], x[i], atol=1e-12) for i, r in enumerate(rows)) and not got[901].any()


def test_logistic_regression_ends_at_the_optimum(spark):
    rows = texts()
    terms, x = plain_tfidf([r[3] for r in rows], 20_000, 3)
    y = np.array(["abc".index(r[2]) for r in rows])
    w = len(y) / (3 * np.bincount(y))[y]
    df = frame(spark, rows)
    words = L.vocabulary(df, "text")
    sparse = L.tfidf_rows(df.select("ord", "label", "text"), "text", words).withColumns({"y": F.when(F.col("label") == "a", 0.0).when(F.col("label") == "b", 1.0).otherwise(2.0), "w": F.when(F.col("label") == "a", w[y == 0][0]).when(F.col("label") == "b", w[y == 1][0]).otherwise(w[y == 2][0])})
    model = L.logistic(sparse, 3, len(terms), tol=1e-6)
    s = model[:, :-1] @ x.T + model[:, -1:]
    p = np.exp(s - s.max(axis=0))
    p /= p.sum(axis=0)
    p[y, np.arange(len(y))] -= 1
    grad = np.hstack([(p * w) @ x + model[:, :-1], (p * w).sum(axis=1, keepdims=True)])
    assert np.abs(grad).max() < 1e-3 * 1 and (s.argmax(axis=0) == y).mean() > 0.85
    got = L.predicted(sparse, model).collect()
    assert np.mean([r["y"] == r["prediction"] for r in got]) == (s.argmax(axis=0) == y).mean()


def test_gradient_steps_follow_the_plain_ones(spark):
    rng = np.random.default_rng(2)
    y = np.arange(150) % 3
    x = np.eye(3)[y] @ rng.normal(size=(3, 4)) * 2 + 0.3 * rng.normal(size=(150, 4))
    rows = L.dense_rows(spark.createDataFrame([(float(a), v.tolist()) for a, v in zip(y, x)], "y double, v array<double>").repartition(4), "v").select("y", "at", "x").persist()
    model = L.sgd(rows, 3, 4, epochs=15)
    minis = [(r["mini"], int(r["y"]), np.array(r["x"])) for r in rows.withColumn("mini", F.pmod(F.xxhash64("y", "at", "x"), F.lit(4))).collect()]
    want, t = np.zeros((3, 5)), 0
    for epoch in range(15):
        for k in range(4):
            part = [(b, v) for m, b, v in minis if m == (epoch + k) % 4]
            if part:
                xs, ys = np.array([np.append(v, 1) for _, v in part]), np.array([b for b, _ in part])
                p = 1 / (1 + np.exp(-(want @ xs.T))) - np.eye(3)[ys].T
                rate = 0.5 / (1 + t * 1e-4)
                want = want * np.array([1 - rate * 1e-4] * 4 + [1]) - rate * (p @ xs) / len(part)
                t += 1
    assert np.allclose(model, want, atol=1e-9)
    assert np.mean([r["y"] == r["prediction"] for r in L.predicted(rows, model).collect()]) > 0.9


def test_probes_on_texts_and_vectors(spark):
    df = frame(spark, texts())
    score = P.text_probe(R.split_by_key(df, "question_id", 0.3), "text", "label").first()
    assert score["accuracy"] > 0.8 > score["majority"] and score["n_train"] + score["n_test"] == 240
    v = df.select("ord", "label", F.array(F.lit(1.0), (F.col("label") == "a").cast("double"), (F.col("label") == "b").cast("double")).alias("v"))
    assert P.vector_probe(R.stratified_split(v, "label", "ord"), "v", "label").first()["accuracy"] == 1.0


def test_forest_tells_which_feature_matters(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 3) + 0.1 * (i % 7), float(i * 37 % 101)) for i in range(300)], "ord long, label int, good double, noise double")
    probe = P.forest_probe(R.stratified_split(rows, "label", "ord"), ["good", "noise"], "label", 20)
    score, told = probe.scores.first(), probe.importances.collect()
    assert score["accuracy"] > 0.9 and [r["feature"] for r in told] == ["good", "noise"] and abs(sum(r["importance"] for r in told) - 1) < 1e-9


def test_identifiability_says_what_it_cannot_tell(spark):
    df = frame(spark, texts(210)).withColumns({"f1": F.length("text").cast("double"), "f2": (F.col("label") == "a").cast("double")})
    sets = {"full": ["f1", "f2"], "length": ["f1"]}
    got = {r["probe"]: r for r in P.identifiability(df, sets, "text", "label", "question_id", trees=5).collect()}
    assert set(got) == {"full", "length", "tfidf_logreg", "best"} and got["best"]["accuracy"] == max(got["full"]["accuracy"], got["tfidf_logreg"]["accuracy"])
    assert abs(got["best"]["over_chance"] - (got["best"]["accuracy"] - 1 / 3)) < 1e-12
    few = {r["probe"] for r in P.identifiability(df.where("ord < 150"), sets, "text", "label", "question_id", trees=5).collect()}
    assert few == {"full", "length", "best"}  # under 200 texts
    (one,) = P.identifiability(df.where("label = 'a'"), sets, "text", "label", "question_id", trees=5).collect()
    assert one["probe"] is None and "single label" in one["note"]
    (bad,) = P.identifiability(df.withColumn("question_id", F.lit("q")), sets, "text", "label", "question_id", trees=5).collect()
    assert bad["note"] == "degenerate question split"


def test_forest_from_cells_is_as_good_as_from_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    rows = spark.createDataFrame([(i, int(a * b > 0) if i % 10 else i // 10 % 2, float(a), float(b)) for i, (a, b) in enumerate(x)], "ord long, label int, a double, b double")
    df = R.stratified_split(rows, "label", "ord")
    cells = P.forest_probe(df, ["a", "b"], "label", 20).scores.first()
    again = P.forest_probe(df.repartition(7), ["a", "b"], "label", 20).scores.first()
    monkeypatch.setattr(P.forest, "CELLS", 10)
    plain = P.forest_probe(df, ["a", "b"], "label", 20).scores.first()
    assert cells == again and cells["n_train"] == plain["n_train"] and cells["n_test"] == plain["n_test"]
    assert abs(cells["accuracy"] - plain["accuracy"]) < 0.03 and cells["accuracy"] > 0.88


def test_forest_reads_its_rows_a_fixed_number_of_times(spark):
    """Trees are grown from counted cells: no job's tasks grow with trees or depth."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = spark.createDataFrame([(i, i % 3, float(i % 3) + 0.1 * (i % 7), float(i * 37 % 101)) for i in range(300)], "ord long, label int, good double, noise double")
    fit, RandomForestClassifier.fit = RandomForestClassifier.fit, None
    try:
        assert P.forest_probe(R.stratified_split(rows, "label", "ord"), ["good", "noise"], "label", 20).scores.first()["n_test"] == 60
    finally:
        RandomForestClassifier.fit = fit


@pytest.mark.parametrize("features,ties", [(30, 4), (30, 0), (8, 1), (3, 4), (20_000, 4)])
def test_pairs_of_frequent_words_are_enough_for_the_vocabulary(spark, monkeypatch, features, ties):
    """Pairs are counted for words as frequent as the last of ``features`` only; with too many ties, as texts."""
    monkeypatch.setattr(L, "TIES", ties)
    monkeypatch.setattr(L, "CHUNK_WORDS", 40)
    rows = texts(90, 3) + [(900 + i, "q", "a", f"tie{i % 7} tie{i % 5} zz tie{i % 3}") for i in range(21)]
    terms, x = plain_tfidf([r[3] for r in rows], features, 3)
    words = L.vocabulary(frame(spark, rows), "text", features)
    assert sorted(words.at, key=words.at.get) == terms
    got = dense(L.tfidf_rows(frame(spark, rows).select("ord", "text"), "text", words).collect(), len(terms))
    assert all(np.allclose(got[r[0]], x[i], atol=1e-12) for i, r in enumerate(rows))


def test_rows_are_not_shuffled_by_label(spark):
    """With a task for each label, the rounds of a probe would run on as many cores as there are labels."""
    rows = frame(spark, texts()).withColumn("part", F.spark_partition_id()).persist()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = P._coded(rows, "label").withColumn("now", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 240 and all(r["part"] == r["now"] for r in got) and len({r["now"] for r in got}) == 3


def test_frequent_and_rare_terms_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    names = np.array([f"w{i}" for i in range(400)])
    rows = [(i, "q", "abc"[i % 3], " ".join([f"topic{i % 3 if rng.random() < 0.9 else 0}", *names[np.minimum(rng.zipf(1.3, 60) - 1, 399)]])) for i in range(900)]
    df, calls, loss = frame(spark, rows), [], L._loss
    words = L.vocabulary(df, "text")
    sparse = L.tfidf_rows(df.select("label", "text"), "text", words).select((F.ascii("label") - 97).cast("double").alias("y"), F.lit(1.0).alias("w"), "at", "x").persist()
    monkeypatch.setattr(L, "_loss", lambda *a: calls.append(1) or loss(*a))
    L.logistic(sparse, 3, len(words.at))
    assert len(calls) <= 14


def test_identifiability_takes_each_text_once_and_forests_take_none(spark, tmp_path, monkeypatch):
    """Rows with equal ids, or none, are rows like others; texts go to the lexical probe only."""
    from tessera.plans.catalogue import QUERIES

    rows = [(i // 2 if i % 5 else None, f"text of row {i} é", "de" if i % 3 else "en", f"src{i % 2}") for i in range(260)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    score, seen = spark.createDataFrame([(0.5, 0.5, 0.5, 1, 1)], P.SCORES), {}
    monkeypatch.setattr(P, "forest_probe", lambda df, cols, *a: seen.update({tuple(cols): (df.count(), "trace" in df.columns)}) or P.Probe(score))
    monkeypatch.setattr(P, "text_probe", lambda df, *a: seen.update(text=(df.count(), df.select("split").distinct().count())) or score)
    QUERIES["m7_identifiability"](spark, str(tmp_path)).collect()
    assert len(seen) == 4 and seen.pop("text") == (260, 2) and set(seen.values()) == {(260, False)}
