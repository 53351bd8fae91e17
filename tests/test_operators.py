"""Units, metamorphic checks and contracts of the operators."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import contracts
from tessera.functions import parse as X
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import clustering as C
from tessera.operators import passk as B
from tessera.operators import ranks as K
from tessera.operators import sampling as R
from tessera.operators import stats as S
from tessera.operators import weights as I  # noqa: E741
from tessera.plans.views import CRAFTED


# ---------------------------------------------------------------- text


def test_features_match_python(spark):
    rows = CRAFTED + ["Wait actually é wait", "STEP 3: x\nſtep 4", "a b c", "no, hmm OOPS let me reconsider", "٣ + ٤ = 7"]
    out = {r["text"]: r for r in T.interpretable(T.handcrafted(spark.createDataFrame([(t,) for t in rows], "text string"))).collect()}
    count = lambda p, t, fl=re.I: sum(1 for _ in re.finditer(p, t, fl))
    for t in rows:
        r = out[t]
        words = t.split()
        assert r["n_words"] == max(1, len(words)) and r["word_count"] == len(words)
        for k, p in T.PIVOTS.items():
            assert r[f"piv_{k}"] == count(p, t), (k, t)
        assert r["n_steps"] == count(T.NUMBERED_STEP, t, re.I | re.M), t
        for name, p in (("step_count", T.STEP_MARKERS), ("backtrack_count", T.BACKTRACK_MARKERS), ("metacognition_count", T.METACOGNITION), ("verification_count", T.VERIFICATION), ("alternative_count", T.ALTERNATIVES), ("variable_assignment_count", T.ASSIGNMENT)):
            assert r[name] == count(p, t), (name, t)
        assert r["avg_sent_len_words"] == max(1, len(words)) / max(1, len([s for s in re.split(T.SENTENCE_END, t) if s.strip()]))
        assert r["paragraph_count"] == len([p for p in re.split(r"\n\s*\n", t.strip()) if p.strip()])
        assert all(math.isfinite(v) for v in r if isinstance(v, float))


def test_density_survives_duplication(spark):
    text = CRAFTED[0] + " " + CRAFTED[2]
    a, b = T.handcrafted(spark.createDataFrame([(text,), (text + "\n" + text,)], "text string")).orderBy("n_chars").select("dens_backtrack").collect()
    assert abs(a[0] - b[0]) <= 0.05 * a[0]


def test_null_text_is_empty(spark):
    r = T.handcrafted(spark.createDataFrame([(None,)], "text string")).first()
    assert r["n_words"] == 1 and r["n_chars"] == 0


@pytest.mark.parametrize("text, want", [(r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{1", ""), ("none", ""), (r"\boxed{ {2} }", "{2}"), (None, "")])
def test_boxed(text, want):
    assert X._boxed(text) == want


@pytest.mark.parametrize("a, b, same", [("1/2", "0.5", True), ("2*sqrt(2)", "sqrt(8)", True), ("2**10", "1024", True), ("x+1", "1+x", True), ("x+1", "x+2", False), ("1/0", "1", False), ("9**9**9", "1", False), ("pi", "3.1415927", True), ("((1)/(2))", "((2)/(4))", True), ("(" * 300, "1", False)])
def test_values(a, b, same):
    assert (X._same(a, b, a, b) is not None) == same


def test_prefix_errors(spark):
    with pytest.raises(ValueError):
        X.with_prefix(F.lit("style_1"), F.lit("q"), "other")
    with pytest.raises(Exception, match="no style prefix"):
        spark.range(1).select(X.respelled(F.lit("[plain]\nq"))).collect()


# ---------------------------------------------------------------- Pass@k


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40), st.integers(-1, 50)), min_size=1, max_size=20))
def test_unbiased_is_binomial(spark, cases):
    cases = [(n, min(c, n), k) for n, c, k in cases]
    df = spark.createDataFrame(cases, "n bigint, c bigint, k int").select("n", "c", "k", B.unbiased(F.col("n"), F.col("c"), F.col("k")).alias("u"), B.unbiased_clamped(F.col("n"), F.col("c"), F.col("k")).alias("v"))
    for r in df.collect():
        n, c, k = r["n"], r["c"], r["k"]
        want = 0.0 if k <= 0 or c <= 0 else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
        assert abs(r["u"] - want) < 1e-12
        k = min(k, n)
        want = 0.0 if k <= 0 or c <= 0 else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
        assert abs(r["v"] - want) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.lists(st.floats(0, 10), min_size=1, max_size=9))
def test_allocation(total, ws):
    weights = {f"style_{i + 1}": w for i, w in enumerate(ws)}
    if sum(ws) <= 0:
        with pytest.raises(ValueError):
            B.allocate(total, weights)
        return
    got = B.allocate(total, weights)
    assert sum(got.values()) == total and (total < len(ws) or min(got.values()) >= (1 if total >= len(ws) and max(got.values()) > 1 else 0))


def test_question_mean_skips_small_questions(spark):
    rows = [("a", i < 2) for i in range(4)] + [("b", True)]
    out = {r["k"]: r for r in B.question_mean(spark.createDataFrame(rows, "question_id string, correct boolean"), budgets=[1, 4, 8]).collect()}
    assert out[1]["n_questions"] == 2 and out[4]["n_questions"] == 1 and out[8]["pass_at_k"] is None and out[1]["pass_at_k"] == 0.75


# ---------------------------------------------------------------- weights and sampling


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(int(i), int(rng.integers(20)), f"style_{int(rng.choice([1, 1, 1, 2, 3]))}") for i in range(500)], "ord bigint, question_id bigint, style string").persist()


@pytest.mark.parametrize("target", ["uniform", "observed", "global"])
def test_mean_weight_is_one(cells, target):
    w = I.importance(cells, 3, target)
    assert w.count() == 500 and abs(w.agg(F.avg("is_weight")).first()[0] - 1) < 1e-9


def test_weights_survive_repartition(cells):
    get = lambda df: {r["ord"]: r["is_weight"] for r in I.importance(df, 3).select("ord", "is_weight").collect()}
    a, b = get(cells), get(cells.repartition(7))
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_unknown_variants(cells):
    with pytest.raises(ValueError):
        I.importance(cells, 3, "other")
    with pytest.raises(ValueError):
        I.build_variant(cells, "other", 3)


def test_resampling_draws_with_replacement_only_where_needed(cells):
    out = I.resample_equal(cells, 120).collect()
    per = Counter(r["style"] for r in out)
    assert set(per.values()) == {120}
    big = [r["ord"] for r in out if r["style"] == "style_1"]
    assert len(set(big)) == 120
    assert sorted((r["style"], r["ord"], r["draw"]) for r in I.resample_equal(cells.repartition(5), 120).collect()) == sorted((r["style"], r["ord"], r["draw"]) for r in out)


def test_tail_split(spark):
    df = spark.createDataFrame([(str(q), t) for q in (1, 2, 3) for t in "ab"], "question_id string, trace string")
    out = R.tail_split(df, "question_id", 0.34).collect()
    assert {r["question_id"] for r in out if r["split"] == "validation"} == {"3"} and len(out) == 6


def test_pairs(spark):
    df = spark.createDataFrame([("1", f"1{c}") for c in "abcd"], "question_id string, trace string")
    assert R.same_question_pairs(df, "question_id", "trace").count() == 6


# ---------------------------------------------------------------- vectors and statistics


def _batch(spark, m, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"id bigint, {name} array<double>")


def test_orthogonal_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 1.0], [1.0, 0.0])], "c array<double>, z array<double>")
    assert df.agg(F.avg(F.pow(V.cosine(F.col("c"), F.col("z")), 2))).first()[0] < 1e-7


def test_contrastive_ignores_sides(spark):
    m = np.random.default_rng(0).standard_normal((4, 16))
    rows = [(i // 2, i % 2, [float(x) for x in r]) for i, r in enumerate(m)]
    swapped = [(p, 1 - s if p == 0 else s, v) for p, s, v in rows]
    kind = "pair int, side int, v array<double>"
    a, b = (V.contrastive(spark.createDataFrame(x, kind)).first()[0] for x in (rows, swapped))
    assert abs(a - b) < 1e-9


def test_variance_hinge(spark):
    rng = np.random.default_rng(0)
    value = lambda m: V.variance_hinge(_batch(spark, m), "v").first()[0]
    assert value(np.ones((8, 16))) > 0.9 and value(5 * rng.standard_normal((64, 8))) < 1e-4 and value(np.ones((1, 4))) == 0


def test_entropy_of_spread_is_lower(spark):
    rng = np.random.default_rng(0)
    value = lambda m: V.similarity_entropy(_batch(spark, m), "id", "v").first()[0]
    near = np.repeat(rng.standard_normal((4, 16)), 2, axis=0) + 0.01 * rng.standard_normal((8, 16))
    assert value(rng.standard_normal((8, 16))) < 0 and value(near) > value(3 * rng.standard_normal((8, 16)))


def test_zero_vector_stays_zero(spark):
    assert _batch(spark, [[0, 0]]).select(V.unit(F.col("v")).alias("u")).first()["u"] == [0.0, 0.0]


def test_scores_ignore_label_names(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(x), int(y), int((x + 1) % 4)) for x, y in zip(a, b)], "a int, b int, c int")
    for f in (S.adjusted_rand, S.normalised_information, S.mutual_information):
        assert abs(f(df, "a", "b").first()[0] - f(df, "c", "b").first()[0]) < 1e-9
    assert abs(S.adjusted_rand(df, "a", "c").first()[0] - 1) < 1e-9 and abs(S.normalised_information(df, "a", "c").first()[0] - 1) < 1e-9


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(S.safe_corr("a", "b")).first()[0] is None


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(4)
    m = np.vstack([rng.normal(-3, 0.3, (60, 3)), rng.normal(3, 0.3, (60, 3))])
    model = C.fit_gmm(_batch(spark, m), "v", 2, n_init=3, max_iter=40, normalise=False)
    got = [r["cluster_id"] for r in C.predict(_batch(spark, m), "v", model).orderBy("id").collect()]
    assert len(set(got[:60])) == len(set(got[60:])) == 1 and got[0] != got[-1]


# ---------------------------------------------------------------- contracts, sources, streams


def test_running_sums_over_bins(spark):
    """Ranks over many bins, with a value that a third of the rows share and nulls."""
    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 7 else 5 if k % 3 == 0 else int(rng.integers(0, 40)), k, int(rng.integers(0, 9))) for k in range(3000)]
    df = spark.createDataFrame(rows, "v int, k int, n int").repartition(7)
    out = {r["k"]: r["upto"] for r in K.running(df, ["v", "k"], F.col("n"), "upto", bin_rows=100).collect()}
    total = 0
    for v, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += n
        assert out[k] == total
    names = spark.createDataFrame([(f"q{k % 211}::{k}", 1) for k in range(900)], "q string, n int")
    out = K.running(names, ["q"], F.col("n"), "r", bin_rows=64).orderBy("q").collect()
    assert [r["r"] for r in out] == list(range(1, 901))


def test_moments_match_numpy(spark):
    x = np.random.default_rng(5).standard_normal((500, 9)) + 100
    df = spark.createDataFrame([(k, r[:5].tolist(), r[5:].tolist()) for k, r in enumerate(x)], "k int, a array<double>, b array<double>").repartition(6)
    got = {(r["i"], r["j"]): (r["cov_samp"], r["cov_pop"]) for r in V.covariance(df, "k", "a").collect()}
    want = np.cov(x[:, :5].T)
    assert len(got) == 25 and all(abs(got[i, j][0] - want[i, j]) < 1e-9 and abs(got[i, j][1] - want[i, j] * 499 / 500) < 1e-9 for i in range(5) for j in range(5))
    a, b = x[:, :5] - x[:, :5].mean(0), x[:, 5:] - x[:, 5:].mean(0)
    cka = np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
    assert abs(V.linear_cka(df, "a", "b").first()[0] - cka) < 1e-9
    nuclear = np.linalg.svd(a.T @ b / np.linalg.norm(a) / np.linalg.norm(b), compute_uv=False).sum()
    assert abs(V.procrustes(df, "a", "b") - (2 - 2 * nuclear)) < 1e-9


def test_refit_sweep_and_saved_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 0.1, (90, 3)) + [1, 0, 0], rng.normal(0, 0.1, (60, 3)) + [0, 1, 0]))
    df = spark.createDataFrame([(k, k % 30, r.tolist()) for k, r in enumerate(x)], "id int, q int, v array<double>").repartition(4)
    model, given = C.select_and_refit(df, "id", "q", "v", [2], spark)
    sides = {}
    for r in given.collect():
        sides.setdefault(r["cluster_id"], set()).add(r["id"] < 90)
    assert len(sides) == 2 and all(len(s) == 1 for s in sides.values())
    C.save_gmm(spark, model, f"{tmp_path}/model")
    back = C.load_gmm(spark, f"{tmp_path}/model")
    assert all(np.array_equal(getattr(model, f), getattr(back, f)) for f in ("weight", "mean", "var"))
    table, parts = C.full_sweep(df, "id", "v", [2, 3], spark)
    rows = {r["k"]: r for r in table.collect()}
    assert rows[2]["best_silhouette"] and not rows[3]["best_silhouette"] and sum(r["best_bic"] for r in rows.values()) == 1
    assert parts.groupBy("k").count().where("count = 150").count() == 2


def test_fractions_of_any_depth(spark):
    text = "x"
    for k in range(9):
        text = rf"\frac{{{text}}}{{{k}}}"
    out = spark.createDataFrame([(text, "1/" + "+".join(["1"] * 300), f"1/300", None)], "s string, a string, b string, n string")
    r = out.select(X.fractions(F.col("s")).alias("s"), X.grade("a", "b").alias("g"), X.fractions(F.col("n")).alias("n")).first()
    assert "frac" not in r["s"] and r["s"].count("/") == 9 and r["n"] is None and not r["g"]["matched"]
    assert X._same("(" + "+".join(["1"] * 300) + ")", "300", "", "") == "exact_value"


def test_folding_guard_finds_every_match(spark):
    rows = ["WA\u0130T", "alternat\u0130vely", "\u017fo", "o\u212a", "hm\u0131m", "SO", "\u00dfo well", "Step one"] + CRAFTED
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    low = T.folded(F.col("t"))
    for p in T.NEEDLES:
        fold = p not in (T.MATH, T.CODE_BLOCK)
        both = df.select("t", T.found(F.col("t"), p, fold).alias("plain"), T.found(F.col("t"), p, fold, low=low).alias("guarded")).collect()
        assert all(r["plain"] == r["guarded"] for r in both), p


def test_ridge_is_the_closed_form(spark):
    from tessera.operators import probes as P

    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 4))
    y = x @ np.array([2.0, -1.0, 0.5, 0.0]) + 0.1 * rng.standard_normal(400)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "v array<double>, y double")
    r = P.ridge(df, "v", F.col("y"), [1e-6]).first()
    fold = [f["f"] for f in df.select(F.pmod(F.xxhash64("v"), F.lit(5)).alias("f")).collect()]
    test = np.array(fold) == 0
    one = np.hstack([x, np.ones((400, 1))])
    w = np.linalg.lstsq(one[~test], y[~test], rcond=None)[0]
    err = y[test] - one[test] @ w
    assert abs(r["mae"] - abs(err).mean()) < 1e-3 and abs(r["r2"] - (1 - (err**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())) < 1e-3


def test_means_keep_separated_groups(spark):
    rng = np.random.default_rng(9)
    m = np.vstack([rng.normal(c, 0.2, (50, 3)) for c in (-4, 0, 4)])
    got = [r["cluster_id"] for r in C.kmeans(_batch(spark, m), "v", 3, n_init=3).orderBy("id").collect()]
    assert [len(set(got[k : k + 50])) for k in (0, 50, 100)] == [1, 1, 1] and len(set(got)) == 3


def test_cluster_prefixes_and_training_tables(spark):
    rows = [(q, a, f"[style_9]\ntext {q} {a}", 10 * q + len(a)) for q in range(6) for a in ("x", "yy")]
    df = spark.createDataFrame(rows, "question_id int, author string, text string, trace_len int")
    given = df.select("question_id", "author", (F.col("question_id") % 2).alias("cluster_id"))
    train, held = df.where("question_id < 4"), df.where("question_id >= 4")
    keys = ["question_id", "author"]
    out = I.cluster_prefixed(train, held, given.where("question_id < 4"), given.where("question_id >= 4"), keys)
    for r in out.collect():
        style = "style_1" if r["question_id"] % 2 == 0 else "style_2"
        assert r["text"] == f"[{style}]\ntext {r['question_id']} {r['author']}" and r["oracle_style_name"] == r["author"]
    with pytest.raises(contracts.ContractError):
        I.cluster_prefixed(train, held, given.where("question_id < 3"), given.where("question_id >= 4"), keys)
    meta = {(r["split"], r["style"]): (r["style_index"], r["n"]) for r in I.prefix_meta(out).collect()}
    assert meta["train", "style_1"] == (1, 4) and meta["validation", "style_2"] == (2, 2)
    raw = spark.createDataFrame([(q, a, "  ask ", t) for q in range(20) for a, t in (("x", "t"), ("yy", " "), ("z", "t"))], "question_id int, author string, instruction string, trace string")
    sft = I.sft_tables(raw, ["yy", "x"]).collect()
    assert len(sft) == 40 and {r["author"] for r in sft} == {"x"} and {r["style_id"] for r in sft} == {1}
    assert {r["question_id"] for r in sft if r["split"] == "validation"} == {18, 19}
    assert {r["messages"] for r in sft if r["variant"] == "prefixed"} == {'[{"role":"user","content":"[x]\\nask"},{"role":"assistant","content":"t"}]'}


def test_small_inputs_go_to_all_cores(spark, tmp_path):
    from tessera.plans.views import spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(9).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread(many) is many


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    for bad in (lambda: contracts.unique(df, "k"), lambda: contracts.not_null(df, "v"), lambda: contracts.covered(df, "v", 0.99)):
        with pytest.raises(contracts.ContractError):
            bad()
    one = df.limit(1)
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(one, spark.createDataFrame([(2, "x")], "k int, w string"), ["k"])


def test_jsonl_modes(spark, tmp_path):
    from tessera.sources import io

    p = tmp_path / "g.jsonl"
    p.write_text('{"question_id": "1", "correct": true}\nnot json\n\n{"question_id": "2", "correct": null}\n')
    assert sorted((r["question_id"], r["correct"]) for r in io.read_jsonl(spark, str(p)).select("question_id", "correct").collect()) == [("1", True), ("2", None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(p), strict=True).collect()


def test_shards_must_touch(spark):
    from tessera.sources import io

    rows = spark.createDataFrame([(0, 10), (11, 20)], "row_start bigint, row_end bigint")
    with pytest.raises(contracts.ContractError):
        io.contiguous(rows)


def test_matrix_files(spark, tmp_path):
    from tessera.sources import io

    np.savez(tmp_path / "z.npz", z_s=np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["vector"] for r in io.read_vectors(spark, str(tmp_path / "z.npz"), "z_s").orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_two_sinks_and_csv(spark, tmp_path):
    from tessera.sources import io

    df = spark.createDataFrame([("q", "a")], "text string, style string")
    io.write_two(df, f"{tmp_path}/a", f"{tmp_path}/b", F.concat(F.lit("["), "style", F.lit("]\n")), "text")
    assert spark.read.parquet(f"{tmp_path}/b").first()["text"] == "[a]\nq" and spark.read.parquet(f"{tmp_path}/a").first()["text"] == "q"
    io.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 1


def test_feature_stream(spark, tmp_path):
    from tessera.streaming.records import feature_stream, write_records

    df = spark.createDataFrame([("1", "Wait, no."), ("2", "fine")], "question_id string, output string")
    df.write.parquet(f"{tmp_path}/in")
    q = write_records(feature_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {r["question_id"]: r["piv_realization"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"1": 1.0, "2": 0.0}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
