"""Analysis queries (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyses as A
from ..operators import clustering as C
from ..operators import stats as S
from ..operators.sampling import draw_sql
from .q_passk import KS, PQ, PQS, unbiased_sql
from .q_text import HANDCRAFTED
from .registry import ORACLE_SQL, query
from .views import GENS, K, STYLES, TEXTS, VECS, gens, spread, table, vecs

P = "CAST(correct AS DOUBLE)"
SPACE = ["f1", "f2", "f3"]


def recs(spark, sf):
    """Records with a small style space: one generation for each document."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t")))
    w = F.greatest(F.lit(1), F.size(T.words_of(F.col("t"))))
    return d.withColumn("w", w).select(
        F.col("doc_id").alias("ord"), (F.col("doc_id") % 60).alias("question_id"), F.concat(F.lit("style_"), F.col("doc_id") % 4 + 1).alias("prefix_style"), (F.col("doc_id") % 3 == 0).alias("correct"), "lang",
        F.length("t").cast("double").alias("len"), F.log1p("w").alias("f1"), ((T.literal_count(F.col("t"), "\n") + 1) * (F.lit(100.0) / F.col("w"))).alias("f2"), (F.length(F.regexp_replace("t", r"(?U)\s+", "")) / F.col("w")).alias("f3"),
    )


RECS = r"""rw AS (SELECT doc_id, lang, coalesce(text, '') AS t, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS w FROM documents),
 recs AS (SELECT doc_id AS ord, doc_id % 60 AS question_id, 'style_' || CAST(doc_id % 4 + 1 AS VARCHAR) AS prefix_style, doc_id % 3 = 0 AS correct, lang, CAST(length(t) AS DOUBLE) AS len, ln(1 + w) AS f1, (length(t) - length(replace(t, chr(10), '')) + 1) * (100.0 / w) AS f2, length(regexp_replace(t, '\s+', '', 'g')) / w AS f3 FROM rw)"""
_MU = ", ".join(f"avg({c}) AS m{c}, greatest(stddev_pop({c}), 1e-9) AS s{c}" for c in SPACE)
_Z = ", ".join(f"(avg({c}) - any_value(m{c})) / any_value(s{c}) AS z{c}" for c in SPACE)
BASIS = f"mu AS (SELECT {_MU}, count(*) AS t FROM recs), bs AS (SELECT lang, count(*) / any_value(t) AS prop, avg(len) AS ml, {_Z} FROM recs, mu GROUP BY lang), basis AS (SELECT *, 'style_' || CAST(row_number() OVER (ORDER BY ml, lang) AS VARCHAR) AS style FROM bs)"
_FAR = " + ".join(f"pow((r.{c} - m{c}) / s{c} - z{c}, 2)" for c in SPACE)
REAL = f"dist AS (SELECT r.*, style, {_FAR} AS far FROM recs r, mu, basis), realised AS (SELECT ord, any_value(question_id) AS question_id, any_value(prefix_style) AS prefix_style, any_value(correct) AS correct, arg_min(style, (far, style)) AS realised FROM dist GROUP BY ord)"
ALL = f"WITH {RECS}, {BASIS}, {REAL}"


def _basis(spark, sf):
    return A.basis(recs(spark, sf), "lang", "len", SPACE)


_SAMPLED = f"SELECT doc_id AS ord, {draw_sql('0', 'doc_id % 60')} % 4 = 0 AND row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id) <= 4 AS sampled FROM documents"


@query("a1_extract_records", f"SELECT ord, sampled, {', '.join(T.PROFILE_FEATURES)} FROM ({HANDCRAFTED.replace(TEXTS, 'texts AS (SELECT doc_id AS id, text FROM documents)')}) JOIN ({_SAMPLED}) ON ord = id")
def a1(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 60).alias("question_id"), F.lit("style_1").alias("prefix_style"), "text")
    return A.extract_records(d, "text", "ord").select("ord", "sampled", *T.PROFILE_FEATURES)


@query("a2_teacher_basis", f"WITH {RECS}, {BASIS} SELECT style, lang, prop, zf1, zf2, zf3 FROM basis")
def a2(spark, sf):
    return _basis(spark, sf).select("style", "lang", "prop", *[F.col("centroid")[i].alias(f"z{c}") for i, c in enumerate(SPACE)])


@query("a3_forced_style", f"""WITH {GENS}, {PQS}, {KS}, v AS (SELECT prefix_style, k, CASE WHEN n >= k THEN {unbiased_sql()} END AS v FROM pqs, ks), c AS (SELECT prefix_style, {", ".join(f"avg(v) FILTER (k = {k}) AS pass_{k}" for k in (1, 8))} FROM v GROUP BY ALL),
 b AS (SELECT prefix_style, count(*) AS n, avg(n_tokens) AS n_tokens_mean, 100 * avg(CAST(finish_reason = 'length' AS DOUBLE)) AS pct_length, avg({P}) AS acc FROM gens GROUP BY ALL) SELECT * FROM b JOIN c USING (prefix_style)""")
def a3(spark, sf):
    return A.forced_style(gens(spark, sf), [1, 8])


@query("a4_length_separation", f"""WITH {GENS}, m AS (SELECT question_id, prefix_style, avg(n_tokens) AS m FROM gens GROUP BY ALL), f AS (SELECT question_id, avg(m) AS mean, stddev_pop(m) AS sd FROM m GROUP BY ALL HAVING count(*) = {K}), g AS (SELECT a.question_id, avg(abs(a.m - b.m)) AS gap FROM m a JOIN m b ON a.question_id = b.question_id AND a.prefix_style < b.prefix_style GROUP BY ALL)
 SELECT count(*) AS n_questions, avg(gap) AS abs_gap, avg(gap / greatest(mean, 1e-6)) AS rel_gap, avg(sd / greatest(mean, 1e-6)) AS mean_cv, avg(CAST(sd / greatest(mean, 1e-6) < 0.05 AS DOUBLE)) AS collapse_rate FROM f JOIN g USING (question_id)""")
def a4(spark, sf):
    return A.length_separation(gens(spark, sf), STYLES, "n_tokens")


@query("a5_text_separation")
def a5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 30).alias("question_id"), F.concat(F.lit("style_"), F.floor(F.col("doc_id") / 30) % 2 + 1).alias("prefix_style"), "text")
    return A.text_separation(d, STYLES[:2], "text", "ord")


@query("a6_confusion", f"{ALL}, c AS (SELECT prefix_style, realised, count(*) AS n FROM realised GROUP BY ALL) SELECT prefix_style, realised, n / sum(n) OVER (PARTITION BY prefix_style) AS share FROM c")
def a6(spark, sf):
    return A.confusion(A.realised(recs(spark, sf), _basis(spark, sf), SPACE))


@query("a7_complementarity", f"""WITH {GENS}, {PQS}, q AS (SELECT question_id, CAST(sum(n) AS BIGINT) AS tn, CAST(sum(c) AS BIGINT) AS tc, count(*) FILTER (c > 0) AS solvers FROM pqs GROUP BY ALL), w AS (SELECT avg(CASE WHEN tn >= 8 THEN {unbiased_sql("tn", "tc", "8")} END) AS all_k FROM q), st AS (SELECT DISTINCT prefix_style FROM pqs),
 g AS (SELECT q.question_id, st.prefix_style, tn - coalesce(n, 0) AS rn, tc - coalesce(c, 0) AS rc, coalesce(c, 0) AS c, solvers FROM q CROSS JOIN st LEFT JOIN pqs ON pqs.question_id = q.question_id AND pqs.prefix_style = st.prefix_style)
 SELECT prefix_style, count(*) FILTER (c > 0) AS solved, count(*) FILTER (c > 0 AND solvers = 1) AS only, avg(CASE WHEN rn >= 8 THEN {unbiased_sql("rn", "rc", "8")} END) AS without, any_value(all_k) - avg(CASE WHEN rn >= 8 THEN {unbiased_sql("rn", "rc", "8")} END) AS delta FROM g, w GROUP BY prefix_style""")
def a7(spark, sf):
    return A.complementarity(gens(spark, sf), 8)


@query("a7_by_difficulty", f"""WITH {GENS}, q AS (SELECT question_id, avg({P}) AS p FROM gens GROUP BY ALL), r AS (SELECT question_id, row_number() OVER (ORDER BY p, question_id) AS r, count(*) OVER () AS n FROM q), b AS (SELECT question_id, CAST(r > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(r > 1 + (n - 1) * 0.5 AS INTEGER) + CAST(r > 1 + (n - 1) * 0.75 AS INTEGER) AS bucket FROM r)
 SELECT bucket, prefix_style, avg({P}) AS acc, count(DISTINCT question_id) AS questions FROM gens JOIN b USING (question_id) GROUP BY ALL""")
def a7b(spark, sf):
    return A.by_difficulty(gens(spark, sf))


_NULL = GENS.replace("gens AS", "g0 AS") + f", gens AS (SELECT * REPLACE ('style_' || CAST({draw_sql('5', str(K), 'ord')} % {K} + 1 AS VARCHAR) AS prefix_style) FROM g0)"


@query("a8_null_styles", ORACLE_SQL["a4_length_separation"].replace(GENS, _NULL))
def a8(spark, sf):
    """The forced-style block with random styles: what spread chance alone gives."""
    from ..operators.sampling import random_label

    g = gens(spark, sf).withColumn("prefix_style", F.concat(F.lit("style_"), random_label(F.col("ord"), K, 5) + 1))
    return A.length_separation(g, STYLES, "n_tokens")


@query("a9_rerank", f"""{ALL}, d2 AS (SELECT d.style, d.question_id, d.ord, d.far, d.correct, r.realised = d.style AS mine FROM dist d JOIN realised r USING (ord)), q AS (SELECT style, question_id, arg_min(CAST(correct AS DOUBLE), (far, ord)) AS pick, count(*) FILTER (mine) AS size, max(CAST(mine AND correct AS INTEGER)) AS hit FROM d2 GROUP BY ALL)
 SELECT style, avg(pick) AS pick_accuracy, avg(CAST(size > 0 AS DOUBLE)) AS coverage, avg(size) AS mean_size, avg(hit) AS correct_in_basin FROM q GROUP BY style""")
def a9(spark, sf):
    return A.rerank(recs(spark, sf), _basis(spark, sf), SPACE, "ord")


@query("a10_occupancy", f"""WITH {GENS}, c AS (SELECT question_id, prefix_style, count(*) AS n FROM gens GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY question_id) AS p FROM c), q AS (SELECT question_id, count(*) AS u, -sum(p * log2(p)) AS h, max(p) AS m FROM p GROUP BY ALL), t AS (SELECT -sum(p * log2(p)) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM gens GROUP BY prefix_style))
 SELECT count(*) AS n_questions, avg(u) AS mean_styles, avg(h) AS mean_entropy, avg(m) AS mean_max_share, avg(CAST(u <= 1 AS DOUBLE)) AS single_style, any_value(entropy) AS entropy FROM q, t""")
def a10(spark, sf):
    return A.occupancy(gens(spark, sf), "prefix_style")


_ST = f"s AS (SELECT prefix_style, count(*) AS n, sum(CAST(correct AS INTEGER)) AS c, avg(CAST(finish_reason = 'length' AS DOUBLE)) AS truncated, avg(n_tokens) AS mean_tokens FROM gens WHERE finish_reason <> 'length' GROUP BY ALL)"


@query("a11_style_table", f"WITH {GENS}, {_ST} SELECT prefix_style, n / sum(n) OVER () AS occupancy, c / n AS p_correct, c / n - sum(c) OVER () / sum(n) OVER () AS lift, c / sum(c) OVER () AS share_of_correct, truncated, mean_tokens FROM s")
def a11(spark, sf):
    return A.style_table(gens(spark, sf).where("finish_reason <> 'length'"), "prefix_style")


CELL = f"cell AS (SELECT question_id, prefix_style, count(*) AS n, avg({P}) AS p FROM gens GROUP BY ALL)"


@query("a12_usefulness", f"WITH {GENS}, {CELL}, q AS (SELECT question_id, max(p) - avg(p) AS gap FROM cell GROUP BY ALL HAVING count(*) = {K} AND min(n) >= 5) SELECT count(*) AS n_questions, avg(gap) AS mean_gap, quantile_cont(gap, 0.25) AS q25, quantile_cont(gap, 0.5) AS q50, quantile_cont(gap, 0.75) AS q75, avg(CAST(gap > 0.05 AS DOUBLE)) AS over_05, avg(CAST(gap > 0.1 AS DOUBLE)) AS over_10 FROM q")
def a12(spark, sf):
    return A.usefulness(gens(spark, sf), K, 5)


@query("a13_usefulness_variance", f"""WITH {GENS}, {CELL}, q AS (SELECT question_id, count(*) AS s, var_pop(p) AS v FROM cell WHERE n >= 8 GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT question_id, prefix_style AS a, correct AS b, CAST(count(*) AS DOUBLE) AS n FROM gens GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY question_id, a) AS na, sum(n) OVER (PARTITION BY question_id, b) AS nb, sum(n) OVER (PARTITION BY question_id) AS t FROM c), i AS (SELECT question_id, sum(n / t * log2(n * t / (na * nb))) AS mi FROM m GROUP BY ALL)
 SELECT count(*) AS n_questions, avg(s) AS mean_styles, avg(v) AS mean_var, quantile_cont(v, 0.5) AS median_var, avg(mi) AS mean_mi, avg(CAST(v > 0.0025 AS DOUBLE)) AS var_over, avg(CAST(mi > 0.02 AS DOUBLE)) AS mi_over FROM q JOIN i USING (question_id)""")
def a13(spark, sf):
    return A.usefulness_variance(gens(spark, sf), 8)


@query("a14_assignment_usefulness", f"""WITH {GENS}, {CELL}, pi AS (SELECT question_id, prefix_style, count(*) AS k FROM gens WHERE pk < 30 GROUP BY ALL), f AS (SELECT question_id FROM cell GROUP BY ALL HAVING count(*) = {K}), j AS (SELECT cell.*, coalesce(k, 0) AS k FROM cell SEMI JOIN f USING (question_id) LEFT JOIN pi USING (question_id, prefix_style)),
 q AS (SELECT question_id, sum(k * p) / greatest(sum(k), 1) AS v_pi, avg(p) AS v_unif, max(p) AS v_oracle, CASE WHEN stddev_pop(k) >= 1e-12 AND stddev_pop(p) >= 1e-12 THEN corr(k, p) END AS align FROM j GROUP BY ALL)
 SELECT count(*) AS n, avg(v_pi) AS v_pi, avg(v_unif) AS v_unif, avg(v_oracle) AS v_oracle, avg(v_pi - v_unif) AS lift, avg(CASE WHEN v_oracle - v_unif > 1e-9 THEN (v_pi - v_unif) / (v_oracle - v_unif) END) AS frac_gap, avg(align) AS align FROM q""")
def a14(spark, sf):
    g = gens(spark, sf)
    return A.assignment_usefulness(g, g.where("pk < 30"), K)


_HALVES = f"p AS (SELECT *, row_number() OVER (PARTITION BY question_id, prefix_style ORDER BY ord) AS i FROM gens), h AS (SELECT question_id, prefix_style, correct, s AS split, {draw_sql('0', 's', 'i')} % 2 AS half FROM p, range(1, 41) t(s))"


@query("a15_split_selection", f"""WITH {GENS}, {_HALVES}, c AS (SELECT split, question_id, prefix_style, avg({P}) FILTER (half = 0) AS a, avg({P}) FILTER (half = 1) AS b FROM h GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
 q AS (SELECT split, question_id, avg(b) AS uniform, arg_max(b, (a, prefix_style)) AS per_question, max(b) AS oracle FROM c GROUP BY ALL), f AS (SELECT split, arg_max(b, (a, prefix_style)) AS best_fixed FROM (SELECT split, prefix_style, avg(a) AS a, avg(b) AS b FROM c GROUP BY ALL) GROUP BY split),
 t AS (SELECT split, avg(uniform) AS uniform, avg(per_question) AS per_question, avg(oracle) AS oracle FROM q GROUP BY split) SELECT {", ".join(f"avg({c}) AS {c}, quantile_cont({c}, 0.025) AS {c}_low, quantile_cont({c}, 0.975) AS {c}_high" for c in ("uniform", "best_fixed", "per_question", "oracle"))} FROM t JOIN f USING (split)""")
def a15(spark, sf):
    return A.split_selection(gens(spark, sf), "ord", 40)


@query("a16_question_wins", f"WITH {GENS}, {CELL}, w AS (SELECT *, max(p) OVER (PARTITION BY question_id) AS top FROM cell), t AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS ties FROM w WHERE p = top) SELECT prefix_style, count(*) FILTER (ties = 1) AS alone, count(*) FILTER (ties > 1) AS tied FROM t GROUP BY prefix_style")
def a16(spark, sf):
    return A.question_wins(gens(spark, sf))


@query("a17_entropy_and_passk", f"WITH {GENS}, {PQ}, c AS (SELECT question_id, count(*) AS n FROM gens GROUP BY question_id, prefix_style), h AS (SELECT question_id, -sum(p * log2(p)) AS entropy, count(*) AS styles FROM (SELECT question_id, n / sum(n) OVER (PARTITION BY question_id) AS p FROM c) GROUP BY question_id) SELECT question_id, entropy, styles, {unbiased_sql(k='32')} AS pass_32 FROM pq JOIN h USING (question_id)")
def a17(spark, sf):
    from ..operators import passk as B

    g = gens(spark, sf)
    n = g.groupBy("question_id").agg(F.countDistinct("prefix_style").alias("styles"))
    p = B.per_question(g).select("question_id", B.unbiased(F.col("n"), F.col("c"), 32).alias("pass_32"))
    return S.entropy(g, "prefix_style", True, "question_id").join(n, "question_id").join(p, "question_id")


@query("a18_characterise", f"{ALL}, f AS (SELECT lang, 'f1' AS feature, f1 AS x FROM recs UNION ALL SELECT lang, 'f2', f2 FROM recs UNION ALL SELECT lang, 'f3', f3 FROM recs), g AS (SELECT feature, lang, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY ALL), t AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL) SELECT feature, sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum(n * v)) AS eta2 FROM g JOIN t USING (feature) GROUP BY feature")
def a18(spark, sf):
    return S.eta_squared(recs(spark, sf), "lang", SPACE)


@query("a19_compare_representations")
def a19(spark, sf):
    """ARI, NMI and CKA of two halves of the vectors."""
    from ..functions.vectors import linear_cka

    v = vecs(spark, sf)
    a = C.kmeans(v, "c", 3, 1, 1).select("vec_id", F.col("cluster_id").alias("ca"))
    b = C.kmeans(v, "z", 3, 1, 1).select("vec_id", F.col("cluster_id").alias("cb"))
    both = a.join(b, "vec_id")
    return S.adjusted_rand(both, "ca", "cb").crossJoin(S.normalised_information(both, "ca", "cb")).crossJoin(linear_cka(v, "c", "z"))  # one row each


@query("a20_restyle", f"{ALL} SELECT prefix_style, avg(CAST(realised = prefix_style AS DOUBLE)) AS realised_accuracy, avg(len) AS mean_len FROM realised JOIN (SELECT ord, len FROM recs) USING (ord) GROUP BY prefix_style")
def a20(spark, sf):
    r = A.realised(recs(spark, sf), _basis(spark, sf), SPACE)
    return r.groupBy("prefix_style").agg(A.rate(F.col("realised") == F.col("prefix_style")).alias("realised_accuracy"), F.avg("len").alias("mean_len"))


@query("a21_swap_matrix", f"WITH {GENS}, m AS (SELECT prefix_style AS s, 'style_' || CAST(pk % 5 + 1 AS VARCHAR) AS t, avg(n_tokens) AS mc FROM gens GROUP BY ALL) SELECT s AS source, arg_min(t, (mc, t)) AS cheapest, max(mc) FILTER (s = t) AS own, avg(mc) FILTER (s <> t) AS others FROM m GROUP BY s")
def a21(spark, sf):
    g = gens(spark, sf).select(F.col("prefix_style").alias("source"), F.concat(F.lit("style_"), F.col("pk") % 5 + 1).alias("target"), "n_tokens")
    return A.swap_matrix(g, "source", "target", "n_tokens")


@query("a22_a23_scoring", f"{ALL}, r AS (SELECT rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0 AS rx, rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2.0 AS ry FROM recs) SELECT corr(rx, ry) AS rho FROM r")
def a22(spark, sf):
    return S.spearman(recs(spark, sf), "f1", "len")


@query("a24_identifiability")
def a24(spark, sf):
    from ..operators import probes as PR

    r = recs(spark, sf)
    null = r.drop("lang").join(PR.permuted(r.select("ord", "lang"), "ord", "lang", "lang", 24), "ord")
    real, null = (PR.forest_probe(PR.split_by_key(x, "question_id", 0.3), SPACE, "lang", 300).scores.select("accuracy", "majority") for x in (r, null))
    return real.withColumn("labels", F.lit("author")).unionByName(null.withColumn("labels", F.lit("shuffled")))


@query("a26_stop_probe", f"WITH {GENS} SELECT prefix_style, avg(CAST(finish_reason = 'stop' AS DOUBLE)) AS stopped, avg(CAST(finish_reason = 'stop' AND n_tokens < 1000 AS DOUBLE)) AS early, avg(greatest(0, n_tokens - 1000)) AS wasted FROM gens GROUP BY prefix_style")
def a26(spark, sf):
    return A.stop_probe(gens(spark, sf), 1000)


@query("a27_length_statistics", f"WITH {GENS} SELECT prefix_style, count(*) AS n, avg(n_tokens) AS mean, quantile_cont(n_tokens, 0.1) AS p10, quantile_cont(n_tokens, 0.5) AS p50, quantile_cont(n_tokens, 0.9) AS p90, stddev_pop(n_tokens) / avg(n_tokens) AS cv FROM gens GROUP BY prefix_style")
def a27(spark, sf):
    return A.length_statistics(gens(spark, sf))


@query("a28_claims_report", f"WITH {GENS} SELECT '| ' || prefix_style || ' | ' || printf('%.3f', avg({P})) || ' | ' || printf('%.1f', avg(n_tokens)) || ' |' AS line FROM gens GROUP BY prefix_style")
def a28(spark, sf):
    t = gens(spark, sf).groupBy("prefix_style").agg(A.rate(F.col("correct")).alias("p"), F.avg("n_tokens").alias("m"))
    return t.select(F.concat(F.lit("| "), "prefix_style", F.lit(" | "), F.format_string("%.3f", "p"), F.lit(" | "), F.format_string("%.1f", "m"), F.lit(" |")).alias("line"))


@query("a29_representation_scores", f"WITH {VECS}, u AS (SELECT label, vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM vecs) SELECT a.label, avg(list_dot_product(a.u, b.u)) AS mean_cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def a29(spark, sf):
    from ..functions.vectors import mean_pair_cosine

    return mean_pair_cosine(vecs(spark, sf), "label", "c").select("label", "mean_cosine")
