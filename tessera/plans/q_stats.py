"""Vector, clustering-metric and statistics queries (V, C, M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering as C
from ..operators import probes as PR
from ..operators import stats as S
from ..operators import tfidf as TF
from ..operators.sampling import draw_sql
from .registry import query
from .views import GENS, STYLES, TEXTS, TRACES, VECS, gens, table, texts, traces, vecs

D = "list_dot_product"
UNIT = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt({D}({v}, {v})), 1e-12))"


@query("v1_unit", f"WITH {VECS}, u AS (SELECT vec_id, {UNIT('z')} AS u FROM vecs) SELECT vec_id, u[1] AS first, {D}(u, u) AS size FROM u")
def v1(spark, sf):
    u = vecs(spark, sf).select("vec_id", V.unit(F.col("z")).alias("u"))
    return u.select("vec_id", F.col("u")[0].alias("first"), V.dot(F.col("u"), F.col("u")).alias("size"))


@query("v2_v24_v25_cosine", f"WITH {VECS} SELECT vec_id, {D}(c, z) / greatest(sqrt({D}(c, c)) * sqrt({D}(z, z)), 1e-7) AS cosine, len(list_concat(c, z)) AS n, list_sum(z[17:32]) AS head2 FROM vecs")
def v2(spark, sf):
    v = vecs(spark, sf)
    return v.select("vec_id", V.cosine(F.col("c"), F.col("z")).alias("cosine"), F.size(V.concat(F.col("c"), F.col("z"))).cast("long").alias("n"), V.total(V.heads(F.col("z"), 2, 16)[1]).alias("head2"))


#: A batch is 64 rows in a row.
BATCH = f"WITH {VECS}, b AS (SELECT vec_id // 64 AS batch, vec_id // 2 AS pair, vec_id % 2 AS side, {UNIT('z')} AS u FROM vecs)"


@query("v3_v9_contrastive", f"{BATCH}, s AS (SELECT a.pair, a.side, a.pair = o.pair AS mate, {D}(a.u, o.u) / 0.07 AS s FROM b a JOIN b o ON a.batch = o.batch AND (a.pair, a.side) <> (o.pair, o.side)), l AS (SELECT ln(sum(exp(s))) - max(CASE WHEN mate THEN s END) AS l FROM s GROUP BY pair, side) SELECT avg(l) AS value FROM l")
def v3(spark, sf):
    b = vecs(spark, sf).select(F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("z").alias("v"))
    return V.contrastive(b)


DIM = f"WITH {VECS}, d AS (SELECT vec_id, label, i, z[i] AS x FROM vecs, range(1, 33) t(i))"


@query("v4_variance_hinge", f"{DIM}, s AS (SELECT stddev_samp(x) AS s FROM d GROUP BY i) SELECT avg(greatest(0, 1 - s + 1e-4)) AS value FROM s")
def v4(spark, sf):
    return V.variance_hinge(vecs(spark, sf), "z")


COV = f"{DIM}, c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS cs, covar_pop(a.x, b.x) AS cp FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i)"


@query("v5_covariance_penalty", f"{COV} SELECT sum(CASE WHEN i <> j THEN cs * cs ELSE 0 END) / 32 AS value FROM c")
def v5(spark, sf):
    return V.covariance_penalty(V.covariance(vecs(spark, sf), "vec_id", "z"))


@query("v6_length_decorrelation", f"{DIM}, s AS (SELECT covar_pop(x, label) / ((stddev_samp(x) + 1e-6) * (stddev_samp(label) + 1e-6)) AS c FROM d GROUP BY i) SELECT sum(c * c) AS value FROM s")
def v6(spark, sf):
    return V.length_decorrelation(vecs(spark, sf), "z", "label")


@query("v7_similarity_entropy", f"{BATCH}, s AS (SELECT a.pair, a.side, {D}(a.u, o.u) / 0.1 AS s FROM b a JOIN b o ON a.batch = o.batch AND (a.pair, a.side) <> (o.pair, o.side)), e AS (SELECT ln(sum(exp(s))) - sum(exp(s) * s) / sum(exp(s)) AS h FROM s GROUP BY pair, side) SELECT -avg(h) AS value FROM e")
def v7(spark, sf):
    return V.similarity_entropy(vecs(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 64)), "vec_id", "z", batch="batch")


@query("v8_v10_group_diversity", f"WITH {VECS}, u AS (SELECT vec_id, vec_id // 16 AS question_id, {UNIT('z')} AS u FROM vecs) SELECT avg(greatest(0, {D}(a.u, b.u) - 0.1)) AS diversity, 0.5 * avg(greatest(0, {D}(a.u, b.u) - 0.1)) + 1 AS total FROM u a JOIN u b ON a.question_id = b.question_id AND a.vec_id < b.vec_id")
def v8(spark, sf):
    """V8: mean of max(0, cosine - margin) over pairs of a question (sixteen vectors in a row, at any size of the table); V10: a weighted sum of losses."""
    d = F.avg(F.greatest(F.lit(0.0), F.col("cosine") - 0.1))
    return V.within_pairs(vecs(spark, sf).withColumn("question_id", F.floor(F.col("vec_id") / 16)), "question_id", "vec_id", "z").agg(d.alias("diversity"), (0.5 * d + 1).alias("total"))


@query("v11_effective_rank", f"{COV} SELECT pow(sum(CASE WHEN i = j THEN cp END), 2) / sum(cp * cp) AS value FROM c")
def v11(spark, sf):
    return V.effective_rank(V.covariance(vecs(spark, sf), "vec_id", "z"))


CEN = "cm AS (SELECT label, i, avg(z[i]) AS x FROM vecs, range(1, 33) t(i) GROUP BY ALL), cen AS (SELECT label, list(x ORDER BY i) AS c2 FROM cm GROUP BY label)"


@query("v12_v13_v14_nearest_centroid", f"WITH {VECS}, {CEN}, s AS (SELECT vec_id, cen.label, {D}(z, c2) AS dp, {D}(z, c2) / (sqrt({D}(z, z)) * sqrt({D}(c2, c2))) AS cs FROM vecs, cen) SELECT vec_id, arg_max(label, (dp, -label)) AS by_dot, arg_max(label, (cs, -label)) AS by_cosine FROM s GROUP BY vec_id")
def v13(spark, sf):
    v = vecs(spark, sf)
    cen = V.vector_mean(v, ["label"], "z")
    j = V.nearest_centroid(V.nearest_centroid(v.select("vec_id", "z"), cen, "z", "by_dot"), cen, "z", "by_cosine", "cosine")
    return j.select("vec_id", "by_dot", "by_cosine")


@query("v15_v16_euclidean", f"WITH {VECS}, {CEN} SELECT vec_id, min(list_sum(list_transform(list_zip(z, c2), lambda p: pow(p[1] - p[2], 2)))) AS dist FROM vecs, cen GROUP BY vec_id")
def v15(spark, sf):
    v = vecs(spark, sf)
    return V.nearest_centroid(v.select("vec_id", "z"), V.vector_mean(v, ["label"], "z"), "z", "near", "euclidean").select("vec_id", F.col("near_far").alias("dist"))


@query("v17_standardise", f"WITH {GENS}, s AS (SELECT avg(n_tokens) AS m, greatest(stddev_pop(n_tokens), 1e-9) AS s, avg(pk) AS m2, greatest(stddev_pop(pk), 1e-9) AS s2 FROM gens) SELECT ord, (n_tokens - m) / s AS n_tokens, (pk - m2) / s2 AS pk FROM gens, s")
def v17(spark, sf):
    return V.standardise(gens(spark, sf).select("ord", F.col("n_tokens").cast("double").alias("n_tokens"), F.col("pk").cast("double").alias("pk")), ["n_tokens", "pk"])


@query("v18_separation", f"WITH {VECS}, {CEN}, u AS (SELECT label, {UNIT('c2')} AS cu FROM cen), w AS (SELECT avg(1 - {D}({UNIT('z')}, cu)) AS within FROM vecs JOIN u USING (label)), b AS (SELECT avg(1 - {D}(a.cu, o.cu)) AS between FROM u a JOIN u o ON a.label < o.label) SELECT within, between, between / within AS ratio FROM w, b")
def v18(spark, sf):
    return V.separation(vecs(spark, sf), "label", "z")


@query("v19_cosine_gap", f"WITH {VECS}, u AS (SELECT vec_id, label, {UNIT('z')} AS u FROM vecs), w AS (SELECT a.label, avg({D}(a.u, b.u)) AS w FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label), p AS (SELECT a.label AS la, b.label AS lb, avg({D}(a.u, b.u)) AS m FROM u a JOIN u b ON a.label < b.label GROUP BY ALL), r AS (SELECT avg(w) AS within FROM w), q AS (SELECT avg(m) AS between FROM p) SELECT within, between, within - between AS gap FROM r, q")
def v19(spark, sf):
    return V.cosine_gap(vecs(spark, sf), "label", "z")


@query("v20_pair_cosine", f"WITH {VECS}, u AS (SELECT vec_id, question_id, {UNIT('z')} AS u FROM vecs) SELECT a.question_id, avg({D}(a.u, b.u)) AS mean_cosine FROM u a JOIN u b ON a.question_id = b.question_id AND a.vec_id < b.vec_id GROUP BY a.question_id")
def v20(spark, sf):
    return V.mean_pair_cosine(vecs(spark, sf), "question_id", "z").select("question_id", "mean_cosine")


def _blk(n, x, y):
    return f"{n} AS (SELECT sum(c * c) AS s FROM (SELECT covar_pop({x}[i], {y}[j]) AS c FROM vecs, range(1, 33) a(i), range(1, 33) b(j) GROUP BY i, j))"


@query("v21_linear_cka", f"WITH {VECS}, {_blk('ab', 'c', 'z')}, {_blk('aa', 'c', 'c')}, {_blk('bb', 'z', 'z')} SELECT ab.s / sqrt(aa.s * bb.s) AS cka FROM ab, aa, bb")
def v21(spark, sf):
    return V.linear_cka(vecs(spark, sf), "c", "z")


@query("v22_procrustes")
def v22(spark, sf):
    return spark.createDataFrame([(k, V.procrustes(vecs(spark, sf), "c", "z", k)) for k in (64, 8)], "components int, disparity double")


@query("v23_pooling", "SELECT conv_id, list_sum(l) / len(l) AS mean_pool, l[-1] AS last_pool FROM (SELECT conv_id, list(length(text) ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def v23(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("l"))
    return c.select("conv_id", (V.total(F.transform("l", lambda x: x["n"].cast("double"))) / F.size("l")).alias("mean_pool"), F.element_at("l", -1)["n"].alias("last_pool"))


# ---------------------------------------------------------------- clustering


@query("c1_c4_gmm_sweep")
def c1(spark, sf):
    return C.sweep(vecs(spark, sf), "vec_id", "question_id", "z", [2, 3, 4], spark)


@query("c2_c7_gmm_assign")
def c2(spark, sf):
    v = vecs(spark, sf)
    model = C.fit_gmm(v, "z", 3, seed=1, n_init=1)
    return C.predict(v, "z", model).groupBy("cluster_id").agg(F.count("*").alias("n"))


_GM = "g(k, p, m, s) AS (VALUES (0, 0.5, 0.1, 1.0), (1, 0.3, -0.2, 0.5), (2, 0.2, 0.0, 2.0))"
_LL = f"WITH {VECS}, {_GM}, r AS (SELECT vec_id, k, ln(p) + list_sum(list_transform(z, lambda x: -0.5 * (ln(2 * pi() * s) + (x - m) * (x - m) / s))) AS l FROM vecs, g), e AS (SELECT vec_id, arg_max(k, (l, -k)) AS cluster_id, max(l) AS top, ln(sum(exp(l - mx))) + max(mx) AS ll FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM r) GROUP BY vec_id)"


@query("c2_c3_gmm_fixed", f"{_LL} SELECT avg(ll) AS mean_ll, -2 * avg(ll) * count(*) + (3 - 1 + 2 * 3 * 32) * ln(count(*)) AS bic, count(*) FILTER (cluster_id = 1) AS n1 FROM e")
def c3(spark, sf):
    """Prediction and BIC of a model given beforehand."""
    model = C.fixed([0.5, 0.3, 0.2], [0.1, -0.2, 0.0], [1.0, 0.5, 2.0], 32)
    p = C.predict(vecs(spark, sf), "z", model)
    return p.agg(F.avg("ll").alias("mean_ll"), (-2 * F.avg("ll") * F.count("*") + (3 - 1 + 2 * 3 * 32) * F.log(F.count("*"))).alias("bic"), F.sum((F.col("cluster_id") == 1).cast("long")).alias("n1"))


@query("k6_saved_model", f"{_LL} SELECT vec_id, cluster_id FROM e")
def k6(spark, sf):
    """The fixed model written and read again; it assigns as before."""
    from ..sources.io import scratch

    path = scratch(spark)
    C.save_gmm(spark, C.fixed([0.5, 0.3, 0.2], [0.1, -0.2, 0.0], [1.0, 0.5, 2.0], 32), path)
    return C.predict(vecs(spark, sf), "z", C.load_gmm(spark, path)).select("vec_id", "cluster_id")


@query("c5_refit_on_all")
def c5(spark, sf):
    _, given = C.select_and_refit(vecs(spark, sf), "vec_id", "question_id", "z", [2, 3], spark, max_iter=10)
    return given.select("vec_id", "cluster_id")


@query("c6_full_sweep")
def c6(spark, sf):
    table_, _ = C.full_sweep(vecs(spark, sf), "vec_id", "z", [2, 3], spark, max_iter=10)
    return table_


@query("c8_kmeans")
def c8(spark, sf):
    return C.kmeans(vecs(spark, sf), "z", 4, n_init=2, seed=3).groupBy("cluster_id").agg(F.count("*").alias("n"))


def _density(spark, sf, rows):
    from ..operators import density as D

    return D, D.fit(rows, "vec_id", "z", most_noise=0.1)


@query("c9_c10_c11_c12_density_clusters")
def c9(spark, sf):
    """Density clusters of the chosen size, noise sent to the nearest centroid."""
    v = vecs(spark, sf)
    D, model = _density(spark, sf, v)
    return D.resolved(model, D.assigned(model), v, "vec_id", "z").groupBy("cluster_id").agg(F.count("*").alias("n"))


_SIL = f"WITH {VECS}, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda q: pow(q[1] - q[2], 2))))) AS d, count(*) AS n FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM p GROUP BY vec_id) SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s"


@query("c13_silhouette", _SIL)
def c13(spark, sf):
    return C.silhouette(vecs(spark, sf), "vec_id", "label", "z")


@query("c14_adjusted_rand", "WITH c AS (SELECT event_type AS a, user_id % 4 AS b, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY a)) AS sa, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY b)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t) AS ari FROM x")
def c14(spark, sf):
    return S.adjusted_rand(table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("u")), "event_type", "u")


MI = "c AS (SELECT prefix_style AS a, pk % 4 AS b, CAST(count(*) AS DOUBLE) AS n FROM gens GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)"


@query("c15_m14_information", f"WITH {GENS}, {MI}, i AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM m), h AS (SELECT (SELECT -sum(p * ln(p)) FROM (SELECT DISTINCT a, na / t AS p FROM m)) AS ha, (SELECT -sum(p * ln(p)) FROM (SELECT DISTINCT b, nb / t AS p FROM m)) AS hb) SELECT mi / ((ha + hb) / 2) AS nmi FROM i, h")
def c15(spark, sf):
    return S.normalised_information(gens(spark, sf).withColumn("b", F.col("pk") % 4), "prefix_style", "b")


@query("c16_purity", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT max(n) AS m, sum(n) AS t FROM c GROUP BY source) SELECT sum(m) / sum(t) AS purity FROM m")
def c16(spark, sf):
    return S.purity(table(spark, sf, "documents"), "source", "lang")


@query("c18_assignment_summary", "SELECT d.lang, l.quality, count(*) AS n, avg(length(text)) AS mean_len FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def c18(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return j.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_len"))


# ---------------------------------------------------------------- probes and statistics


@query("m1_m2_forest_probe")
def m1(spark, sf):
    """300 trees on a split by question, 200 on a stratified split of rows."""
    rows = PR.length_features(traces(spark, sf))
    kinds = {"question": PR.split_by_key(rows, "question_id", 0.3), "rows": PR.stratified_split(rows, "author", "ord", 0.2)}
    parts = [PR.forest_probe(split, ["f1", "f2", "f3"], "author", trees).scores.withColumn("split", F.lit(name)) for (name, split), trees in zip(kinds.items(), (300, 200))]
    return parts[0].unionByName(parts[1])


@query("m2_forest_importances")
def m2(spark, sf):
    rows = PR.stratified_split(PR.length_features(traces(spark, sf)), "author", "ord", 0.2)
    return PR.forest_probe(rows, ["f1", "f2", "f3"], "author", 200).importances


@query("m2_m4_stratified_split", f"WITH {TRACES}, r AS (SELECT ord, author, row_number() OVER (PARTITION BY author ORDER BY {draw_sql('0', 'ord')}, ord) AS i, count(*) OVER (PARTITION BY author) AS n FROM traces) SELECT ord, CASE WHEN i <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r")
def m2_split(spark, sf):
    return PR.stratified_split(traces(spark, sf), "author", "ord", 0.2).select("ord", "split")


@query("m3_m4_m7_text_probe")
def m3(spark, sf):
    """The lexical probe at its full 20,000 features."""
    return PR.text_probe(PR.split_by_key(traces(spark, sf), "question_id", 0.3), "trace", "author")


@query("m4_sgd_probe")
def m4(spark, sf):
    """A linear probe of the labels from vectors, on a stratified split."""
    v = vecs(spark, sf).select("vec_id", "label", "z")
    return PR.vector_probe(PR.stratified_split(v, "label", "vec_id", 0.2), "z", "label")


@query("m7_identifiability")
def m7(spark, sf):
    """All four probes of the author."""
    return PR.identifiability(PR.length_features(traces(spark, sf), "trace"), {"handcrafted_full": ["f1", "f2", "f3"], "handcrafted_density": ["f2", "f3"], "length_only": ["f1"]}, "trace", "author", "question_id")


@query("m5_ridge")
def m5(spark, sf):
    return PR.ridge(vecs(spark, sf), "z", F.col("label").cast("double"), [0.1, 1.0, 10.0])


@query("m8_shuffled_probe")
def m8(spark, sf):
    """The same probe on labels dealt out again among all rows."""
    rows = PR.length_features(traces(spark, sf))
    null = rows.drop("author").join(PR.permuted(rows.select("ord", "author"), "ord", "author", "author", 8), "ord")
    return PR.forest_probe(PR.split_by_key(null, "question_id", 0.3), ["f1", "f2", "f3"], "author", 300).scores


@query("m6_classification", "WITH x AS (SELECT lang AS t, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS g FROM documents), l AS (SELECT DISTINCT t AS l FROM x UNION SELECT DISTINCT g FROM x), f AS (SELECT l, (SELECT count(*) FROM x WHERE t = l AND g = l) AS h, (SELECT count(*) FROM x WHERE t = l) AS a, (SELECT count(*) FROM x WHERE g = l) AS b FROM l) SELECT sum(h) / sum(a) AS accuracy, avg(2 * h / (a + b)) AS macro_f1 FROM f")
def m6(spark, sf):
    x = table(spark, sf, "documents").select(F.col("lang").alias("t"), F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("g"))
    return S.classification(x, "t", "g")


@query("m9_m11_pearson", f"WITH {GENS} SELECT question_id, corr(n_tokens, pk) AS r FROM gens GROUP BY question_id")
def m9(spark, sf):
    return gens(spark, sf).groupBy("question_id").agg(S.safe_corr("n_tokens", "pk").alias("r"))


@query("m10_spearman", f"WITH {GENS}, r AS (SELECT rank() OVER (ORDER BY n_tokens) + (count(*) OVER (PARTITION BY n_tokens) - 1) / 2.0 AS rx, rank() OVER (ORDER BY pk) + (count(*) OVER (PARTITION BY pk) - 1) / 2.0 AS ry FROM gens) SELECT corr(rx, ry) AS rho FROM r")
def m10(spark, sf):
    return S.spearman(gens(spark, sf), "n_tokens", "pk")


@query("m12_m13_eta_squared", f"WITH {GENS}, f AS (SELECT prefix_style, 'n_tokens' AS feature, CAST(n_tokens AS DOUBLE) AS x FROM gens UNION ALL SELECT prefix_style, 'pk', pk FROM gens), g AS (SELECT feature, prefix_style, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY ALL), t AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL) SELECT feature, sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum(n * v)) AS eta2 FROM g JOIN t USING (feature) GROUP BY feature")
def m12(spark, sf):
    return S.eta_squared(gens(spark, sf), "prefix_style", ["n_tokens", "pk"])


@query("m15_m16_information_bits", f"WITH {GENS}, c AS (SELECT question_id, prefix_style AS a, correct AS b, CAST(count(*) AS DOUBLE) AS n FROM gens GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY question_id, a) AS na, sum(n) OVER (PARTITION BY question_id, b) AS nb, sum(n) OVER (PARTITION BY question_id) AS t FROM c), e AS (SELECT question_id, -sum(p * log2(p)) AS entropy FROM (SELECT DISTINCT question_id, a, na / t AS p FROM m) GROUP BY question_id) SELECT question_id, sum(n / t * log2(n * t / (na * nb))) AS mi, any_value(entropy) AS entropy FROM m JOIN e USING (question_id) GROUP BY question_id")
def m15(spark, sf):
    g = gens(spark, sf)
    return S.mutual_information(g, "prefix_style", "correct", True, "question_id").join(S.entropy(g, "prefix_style", True, "question_id"), "question_id")


@query("m17_total_variation", f"WITH {GENS}, p AS (SELECT prefix_style, count(*) / sum(count(*)) OVER () AS p FROM gens WHERE correct GROUP BY ALL), q AS (SELECT prefix_style, count(*) / sum(count(*)) OVER () AS q FROM gens WHERE NOT correct GROUP BY ALL) SELECT sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS tv FROM p FULL JOIN q USING (prefix_style)")
def m17(spark, sf):
    def shares(df):
        c = df.groupBy("prefix_style").count()
        return c.crossJoin(F.broadcast(c.agg(F.sum("count").alias("t")))).select("prefix_style", (F.col("count") / F.col("t")).alias("p"))  # one row

    g = gens(spark, sf)
    return S.total_variation(shares(g.where("correct")), shares(g.where("NOT correct")), "prefix_style")


@query("m18_jaccard", f"WITH {GENS}, s AS (SELECT DISTINCT prefix_style AS o, question_id AS q FROM gens WHERE correct), z AS (SELECT o, count(*) AS n FROM s GROUP BY o), i AS (SELECT x.o AS a, y.o AS b, count(*) AS k FROM s x JOIN s y ON x.q = y.q AND x.o < y.o GROUP BY ALL) SELECT a, b, k / (za.n + zb.n - k) AS jaccard FROM i JOIN z za ON a = za.o JOIN z zb ON b = zb.o")
def m18(spark, sf):
    return S.jaccard_pairs(gens(spark, sf).where("correct"), "prefix_style", "question_id")


TOK = r"regexp_extract_all(lower(trace), '[\p{L}\p{N}_][\p{L}\p{N}_]+')"
TFSQL = f"""WITH {TRACES}, w AS (SELECT ord, question_id, {TOK} AS w FROM traces), g AS (SELECT ord, question_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT ord, any_value(question_id) AS question_id, term, count(*) AS tf FROM g GROUP BY ord, term),
 v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 4096), n AS (SELECT count(DISTINCT ord) AS n FROM traces), x AS (SELECT ord, question_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN v USING (term), n), u AS (SELECT ord, question_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY ord)) AS x FROM x)"""


@query("m19_tfidf", f"{TFSQL} SELECT ord, term, x FROM u")
def m19(spark, sf):
    return TF.tfidf(traces(spark, sf), "ord", "trace", features=4096, min_df=2)


@query("m20_tfidf_distance", f"{TFSQL} SELECT a.question_id, a.ord AS a, b.ord AS b, round(greatest(0, 1 - sum(a.x * b.x)), 9) AS distance FROM u a JOIN u b ON a.question_id = b.question_id AND a.term = b.term AND a.ord < b.ord GROUP BY ALL")
def m20(spark, sf):
    """The texts of each question, as its answers are compared with each other. Equal texts are 0 apart, so nine places are kept."""
    return TF.text_distances(traces(spark, sf), "ord", "question_id", "trace", features=4096, min_df=2).withColumn("distance", F.round("distance", 9))
