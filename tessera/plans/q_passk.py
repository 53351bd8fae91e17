"""Pass@k, budgets, importance weights and variants (B, I, and the sampling rows R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passk as B
from ..operators import sampling as R
from ..operators import weights as I  # noqa: E741
from ..operators.sampling import draw_sql
from .registry import query
from .views import GENS, K, STYLES, TEXTS, TRACES, gens, table, texts, traces

KS = "ks(k) AS (VALUES " + ", ".join(f"({k})" for k in B.BUDGETS) + ")"
PQ = "pq AS (SELECT question_id, count(*) AS n, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS c FROM gens GROUP BY question_id)"
PQS = "pqs AS (SELECT prefix_style, question_id, count(*) AS n, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS c FROM gens GROUP BY ALL)"


def unbiased_sql(n="n", c="c", k="k"):
    return f"CASE WHEN {n} <= 0 OR {k} <= 0 OR {c} <= 0 THEN 0.0 WHEN {n} - {c} < {k} THEN 1.0 ELSE 1 - list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1 - {k} / i)), lambda a, b: a * b) END"


@query("b1_plug_in", f"WITH {GENS}, {PQ}, {KS} SELECT question_id, k, 1 - pow(1 - c / n, k) AS pass_at_k FROM pq, ks")
def b1(spark, sf):
    return B.with_budgets(B.per_question(gens(spark, sf))).select("question_id", "k", B.plug_in(F.col("c") / F.col("n"), F.col("k")).alias("pass_at_k"))


@query("b2_unbiased", f"WITH {GENS}, {PQ}, {KS} SELECT question_id, k, {unbiased_sql()} AS pass_at_k FROM pq, ks")
def b2(spark, sf):
    return B.with_budgets(B.per_question(gens(spark, sf))).select("question_id", "k", B.unbiased(F.col("n"), F.col("c"), F.col("k")).alias("pass_at_k"))


@query("b3_unbiased_clamped", f"WITH {GENS}, {PQS}, {KS}, l AS (SELECT *, least(k, n) AS kk FROM pqs, ks) SELECT prefix_style, question_id, k, {unbiased_sql(k='kk')} AS pass_at_k FROM l")
def b3(spark, sf):
    return B.with_budgets(B.per_question(gens(spark, sf), "prefix_style")).select("prefix_style", "question_id", "k", B.unbiased_clamped(F.col("n"), F.col("c"), F.col("k")).alias("pass_at_k"))


B4 = f"WITH {GENS}, {PQS}, {KS}, v AS (SELECT prefix_style, k, CASE WHEN n >= k THEN {unbiased_sql()} END AS v FROM pqs, ks) SELECT prefix_style, k, avg(v) AS pass_at_k, count(v) AS n_questions FROM v GROUP BY ALL"


@query("b4_passk_question_mean", B4)
def b4(spark, sf):
    return B.question_mean(gens(spark, sf), "prefix_style")


@query("b5_passk_question_mean_clamped", f"WITH {GENS}, {PQS}, {KS}, l AS (SELECT *, least(k, n) AS kk FROM pqs, ks) SELECT prefix_style, k, avg({unbiased_sql(k='kk')}) AS pass_at_k FROM l GROUP BY ALL")
def b5(spark, sf):
    return B.question_mean_clamped(gens(spark, sf), "prefix_style")


WEIGHTS = "wt AS (SELECT prefix_style AS style, count(*) AS weight FROM gens GROUP BY ALL)"


@query("b6_b12_train_weights", f"WITH {GENS}, {WEIGHTS} SELECT style, weight / sum(weight) OVER () AS w FROM wt")
def b6(spark, sf):
    wt = gens(spark, sf).groupBy(F.col("prefix_style").alias("style")).count()
    return wt.crossJoin(F.broadcast(wt.agg(F.sum("count").alias("s")))).select("style", (F.col("count") / F.col("s")).alias("w"))


ALLOC = """raw AS (SELECT total, style, total * (weight / sum(weight) OVER (PARTITION BY total)) AS raw FROM wt, (VALUES (7), (16), (100)) t(total)),
 fl AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base, total - sum(floor(raw)) OVER (PARTITION BY total) AS spare FROM raw),
 al AS (SELECT total, style, base + CAST(row_number() OVER (PARTITION BY total ORDER BY raw - base DESC, CAST(substr(style, 7) AS INTEGER)) <= spare AS BIGINT) AS samples FROM fl)"""


@query("b7_b13_allocate", f"WITH {GENS}, {WEIGHTS}, {ALLOC} SELECT total, style, samples FROM al")
def b7(spark, sf):
    wt = gens(spark, sf).groupBy(F.col("prefix_style").alias("style")).agg(F.count("*").alias("weight"))
    return B.allocate_table(wt, [7, 16, 100])


PS = "ps AS (SELECT question_id, prefix_style AS style, avg(CAST(correct AS DOUBLE)) AS p FROM gens GROUP BY ALL)"
EVEN = {k: B.allocate(k, B.balanced(STYLES)) for k in B.BUDGETS}
EVEN_SQL = "ev(k, style, samples) AS (VALUES " + ", ".join(f"({k}, '{s}', {n})" for k, a in EVEN.items() for s, n in a.items()) + ")"


@query("b8_multi_prefix", f"WITH {GENS}, {PS}, {EVEN_SQL} SELECT question_id, k, CASE WHEN k = 1 THEN sum(p / {K}) ELSE 1 - product(pow(1 - p, samples)) END AS value FROM ps JOIN ev USING (style) GROUP BY question_id, k")
def b8(spark, sf):
    p = gens(spark, sf).groupBy("question_id", F.col("prefix_style").alias("style")).agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return B.multi_prefix(p, B.balanced(STYLES))


@query("b9_curves_by_subject", f"""WITH {GENS}, {KS}, q AS (SELECT question_id, question_id % 5 AS subject, prefix_style, avg(CAST(correct AS DOUBLE)) AS p FROM gens GROUP BY ALL)
 SELECT coalesce(CAST(subject AS VARCHAR), 'all') AS subject, coalesce(prefix_style, 'pooled') AS style, k, avg(1 - pow(1 - p, k)) AS pass_at_k FROM q, ks GROUP BY GROUPING SETS ((k), (subject, k), (prefix_style, k))""")
def b9(spark, sf):
    """Curves for all, for each subject and for each style in one pass of grouping sets."""
    q = gens(spark, sf).withColumn("subject", F.col("question_id") % 5).groupBy("question_id", "subject", "prefix_style").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    q = B.with_budgets(q).withColumn("v", B.plug_in(F.col("p"), F.col("k")))
    sets = q.groupingSets([[F.col("k")], [F.col("subject"), F.col("k")], [F.col("prefix_style"), F.col("k")]], "subject", "prefix_style", "k").agg(F.avg("v").alias("pass_at_k"))
    return sets.select(F.coalesce(F.col("subject").cast("string"), F.lit("all")).alias("subject"), F.coalesce("prefix_style", F.lit("pooled")).alias("style"), "k", "pass_at_k")


@query("b10_standard_curve", f"WITH {GENS}, {PQ}, {KS} SELECT k, avg(1 - pow(1 - c / n, k)) AS pass_at_k FROM pq, ks GROUP BY k")
def b10(spark, sf):
    q = B.with_budgets(B.per_question(gens(spark, sf)))
    return q.groupBy("k").agg(F.avg(B.plug_in(F.col("c") / F.col("n"), F.col("k"))).alias("pass_at_k"))


@query("b11_regrade", f"WITH {TEXTS} SELECT abs(id) % 3 AS question_id, count(*) AS n, CAST(count(*) FILTER (id = -1 OR trim(text) = '42') AS BIGINT) AS c FROM texts GROUP BY ALL")  # of the crafted texts only the first answers 42
def b11(spark, sf):
    """Grades all texts, the crafted ones among them, against a gold answer again and recomputes the success rate."""
    from ..functions.parse import grade

    df = texts(spark, sf).select("id", (F.abs("id") % 3).alias("question_id"), F.col("text").alias("prediction"), F.lit("42").alias("gold"))
    out = df.withColumn("correct", grade("prediction", "gold")["matched"])
    return B.per_question(out).select("question_id", "n", "c")


# ---------------------------------------------------------------- importance weights

IS = f"""cell AS (SELECT question_id, prefix_style, CAST(count(*) AS DOUBLE) AS is_n_c FROM gens GROUP BY ALL), qn AS (SELECT question_id, sum(is_n_c) AS is_K, CAST(count(*) AS DOUBLE) AS is_n_styles_on_q FROM cell GROUP BY ALL),
 sn AS (SELECT prefix_style, sum(is_n_c) AS sn FROM cell GROUP BY ALL), tn AS (SELECT sum(is_n_c) AS tn FROM cell), j AS (SELECT * FROM cell JOIN qn USING (question_id) JOIN sn USING (prefix_style), tn)"""


def _is(target):
    q = f"(sn + 0.01) / (tn + {K} * 0.01)" if target == "global" else f"(is_n_c + is_K * 0.01) / (is_K * 1.01) / ((1 + {K} * 0.01) / 1.01)"
    p = "1.0 / is_n_styles_on_q" if target == "observed" else f"CAST(1.0 / {K} AS DOUBLE)"
    return f"""WITH {GENS}, {IS}, w AS (SELECT *, {q} AS is_q, {p} AS is_p FROM j), m AS (SELECT sum(is_p / is_q * is_n_c) / sum(is_n_c) AS m FROM w)
 SELECT ord, is_q, is_p, is_n_c, is_K, is_n_styles_on_q, is_p / is_q AS is_weight_raw, is_p / is_q / m AS is_weight FROM gens JOIN w USING (question_id, prefix_style), m"""


def _weights(target):
    def run(spark, sf):
        out = I.importance(gens(spark, sf), K, target, style="prefix_style")
        return out.select("ord", "is_q", "is_p", "is_n_c", "is_K", "is_n_styles_on_q", "is_weight_raw", "is_weight")

    return run


for _name, _target in (("i1_i2_i5_weights_uniform", "uniform"), ("i3_weights_observed", "observed"), ("i4_weights_global", "global")):
    query(_name, _is(_target))(_weights(_target))

_W = _is("uniform")


@query("i6_weight_stats", f"WITH z AS ({_W}), g2 AS (SELECT z.*, event_type FROM z JOIN events ON ord = event_id) SELECT event_type, count(*) AS n, avg(is_weight) AS mean, min(is_weight) AS least, max(is_weight) AS most, quantile_cont(is_weight, 0.5) AS p50, quantile_cont(is_weight, 0.9) AS p90, quantile_cont(is_weight, 0.99) AS p99, sum(is_weight) AS total FROM g2 GROUP BY ALL")
def i6(spark, sf):
    from .views import table

    w = I.importance(gens(spark, sf), K, style="prefix_style")
    return I.weight_stats(w.join(table(spark, sf, "events").select(F.col("event_id").alias("ord"), "event_type"), "ord"), "event_type")


@query("i7_variant_style", f"WITH {GENS} SELECT ord FROM gens WHERE prefix_style = 'style_2'")
def i7a(spark, sf):
    return I.build_variant(gens(spark, sf), "style2", K, style="prefix_style").select("ord")


@query("i7_r2_variant_rebalanced", f"""WITH {GENS}, z AS (SELECT prefix_style, count(*) AS n FROM gens GROUP BY ALL), t AS (SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS t FROM z),
 r AS (SELECT prefix_style, ord, row_number() OVER (PARTITION BY prefix_style ORDER BY {draw_sql('0', 'ord')}, ord) AS r FROM gens), d AS (SELECT z.*, t, unnest(range(1, t + 1)) AS draw FROM z, t)
 SELECT d.prefix_style, d.draw, r.ord FROM d JOIN r ON r.prefix_style = d.prefix_style AND r.r = CASE WHEN n >= t THEN draw ELSE {draw_sql('0', 'd.prefix_style', 'draw')} % n + 1 END""")
def i7b(spark, sf):
    return I.build_variant(gens(spark, sf), "rebal", K, style="prefix_style").select("prefix_style", "draw", "ord")


@query("i7_r1_variant_random", f"WITH {GENS} SELECT ord FROM gens QUALIFY row_number() OVER (ORDER BY {draw_sql('0', 'ord')}, ord) <= (SELECT count(*) FROM gens WHERE prefix_style = 'style_1')")
def i7c(spark, sf):
    return I.build_variant(gens(spark, sf), "rand-style1", K, style="prefix_style").select("ord")


@query("i8_i9_control_variants", rf"""WITH {TEXTS}, p AS (SELECT id, regexp_replace(coalesce(text, ''), '^(?:\[[^\]]+\]|<(style_\d+)>)\n', '') AS bare, 'style_' || CAST(abs(id) % 3 + 1 AS VARCHAR) AS s FROM texts)
 SELECT id, '[style_1]' || chr(10) || bare AS const1, '<' || s || '>' || chr(10) || bare AS special, bare AS validation FROM p""")
def i8(spark, sf):
    from ..functions.parse import respelled, with_prefix, without_prefix

    bare = without_prefix(F.coalesce("text", F.lit("")))
    p = texts(spark, sf).select("id", bare.alias("bare"), F.concat(F.lit("style_"), F.abs("id") % 3 + 1).alias("s"))
    return p.select("id", with_prefix(F.lit("style_1"), F.col("bare"), "hard").alias("const1"), respelled(with_prefix(F.col("s"), F.col("bare"), "hard")).alias("special"), F.col("bare").alias("validation"))


@query("i10_reprefix", rf"""WITH {TEXTS} SELECT id, regexp_matches(coalesce(text, ''), '^(?:\[[^\]]+\]|<(style_\d+)>)\n') AS had_prefix, '[style_9]' || chr(10) || regexp_replace(coalesce(text, ''), '^(?:\[[^\]]+\]|<(style_\d+)>)\n', '') AS text FROM texts""")
def i10(spark, sf):
    df = texts(spark, sf).select("id", F.coalesce("text", F.lit("")).alias("text"), F.lit("style_9").alias("s"))
    return I.reprefixed(df, "s", "text").select("id", "had_prefix", "text")


@query("i13_weighted_loss", f"WITH z AS ({_W}) SELECT avg(is_weight * n_tokens) AS loss FROM z JOIN (WITH {GENS} SELECT ord, n_tokens FROM gens) USING (ord)")
def i13(spark, sf):
    return I.importance(gens(spark, sf), K, style="prefix_style").agg(F.avg(F.col("is_weight") * F.col("n_tokens")).alias("loss"))


_SFT = "SELECT doc_id AS ord, doc_id AS question_id, lang AS author, text, CAST(length(text) AS BIGINT) AS trace_len, CAST(length(source) AS INTEGER) * 7 % 3 AS cluster_id, CASE WHEN doc_id % 9 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents"


def _sft(spark, sf):
    """Rows as training examples with clusters, in two splits."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("question_id"), F.col("lang").alias("author"), "text", F.length("text").cast("long").alias("trace_len"), (F.length("source") * 7 % 3).alias("cluster_id"))
    return d.where("ord % 9 != 0"), d.where("ord % 9 = 0")


@query("i11_cluster_prefix_build", f"""WITH s AS ({_SFT}), m AS (SELECT cluster_id, 'style_' || CAST(row_number() OVER (ORDER BY avg(trace_len), cluster_id) AS VARCHAR) AS style FROM s WHERE split = 'train' GROUP BY cluster_id)
 SELECT ord, split, style, author AS oracle_style_name, md5('[' || style || ']' || chr(10) || regexp_replace(coalesce(text, ''), '^(?:\\[[^\\]]+\\]|<(style_\\d+)>)\\n', '')) AS digest FROM s JOIN m USING (cluster_id)""")
def i11(spark, sf):
    train, validation = _sft(spark, sf)
    keys = ["question_id", "author"]
    bare = lambda d: d.drop("cluster_id")
    given = lambda d: d.select(*keys, "cluster_id")
    out = I.cluster_prefixed(bare(train), bare(validation), given(train), given(validation), keys)
    return out.select("ord", "split", "style", "oracle_style_name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("i12_sft_tables", f"""WITH s AS (SELECT doc_id AS ord, source || '::q' || CAST(doc_id % 37 AS VARCHAR) AS question_id, lang AS author, source AS instruction, trim(coalesce(text, '')) AS trace FROM documents WHERE lang IN ('en', 'de') AND trim(coalesce(text, '')) <> ''),
 k AS (SELECT DISTINCT question_id FROM s), r AS (SELECT question_id, row_number() OVER (ORDER BY question_id DESC) AS i, count(*) OVER () AS n FROM k), t AS (SELECT s.*, CASE WHEN i <= least(greatest(1, round_even(0.1 * n, 0)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM s JOIN r USING (question_id))
 SELECT ord, variant, split, CASE author WHEN 'en' THEN 0 ELSE 1 END AS style_id, CASE variant WHEN 'prefixed' THEN '[' || author || ']' || chr(10) ELSE '' END || instruction AS user_text, md5(trace) AS digest FROM t, (VALUES ('standard'), ('prefixed')) v(variant)""")
def i12(spark, sf):
    rows = traces(spark, sf).withColumnRenamed("source_dataset", "instruction")
    out = I.sft_tables(rows, ["en", "de"])
    chat = F.from_json("messages", "array<struct<role:string,content:string>>")
    return out.select("ord", "variant", "split", "style_id", chat[0]["content"].alias("user_text"), F.md5(chat[1]["content"].cast("binary")).alias("digest"))


# ---------------------------------------------------------------- sampling


@query("r3_r10_random_labels", f"WITH {TRACES} SELECT ord, CAST({draw_sql('7', '6', 'ord')} % 6 AS INTEGER) AS label FROM traces")
def r3(spark, sf):
    return traces(spark, sf).select("ord", R.random_label(F.col("ord"), 6, 7).alias("label"))


@query("r4_question_split", f"WITH {TRACES}, k AS (SELECT DISTINCT question_id AS q FROM traces), r AS (SELECT q, row_number() OVER (ORDER BY {draw_sql('0', 'q')}, q) AS i, count(*) OVER () AS n FROM k) SELECT ord, CASE WHEN i <= greatest(1, round_even(0.1 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM traces JOIN r ON question_id = q")
def r4(spark, sf):
    return R.split_by_key(traces(spark, sf), "question_id", 0.1).select("ord", "split")


@query("r9_random_halves", f"WITH {GENS}, p AS (SELECT ord, row_number() OVER (PARTITION BY question_id, prefix_style ORDER BY ord) AS i FROM gens), s AS (SELECT ord, s AS split, {draw_sql('0', 's', 'i')} % 2 AS half FROM p, range(1, 9) t(s)) SELECT split, half, count(*) AS n, CAST(sum(ord) AS BIGINT) AS total FROM s GROUP BY ALL")
def r9(spark, sf):
    h = R.random_halves(gens(spark, sf), ["question_id", "prefix_style"], "ord", 8)
    return h.groupBy("split", "half").agg(F.count("*").alias("n"), F.sum("ord").alias("total"))


@query("r5_tail_split", f"WITH {TRACES}, k AS (SELECT DISTINCT question_id FROM traces), r AS (SELECT question_id, row_number() OVER (ORDER BY question_id DESC) AS i, count(*) OVER () AS n FROM k) SELECT ord, CASE WHEN i <= least(greatest(1, round_even(0.1 * n, 0)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM traces JOIN r USING (question_id)")
def r5(spark, sf):
    return R.tail_split(traces(spark, sf), "question_id", 0.1).select("ord", "split")


@query("r6_r7_group_cap", f"WITH {GENS} SELECT question_id, ord FROM gens QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {draw_sql('0', 'ord')}, ord) <= 20")
def r6(spark, sf):
    return R.per_group_cap(gens(spark, sf), ["question_id"], "ord", 20).select("question_id", "ord")


@query("r8_cap_questions", f"WITH {TRACES}, k AS (SELECT DISTINCT question_id FROM traces), c AS (SELECT question_id FROM k ORDER BY {draw_sql('0', 'question_id')}, question_id LIMIT 30) SELECT question_id, count(*) AS n FROM traces SEMI JOIN c USING (question_id) GROUP BY question_id")
def r8(spark, sf):
    t = traces(spark, sf)
    keys = I.random_subset(t.select("question_id").distinct(), 30, "question_id")
    return t.join(keys, "question_id", "left_semi").groupBy("question_id").agg(F.count("*").alias("n"))


@query("r11_permuted_labels", f"WITH {GENS}, a AS (SELECT ord, row_number() OVER (ORDER BY {draw_sql('1', 'ord')}, ord) AS i FROM gens), b AS (SELECT prefix_style, row_number() OVER (ORDER BY {draw_sql('2', 'ord')}, ord) AS i FROM gens) SELECT ord, prefix_style AS label FROM a JOIN b USING (i)")
def r11(spark, sf):
    """Labels dealt out again among all rows."""
    return R.permuted(gens(spark, sf).select("ord", "prefix_style"), "ord", "prefix_style", "label")


@query("r12_sign_flip", f"WITH {GENS}, c AS (SELECT question_id, avg(n_tokens) - 500 AS cost FROM gens GROUP BY ALL), d AS (SELECT b, avg(cost * (2 * ({draw_sql('0', 'b', 'question_id')} % 2) - 1)) AS d FROM c, range(1, 200) t(b) GROUP BY b), o AS (SELECT avg(cost) AS observed FROM c) SELECT observed, (count(*) FILTER (abs(d) >= abs(observed)) + 1) / (count(*) + 1) AS p_value FROM d, o GROUP BY observed")
def r12(spark, sf):
    """Two-sided sign-flip test of a paired cost against zero: (draws at least as far + 1) / (B + 1)."""
    cost = gens(spark, sf).groupBy("question_id").agg((F.avg("n_tokens") - 500).alias("cost"))
    draws = cost.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(199)))).groupBy("b").agg(F.avg(F.col("cost") * (2 * (R.draw(0, F.col("b"), F.col("question_id")) % 2) - 1)).alias("d"))
    seen = cost.agg(F.avg("cost").alias("observed"))
    return draws.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((F.sum((F.abs("d") >= F.abs("observed")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))  # one row


@query("r13_shards", f"WITH {GENS}, i AS (SELECT ord, ord AS i, count(*) OVER () AS n FROM gens) SELECT ord, CAST((i + 1) * 8 // n - CAST((i + 1) * 8 % n = 0 AS INTEGER) AS BIGINT) AS block, CAST(i % 8 AS BIGINT) AS robin FROM i")
def r13(spark, sf):
    g = gens(spark, sf)
    n = g.count()
    block = F.lit(None).cast("long")
    for i, (a, b) in enumerate(R.shard_ranges(n, 8)):
        block = F.when((F.col("ord") >= a) & (F.col("ord") < b), i).otherwise(block)
    return g.select("ord", block.cast("long").alias("block"), (F.col("ord") % 8).alias("robin"))
