"""Joins, aggregations, windows, ordering and set operations (J, G, W, O, U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..contracts import covered, not_null, one_to_one, unique
from ..operators import ranks as K
from ..operators.sampling import same_question_pairs
from .registry import query
from .views import GENS, STYLES, TRACES, gens, table, table_bytes, traces

P = "CAST(correct AS DOUBLE)"
LAB = "lab AS (SELECT doc_id AS ord, quality AS cluster_id FROM labels)"


def labels(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("cluster_id"))


# ---------------------------------------------------------------- joins


@query("j1_j2_one_to_one", f"WITH {TRACES} SELECT traces.ord, trace_len, source_dataset || '/' || author AS tag FROM traces")
def j1(spark, sf):
    t = traces(spark, sf)
    return one_to_one(t.select("ord", "trace_len"), t.select("ord", F.concat("source_dataset", F.lit("/"), "author").alias("tag")), ["ord"])


@query("j3_style_name_map", f"WITH {GENS}, m AS (SELECT DISTINCT prefix_style, CAST(substr(prefix_style, 7) AS INTEGER) AS style_id FROM gens) SELECT ord, style_id FROM gens LEFT JOIN m USING (prefix_style)")
def j3(spark, sf):
    g = gens(spark, sf)
    names = g.select("prefix_style").distinct().withColumn("style_id", F.substring("prefix_style", 7, 5).cast("int"))
    return g.join(names, "prefix_style", "left").select("ord", "style_id")


@query("j4_j5_left_with_defaults", f"WITH {TRACES}, {LAB} SELECT ord, coalesce(cluster_id, -1) AS cluster_id, bool_or(cluster_id IS NULL) OVER () AS any_missing FROM traces LEFT JOIN lab USING (ord)")
def j4(spark, sf):
    j = traces(spark, sf).select("ord").join(labels(spark, sf), "ord", "left")
    flag = j.agg(F.max(F.col("cluster_id").isNull()).alias("any_missing"))
    return j.crossJoin(F.broadcast(flag)).select("ord", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "any_missing")  # one row


@query("j6_j7_coverage_contract", f"WITH {TRACES}, {LAB} SELECT ord, cluster_id FROM traces JOIN lab USING (ord)")
def j7(spark, sf):
    t = traces(spark, sf).select("ord")
    lab = unique(labels(spark, sf), "ord")
    return not_null(covered(t.join(lab, "ord", "inner"), "cluster_id", 0.99), "ord")


@query("j8_text_prefix_join", f"WITH {TRACES}, l AS (SELECT question_id, substr(trace, 1, 200) AS head, max(ord) AS last_ord FROM traces WHERE ord % 2 = 0 GROUP BY ALL) SELECT traces.ord, coalesce(last_ord, -1) AS matched FROM traces LEFT JOIN l ON traces.question_id = l.question_id AND substr(trace, 1, 200) = head")
def j8(spark, sf):
    """The last of duplicate labels wins; a miss is -1."""
    t = traces(spark, sf).withColumn("head", F.substring("trace", 1, 200))
    last = t.where("ord % 2 = 0").groupBy("question_id", "head").agg(F.max("ord").alias("last_ord"))
    return t.join(last, ["question_id", "head"], "left").select("ord", F.coalesce("last_ord", F.lit(-1)).alias("matched"))


@query("j9_fallback_keys", f"""WITH {TRACES}, gold AS (SELECT question_id AS key, min(ord) AS answer FROM traces WHERE ord % 3 = 0 GROUP BY ALL UNION ALL SELECT split_part(question_id, '::', 2), max(ord) FROM traces WHERE ord % 5 = 0 GROUP BY ALL),
 k AS (SELECT ord, question_id AS key, 0 AS pr FROM traces UNION ALL SELECT ord, split_part(question_id, '::', 2), 1 FROM traces) SELECT ord, arg_min(answer, pr) AS answer FROM k JOIN gold USING (key) GROUP BY ord""")
def j9(spark, sf):
    t = traces(spark, sf).withColumn("short", F.split("question_id", "::", 2)[1])
    gold = t.where("ord % 3 = 0").groupBy(F.col("question_id").alias("key")).agg(F.min("ord").alias("answer")).unionByName(t.where("ord % 5 = 0").groupBy(F.col("short").alias("key")).agg(F.max("ord").alias("answer")))
    keys = t.select("ord", F.posexplode(F.array("question_id", "short")).alias("pr", "key"))
    return keys.join(gold, "key").groupBy("ord").agg(F.min_by("answer", "pr").alias("answer"))


@query("j10_j11_key_alignment", "SELECT e.vec_id, e.label, d.lang FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def j10(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")


@query("j12_j13_problem_meta", f"WITH {GENS}, m AS (SELECT DISTINCT question_id, question_id % 4 AS bucket FROM gens) SELECT bucket, count(*) AS n, avg({P}) AS acc FROM gens JOIN m USING (question_id) GROUP BY bucket")
def j12(spark, sf):
    g = gens(spark, sf)
    meta = g.select("question_id").distinct().withColumn("bucket", F.col("question_id") % 4)
    return g.join(meta, "question_id").groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"))


@query("j14_j15_style_grid", f"SELECT item_id, 'style_' || CAST(s AS VARCHAR) AS style FROM benchmark, range(1, {len(STYLES) + 1}) t(s)")
def j15(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.array(*[F.lit(s) for s in STYLES])).alias("style"))


@query("j16_question_pairs", f"WITH {TRACES} SELECT a.question_id, a.ord AS id_a, b.ord AS id_b FROM traces a JOIN traces b ON a.question_id = b.question_id AND a.ord < b.ord")
def j16(spark, sf):
    return same_question_pairs(traces(spark, sf), "question_id", "ord")


@query("j17_style_pairs", "SELECT a.s AS a, b.s AS b FROM (SELECT DISTINCT event_type AS s FROM events) a, (SELECT DISTINCT event_type AS s FROM events) b WHERE a.s < b.s")
def j17(spark, sf):
    s = table(spark, sf, "events").select(F.col("event_type").alias("a")).distinct()
    return s.join(s.withColumnRenamed("a", "b"), F.expr("a < b"))


@query("j18_semi_join", f"WITH {GENS} SELECT ord FROM gens WHERE question_id IN (SELECT question_id FROM gens GROUP BY question_id HAVING count(*) >= 70)")
def j18(spark, sf):
    g = gens(spark, sf)
    return g.join(g.groupBy("question_id").count().where("count >= 70"), "question_id", "left_semi").select("ord")


#: Bytes of keys that one block of rows is dealt for.
BLOCK_BYTES = 32 << 20


@query("j19_partner_of_other_question")
def j19(spark, sf):
    """Every row with a row of another question: both are dealt to places by hash within a block, and shifted until they differ.

    After four shifts the next row of another question in the block's order is taken, or the first of the next block that has one.
    """
    t = traces(spark, sf).select("ord", "question_id")
    blocks = max(16, table_bytes(t) // BLOCK_BYTES)
    h = F.xxhash64("ord")
    place = W.partitionBy("b").orderBy(h, "ord")
    me = F.struct(F.col("ord").alias("partner"), F.col("question_id").alias("other"))
    a = t.withColumn("b", F.pmod(F.xxhash64("ord", F.lit(3)), F.lit(blocks))).withColumns({"i": F.row_number().over(place), "n": F.count("*").over(W.partitionBy("b")), "new": F.coalesce(F.lag("question_id").over(place) != F.col("question_id"), F.lit(False))})
    later = W.partitionBy("b").orderBy(h.desc(), F.desc("ord")).rowsBetween(W.unboundedPreceding, -1)
    a = a.withColumn("next", F.last(F.when(F.col("new"), me), True).over(later))
    shifts = a.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("j", F.pmod(F.col("i") - 1 + F.col("shift"), F.col("n")) + 1)
    b = a.select("b", F.col("i").alias("j"), F.col("ord").alias("partner"), F.col("question_id").alias("other"))
    near = shifts.join(b, ["b", "j"]).where("question_id <> other").groupBy("ord", "question_id").agg(F.min_by(F.struct("partner", "other"), "shift").alias("p"))
    lone = a.join(near.select("ord", "question_id"), ["ord", "question_id"], "left_anti")
    # the first row of each block and its first of another question: two rows for each block
    firsts = a.where("i = 1 OR new").groupBy("b").agg(F.min_by(me, "i").alias("x"), F.min_by(me, F.when(F.col("new"), F.col("i"))).alias("y"))
    firsts = firsts.select(F.col("b").alias("fb"), F.posexplode(F.array("x", "y")).alias("k", "q")).where("q IS NOT NULL")
    far = lone.where("next IS NULL").join(F.broadcast(firsts), F.expr("question_id <> q.other")).groupBy("ord", "question_id").agg(F.min_by("q", F.struct(F.pmod(F.col("fb") - F.col("b"), F.lit(blocks)), "k")).alias("p"))
    found = near.unionByName(lone.where("next IS NOT NULL").select("ord", "question_id", F.col("next").alias("p"))).unionByName(far)
    return found.select("ord", "question_id", "p.partner", "p.other")


@query("j20_anti_and_exactly_one", f"WITH {GENS}, s AS (SELECT question_id, prefix_style FROM gens GROUP BY ALL HAVING sum(CAST(correct AS INTEGER)) >= 9), c AS (SELECT question_id, count(s.prefix_style) AS n FROM (SELECT DISTINCT question_id FROM gens) LEFT JOIN s USING (question_id) GROUP BY ALL) SELECT question_id, n AS styles FROM c WHERE n <= 1")
def j20(spark, sf):
    g = gens(spark, sf)
    solved = g.groupBy("question_id", "prefix_style").agg(F.sum(F.col("correct").cast("int")).alias("c")).where("c >= 9")
    one = solved.groupBy("question_id").agg(F.count("*").alias("styles")).where("styles = 1")
    return one.unionByName(g.select("question_id").distinct().join(solved, "question_id", "left_anti").withColumn("styles", F.lit(0).cast("long")))


# ---------------------------------------------------------------- aggregations


@query("g1_g2_counts_and_shares", f"WITH {GENS} SELECT prefix_style, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM gens GROUP BY prefix_style")
def g1(spark, sf):
    c = gens(spark, sf).groupBy("prefix_style").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("prefix_style", "n", (F.col("n") / F.col("t")).alias("share"))  # one row


@query("g3_mean_over_domain", f"WITH {GENS}, d AS (SELECT 'style_' || CAST(i AS VARCHAR) AS prefix_style FROM range(1, 8) t(i)) SELECT prefix_style, coalesce(avg(n_tokens), 0) AS mean_or_zero, avg(n_tokens) AS mean_or_null FROM d LEFT JOIN gens USING (prefix_style) GROUP BY prefix_style")
def g3(spark, sf):
    domain = spark.range(1, 8).select(F.concat(F.lit("style_"), "id").alias("prefix_style"))
    m = gens(spark, sf).groupBy("prefix_style").agg(F.avg("n_tokens").alias("mean_or_null"))
    return domain.join(m, "prefix_style", "left").select("prefix_style", F.coalesce("mean_or_null", F.lit(0.0)).alias("mean_or_zero"), "mean_or_null")


@query("g4_count_distinct", f"WITH {GENS} SELECT prefix_style, count(DISTINCT question_id) AS questions FROM gens GROUP BY prefix_style")
def g4(spark, sf):
    return gens(spark, sf).groupBy("prefix_style").agg(F.countDistinct("question_id").alias("questions"))


@query("g5_g6_two_level_mean", f"WITH {GENS}, q AS (SELECT prefix_style, question_id, avg({P}) AS p FROM gens GROUP BY ALL) SELECT prefix_style, avg(p) AS mean_p, count(*) AS questions FROM q GROUP BY prefix_style")
def g6(spark, sf):
    q = gens(spark, sf).groupBy("prefix_style", "question_id").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return q.groupBy("prefix_style").agg(F.avg("p").alias("mean_p"), F.count("*").alias("questions"))


@query("g7_g10_quantiles_and_spread", f"WITH {GENS} SELECT prefix_style, quantile_cont(n_tokens, 0.5) AS p50, quantile_cont(n_tokens, 0.9) AS p90, quantile_cont(n_tokens, 0.99) AS p99, stddev_pop(n_tokens) AS sd_pop, stddev_samp(n_tokens) AS sd_samp FROM gens GROUP BY prefix_style")
def g7(spark, sf):
    g = gens(spark, sf)
    spread = g.groupBy("prefix_style").agg(F.stddev_pop("n_tokens").alias("sd_pop"), F.stddev_samp("n_tokens").alias("sd_samp"))
    return K.beside(spread, K.quantiles(g, ["prefix_style"], "n_tokens", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), ["prefix_style"])


@query("g8_nearest_rank", f"WITH {GENS}, r AS (SELECT prefix_style, n_tokens, row_number() OVER (PARTITION BY prefix_style ORDER BY n_tokens) - 1 AS i, count(*) OVER (PARTITION BY prefix_style) AS n FROM gens) SELECT prefix_style, max(n_tokens) FILTER (i = n // 2) AS p50, max(n_tokens) FILTER (i = CAST(floor(0.99 * (n - 1)) AS BIGINT)) AS p99 FROM r GROUP BY prefix_style")
def g8(spark, sf):
    return K.nearest_rank(gens(spark, sf), ["prefix_style"], "n_tokens", {"p50": lambda n: F.floor(n / 2), "p99": lambda n: F.floor(F.lit(0.99) * (n - 1))})


@query("g9_median_group_count", f"WITH {GENS}, c AS (SELECT count(*) AS n FROM gens GROUP BY prefix_style) SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS target FROM c")
def g9(spark, sf):
    return gens(spark, sf).groupBy("prefix_style").agg(F.count("*").alias("n")).agg(F.floor(F.percentile("n", F.lit(0.5))).alias("target"))


@query("g11_conditional_rates", f"WITH {GENS} SELECT prefix_style, avg(CAST(finish_reason = 'length' AS INTEGER)) AS truncated, avg(CAST(n_tokens > 500 AS INTEGER)) AS long_share FROM gens GROUP BY prefix_style")
def g11(spark, sf):
    rate = lambda c: F.avg(c.cast("int"))
    return gens(spark, sf).groupBy("prefix_style").agg(rate(F.col("finish_reason") == "length").alias("truncated"), rate(F.col("n_tokens") > 500).alias("long_share"))


@query("g12_mode", f"WITH {GENS}, c AS (SELECT question_id, prefix_style, count(*) AS n FROM gens GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY question_id) AS t, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, prefix_style) AS i FROM c) SELECT question_id, prefix_style AS mode, n / t AS share FROM r WHERE i = 1")
def g12(spark, sf):
    return K.mode(gens(spark, sf), ["question_id"], "prefix_style")


@query("g13_g14_contingency", f"WITH {GENS}, c AS (SELECT prefix_style, pk % 4 AS b, count(*) AS n FROM gens GROUP BY ALL) SELECT prefix_style, b, n, n / sum(n) OVER (PARTITION BY prefix_style) AS share FROM c")
def g13(spark, sf):
    return K.row_shares(gens(spark, sf).withColumn("b", F.col("pk") % 4), "prefix_style", "b")


@query("g15_pivot_complete", f"WITH {GENS}, m AS (SELECT question_id, {', '.join(f'avg(n_tokens) FILTER (prefix_style = {chr(39)}{s}{chr(39)}) AS {s}' for s in STYLES)} FROM gens GROUP BY question_id) SELECT * FROM m WHERE {' AND '.join(f'{s} IS NOT NULL' for s in STYLES)}")
def g15(spark, sf):
    return gens(spark, sf).groupBy("question_id").pivot("prefix_style", STYLES).agg(F.avg("n_tokens")).na.drop("any")


@query("g16_ordered_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def g16(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


@query("g18_vector_mean", "SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def g18(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.avg("x").alias("mean"))


@query("g17_solved_sets", f"WITH {GENS}, s AS (SELECT question_id, prefix_style, max(CAST(correct AS INTEGER)) AS ok FROM gens GROUP BY ALL) SELECT prefix_style, CAST(sum(ok) AS BIGINT) AS solved, count(*) AS seen FROM s GROUP BY prefix_style")
def g17(spark, sf):
    s = gens(spark, sf).groupBy("question_id", "prefix_style").agg(F.max(F.col("correct").cast("int")).alias("ok"))
    return s.groupBy("prefix_style").agg(F.sum("ok").alias("solved"), F.count("*").alias("seen"))


@query("g20_weighted_sum", f"WITH {GENS}, s AS (SELECT question_id, prefix_style, avg({P}) AS p FROM gens GROUP BY ALL) SELECT question_id, sum(p * CAST(substr(prefix_style, 7) AS INTEGER) / 15.0) AS value FROM s GROUP BY question_id")
def g20(spark, sf):
    s = gens(spark, sf).groupBy("question_id", "prefix_style").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return s.groupBy("question_id").agg(F.sum(F.col("p") * F.substring("prefix_style", 7, 3).cast("int") / 15.0).alias("value"))


@query("g21_g22_grouping_sets", f"WITH {TRACES} SELECT coalesce(author, 'all') AS author, coalesce(source_dataset, 'all') AS source, count(*) AS n, avg(trace_len) AS mean_len FROM traces GROUP BY GROUPING SETS ((), (author), (author, source_dataset))")
def g21(spark, sf):
    a, s = F.col("author"), F.col("source_dataset")
    t = traces(spark, sf).groupingSets([[], [a], [a, s]], "author", "source_dataset").agg(F.count("*").alias("n"), F.avg("trace_len").alias("mean_len"))
    return t.select(F.coalesce("author", F.lit("all")).alias("author"), F.coalesce("source_dataset", F.lit("all")).alias("source"), "n", "mean_len")


# ---------------------------------------------------------------- windows


@query("w1_w2_w3_group_sizes", f"WITH {GENS}, q AS (SELECT question_id, count(*) AS n_q, count(DISTINCT prefix_style) AS n_styles FROM gens GROUP BY ALL), c AS (SELECT question_id, prefix_style, count(*) AS n_c FROM gens GROUP BY ALL) SELECT ord, n_q, n_c, n_styles FROM gens JOIN q USING (question_id) JOIN c USING (question_id, prefix_style)")
def w1(spark, sf):
    """Sizes as aggregates joined back, so no task holds a whole group."""
    g = gens(spark, sf)
    c = g.groupBy("question_id", "prefix_style").agg(F.count("*").alias("n_c"))
    q = c.groupBy("question_id").agg(F.sum("n_c").alias("n_q"), F.count("*").alias("n_styles"))
    return g.join(c.join(q, "question_id"), ["question_id", "prefix_style"]).select("ord", "n_q", "n_c", "n_styles")


@query("w4_mean_normalise", f"WITH {GENS} SELECT ord, n_tokens / avg(n_tokens) OVER () AS w FROM gens")
def w4(spark, sf):
    g = gens(spark, sf)
    return g.crossJoin(F.broadcast(g.agg(F.avg("n_tokens").alias("m")))).select("ord", (F.col("n_tokens") / F.col("m")).alias("w"))  # one row


@query("w5_w6_first_k", f"WITH {GENS}, r AS (SELECT ord, row_number() OVER (PARTITION BY question_id, prefix_style ORDER BY ord) - 1 AS sample_idx FROM gens) SELECT * FROM r WHERE sample_idx < 4")
def w5(spark, sf):
    r = F.row_number().over(W.partitionBy("question_id", "prefix_style").orderBy("ord"))
    return gens(spark, sf).withColumn("r", r).where("r <= 4").select("ord", (F.col("r") - 1).cast("long").alias("sample_idx"))


@query("w7_c17_rank_clusters", "WITH m AS (SELECT d.source AS cluster, avg(length(text)) AS mean_len, count(*) AS n FROM documents d GROUP BY ALL) SELECT cluster, 'style_' || CAST(row_number() OVER (ORDER BY mean_len, cluster) AS VARCHAR) AS style, n FROM m")
def w7(spark, sf):
    return K.name_clusters(table(spark, sf, "documents").withColumn("len", F.length("text")), "source", "len").withColumnRenamed("source", "cluster")


@query("w8_average_rank", f"WITH {GENS}, r AS (SELECT ord, question_id, rank() OVER (PARTITION BY question_id ORDER BY n_tokens) AS r, count(*) OVER (PARTITION BY question_id, n_tokens) AS c FROM gens) SELECT ord, r + (c - 1) / 2.0 AS avg_rank FROM r")
def w8(spark, sf):
    return K.average_rank(gens(spark, sf), ["question_id"], "n_tokens", "avg_rank").select("ord", "avg_rank")


@query("w9_quartile_of_rank", f"WITH {GENS}, q AS (SELECT question_id, avg({P}) AS p FROM gens GROUP BY ALL), r AS (SELECT question_id, row_number() OVER (ORDER BY p, question_id) AS r, count(*) OVER () AS n FROM q) SELECT question_id, CAST(r > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(r > 1 + (n - 1) * 0.5 AS INTEGER) + CAST(r > 1 + (n - 1) * 0.75 AS INTEGER) AS bucket FROM r")
def w9(spark, sf):
    q = gens(spark, sf).groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return K.rank_quartile(q, "p", "question_id").select("question_id", "bucket")


@query("w10_digitise", f"WITH {GENS}, z AS (SELECT quantile_cont(n_tokens, 0.25) AS a, quantile_cont(n_tokens, 0.5) AS b, quantile_cont(n_tokens, 0.75) AS c FROM gens) SELECT ord, CAST(n_tokens >= a AS INTEGER) + CAST(n_tokens >= b AS INTEGER) + CAST(n_tokens >= c AS INTEGER) AS bin FROM gens, z")
def w10(spark, sf):
    return K.digitise(gens(spark, sf), "n_tokens", [0.25, 0.5, 0.75], "bin").select("ord", "bin")


@query("w11_argmin", f"WITH {GENS} SELECT question_id, arg_min(correct, (abs(n_tokens - 400), ord)) AS picked, min((abs(n_tokens - 400), ord)::STRUCT(a INTEGER, b BIGINT)).a AS dist FROM gens GROUP BY question_id")
def w11(spark, sf):
    key = F.struct(F.abs(F.col("n_tokens") - 400).alias("d"), "ord")
    return gens(spark, sf).groupBy("question_id").agg(F.min_by("correct", key).alias("picked"), F.min(key)["d"].alias("dist"))


@query("w12_w13_winners", f"WITH {GENS}, p AS (SELECT question_id, prefix_style, avg({P}) AS p FROM gens GROUP BY ALL), r AS (SELECT *, max(p) OVER (PARTITION BY question_id) AS m, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, prefix_style) AS i FROM p) SELECT question_id, count(*) FILTER (p = m) AS winners, min(prefix_style) FILTER (i = 1) AS best, max(p) FILTER (i = 1) - max(p) FILTER (i = 2) AS gap FROM r GROUP BY question_id")
def w12(spark, sf):
    p = gens(spark, sf).groupBy("question_id", "prefix_style").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return K.winners(p, "question_id", "prefix_style", "p")


@query("w15_cumulative_groups", f"WITH {TRACES}, n AS (SELECT question_id, count(*) AS n FROM traces GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY question_id ROWS UNBOUNDED PRECEDING) AS upto FROM n) SELECT question_id, n FROM r WHERE upto - n < 200")
def w15(spark, sf):
    """Whole questions in key order until 200 rows are reached; one row for each question is ordered."""
    n = traces(spark, sf).groupBy("question_id").agg(F.count("*").alias("n"))
    return K.running(n, ["question_id"], F.col("n"), "upto").where("upto - n < 200").select("question_id", "n")


@query("w16_nucleus", f"WITH {GENS}, c AS (SELECT question_id, prefix_style, count(*) AS n FROM gens GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY question_id) AS p FROM c), r AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY question_id) AS t, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY question_id ORDER BY n DESC, prefix_style ROWS UNBOUNDED PRECEDING)) SELECT question_id, prefix_style FROM r WHERE i = 1 OR upto * 10 <= t * 7")
def w16(spark, sf):
    """The most probable styles while their sum stays within 0.7, the first always."""
    c = gens(spark, sf).groupBy("question_id", "prefix_style").agg(F.count("*").alias("n"))
    w = W.partitionBy("question_id").orderBy(F.desc("n"), "prefix_style")
    r = c.withColumns({"upto": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "t": F.sum("n").over(W.partitionBy("question_id")), "i": F.row_number().over(w)})
    return r.where("i = 1 OR upto * 10 <= t * 7").select("question_id", "prefix_style")


@query("w17_ecdf", f"WITH {GENS}, q AS (SELECT question_id, avg({P}) AS p FROM gens GROUP BY ALL) SELECT question_id, row_number() OVER (ORDER BY p, question_id) / count(*) OVER () AS ecdf FROM q")
def w17(spark, sf):
    q = gens(spark, sf).groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return K.ecdf(q, ["p", "question_id"]).select("question_id", "ecdf")


# ---------------------------------------------------------------- order and sets


@query("o1_o2_o3_orders", """SELECT name, CAST(row_number() OVER (ORDER BY CASE WHEN name = 'other' THEN 99 ELSE CAST(substr(name, 7) AS INTEGER) END) AS BIGINT) AS place, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS lexical,
 CAST(CASE name WHEN 'style_7' THEN 0 WHEN 'other' THEN 1 WHEN 'style_2' THEN 2 ELSE 3 END AS INTEGER) AS ordinal FROM (SELECT DISTINCT CASE WHEN doc_id % 13 = 12 THEN 'other' ELSE 'style_' || CAST(doc_id % 13 + 1 AS VARCHAR) END AS name FROM documents)""")
def o1(spark, sf):
    """Distinct names of a code table's size, in natural, code point and custom order."""
    from ..operators.passk import style_order

    k = F.col("doc_id") % 13
    names = table(spark, sf, "documents").select(F.when(k == 12, "other").otherwise(F.concat(F.lit("style_"), (k + 1).cast("string"))).alias("name")).distinct()
    ordinal = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(("style_7", "other", "style_2")) for x in (n, i)]), F.col("name")), F.lit(3))
    return names.select("name", F.row_number().over(W.orderBy(style_order("name"))).cast("long").alias("place"), F.row_number().over(W.orderBy("name")).cast("long").alias("lexical"), ordinal.alias("ordinal"))


@query("o4_o5_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o6_first_distinct_keys", f"WITH {TRACES}, k AS (SELECT question_id, min(ord) AS f FROM traces GROUP BY ALL ORDER BY f LIMIT 40) SELECT ord FROM traces SEMI JOIN k USING (question_id)")
def o6(spark, sf):
    t = traces(spark, sf)
    first = t.groupBy("question_id").agg(F.min("ord").alias("f")).orderBy("f").limit(40)
    return t.join(first, "question_id", "left_semi").select("ord")


SOLVED = f"WITH {GENS}, s AS (SELECT question_id, prefix_style FROM gens GROUP BY ALL HAVING sum(CAST(correct AS INTEGER)) >= 6)"


@query("u1_u2_u3_set_operations", f"""{SOLVED}, a AS (SELECT question_id FROM s WHERE prefix_style = 'style_1'), b AS (SELECT question_id FROM s WHERE prefix_style = 'style_2')
 SELECT 'union' AS op, question_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', question_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', question_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def u1(spark, sf):
    s = gens(spark, sf).groupBy("question_id", "prefix_style").agg(F.sum(F.col("correct").cast("int")).alias("c")).where("c >= 6")
    a, b = (s.where(F.col("prefix_style") == f"style_{k}").select("question_id") for k in (1, 2))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "question_id")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "both")).unionByName(tag(a.subtract(b), "only"))


@query("star_revenue_by_nation", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star(spark, sf):
    """The relational parts at volume: three joins and an aggregate over the largest table."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
