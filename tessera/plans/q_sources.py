"""Source, sink, projection and registry queries (S, K, P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import registry as RG
from ..operators.ranks import running
from ..operators.sampling import draw, draw_sql
from ..sources import io
from .registry import query
from .views import GENS, MSGS, STYLES, TEXTS, TRACES, gens, msgs, table, texts, traces


@query("s1_config_scan", "SELECT doc_id, source FROM documents WHERE source = 'src3'")
def s1(spark, sf):
    return io.read_config(spark, f"{sf}/documents.parquet", "src3", "source").select("doc_id", "source")


@query("s2_s3_k1_split_scan", f"WITH {TRACES} SELECT ord, trace_len FROM traces WHERE ord % 10 = 0")
def s2(spark, sf):
    path = io.scratch(spark)
    io.write_split(traces(spark, sf).select("ord", "trace_len", F.when(F.col("ord") % 10 == 0, "validation").otherwise("train").alias("split")), path)
    return io.read_split(spark, path).select("ord", "trace_len")


@query("s4_full_scan", "SELECT * FROM customer")
def s4(spark, sf):
    return io.read_table(spark, f"{sf}/customer.parquet")


@query("s5_column_pruning", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s5(spark, sf):
    return io.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("s6_s7_k4_jsonl", f"WITH {GENS} SELECT CAST(question_id AS VARCHAR) AS question_id, prefix_style, correct, CAST(n_tokens AS BIGINT) AS n_tokens, finish_reason, true AS strict_raises FROM gens WHERE ord % 7 <> 0 AND ord % 11 <> 0")
def s6(spark, sf):
    """Lines of generations, some cut off and some blank: the tolerant scan leaves these out, the strict one raises at the first that is cut."""
    path = io.scratch(spark)
    rows = gens(spark, sf).select("ord", F.to_json(F.struct(F.col("question_id").cast("string").alias("question_id"), "prefix_style", "correct", F.col("n_tokens").cast("long").alias("n_tokens"), "finish_reason")).alias("line"))
    io.write_lines(rows.select(F.when(F.col("ord") % 11 == 0, "").when(F.col("ord") % 7 == 0, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line"))), path)
    try:
        io.read_jsonl(spark, path, strict=True).write.format("noop").mode("overwrite").save()
        raises = False
    except Exception as e:  # noqa: BLE001  Spark's own kinds of error
        raises = "MALFORMED" in str(e).upper()
    return io.read_jsonl(spark, path).select("question_id", "prefix_style", "correct", "n_tokens", "finish_reason", F.lit(raises).alias("strict_raises"))


@query("s8_fallback_fields", "SELECT conv_id, turn, substr(coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE text END, ''), nullif(text, ''), ''), 1, 2000) AS output FROM conversations")
def s8(spark, sf):
    c = table(spark, sf, "conversations").withColumn("output", F.when(F.col("role") == "user", "").otherwise(F.col("text")))
    return c.select("conv_id", "turn", io.first_text("output", "text").alias("output"))


MATRIX_ROWS = 256


@query("s9_matrix_scan", f"SELECT vec_id // {MATRIX_ROWS} AS shard, vec_id % {MATRIX_ROWS} AS row, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings")
def s9(spark, sf):
    """The embeddings as archives of 256 rows each, written and scanned again."""
    path = io.scratch(spark)
    io.write_matrices(table(spark, sf, "embeddings").withColumn("shard", F.floor(F.col("vec_id") / MATRIX_ROWS)), "shard", "vec_id", "embedding", "z_s", path)
    return io.read_matrices(spark.read.parquet(path), "z_s", "shard").select("shard", "row", F.col("vector")[0].alias("first"), F.element_at("vector", -1).alias("last"))


@query("s10_w14_contiguity", f"SELECT vec_id // {MATRIX_ROWS} AS shard_id, min(vec_id) AS row_start, max(vec_id) + 1 AS row_end FROM embeddings GROUP BY 1")
def s10(spark, sf):
    shards = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / MATRIX_ROWS).alias("shard_id")).agg(F.min("vec_id").alias("row_start"), (F.max("vec_id") + 1).alias("row_end"))
    return io.contiguous(shards)


@query("s11_curve_files", f"""WITH {GENS}, q AS (SELECT question_id, avg(CAST(correct AS DOUBLE)) AS p FROM gens GROUP BY question_id)
 SELECT question_id, CASE WHEN question_id % 4 < 2 THEN round(p * 100, 2) END AS pass_1, CASE question_id % 4 WHEN 0 THEN round(p / 2 * 100, 2) WHEN 2 THEN round(p * 100, 2) END AS pass_8 FROM q""")
def s11(spark, sf):
    """Result texts of each question, in the three forms that such files have and one that holds no curve."""
    p, half = F.col("p").cast("string"), (F.col("p") / 2).cast("string")
    told = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        told('{"pass_at_k": {"1": ', p, ', "8": ', half, "}}"), told('{"pass_at_k_cluster_prefix": {"1": ', p, '}, "pass_at_k": {"1": 0.1}}'),
        told('{"pass_at_k": {}, "pass_at_k_standard": {"8": ', p, "}}"), F.lit('{"other": 1}'),
    ]
    q = gens(spark, sf).groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return q.withColumn("text", F.element_at(F.array(*forms), (F.col("question_id") % 4 + 1).cast("int"))).select("question_id", *io.curve_values(F.col("text"), [1, 8]))


_LISTED = ["customer", "conversations"]


@query("s12_directory_scan", " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, count(*) AS n FROM {n}" for n in _LISTED))
def s12(spark, sf):
    """The tables of the folder whose names match, and how many rows their files hold."""
    files = io.list_files(spark, sf, glob="*.parquet", keep=r"^c.*s\.parquet$|^customer", drop=r"events")
    parts = [io.read_table(spark, f"{sf}/{r['name']}").agg(F.lit(r["name"]).alias("name"), F.count("*").alias("n")) for r in files.select("name").distinct().orderBy("name").collect()]  # tables of a folder
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s13_s14_problem_union", "SELECT 'b' || CAST(item_id AS VARCHAR) AS question_id, text AS question, CAST(item_id AS VARCHAR) AS answer, 'bench' AS subject FROM benchmark UNION ALL SELECT CAST(doc_id AS VARCHAR), text, CAST(n_chars AS VARCHAR), lang FROM documents")
def s13(spark, sf):
    a = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("unique_id"), F.col("text").alias("problem"), F.col("item_id").alias("answer"), F.lit(0).alias("row"))
    b = table(spark, sf, "documents").select(F.col("text").alias("Question"), F.col("n_chars").alias("Answer"), F.col("lang").alias("subject"), F.col("doc_id").alias("row"))
    return io.problems(a, "row", "bench").unionByName(io.problems(b, "row")).drop("level")


@query("s15_s16_problem_filters", "SELECT doc_id, lang AS answer FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND (doc_id % 10 >= 7 OR doc_id % 7 = 0)")
def s15(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("many"), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("answers"), F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise((F.col("doc_id") % 10).cast("string")).alias("difficulty"))
    return io.hard_only(io.single_answer(d, "many", "answers"), "difficulty").select("doc_id", "answer")


@query("s17_first_row_per_key", f"WITH {TRACES} SELECT question_id, min(ord) AS ord, arg_min(substr(trace, 1, 100), ord) AS head FROM traces GROUP BY question_id")
def s17(spark, sf):
    return traces(spark, sf).groupBy("question_id").agg(F.min("ord").alias("ord"), F.min_by(F.substring("trace", 1, 100), "ord").alias("head"))


@query("s18_mock_traces", f"WITH {TRACES}, q AS (SELECT DISTINCT question_id FROM traces) SELECT question_id, question_id || ' <answer>' || CAST(i AS VARCHAR) || '</answer>' AS trace FROM q, range(4) b(i)")
def s18(spark, sf):
    return io.mock_traces(traces(spark, sf).select("question_id").distinct(), "question_id", 4)


@query("s20_count_contract", "SELECT label, count(*) AS n, CAST(min(vec_id) AS BIGINT) AS least, false AS first_reused, true AS again_reused FROM embeddings GROUP BY label")
def s20(spark, sf):
    """A result computed once and scanned the second time, as its inputs, parameters and rows are the same."""
    path, source = io.scratch(spark), table(spark, sf, "embeddings")
    compute = lambda: source.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    _, first = io.scan_or_compute(spark, path, source, {"by": "label"}, compute)
    held, again = io.scan_or_compute(spark, path, source, {"by": "label"}, compute)
    return held.select("label", "n", "least", F.lit(first).alias("first_reused"), F.lit(again).alias("again_reused"))


@query("k2_plain_write", "SELECT doc_id, source, n_chars FROM documents")
def k2(spark, sf):
    path = io.scratch(spark)
    io.write_plain(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path)
    return io.read_table(spark, path)


@query("k3_dual_write", f"WITH {TRACES} SELECT 'plain' AS variant, ord, CAST(length(trace) AS BIGINT) AS n FROM traces UNION ALL SELECT 'prefixed', ord, CAST(length(trace) + length(author) + 3 AS BIGINT) FROM traces")
def k3(spark, sf):
    path = io.scratch(spark)
    io.write_two(traces(spark, sf).select("ord", "author", "trace"), f"{path}/plain", f"{path}/prefixed", F.concat(F.lit("["), "author", F.lit("]\n")), "trace")
    part = lambda v: spark.read.parquet(f"{path}/{v}").select(F.lit(v).alias("variant"), "ord", F.length("trace").cast("long").alias("n"))
    return part("plain").unionByName(part("prefixed"))


@query("k5_done_marker", "SELECT count(*) AS n, true AS before_none FROM events")
def k5(spark, sf):
    """The marker of a written table holds its rows; without one there is none."""
    path = io.scratch(spark)
    before = io.done_rows(spark, path)
    n = io.write_jsonl(gens(spark, sf).select("ord", "prefix_style"), path)
    io.mark_done(spark, path, n)
    return spark.createDataFrame([(io.done_rows(spark, path), before is None)], "n bigint, before_none boolean")


@query("k7_meta_file", f"WITH {TRACES} SELECT author, count(*) AS n, count(DISTINCT question_id) AS questions FROM traces GROUP BY author")
def k7(spark, sf):
    path = io.scratch(spark)
    io.write_meta(traces(spark, sf).groupBy("author").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("questions")), path)
    return spark.read.schema("author string, n bigint, questions bigint").json(path)


@query("k8_tidy_profile", f"WITH {GENS} SELECT prefix_style, 'n_tokens' AS feature, count(*) AS n, min(n_tokens) AS least FROM gens GROUP BY prefix_style")
def k8(spark, sf):
    path = io.scratch(spark)
    io.write_csv(gens(spark, sf).groupBy("prefix_style").agg(F.lit("n_tokens").alias("feature"), F.count("*").alias("n"), F.min("n_tokens").alias("least")), path)
    return spark.read.schema("prefix_style string, feature string, n bigint, least int").option("header", True).csv(path)


@query("k9_markdown_table", f"WITH {GENS} SELECT '| ' || prefix_style || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || printf('%.1f', 100 * avg(CAST(correct AS DOUBLE))) || '% |' AS line FROM gens GROUP BY prefix_style")
def k9(spark, sf):
    g = gens(spark, sf).groupBy("prefix_style").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("p"))
    return g.select(F.concat(F.lit("| "), "prefix_style", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.format_string("%.1f", F.col("p") * 100), F.lit("% |")).alias("line"))


@query("k10_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k10(spark, sf):
    return io.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id").select("doc_id")


# ---------------------------------------------------------------- projections


@query("p1_author_filter", f"WITH {TRACES} SELECT ord, author FROM traces WHERE author IN ('en', 'de')")
def p1(spark, sf):
    return traces(spark, sf).where(F.col("author").isin("en", "de")).select("ord", "author")


@query("p2_clean", rf"WITH {TEXTS}, t AS (SELECT id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM texts) SELECT * FROM t WHERE text <> ''")
def p2(spark, sf):
    return texts(spark, sf).select("id", strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")


@query("p3_p4_composite_key", f"WITH {TRACES} SELECT ord, question_id, split_part(question_id, '::', 1) AS source_dataset, split_part(question_id, '::', 2) AS local_qid FROM traces")
def p3(spark, sf):
    parts = F.split("question_id", "::", 2)
    return traces(spark, sf).select("ord", F.concat(F.coalesce("source_dataset", F.lit("")), F.lit("::"), F.split("question_id", "::", 2)[1]).alias("question_id"), parts[0].alias("source_dataset"), parts[1].alias("local_qid"))


@query("p5_author_code", f"WITH {TRACES} SELECT ord, CASE author WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS style_id FROM traces")
def p5(spark, sf):
    codes = F.create_map(*[F.lit(x) for k, a in enumerate(["en", "fr", "de", "es"]) for x in (a, k)])
    return traces(spark, sf).select("ord", F.element_at(codes, F.col("author")).alias("style_id"))


@query("p6_label_encoding", f"WITH {TRACES} SELECT ord, CAST(dense_rank() OVER (ORDER BY source_dataset) - 1 AS INTEGER) AS code FROM traces")
def p6(spark, sf):
    """Only the distinct values are ranked."""
    t = traces(spark, sf)
    codes = running(t.select("source_dataset").distinct(), ["source_dataset"], F.lit(1), "r").select("source_dataset", (F.col("r") - 1).cast("int").alias("code"))
    return t.join(codes, "source_dataset").select("ord", "code")


@query("p7_p8_messages_round_trip", f"WITH {TRACES} SELECT ord, 'user' AS role, author AS first_content, trace AS last_content FROM traces")
def p7(spark, sf):
    kind = "array<struct<role:string,content:string>>"
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("author").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("trace").alias("content")))
    back = traces(spark, sf).select("ord", F.from_json(F.to_json(m), kind).alias("m"))
    return back.select("ord", F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("first_content"), F.col("m")[1]["content"].alias("last_content"))


@query("p9_p10_p11_p12_message_edit", rf"""WITH {MSGS}, u AS (SELECT conv_id, messages, list_position(list_transform(messages, lambda m: m.role), 'user') AS pos FROM msgs)
 SELECT conv_id, pos - 1 AS user_idx, coalesce(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '') AS assistant_text, CASE WHEN pos = 0 THEN messages[1].content ELSE '[x] ' || messages[pos].content END AS rewritten, regexp_replace(messages[-1].content, '^\s+|\s+$', '', 'g') AS last_text FROM u WHERE pos > 0""")
def p9(spark, sf):
    pos = F.array_position(F.transform("messages", lambda m: m["role"]), "user").cast("int")
    m = msgs(spark, sf).withColumn("pos", pos).where("pos > 0")
    edited = F.transform("messages", lambda x, i: F.when(i == F.col("pos") - 1, x.withField("content", F.concat(F.lit("[x] "), x["content"]))).otherwise(x))
    return m.select("conv_id", (F.col("pos") - 1).alias("user_idx"), F.coalesce(F.get(F.filter("messages", lambda x: x["role"] == "assistant"), F.lit(0))["content"], F.lit("")).alias("assistant_text"), F.element_at(edited, F.col("pos"))["content"].alias("rewritten"), strip(F.element_at("messages", -1)["content"]).alias("last_text"))


@query("p13_length_enrichment", f"WITH {TRACES} SELECT ord, trace_len, coalesce(CASE WHEN ord % 5 = 0 THEN NULL ELSE author END, 'unknown') AS oracle_style_name, coalesce(CASE WHEN ord % 5 = 0 THEN NULL ELSE ord END, -1) AS oracle_style_id FROM traces")
def p13(spark, sf):
    has = F.col("ord") % 5 != 0
    return traces(spark, sf).select("ord", "trace_len", F.coalesce(F.when(has, F.col("author")), F.lit("unknown")).alias("oracle_style_name"), F.coalesce(F.when(has, F.col("ord")), F.lit(-1)).alias("oracle_style_id"))


@query("p14_p15_p19_row_filters", f"WITH {GENS} SELECT ord FROM gens WHERE prefix_style = 'style_3' AND finish_reason <> 'length' AND pk >= 0 AND prefix_style <> 'None'")
def p14(spark, sf):
    return gens(spark, sf).where((F.col("prefix_style") == "style_3") & (F.col("finish_reason") != "length") & (F.col("pk") >= 0) & (F.col("prefix_style") != "None")).select("ord")


@query("p16_p17_complete_groups", f"WITH {GENS}, c AS (SELECT question_id, prefix_style, count(*) AS n FROM gens GROUP BY ALL), k AS (SELECT question_id FROM c GROUP BY question_id HAVING count(*) = {len(STYLES)} AND min(n) >= 8) SELECT question_id, count(*) AS n FROM gens SEMI JOIN k USING (question_id) GROUP BY question_id")
def p16(spark, sf):
    """Relational division with a least cell size, then a semi-join."""
    g = gens(spark, sf)
    full = g.groupBy("question_id", "prefix_style").count().groupBy("question_id").agg(F.count("*").alias("s"), F.min("count").alias("m")).where((F.col("s") == len(STYLES)) & (F.col("m") >= 8))
    return g.join(full, "question_id", "left_semi").groupBy("question_id").agg(F.count("*").alias("n"))


@query("p18_hash_gate", f"WITH {GENS} SELECT ord, question_id FROM gens WHERE {draw_sql('0', 'question_id')} % 4 = 0")
def p18(spark, sf):
    return gens(spark, sf).where(draw(0, F.col("question_id")) % 4 == 0).select("ord", "question_id")


#: Specs of some sources: a wide pattern for each, and a longer one for one language.
SPECS = [(f"src{k}", "any", "1x", "bench", f"src{k}-*_checkpoint-*-bench") for k in range(4)] + [(f"src{k}", "en", "1x", "bench", f"src{k}-en_checkpoint-*-bench") for k in range(4)]
_STEP = "CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END"
RUNSQL = f"runs AS (SELECT doc_id, source, lang, source || '-' || lang || CASE WHEN doc_id % 9 = 0 THEN '-4b-final' ELSE '' END || '_checkpoint-' || {_STEP} || '-bench' || CASE WHEN doc_id % 11 = 0 THEN '-single-style_2' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '-eosfix' ELSE '' END AS eval_dir FROM documents)"
_RESOLVED = f"""{RUNSQL}, resolved AS (SELECT DISTINCT eval_dir, source AS arm, CASE WHEN lang = 'en' AND doc_id % 9 <> 0 THEN 'en' ELSE 'any' END AS student, CAST(CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id END AS INTEGER) AS ckpt_step,
 CASE WHEN doc_id % 2 = 0 THEN 'eosfix' ELSE 'legacy' END AS protocol FROM runs WHERE source IN ('src0', 'src1', 'src2', 'src3') AND doc_id % 11 <> 0)"""


def runs(spark, sf):
    """Names of runs made from documents' sources, languages and ids."""
    d = F.col("doc_id")
    name = F.concat(
        "source", F.lit("-"), "lang", F.when(d % 9 == 0, "-4b-final").otherwise(""), F.lit("_checkpoint-"), F.when(d % 13 == 0, "x").otherwise(d.cast("string")), F.lit("-bench"), F.when(d % 11 == 0, "-single-style_2").otherwise(""), F.when(d % 2 == 0, "-eosfix").otherwise("")
    )
    return table(spark, sf, "documents").select(name.alias("eval_dir"))


def specs(spark):
    return spark.createDataFrame(SPECS, "arm string, student string, scale string, benchmark string, pattern string")


@query("p20_p21_registry_resolve", f"WITH {_RESOLVED} SELECT eval_dir, arm, student, ckpt_step, protocol FROM resolved")
def p20(spark, sf):
    return RG.resolve(runs(spark, sf), specs(spark)).select("eval_dir", "arm", "student", "ckpt_step", "protocol")


@query("p22_protocol", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'eosfix' WHEN 1 THEN 'legacy' WHEN 2 THEN 'eosfix' WHEN 3 THEN 'eosfix' ELSE 'legacy' END AS protocol FROM documents")
def p22(spark, sf):
    """The flag in the result decides before the name, the name before the first generation."""
    k = F.col("doc_id") % 5
    name = F.concat("source", F.when(k.isin(1, 2), "-eosfix").otherwise(""))
    result = F.when(k == 0, '{"eos_fix": true}').when(k == 1, '{"eos_fix": false}').when(k == 2, "{}").when(k == 4, "not json")
    head = F.when(k == 3, F.to_json(F.struct(F.lit("stop").alias("finish_reason"), "lang"))).when(k == 4, F.to_json(F.struct("lang")))
    return table(spark, sf, "documents").select("doc_id", RG.protocol(name, result, head).alias("protocol"))


@query("p23_name_cascade", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'English' WHEN contains(url, '/fr/') THEN 'French' WHEN regexp_matches(url, '/(de|es)/') THEN 'Other' ELSE url END AS label FROM pages")
def p23(spark, sf):
    return table(spark, sf, "pages").select("page_id", RG.label(F.col("url"), [("/en/", "English"), ("/fr/", "French"), ("/(de|es)/", "Other")]).alias("label"))


BOOLS = ["true", " YES", "1", "no", "False", "0", "y", "n", "maybe"]


@query("p24_parse_bool", "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 6 THEN true WHEN 8 THEN NULL ELSE false END AS b, CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS quality FROM labels")
def p24(spark, sf):
    told = F.element_at(F.array(*[F.lit(b) for b in BOOLS]), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, sf, "labels").select("doc_id", RG.parse_bool(told).alias("b"), RG.parse_bool(F.concat(F.lit(" "), F.col("quality").cast("string"))).alias("quality"))


@query("g19_a25_best_run", f"WITH {_RESOLVED} SELECT arm, student, 'bench' AS benchmark, arg_min(eval_dir, (NOT contains(eval_dir, '4b-final'), -ckpt_step, eval_dir)) AS eval_dir FROM resolved WHERE protocol = 'eosfix' GROUP BY arm, student")
def g19(spark, sf):
    return RG.best(RG.resolve(runs(spark, sf), specs(spark)).where("protocol = 'eosfix'"), ["arm", "student", "benchmark"], "4b-final").select("arm", "student", "benchmark", "eval_dir")
