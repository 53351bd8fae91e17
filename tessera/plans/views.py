"""Trace-shaped views over the test tables, each as a DataFrame and as a SQL common table expression.

``gens``: graded generations from ``events``. ``traces``: author texts from ``documents``.
``vecs``: content and style vectors from ``embeddings``. ``msgs``: chats from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_STYLES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
STYLES = [f"style_{k}" for k in EVENT_STYLES.values()]
K = len(STYLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a file that one row group may hold.
GROUP_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """The estimated size of a plan's rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores where its row groups are fewer; larger inputs stay as they are.

    A file of one row group is read by one task, however the scan is split.
    """
    spark = df.sparkSession
    size = table_bytes(df)
    cores = spark.sparkContext.defaultParallelism
    if size > cores * GROUP_BYTES or len(df.inputFiles()) + size // GROUP_BYTES >= cores:
        return df
    return df.repartition(cores)


def gens(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.lit(None).cast("int")
    for name, k in EVENT_STYLES.items():
        style = F.when(F.col("event_type") == name, k).otherwise(style)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("question_id"),
        F.concat(F.lit("style_"), style).alias("prefix_style"),
        (F.col("value") > 50).alias("correct"),
        F.floor(F.col("value") * 10).cast("int").alias("n_tokens"),
        F.when(F.col("value") > 200, "length").otherwise("stop").alias("finish_reason"),
        F.col("event_id").alias("ord"),
        F.get_json_object("props", "$.k").cast("int").alias("pk"),
    )


_CASE = " ".join(f"WHEN '{n}' THEN {k}" for n, k in EVENT_STYLES.items())
GENS = f"""gens AS (SELECT user_id AS question_id, 'style_' || CASE event_type {_CASE} END AS prefix_style, value > 50 AS correct, CAST(floor(value * 10) AS INTEGER) AS n_tokens,
 CASE WHEN value > 200 THEN 'length' ELSE 'stop' END AS finish_reason, event_id AS ord, CAST(json_extract_string(props, '$.k') AS INTEGER) AS pk FROM events)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ord"),
        F.concat(F.col("source"), F.lit("::q"), (F.col("doc_id") % 37).cast("string")).alias("question_id"),
        F.col("lang").alias("author"),
        F.col("source").alias("source_dataset"),
        F.col("text").alias("trace"),
        F.length("text").cast("long").alias("trace_len"),
    )


TRACES = "traces AS (SELECT doc_id AS ord, source || '::q' || CAST(doc_id % 37 AS VARCHAR) AS question_id, lang AS author, source AS source_dataset, text AS trace, CAST(length(text) AS BIGINT) AS trace_len FROM documents)"


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % 50).alias("question_id"), F.col("label").cast("long").alias("label"), F.slice(v, 1, 32).alias("c"), F.slice(v, 33, 32).alias("z"), v.alias("v")
    )


VECS = "vecs AS (SELECT vec_id, vec_id % 50 AS question_id, CAST(label AS BIGINT) AS label, CAST(embedding[1:32] AS DOUBLE[]) AS c, CAST(embedding[33:64] AS DOUBLE[]) AS z, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("messages"))


MSGS = "msgs AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"

#: ASCII rows that hit every lexicon, for text functions whose patterns never occur in the test corpus.
CRAFTED = [
    "Wait, let me check this again. Actually hold on! Therefore the final answer is \\boxed{42}.",
    "Step 1: let x = 4 and y = 5\n2. then solve 3 + 4 = 7\n3) hence so the answer is $x^2$.",
    "What if we try another approach? Let's try alternatives; on the other hand we could also stop. Instead, go.",
    "[style_3]\nOkay so I need to verify. Let me reconsider, I was wrong. Scratch that, never mind. Hmm oops",
    "<style_2>\nFirst paragraph here.\n\nSecond paragraph. let me verify; double-check. sanity check\n\n```print(1)```\nafter ```a\nb``` end",
    "no lexicon here just plain words with no end",
    "Now I see. Putting it together: thus, in conclusion, to summarise. \\frac{1}{2} = \\sqrt{4} \\boxed{\\frac{a}{b}} ??",
    "So\nfinally, this means we know \\boxed{1} and then \\boxed{{2}+{3}} indeed as expected.",
    "",
    "   \n  ",
    "<answer> 17 </answer> define f = 3 and set g  = 4, you know, anyway basically right",
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(CRAFTED)], "id bigint, text string")
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).unionByName(made)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents UNION ALL VALUES " + ", ".join(f"({-1 - k}, {quoted(t)})" for k, t in enumerate(CRAFTED)) + ")"
