"""Readers and writers (S and K rows of the survey). Schemas are explicit; nothing is inferred from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ContractError
from ..functions.parse import normalise_answer

#: Generation dumps; ``correct`` is null where a sample was not graded.
GENERATIONS = T.StructType([T.StructField(n, t) for n, t in (("question_id", T.StringType()), ("prefix_style", T.StringType()), ("correct", T.BooleanType()), ("gold_answer", T.StringType()), ("output_len", T.LongType()), ("n_tokens", T.LongType()), ("finish_reason", T.StringType()), ("output", T.StringType()))])
SPLIT_ORDER = ["validation", "val", "test", "train"]


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``; where that is unset, in a temporary one if Spark is local, else it raises."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ContractError("spark.checkpoint.dir is not set, and executors do not share the driver's disk")
        import atexit
        import shutil
        import tempfile

        local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
    return f"{folder}/{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """Rows that several plans read: written to the shared folder once and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One small file through Spark's file systems."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name)
    out.write(raw)
    out.close()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan, of some columns only."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_config(spark: SparkSession, path: str, config: str, column: str = "config") -> DataFrame:
    """The rows of one configuration, or of all."""
    df = spark.read.parquet(path)
    return df if config == "all" else df.where(F.col(column) == config)


def read_split(spark: SparkSession, path: str, wanted: str = "auto") -> DataFrame:
    """One split of a table partitioned by ``split``; ``auto`` takes the first of SPLIT_ORDER that exists."""
    df = spark.read.parquet(path)
    if "split" not in df.columns:
        return df
    there = {r["split"] for r in df.select("split").distinct().collect()}  # directory names
    names = SPLIT_ORDER if wanted == "auto" else [wanted]
    name = next((n for n in names if n in there), None)
    if name is None:
        raise ContractError(f"no split of {names} in {sorted(there)}")
    return df.where(F.col("split") == name)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = GENERATIONS, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped, or with ``strict`` raise. Blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def first_text(*cols: str, most: int = 2000) -> Column:
    """The first column that is not empty, cut to ``most`` characters."""
    return F.substring(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("")), 1, most)


def contiguous(shards: DataFrame, total: int | None = None) -> DataFrame:
    """Shard ranges (row_start, row_end); raises unless each starts where another ends, from 0 on, without overlap.

    Starts meet ends in a join, so no task holds the order of all shards.
    """
    ends = shards.select(F.col("row_end").alias("row_start")).distinct()
    bad = shards.where("row_start <> 0").join(ends, "row_start", "left_anti").orderBy("row_start").limit(1).collect()
    if bad:
        raise ContractError(f"shards are not contiguous at {bad[0].asDict()}")
    last, held = shards.agg(F.max("row_end"), F.sum(F.col("row_end") - F.col("row_start"))).first()
    if held != last:
        raise ContractError(f"shards overlap or leave rows out: {held} rows up to {last}")
    if total is not None and last != total:
        raise ContractError("shards do not cover the table")
    return shards


def write_matrices(df: DataFrame, shard: str, row: str, vector: str, name: str, path: str) -> None:
    """Each shard's vectors in row order as one ``.npz`` archive, in a table (shard, content). A shard is one value, so shards should have a fixed size."""

    def run(key, rows):
        import io

        import numpy as np
        import pandas as pd

        held = io.BytesIO()
        np.savez(held, **{name: np.array(rows.sort_values(row)[vector].tolist(), np.float64)})
        return pd.DataFrame({shard: [key[0]], "content": [held.getvalue()]})

    kind = df.schema[shard].dataType.simpleString()
    df.select(shard, row, vector).groupBy(shard).applyInPandas(run, f"{shard} {kind}, content binary").write.mode("overwrite").parquet(path)


def read_matrices(files: DataFrame, name: str, *keep: str) -> DataFrame:
    """The matrix ``name`` of each archive in the column ``content`` as rows (row, vector) beside the columns ``keep``. One task holds one archive."""

    def run(frames):
        import io

        import numpy as np
        import pandas as pd

        for f in frames:
            for k in range(len(f)):
                m = np.load(io.BytesIO(f["content"].iloc[k]), allow_pickle=False)[name]
                yield pd.DataFrame({**{c: [f[c].iloc[k]] * len(m) for c in keep}, "row": np.arange(len(m)), "vector": [r.tolist() for r in m.astype(np.float64)]})

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select("content", *keep).mapInPandas(run, f"{kinds}row bigint, vector array<double>")


def read_vectors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A matrix of the ``.npz`` files at a path as rows (row, vector)."""
    return read_matrices(spark.read.format("binaryFile").load(path), name)


def list_files(spark: SparkSession, root: str, glob: str = "*", keep: str = "", drop: str | None = None) -> DataFrame:
    """(name, path, bytes) of the files below ``root`` whose first folder or file name matches ``keep`` and not ``drop``.

    ``glob`` prunes file names in the listing; contents are not read. A table that is a folder has a row for each of its files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    # the names below the root, whatever scheme the store puts before it
    below = F.regexp_extract("path", "/" + r"\Q" + root.rstrip("/").rsplit("/", 1)[-1] + r"\E" + r"/([^/]+)", 1)
    rows = files.select(below.alias("name"), "path", F.col("length").alias("bytes")).where(F.col("name").rlike(keep))
    return rows.where(~F.col("name").rlike(drop)) if drop else rows


def mock_traces(questions: DataFrame, key: str, each: int) -> DataFrame:
    """``each`` traces for every question, whose answers are numbered."""
    rows = questions.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit(" <answer>"), F.col("_i").cast("string"), F.lit("</answer>")).alias("trace"))


def scan_or_compute(spark: SparkSession, path: str, source: DataFrame, parameters: dict, compute) -> tuple[DataFrame, bool]:
    """The table at ``path`` if it was made from the same files of ``source`` with the same parameters and still
    has its rows, else ``compute()`` written there. Returns it and whether it was reused.

    The fingerprint holds the parameters, the plan's columns and every file's path, size and time of change.
    """
    import json

    files = spark.read.format("binaryFile").load(source.inputFiles()) if source.inputFiles() else None
    marks = "" if files is None else files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", "modificationTime"))), "\n"), 256)).first()[0]
    text = json.dumps([parameters, source.schema.simpleString(), marks], sort_keys=True, default=str)
    held = done_mark(spark, path)
    if held and held["path"] == text:
        table = spark.read.parquet(path)
        if table.count() == held["rows"]:
            return table, True
    remove(spark, f"{path}.done")  # a computation that breaks off leaves no valid marker
    compute().write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    mark_done(spark, path, table.count(), text)
    return table, False


def curve_values(text: Column, budgets: list[int]) -> list[Column]:
    """100 * Pass@k, rounded to 2 places, from the first of three objects in a result file that is there."""
    names = ("pass_at_k_cluster_prefix", "pass_at_k", "pass_at_k_standard")
    objects = [F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("{}")) for n in names]
    curve = F.coalesce(*objects)
    return [F.round(F.get_json_object(curve, f"$.{k}").cast("double") * 100, 2).alias(f"pass_{k}") for k in budgets]


def problems(df: DataFrame, row: str, subject: str = "") -> DataFrame:
    """Question, answer, id, subject and level from any of the usual column names; raises if one is missing."""
    def first(*names):
        there = [F.col(f"`{c}`") for c in names if c in df.columns]
        return F.coalesce(*[c.cast("string") for c in there]) if there else F.lit(None).cast("string")

    q, a = first("problem", "Problem", "question", "Question"), first("answer", "Answer")
    must = lambda c, what: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"row without {what}")))
    return df.select(
        F.coalesce(first("unique_id", "id", "ID"), F.col(row).cast("string")).alias("question_id"), must(q, "a problem").alias("question"), normalise_answer(must(a, "an answer")).alias("answer"),
        F.coalesce(first("subject"), F.lit(subject)).alias("subject"), first("level", "difficulty").alias("level"),
    )


def single_answer(df: DataFrame, many: str, answers: str) -> DataFrame:
    """Without rows of several answers or none; ``answer`` is the first."""
    return df.where(~F.coalesce(F.col(many), F.lit(False)) & (F.size(answers) > 0)).withColumn("answer", F.element_at(answers, 1))


def hard_only(df: DataFrame, difficulty: str, least: float = 7.0) -> DataFrame:
    """Difficulty at least ``least``, or not known, or no number."""
    d = F.expr(f"try_cast(`{difficulty}` AS double)")
    return df.where(d.isNull() | (d >= least))


# ---------------------------------------------------------------- sinks


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """Parquet with a directory for each split."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_two(df: DataFrame, plain: str, prefixed: str, prefix: Column, text: str) -> None:
    """K3: the same rows as they are and with a prefixed text, from one cached pass."""
    held = df.persist()
    try:
        held.write.mode("overwrite").parquet(plain)
        held.withColumn(text, F.concat(prefix, F.col(text))).write.mode("overwrite").parquet(prefixed)
    finally:
        held.unpersist()


def write_plain(df: DataFrame, path: str) -> None:
    """K2: Parquet as it is."""
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """K4, K5: JSON lines under Spark's commit protocol, which leaves a marker; returns the number of rows."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def write_lines(df: DataFrame, path: str) -> None:
    """Text lines as they are, from a table's only column."""
    df.write.mode("overwrite").text(path)


def mark_done(spark: SparkSession, path: str, rows: int, what: str | None = None) -> None:
    """K5: a marker beside a finished table with its number of rows, and what it was made from."""
    spark.createDataFrame([(what or path, rows)], "path string, rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}.done")


def done_mark(spark: SparkSession, path: str):
    """The marker's row, or null where no marker is."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.done/_SUCCESS")
    if not name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name):
        return None
    return spark.read.schema("path string, rows bigint").json(f"{path}.done").first()


def done_rows(spark: SparkSession, path: str) -> int | None:
    """The rows of a finished table, or null where no marker is."""
    mark = done_mark(spark, path)
    return mark["rows"] if mark else None


def remove(spark: SparkSession, path: str) -> None:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def write_meta(df: DataFrame, path: str) -> None:
    """K7: a small table of counts, parameters or ranks as one JSON file; its rows have a fixed bound."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K8: CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The units of work that have no result yet."""
    return work.join(done, key, "left_anti")
