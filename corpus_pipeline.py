"""The document pipeline: quality classifier, quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with the documents its predecessor kept. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Tables, small_batches
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import classify
from tessera.llm.rules import judge
from tessera.llm.suffixes import remove_repeats
from tessera.plans.views import spread, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps. It judges every row, those without an id, with a repeated one or the same text too;
    null, empty and short texts stay. An empty table gives no rows; other columns are left out, here and in the later stages.
    """
    small_batches(spark)
    return classify(docs, also=tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows within the fences of their language and source, which come from this stage's own input. Null, empty and short texts
    fail the base rule and go. Repeated rows are judged each, and those without an id like others.
    """
    small_batches(spark)
    return judge(docs, also=tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest id; one without an id only where none has one. Of equal rows one stays.

    Ids may be null or repeat, so rows go by numbers of their own, written with them. Null and
    empty texts are linked with nothing and stay.
    """
    rows = Tables(spark).write(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    groups = near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row"))
    names = rows.select("_row", "doc_id", F.xxhash64(*COLUMNS).alias("_hash"))
    stay = groups.join(names.hint("shuffle_hash"), "_row").groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    return rows.join(stay.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts, with the characters they touch; every row stays, whatever its id. All occurrences
    go, as the operator judges its input; whole copies are gone before. A null text becomes an empty one.
    """
    small_batches(spark)
    out = remove_repeats(docs, ["doc_id", "lang", "source"], whole_chars=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's ids in sequences; rows that share an id, or have none, are packed each. A null text is its end id alone."""
    import public_tokenizers

    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: The stages learn, sketch, sort suffixes and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again."""
    docs, tables = spread(table(spark, sf_dir, "documents")), Tables(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.write(docs, name)
            if k:
                tables.drop(STAGES[k - 1][0])
    return docs
