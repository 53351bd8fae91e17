"""Operators do the whole job: every row is treated, and results are those of the plain method."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import pieces
from tessera.llm.common import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_pieces_are_the_librarys(duck):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.pieces(model)
    rng = np.random.default_rng(5)
    parts = ["the", "in", " ", "  ", "ation", "é", "=", "==", "\n", "1", "国", "Ж", "🎉"]
    texts = [t for t in duck("SELECT text FROM documents").text if t and "▁" not in t]
    texts += [" " * k for k in range(1, 40)] + ["=" * k for k in range(1, 200, 7)] + ["The international Device", "国际的人民大会" * 30]
    texts += ["".join(rng.choice(list("etaoinshr"), k)) for k in (9, 63, 64, 65, 3000)] + ["".join(rng.choice(parts, 90)) for _ in range(300)]
    for i, j, buf, off in chunks(pa.array(texts), 1 << 21):
        ids, at = own.encode(buf, off)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library.encode(texts[i:j])
        assert own.decode(ids, at) == [t.encode() for t in texts[i:j]]


def test_pipeline_takes_rows_without_ids_and_with_the_same_id(spark):
    import corpus_pipeline as C

    text = lambda k: " ".join(f"w{k}x{j * j}" for j in range(150))
    ids = [(0, 0), (None, 0), (1, 1), (1, 1), (2, 2), (3, 3), (3, 4), (4, 4), (None, 5), (None, 5), (6, 6)]
    rows = [(i, text(k)) for i, k in ids] + [(None, text(0) + " end"), (2, text(2) + " end"), (None, text(7)), (8, text(7) + " end"), (6, "junk"), (None, "junk")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    judged = C.quality_rules(spark, docs, "").persist()
    assert sorted(r["text"] for r in judged.collect()) == sorted(t for _, t in rows if t != "junk")
    once = C.near_dedup(spark, judged, "").persist()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"].split("x")[0]) for r in once.collect()) == [(-1, "w5"), (0, "w0"), (1, "w1"), (2, "w2"), (3, "w3"), (3, "w4"), (6, "w6"), (8, "w7")]
    assert sorted(r["text"] for r in C.suffix_dedup(spark, once, "").collect()) == sorted(r["text"] for r in once.collect())


def test_classifier_rejects_rows_without_ids(spark):
    import corpus_pipeline as C
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bare = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert C.quality_classifier(spark, bare, "").count() < 0.95 * bare.count()
