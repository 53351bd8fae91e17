"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the element-wise product of its
letters' vectors, each rolled by its place, so order matters; a text is the sum of the vectors of
its trigrams, and a language the sum over its texts. A text gets the language whose prototype has
the largest cosine with it, and that cosine as its score.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import bucket_of, chunks, pick

DIMS, SEED = 1024, 20240607
#: Letter classes: 0 what is no letter, 1-26 the letters a-z, the rest other letters by code point.
CLASSES = 64
UNKNOWN = "und"
#: Languages whose sums a task holds at once.
HELD = 32


def _kept() -> tuple[np.ndarray, list[np.ndarray]]:
    """The class of every code point, and the letter vectors rolled by 2, 1 and 0."""
    kept = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept"))
    if "letters" not in vars(kept):
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (CLASSES, DIMS))
        kept.letters = table, [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
    return kept.letters


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, trigram) of each place; runs of what is no letter count as one blank."""
    table, _ = _kept()
    text = buf.tobytes()
    lead = (buf & 0xC0) != 0x80
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(lead)))[off]
    cls = table[np.minimum(codes, 0x10FFFF)]
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(starts))
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0) | (doc[1:] != doc[:-1])
    cls, doc = cls[keep].astype(np.int32), doc[keep]
    if len(cls) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    gram = (cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:]
    good = (doc[2:] == doc[:-2]) & (gram != 0)
    return doc[:-2][good], gram[good]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    _, (two, one, none) = _kept()
    return two[grams // (CLASSES * CLASSES)] * one[grams // CLASSES % CLASSES] * none[grams % CLASSES]


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    table, _ = _kept()
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off]
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    seen = np.concatenate(([0], np.cumsum(table[np.minimum(codes, 0x10FFFF)] > 0)))
    return seen[lead[1:]] > seen[lead[:-1]]


def prototypes(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, pos, total): the bundled vector of each language; whole numbers, so order does not matter."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, count in sums.items():
                at = np.flatnonzero(count)
                total = count[at].astype(np.float64) @ gram_vectors(at).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["lang", "vector"])
            sums.clear()

        for b in batches:
            langs = b.column(1).to_pylist()
            for i, j, buf, off in chunks(b.column(0)):
                doc, gram = trigrams(buf, off)
                names, code = np.unique(np.array(langs[i:j], dtype=object).astype(str), return_inverse=True)
                of = code[doc]
                for k, lang in enumerate(names):
                    if lang not in sums and len(sums) >= HELD:
                        yield from flush()
                    sums[lang] = sums.get(lang, 0) + np.bincount(gram[of == k], minlength=CLASSES**3)
        yield from flush()

    parts = pick(train, text_col, lang_col).mapInArrow(run, "lang string, vector array<bigint>")
    return parts.select("lang", F.posexplode("vector").alias("pos", "v")).groupBy("lang", "pos").agg(F.sum("v").alias("total"))


def identify(docs: DataFrame, train: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang_pred`` and ``score`` of every document beside the columns ``keep``.

    ``train`` gives the profiles; rows with a null language are not learned from. Only the
    profiles reach the driver: DIMS numbers for each language. A text that is null or has no
    letter gets ``und`` and score 0, as does every text if nothing was learned. A text with
    letters but no trigram gets the language that comes first. Ties go to the first language in
    code-point order. Repeated rows get the same answer each; an empty table gives no rows. A very
    long text is a chunk of its own, read whole; columns that are not named are not read.
    """
    rows = prototypes(train.where(F.col(f"`{lang_col}`").isNotNull()), text_col, lang_col).collect()
    langs = sorted({r["lang"] for r in rows})
    proto = np.zeros((len(langs), DIMS))
    for r in rows:
        proto[langs.index(r["lang"]), r["pos"]] = r["total"]
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
    names = np.array([*langs, UNKNOWN], dtype=object)

    def run(batches):
        for b in batches:
            pred, score = [], []
            for _, _, buf, off in chunks(b.column(b.num_columns - 1)):
                n = len(off) - 1
                if not len(langs):
                    pred += [UNKNOWN] * n
                    score += [0.0] * n
                    continue
                doc, gram = trigrams(buf, off)
                used = np.flatnonzero(np.bincount(gram, minlength=CLASSES**3))
                place = np.zeros(CLASSES**3, np.int32)
                place[used] = np.arange(len(used))
                vectors = np.zeros((n, DIMS), np.float32)
                step = max(1, (1 << 22) // max(1, len(used)))
                table = gram_vectors(used)
                bounds = np.searchsorted(doc, np.arange(0, n + step, step))
                for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
                    lo, hi = k * step, min(n, (k + 1) * step)
                    if lo >= n:
                        break
                    flat = (doc[a:z].astype(np.int64) - lo) * len(used) + place[gram[a:z]]
                    vectors[lo:hi] = np.bincount(flat, minlength=(hi - lo) * len(used)).reshape(hi - lo, -1).astype(np.float32) @ table
                v = vectors.astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                cosine = np.round(v @ proto.T, 9)
                best = cosine.argmax(axis=1)
                known = has_letter(buf, off)
                pred += names[np.where(known, best, len(langs))].tolist()
                score += np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(b.num_columns - 1)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return pick(docs, *keep, text_col).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    train = docs.where(bucket_of("doc_id", 4) != 2)
    return identify(docs.withColumn("held_out", held), train, ["doc_id", "held_out"])
