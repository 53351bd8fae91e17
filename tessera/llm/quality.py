"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each whole text and vote good, bad or not at all.
Expectation-maximisation over the counts of vote patterns (at most 3**labellers rows) estimates
how each labeller votes on good and on bad documents, and so the probability that a document is
good given its votes. Those posteriors train a logistic scorer over hashed n-grams of character
classes, which then judges every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import chunks, pick, span_hashes, word_bounds

LABELLERS = ("symbols", "marks", "shouting", "outcry", "echo", "squeeze", "lines", "prose")
#: Rows the scorer is fitted on, chosen by a hash of the id; all rows if there are fewer.
TRAIN_ROWS = 20_000
DIMS = 1 << 13
#: Labellers do not vote on texts of fewer words and fewer bytes that are no blank.
SHORT, SHORT_BYTES = 12, 300

_GROUPS = ["\n", " \t\r\x0b\x0c", "0123456789", ".", ",", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "-_", "()[]{}", "'\"", ":;", "/\\@+=~^`"]
CLASS = np.zeros(256, np.uint8)  # 0: lower-case letters and bytes of other characters
CLASS[65:91] = 1
for _k, _g in enumerate(_GROUPS):
    for _c in _g:
        CLASS[ord(_c)] = 2 + _k
N_CLASSES = 2 + len(_GROUPS)
SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>~^=+@\\{}"])


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[off[1:]] - total[off[:-1]]


def short_texts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    starts, ends, words = word_bounds(buf, off)
    doc = np.repeat(np.arange(len(words)), words)
    return (words < SHORT) & (np.bincount(doc, weights=ends - starts, minlength=len(words)) < SHORT_BYTES)


def votes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The votes of each labeller on each document: 1 good, -1 bad, 0 none."""
    starts, ends, words = word_bounds(buf, off)
    doc = np.repeat(np.arange(len(words)), words)
    n = np.maximum(words, 1)
    solid = np.maximum(np.bincount(doc, weights=ends - starts, minlength=len(words)), 1)
    judged = ~short_texts(buf, off)
    h = span_hashes(buf, starts, ends)
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper = (buf >= 65) & (buf <= 90)
    letters = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    marked = SYMBOL[buf[ends - 1]] if len(ends) else np.empty(0, bool)  # words that end in a symbol
    cry = (buf[ends - 1] == 33) if len(ends) else np.empty(0, bool)
    in_doc = lambda x: np.bincount(doc, weights=x, minlength=len(words))
    stops = _per_doc((buf == 46) | (buf == 33) | (buf == 63), off)
    short = in_doc((ends - starts) <= 3)
    lines = _per_doc(buf == 10, off) + 1
    tight, dup = np.ones(len(words)), np.zeros(len(words))
    for k in range(len(words)):
        raw = buf[off[k] : off[k + 1]].tobytes()
        if judged[k]:
            tight[k] = len(zlib.compress(raw, 1)) / len(raw)
            parts = raw.split(b"\n")
            dup[k] = len(parts) - len(set(parts))
    say = lambda bad, good=None: np.where(bad, -1, np.where(good, 1, 0) if good is not None else 0)
    out = np.stack([
        say(_per_doc(SYMBOL[buf], off) > 0.04 * solid),
        say(in_doc(marked) > 0.15 * n),
        say(_per_doc(upper, off) > 0.35 * np.maximum(_per_doc(letters, off), 1)),
        say(in_doc(cry) > 0.2 * n),
        say(in_doc(echo) > 0.15 * n, (in_doc(echo) < 0.02 * n) & (words >= 100)),
        say(tight < 0.22),
        say(dup > 0.4 * lines),
        say((short < 0.04 * n) & (words >= 40), (short > 0.1 * n) & (stops > 0.02 * n) & (stops < 0.4 * n)),
    ])
    return np.where(judged, out, 0).T.astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def posteriors(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 100) -> dict[int, float]:
    """P(good | votes) of each vote pattern, by expectation-maximisation.

    It starts from "bad if anyone says so", and each labeller's votes have a small prior weight,
    stronger for votes on the side of the class than against it.
    """
    keys = np.array(sorted(counts))
    if not len(keys):
        return {}
    n = np.array([counts[k] for k in keys], float)
    v = keys[:, None] // 3 ** np.arange(labellers) % 3  # 0 bad, 1 none, 2 good
    good = np.where((v == 0).any(axis=1), 0.05, 0.95)
    one = np.eye(3)[v]
    for _ in range(rounds):
        share = np.clip((n * good).sum() / n.sum(), 0.02, 0.98)
        rates = []
        for w, prior in ((good, (0.02, 1.0, 1.0)), (1 - good, (1.0, 1.0, 0.2))):
            total = (one * (n * w)[:, None, None]).sum(axis=0) + np.array(prior)
            rates.append(np.log(total / total.sum(axis=1, keepdims=True)))
        log_g = np.log(share) + (one * rates[0]).sum(axis=(1, 2))
        log_b = np.log(1 - share) + (one * rates[1]).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(np.clip(log_b - log_g, -50, 50)))
        if abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys.tolist(), good.tolist()))


def features(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed 4-grams of character classes (runs of a class count once) and word echoes: indices and values of unit length."""
    starts, ends, words = word_bounds(buf, off)
    wdoc = np.repeat(np.arange(len(words)), words)
    h = span_hashes(buf, starts, ends)
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    echoes = np.bincount(wdoc, weights=echo, minlength=len(words))
    cls = CLASS[buf]
    doc = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(off))
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | (doc[1:] != doc[:-1])
    cls, doc = cls[keep].astype(np.uint64), doc[keep]
    if len(cls) >= 4:
        gram = ((cls[:-3] * np.uint64(N_CLASSES) + cls[1:-2]) * np.uint64(N_CLASSES) + cls[2:-1]) * np.uint64(N_CLASSES) + cls[3:]
        gram = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)
        gram = np.where(gram < 2, gram + 2, gram)
        within = doc[3:] == doc[:-3] if len(doc) > 3 else np.empty(0, bool)
        gram, doc = gram[within], doc[:-3][within]
    else:
        gram, doc = np.empty(0, np.int64), doc[:0]
    edge = np.searchsorted(doc, np.arange(len(words) + 1))
    out = []
    for k in range(len(words)):
        g = gram[edge[k] : edge[k + 1]]
        count = np.bincount(g, minlength=DIMS) if len(g) else np.zeros(DIMS, np.int64)
        at = np.flatnonzero(count)
        val = np.sqrt(count[at])
        size = np.sqrt((val**2).sum()) or 1.0
        share = echoes[k] / max(1, words[k])
        out.append((np.concatenate(([0, 1], at)), np.concatenate(([1.0, share], val / size))))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, times: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; a row counts ``times``."""
    w = np.zeros(DIMS)
    if not rows:
        return w
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    good = (times * (target >= 0.5)).sum() / times.sum()
    weight = np.where(target >= 0.5, 0.5 / max(1e-9, good), 0.5 / max(1e-9, 1 - good))
    weight = np.minimum(weight, 10) * times / times.sum()
    before, step = w, 4.0
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        z = np.bincount(row, weights=val * ahead[idx], minlength=len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        slope = np.bincount(idx, weights=val * err[row], minlength=DIMS) + ridge * ahead
        before, w = w, ahead - step * slope / 2
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, posterior, score, kept) of every document: kept where the scorer gives at least 0.5, or
    where the text is too short to judge. The columns ``also`` stay beside the verdict of their row.

    The vote counts cover all documents; only the scorer's weights come from at most about
    ``train_rows`` rows, chosen by a hash of id and text; rows that share both are one with their
    number. A null or empty text, and one of under SHORT words and SHORT_BYTES bytes, has no votes
    and is kept. A score of exactly 0.5 is kept. Very long texts are judged whole. Rows with a null
    id and repeated rows are judged each; an empty table gives no rows. Columns that are not named
    are not read.
    """
    slim = pick(docs, id_col, text_col)

    def patterns_of(batches):
        for b in batches:
            for _, _, buf, off in chunks(b.column(0)):
                key, n = np.unique(pattern(votes(buf, off)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pattern", "n"])

    # at most 3**labellers rows
    rows = slim.select(F.col(f"`{text_col}`")).mapInArrow(patterns_of, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    good = posteriors({r["pattern"]: r["n"] for r in rows})
    total = sum(r["n"] for r in rows)
    share = min(1.0, train_rows / max(1, total))
    picked = slim.select(F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def featured(batches):
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                rows, key = features(buf, off), pattern(votes(buf, off))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([good.get(k, 0.5) for k in key.tolist()])],
                    names=["h", "idx", "val", "target"],
                )

    def fitted(batches):
        rows = sorted((h, i, v, t, n) for b in batches for h, i, v, t, n in zip(*(c.to_pylist() for c in b.columns)))
        w = fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v)) for _, i, v, _, _ in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    sample = picked.mapInArrow(featured, "h bigint, idx binary, val binary, target double").groupBy("h").agg(*[F.first(c).alias(c) for c in ("idx", "val", "target")], F.count("*").alias("n")).repartition(1)
    got = sample.mapInArrow(fitted, "w binary").collect()
    weights = np.frombuffer(got[0]["w"]) if got else np.zeros(DIMS)

    names = list(dict.fromkeys([id_col, text_col, *also]))
    given = list(dict.fromkeys([id_col, *also]))

    def judged(batches):
        for b in batches:
            for i, j, buf, off in chunks(b.column(names.index(text_col))):
                z = np.array([float(weights[at] @ val) for at, val in features(buf, off)])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                short = short_texts(buf, off)
                post = [good.get(k, 0.5) for k in pattern(votes(buf, off)).tolist()]
                yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)).slice(i, j - i) for c in given], pa.array(post, pa.float64()), pa.array(np.round(score, 9)), pa.array((score >= 0.5) | short)], names=[*given, "posterior", "score", "kept"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given)
    return pick(docs, *names).mapInArrow(judged, f"{kinds}, posterior double, score double, kept boolean")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents")))
