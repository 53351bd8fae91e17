"""Linear probes over sparse rows (M3, M4): vocabulary, tf-idf rows, logistic regression, stochastic gradient steps.

A row is a pair of arrays, places and values, so 20,000 features cost what a text holds of them. A
model is one array of classes x (features + 1), the last column for the intercepts; tasks add up gradients
of their rows and send one such array each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch

SPARSE = "at array<int>, x array<double>"
#: Fixed: what a word is.
WORD = re.compile(r"(?u)\w\w+")


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(text: str | None) -> list[str]:
    words = _words(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class Vocabulary:
    """Terms in code-point order and their idf."""

    at: dict[str, int]
    idf: np.ndarray


#: Different terms that a task counts before it sends them on, and words whose pairs it counts at once.
HELD_TERMS, CHUNK_WORDS = 1 << 18, 1 << 20
#: Words for each feature that may be known to all tasks where pairs are counted; with more (by ties), pairs are counted as texts.
TIES = 4


def _chunks(col, number, terms=_words):
    """Texts by up to ``CHUNK_WORDS`` words: (from, to, words as numbers, their texts counted from 0)."""
    lo, n, held = 0, 0, []
    for i, t in enumerate(col.to_pylist()):
        words = terms(t)
        held.append(np.fromiter(map(number, words), np.int64, len(words)))
        n += len(words)
        if n >= CHUNK_WORDS or i + 1 == len(col):
            yield lo, i + 1, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
            lo, n, held = i + 1, 0, []


class _Known(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: str) -> int:
        return -1


class _Growing(dict):
    """Numbers of words, in the order of arrival."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _tallied(term: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different terms, how often they occur, and in how many texts."""
    each, n = np.unique(term * docs + doc, return_counts=True)
    term = each // docs
    at = np.flatnonzero(np.diff(term, prepend=-1))
    return term[at], np.add.reduceat(n, at) if len(at) else n, np.diff(at, append=len(term))


def _counted(terms):
    """(term, tf, df) of a task's texts, added up before they are sent."""

    def run(batches):
        ids, tf, df = _Growing(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])

        for b in batches:
            for lo, hi, word, doc in _chunks(b.column(0), ids.__getitem__, terms):
                at, more_tf, more_df = _tallied(word, doc, hi - lo)
                tf, df = (np.pad(c, (0, len(ids) - len(c))) for c in (tf, df))
                tf[at] += more_tf
                df[at] += more_df
                if len(ids) >= HELD_TERMS:
                    yield sent()
                    ids.clear()
                    tf, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield sent()

    return run


def _pairs(word: np.ndarray, doc: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of one text that are both known, as first * known + second, and their texts."""
    both = (doc[1:] == doc[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
    return word[:-1][both] * known + word[1:][both], doc[1:][both]


def _counted_pairs(ids: _Known):
    def run(batches):
        for b in batches:
            for lo, hi, word, doc in _chunks(b.column(0), ids.__getitem__):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in _tallied(*_pairs(word, doc, len(ids)), hi - lo)], names=["pair", "tf", "df"])

    return run


def vocabulary(df: DataFrame, text: str, features: int = 20_000, least: int = 3) -> Vocabulary:
    """The ``features`` most frequent words and word pairs of those in ``least`` texts or more (ties by term), with idf ln((1 + n) / (1 + df)) + 1.

    Words are counted first. A pair is in no more places and texts than either of its words, so only pairs
    of words that are as frequent as the last of ``features`` words can be chosen, and only
    these are counted, as numbers. At most ``TIES * features`` words and as many pairs as features reach the driver.
    """
    texts = df.select(text)

    def most(run, key: str, kind: str, n: int):
        counts = texts.mapInArrow(run, f"{key} {kind}, tf bigint, df bigint").groupBy(key).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= least)
        return [tuple(r) for r in counts.orderBy(F.desc("tf"), key).limit(n).collect()]

    rows = most(_counted(_words), "term", "string", TIES * features + 1)
    floor = rows[features - 1][1] if len(rows) >= features else 0
    if len(rows) > TIES * features and rows[-1][1] >= floor:
        rows = most(_counted(_grams), "term", "string", features)
    else:
        names = sorted(t for t, tf, _ in rows if tf >= floor)  # pairs of numbers are in the order of their texts, as a blank is below all letters
        pairs = most(_counted_pairs(_Known((t, i) for i, t in enumerate(names))), "pair", "bigint", features) if names else []
        rows = rows[:features] + [(f"{names[p // len(names)]} {names[p % len(names)]}", tf, d) for p, tf, d in pairs]
    rows = sorted((t, d) for t, _, d in sorted(rows, key=lambda r: (-r[1], r[0]))[:features])
    n = df.count()
    return Vocabulary({t: i for i, (t, _) in enumerate(rows)}, np.log((1 + n) / (1 + np.array([d for _, d in rows], float))) + 1)


def tfidf_rows(df: DataFrame, text: str, words: Vocabulary) -> DataFrame:
    """Adds (at, x): (1 + ln tf) * idf of the vocabulary's terms, at unit length, in place of the text."""
    keep = [c for c in df.columns if c != text]
    ids = _Known((w, i) for i, w in enumerate(sorted({w for t in words.at for w in t.split(" ")})))
    place, pair_at = np.full(len(ids) + 1, -1), {}
    for t, i in words.at.items():
        a, *b = t.split(" ")
        if b:
            pair_at[ids[a] * len(ids) + ids[b[0]]] = i
        else:
            place[ids[a]] = i
    pairs = np.array(sorted(pair_at), np.int64)
    places, size = np.array([pair_at[p] for p in pairs.tolist()], np.int64), max(len(words.at), 1)

    def run(batches):
        for b in batches:
            for lo, hi, word, doc in _chunks(b.column(len(keep)), ids.__getitem__):
                pair, pair_doc = _pairs(word, doc, len(ids))
                if len(pairs):
                    near = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                    there = pairs[near] == pair
                    near, pair_doc = places[near[there]], pair_doc[there]
                else:
                    near, pair_doc = pair[:0], pair_doc[:0]
                alone = place[word]  # the last place, of -1, is -1
                each, tf = np.unique(np.concatenate((doc[alone >= 0] * size + alone[alone >= 0], pair_doc * size + near)), return_counts=True)
                doc, at = each // size, each % size
                v = (1 + np.log(tf)) * words.idf[at]
                norm = np.sqrt(np.bincount(doc, v * v, hi - lo))
                off = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo)))), pa.int32())
                lists = [pa.ListArray.from_arrays(off, c) for c in (pa.array(at.astype(np.int32)), pa.array(v / np.maximum(norm, 1e-300)[doc]))]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo) for i in range(len(keep))], *lists], names=[*keep, "at", "x"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, text).mapInArrow(run, kinds + SPARSE)


def dense_rows(df: DataFrame, vec: str) -> DataFrame:
    """Adds (at, x) for a dense vector."""
    return df.withColumns({"at": F.transform(F.sequence(F.lit(0), F.size(vec) - 1), lambda i: i.cast("int")), "x": F.col(vec).cast("array<double>")})


class _Block:
    """Rows as arrays: how many places each has, the places and values one after the other."""

    def __init__(self, n: np.ndarray, at: np.ndarray, x: np.ndarray, features: int):
        self.row, self.at, self.x = np.repeat(np.arange(len(n)), n), at.astype(np.int64), x
        self.n, self.features = len(n), features

    @classmethod
    def of(cls, b, features: int) -> _Block:
        """A batch's rows."""
        at = b.column("at")
        return cls(np.diff(at.offsets.to_numpy()), at.flatten().to_numpy(), b.column("x").flatten().to_numpy(), features)

    def scores(self, model: np.ndarray) -> np.ndarray:
        """classes x rows."""
        out = np.repeat(model[:, -1:], self.n, axis=1)
        for k in range(len(model)):
            out[k] += np.bincount(self.row, self.x * model[k, self.at], self.n)
        return out

    def gradient(self, r: np.ndarray) -> np.ndarray:
        """classes x (features + 1) from residuals classes x rows."""
        out = np.empty((len(r), self.features + 1))
        for k in range(len(r)):
            out[k, :-1] = np.bincount(self.at, self.x * r[k, self.row], self.features)
            out[k, -1] = r[k].sum()
        return out


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=0))
    return e / e.sum(axis=0)


#: Values that a packed block holds, and bytes of blocks that a reader holds.
BLOCK_VALUES, GROUP_BYTES = 1 << 16, 16 << 20


def _packed(batches):
    """Rows (y, w, at, x) as blocks of raw arrays, so that a round reads them without taking lists apart."""
    for b in batches:
        at, x = b.column("at"), b.column("x")
        n = np.diff(at.offsets.to_numpy()).astype(np.int32)
        at, x, y, w = at.flatten().to_numpy(), x.flatten().to_numpy(), b.column("y").to_numpy().astype(np.int32), b.column("w").to_numpy()
        off = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        lo = 0
        while lo < len(n):
            hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_VALUES, "right")) - 1), lo + BLOCK_VALUES)
            raw = (y[lo:hi], w[lo:hi], n[lo:hi], at[off[lo] : off[hi]], x[off[lo] : off[hi]])
            yield pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in raw]], names=["y", "w", "n", "at", "x"])
            lo = hi


def packed(rows: DataFrame) -> DataFrame:
    """Rows (y, w, at, x) written once as blocks, for many rounds."""
    kind = "y binary, w binary, n binary, at binary, x binary"
    path = scratch(rows.sparkSession)
    rows.select("y", "w", "at", "x").mapInArrow(_packed, kind).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.schema(kind).parquet(path)


def _added(blocks: DataFrame, tasks: int, features: int, shape: tuple[int, int], of) -> tuple[float, np.ndarray]:
    """The sums of a number and an array that ``of`` gives for each packed block (block, y, w): one array for each of ``tasks`` tasks, added in a second stage."""

    def run(batches):
        loss, grad = 0.0, np.zeros(shape)
        for b in batches:
            for r in zip(*(b.column(c) for c in ("y", "w", "n", "at", "x"))):
                y, w, n, at, x = (np.frombuffer(v.as_buffer(), t) for v, t in zip(r, (np.int32, float, np.int32, np.int32, float)))
                more, part = of(_Block(n, at, x, features), y, w)
                loss += more
                grad += part
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["g", "loss", "grad"])

    def add(batches):
        loss, grad = 0.0, np.zeros(shape[0] * shape[1])
        for b in batches:
            for v, raw in zip(b.column("loss").to_pylist(), b.column("grad").to_pylist()):
                loss, grad = loss + v, grad + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["g", "loss", "grad"])

    kind = "g int, loss double, grad binary"
    parts = blocks.mapInArrow(run, kind)
    got = (parts.repartition(int(tasks**0.5)).mapInArrow(add, kind) if tasks > 64 else parts).collect()  # so that few arrays meet on the driver
    return sum(r["loss"] for r in got), sum(np.frombuffer(r["grad"]) for r in got).reshape(shape)


def _loss(model: np.ndarray):
    """A block's weighted cross-entropy and its gradient."""

    def of(block: _Block, y: np.ndarray, w: np.ndarray):
        p, i = _softmax(block.scores(model)), np.arange(len(y))
        loss = -float((w * np.log(np.maximum(p[y, i], 1e-300))).sum())
        p[y, i] -= 1
        return loss, block.gradient(p * w)

    return of


def _squares(block: _Block, y: np.ndarray, w: np.ndarray):
    """A block's weight and its weighted sums of squares of the features."""
    block.x = block.x * block.x
    return float(w.sum()), block.gradient(w[None])


def logistic(rows: DataFrame, classes: int, features: int, c: float = 1.0, rounds: int = 100, tol: float = 1e-4, memory: int = 10) -> np.ndarray:
    """M3: multinomial logistic regression on rows (y, w, at, x): c * weighted cross-entropy + |W|**2 / 2, intercepts free, by L-BFGS.

    It ends when no part of the gradient is over ``tol`` times the sum of weights or after ``rounds``. Rows are read once and packed; each round reads the
    blocks once or a few times. Steps are scaled by the root of each feature's curvature at 0, as rare and frequent terms
    differ much; this takes fewer rounds to the same optimum.
    """
    blocks = packed(rows)
    shape, tasks = (classes, features + 1), blocks.rdd.getNumPartitions()
    total, squares = _added(blocks, tasks, features, (1, features + 1), _squares)
    curve = squares * max(classes - 1, 1) / classes**2 / total
    curve[:, :-1] += 1 / (c * total)
    scale = np.repeat(1 / np.sqrt(curve), classes, axis=0).reshape(-1)

    def at(v):
        m = v.reshape(shape)
        loss, grad = _added(blocks, tasks, features, shape, _loss(m))
        grad = c * grad
        grad[:, :-1] += m[:, :-1]
        return (c * loss + 0.5 * float((m[:, :-1] ** 2).sum())) / (c * total), (grad / (c * total)).reshape(-1)

    v = np.zeros(classes * (features + 1))
    f, g = at(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            break
        d, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d -= a * y
        d *= scale
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ (scale * y))
        for (s, y), a in zip(steps, reversed(alphas)):
            d += (a - (y @ d) / (s @ y)) * s
        size, slope = 1.0, d @ g
        for _ in range(30):
            nv = v - size * d
            nf, ng = at(nv)
            if nf <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = nv - v, ng - g
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y)]
        v, f, g = nv, nf, ng
    return v.reshape(shape)


def sgd(rows: DataFrame, classes: int, features: int, epochs: int = 20, alpha: float = 1e-4, step: float = 0.5, batches: int = 4) -> np.ndarray:
    """M4: one-against-rest log loss on rows (y, at, x) by mini-batch gradient steps with an l2 penalty of ``alpha``.

    Rows are dealt to ``batches`` mini-batches by a hash of their content and written by them, so a
    step reads its own rows only; its mean gradient is the sum of the tasks' partial sums. Epochs begin at
    different mini-batches, and the step falls as 1 / (1 + t * alpha).
    """
    model, t = np.zeros((classes, features + 1)), 0
    path = scratch(rows.sparkSession)
    rows.select("y", "at", "x", F.pmod(F.xxhash64("y", "at", "x"), F.lit(batches)).cast("int").alias("mini")).write.partitionBy("mini").parquet(path)
    dealt = rows.sparkSession.read.parquet(path)

    def gradient(part: DataFrame, model: np.ndarray) -> tuple[int, np.ndarray]:
        def run(blocks):
            n, grad = 0, np.zeros_like(model)
            for b in blocks:
                if b.num_rows:
                    block, y = _Block.of(b, features), b.column("y").to_numpy().astype(int)
                    p = 1 / (1 + np.exp(-np.clip(block.scores(model), -50, 50)))
                    p[y, np.arange(len(y))] -= 1
                    n, grad = n + len(y), grad + block.gradient(p)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([grad.tobytes()], pa.binary())], names=["n", "grad"])

        got = part.select("y", "at", "x").mapInArrow(run, "n bigint, grad binary").collect()
        return sum(r["n"] for r in got), sum((np.frombuffer(r["grad"]) for r in got), np.zeros(model.size)).reshape(model.shape)

    for epoch in range(epochs):
        for k in range(batches):
            n, grad = gradient(dealt.where(F.col("mini") == (epoch + k) % batches), model)
            if n:
                rate = step / (1 + t * alpha)
                model = model * np.append(np.full(features, 1 - rate * alpha), 1.0) - rate * grad / n
                t += 1
    return model


def predicted(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(y, prediction): the class with the largest score, the first of equals."""
    features = model.shape[1] - 1

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(_Block.of(b, features).scores(model).argmax(axis=0).astype(float))], names=["y", "prediction"])

    return rows.select(F.col("y").cast("double").alias("y"), "at", "x").mapInArrow(run, "y double, prediction double")
