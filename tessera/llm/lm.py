"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces are those of an existing SentencePiece file, and its scores are their prior: a unigram
file gives log probabilities, a BPE file ranks, which count as probabilities that fall with the rank.
The training documents move them: every different training word is segmented once, weighted by its
count, and the prior has the weight of ``PRIOR`` tokens for each piece. The training words themselves
are pieces too, by their counts, so what the model holds grows with the corpus. The probability of
a word is the sum over all its segmentations (single bytes included, so every word has one), by a
forward recursion in log space. No piece crosses a blank, so the probability of a text is the
product over its words and one end.

Words are counted, scored and looked up once each. A batch of documents sends its different
words to the buckets of their hashes and gets counts and probabilities back in the same order;
very frequent words, whose number is bounded, are known to every task beforehand. The number of
buckets follows the input's bytes, and a bucket's asks are answered as a stream.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import BYTE, LOWER, STEP, Tables, bucket_count, bucket_of, chunks, group_starts, grouped, pick, powers, span_hashes, spans, streamed, word_bounds

#: A word is frequent if it is at least one in FREQUENT of all words; so at most FREQUENT are.
FREQUENT = 200_000
BATCH_BYTES, LATTICE_BYTES, MERGE_BYTES = 1 << 22, 1 << 18, 1 << 24
#: Training tokens that the file's scores weigh for each piece, and the share of a word's probability that its own count has.
PRIOR, WORD_SHARE = 0.5, 0.5
#: Scores under this mark pieces that are not meant to win.
UNUSED = -1e8


# ---------------------------------------------------------------- the lattice


class Lattice:
    """Log probabilities of pieces by length and hash, and the forward recursion over words."""

    def __init__(self, pieces: dict[bytes, float]):
        by: dict[int, list[tuple[int, float]]] = {}
        for text, logp in pieces.items():
            by.setdefault(len(text), []).append((self._hash(text), logp))
        self.tables = {}
        for n, rows in sorted(by.items()):
            rows.sort()
            self.tables[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])

    @staticmethod
    def _hash(text: bytes) -> int:
        return int((BYTE[np.frombuffer(text, np.uint8)] * powers(len(text))).sum(dtype=np.uint64))

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The natural log of the probability of each word; a word is its bytes after a blank."""
        out, i, n = np.empty(len(off) - 1), 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + LATTICE_BYTES, side="right")) - 1)
            out[i:j] = self._some(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j
        return out

    def _some(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        lens = np.diff(off) + 1
        starts = off[:-1] + np.arange(len(lens))
        buf = np.full(len(raw) + len(lens), 32, np.uint8)
        solid = np.ones(len(buf), bool)
        solid[starts] = False
        buf[solid] = raw
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[buf] * powers(len(buf)))))
        back = powers(len(buf), pow(STEP, -1, 1 << 64))
        left = np.repeat(starts + lens, lens) - np.arange(len(buf))
        sizes = [k for k in self.tables if k <= int(lens.max())]
        logp = {}
        for k in sizes:
            at = np.flatnonzero(left >= k)
            h = (sums[at + k] - sums[at]) * back[at]
            keys, vals = self.tables[k]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            logp[k] = np.full(len(buf), -np.inf)
            good = keys[place] == h
            logp[k][at[good]] = vals[place[good]]
        out = np.empty(len(lens))
        order = np.argsort(lens, kind="stable")
        cuts = group_starts(lens[order])
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            n, st = int(lens[rows[0]]), starts[rows]
            ahead = np.full((n + 1, len(rows)), -np.inf)
            ahead[0] = 0
            for j in range(1, n + 1):
                ways = np.stack([ahead[j - k] + logp[k][st + j - k] for k in sizes if k <= j])
                top = ways.max(axis=0)
                ahead[j] = top + np.log(np.exp(ways - np.where(np.isfinite(top), top, 0)).sum(axis=0))
            out[rows] = ahead[n]
        return out


def pieces_of(model_file: str) -> tuple[list[bytes | None], np.ndarray, int]:
    """The bytes of each piece, a blank for the word mark (null for control pieces), the prior probabilities by the file's scores, and the end id."""
    import sentencepiece

    from .pieces import is_bpe

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out: list[bytes | None] = []
    scores = np.array([m.get_score(k) for k in range(m.get_piece_size())])
    given = np.zeros(len(scores), bool)
    for k in range(len(scores)):
        p = m.id_to_piece(k)
        out.append(bytes([int(p[3:5], 16)]) if m.is_byte(k) else None if m.is_control(k) or m.is_unknown(k) else p.replace("▁", " ").encode())
        given[k] = out[-1] is not None and not m.is_byte(k) and scores[k] > UNUSED
    worst = scores[given].min() if given.any() else 0.0
    scores = np.where(given, scores, worst)  # bytes, ends and unused pieces have no score of their own
    prior = 1 / (1 - np.minimum(scores, 0)) if is_bpe(model_file) else np.exp(scores - scores.max())
    usable = np.array([p is not None for p in out])
    usable[m.eos_id()] = True
    prior = np.where(usable, prior, 0)
    return out, prior / prior.sum(), m.eos_id()


# ---------------------------------------------------------------- words of batches


def _words(buf: np.ndarray, off: np.ndarray):
    """Of a run of documents: hash, first place and length of each different word, and for each word its index and document."""
    held = []
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 21), side="right")) - 1)
        s, e, count = word_bounds(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        held.append((span_hashes(buf[off[i] : off[j]], s, e, LOWER), s + off[i], e - s, np.repeat(np.arange(i, j), count)))
        i = j
    h, s, length, doc = (np.concatenate(x) for x in zip(*held))
    keys, first, index = np.unique(h, return_index=True, return_inverse=True)
    return keys, s[first], length[first], index, doc


def _counted(buckets: int):
    """Each batch's words as one row for each bucket: bytes, lengths, training counts, all counts."""

    def run(batches):
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, buf, off in chunks(b.column(0), BATCH_BYTES):
                keys, first, length, index, doc = _words(buf, off)
                if not len(keys):
                    continue
                total = np.bincount(index, minlength=len(keys))
                known = np.bincount(index[train[i:j][doc]], minlength=len(keys))
                to = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(buckets + 1))
                cols = [[], [], [], []]
                full = np.flatnonzero(np.diff(edge))
                for k in full:
                    rows = order[edge[k] : edge[k + 1]]
                    cols[0].append(LOWER[buf[spans(first[rows], length[rows])]].tobytes())
                    cols[1].append(length[rows].astype(np.int32).tobytes())
                    cols[2].append(known[rows].astype(np.int64).tobytes())
                    cols[3].append(total[rows].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "words", "lens", "c", "t"])

    return run


def _blob(table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x is not None), kind)


def _merged(batches):
    """One row for each bucket: its different words with their counts over all batches, merged whenever MERGE_BYTES have come."""

    def merge(parts):
        buf, lens, c, t = (np.concatenate(x) for x in zip(*parts))
        starts = np.cumsum(lens) - lens
        keys, first, index = np.unique(span_hashes(buf, starts, starts + lens, LOWER), return_index=True, return_inverse=True)
        c, t = (np.bincount(index, weights=x, minlength=len(keys)).astype(np.int64) for x in (c, t))
        return buf[spans(starts[first], lens[first])], lens[first], c, t

    def row(bucket, parts):
        words, lens, c, t = merge(parts)
        blobs = [words.tobytes(), lens.astype(np.int32).tobytes(), c.tobytes(), t.tobytes()]
        sums = [int((c > 0).sum()), int(c.sum()), int(t.sum())]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs], *[pa.array([x], pa.int64()) for x in sums]], names=["bucket", "words", "lens", "c", "t", "n_known", "n_train", "n_all"])

    now, parts, size = None, [], 0
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        cuts = group_starts(bucket)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if bucket[x] != now:
                if parts:
                    yield row(now, parts)
                now, parts, size = bucket[x], [], 0
            part = pa.Table.from_batches([b.slice(x, y - x)])
            parts.append((_blob(part, "words", np.uint8), _blob(part, "lens", np.int32).astype(np.int64), _blob(part, "c", np.int64), _blob(part, "t", np.int64)))
            size += part.nbytes
            if size > MERGE_BYTES:
                parts, size = [merge(parts)], 0
    if parts:
        yield row(now, parts)


def _unpacked(batch, row: int):
    """(bytes, offsets, hashes, training counts, all counts) of one row of the words table."""
    raw = lambda k, kind: np.frombuffer(batch.column(k)[row].as_buffer(), kind)
    buf, lens = raw("words", np.uint8), raw("lens", np.int32).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(lens)))
    return buf, off, span_hashes(buf, off[:-1], off[1:], LOWER), raw("c", np.int64), raw("t", np.int64)


def _piece_counts(model_file: str):
    def run(batches):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(m.get_piece_size(), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                buf, off, _, c, _ = _unpacked(b, row)
                text = buf.tobytes()
                use = np.flatnonzero(c > 0)
                for a in range(0, len(use), 20_000):
                    some = use[a : a + 20_000]
                    words = [text[off[k] : off[k + 1]].decode("utf-8", "replace") for k in some.tolist()]
                    ids = m.encode(words, num_threads=1)
                    flat = np.fromiter((x for w in ids for x in w), np.int64)
                    total += np.bincount(flat, weights=np.repeat(c[some], [len(w) for w in ids]), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    return run


def _scored(lattice: Lattice, buf: np.ndarray, off: np.ndarray, use: np.ndarray, c: np.ndarray, words: int) -> np.ndarray:
    """The log probability of the words ``use``: their own counts' share and that of their segmentations."""
    if not len(use):
        return np.empty(0)
    lens = np.diff(off)[use]
    sub = lattice.score(buf[spans(off[:-1][use], lens)], np.concatenate(([0], np.cumsum(lens))))
    if not words:
        return sub
    whole = np.log(np.maximum(c[use], 1e-300) / words)
    return np.logaddexp(math.log(1 - WORD_SHARE) + sub, np.where(c[use] > 0, math.log(WORD_SHARE) + whole, -np.inf))


def _frequent(lattice: Lattice, least: int, words: int):
    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                buf, off, h, c, t = _unpacked(b, row)
                use = np.flatnonzero(t >= least)
                yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(c[use]), pa.array(_scored(lattice, buf, off, use, c, words))], names=["h", "c", "logp"])

    return run


# ---------------------------------------------------------------- documents


def _asks(buckets: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Rows of a batch: one with its documents (bucket -1), and for each bucket the words it asks for."""

    def run(batches):
        keys_hot, c_hot, lp_hot = hot
        serial = TaskContext.get().partitionId() << 24
        for b in batches:
            for i, j, buf, off in chunks(b.column(2), BATCH_BYTES):
                keys, _, _, index, doc = _words(buf, off)
                n = j - i
                place = np.minimum(np.searchsorted(keys_hot, keys), max(0, len(keys_hot) - 1))
                known = keys_hot[place] == keys if len(keys_hot) else np.zeros(len(keys), bool)
                common = known[index]
                at = place[index[common]] if len(keys_hot) else np.empty(0, np.int64)
                d = doc[common]
                local = [np.bincount(doc, minlength=n), np.bincount(d, weights=c_hot[at] > 0, minlength=n), np.bincount(d, weights=np.log10(c_hot[at] + 0.5), minlength=n), np.bincount(d, weights=lp_hot[at], minlength=n)]
                rare = np.flatnonzero(~known)
                to = (keys[rare] % np.uint64(buckets)).astype(np.int64)
                rare = rare[np.argsort(to, kind="stable")]
                edge = np.searchsorted(np.sort(to), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                rank = np.full(len(keys), -1, np.int64)
                rank[rare] = np.arange(len(rare))
                refs, owner = rank[index[~common]], doc[~common]
                state = [np.asarray(x, np.float64).tobytes() for x in local] + [refs.astype(np.int32).tobytes(), owner.astype(np.int32).tobytes()]
                asked = [keys[rare[edge[k] : edge[k + 1]]].tobytes() for k in full]
                size = 1 + len(full)
                ids = pa.array([b.column(0).slice(i, n).to_pylist(), *[None] * len(full)], pa.list_(b.schema.field(0).type))
                held = pa.array([b.column(1).slice(i, n).to_pylist(), *[None] * len(full)], pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, serial)), pa.array(np.concatenate(([-1], full)).astype(np.int32)), pa.array([None, *asked], pa.binary()), ids, held, *[pa.array([x, *[None] * len(full)], pa.binary()) for x in state]],
                    names=["batch", "bucket", "asked", "ids", "held", "n", "known", "base", "logp", "refs", "owner"],
                )
                serial += 1

    return run


def _answers(lattice: Lattice, least: int, words: int):
    """Scores the words of each bucket, which come first, and answers the asks that follow, each in its order."""

    def run(batches):
        keys = counts = logp = None
        for b in batches:
            asked, rows, cs, lps = b.column("asked"), [], [], []
            for row in range(b.num_rows):
                if not asked[row].is_valid:
                    buf, off, h, c, t = _unpacked(b, row)
                    use = np.flatnonzero(t < least)
                    use = use[np.argsort(h[use])]
                    keys, counts, logp = h[use], c[use], _scored(lattice, buf, off, use, c, words)
                    continue
                place = np.searchsorted(keys, np.frombuffer(asked[row].as_buffer(), np.uint64))
                rows.append(row)
                cs.append(counts[place].tobytes())
                lps.append(logp[place].tobytes())
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("batch").take(at), b.column("bucket").take(at), pa.array(cs, pa.binary()), pa.array(lps, pa.binary())], names=["batch", "bucket", "c", "lp"])

    return run


def _finished(id_type, tokens: int, distinct: int, ends: int, log_end: float, id_col: str):
    """Adds the answers of each batch to its documents."""

    def run(table: pa.Table):
        table = table.combine_chunks()
        batch, bucket = table.column("batch").to_numpy(), table.column("bucket").to_numpy()
        cuts = group_starts(batch)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = np.arange(a, b)[np.argsort(bucket[a:b])]
            mine, rest = int(rows[0]), rows[1:].tolist()
            raw = lambda k, kind, r=mine: np.frombuffer(table.column(k)[r].as_buffer(), kind)
            n, known, base, logp = (raw(k, np.float64) for k in ("n", "known", "base", "logp"))
            refs, owner = raw("refs", np.int32), raw("owner", np.int32)
            if rest:
                c, lp = (np.concatenate([raw(k, kind, r) for r in rest]) for k, kind in (("c", np.int64), ("lp", np.float64)))
                add = lambda w: np.bincount(owner, weights=w, minlength=len(n))  # noqa: B023, E731
                known, base, logp = known + add(c[refs] > 0), base + add(np.log10(c[refs] + 0.5)), logp + add(lp[refs])
            total = n + 1
            base = base + math.log10(ends + 0.5) - total * math.log10(tokens + 0.5 * (distinct + 1))
            yield pa.RecordBatch.from_arrays(
                [table.column("ids")[mine].values, table.column("held")[mine].values, pa.array(total.astype(np.int64)), pa.array((known + (ends > 0)).astype(np.int64)), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array((logp + log_end) / math.log(10))],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame, held_out, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text; learns from the rows where the condition ``held_out`` is not true.

    Returns the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (log10 under smoothed word counts) and ``score``
    (log10 of the marginal probability under the pieces). Letters A-Z count as lower case.

    A null or empty text is its end alone. Rows with a null id are learned from unless the
    condition says otherwise, and scored. Repeated rows count each. An empty table gives no rows;
    without training rows the file's scores alone count. A very long text is a batch of its own,
    and other columns of the table are not read, so none can clash.
    """
    spark = docs.sparkSession
    tables, buckets = Tables(spark), bucket_count(docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").alias("text"))
    counted = slim.select("text", ~F.col("held")).mapInArrow(_counted(buckets), "bucket int, words binary, lens binary, c binary, t binary")
    words = tables.write(streamed(counted, ["bucket"], [], _merged, "bucket int, words binary, lens binary, c binary, t binary, n_known bigint, n_train bigint, n_all bigint"), "words")
    distinct, trained, all_words = (int(x or 0) for x in words.agg(F.sum("n_known"), F.sum("n_train"), F.sum("n_all")).first())
    ends = slim.where(~F.col("held")).count()
    distinct, tokens = distinct + (ends > 0), trained + ends
    # one row for each piece of the vocabulary at most
    rows = words.mapInArrow(_piece_counts(model_file), "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    pieces, prior, end = pieces_of(model_file)
    seen = PRIOR * len(pieces) * prior
    seen[[r["piece"] for r in rows]] += [r["n"] for r in rows]
    seen[end] += ends
    usable = prior > 0
    logs = np.log(np.where(usable, seen, 1.0) / seen[usable].sum())
    by: dict[bytes, float] = {}
    for p, x in zip(pieces, logs.tolist()):
        if p is not None:
            by[p] = float(np.logaddexp(by[p], x)) if p in by else x
    lattice = Lattice(by)
    least = max(1, all_words // FREQUENT + 1)
    hot = words.mapInArrow(_frequent(lattice, least, trained), "h bigint, c bigint, logp double").toPandas().sort_values("h", key=lambda s: s.to_numpy().view(np.uint64))
    known = hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.float64), hot["logp"].to_numpy(np.float64)
    kind = docs.schema[id_col].dataType.simpleString()
    state = "n binary, known binary, base binary, logp binary, refs binary, owner binary"
    asks = tables.write(slim.mapInArrow(_asks(buckets, known), f"batch bigint, bucket int, asked binary, ids array<{kind}>, held array<boolean>, {state}"), "asks")
    asking = asks.where("bucket >= 0").select("batch", "bucket", "asked", *[F.lit(None).cast("binary").alias(k) for k in ("words", "lens", "c", "t")])
    table = words.select(F.lit(None).cast("bigint").alias("batch"), "bucket", F.lit(None).cast("binary").alias("asked"), "words", "lens", "c", "t")
    answers = streamed(asking.unionByName(table), ["bucket"], ["batch"], _answers(lattice, least, trained), "batch bigint, bucket int, c binary, lp binary")
    own = asks.where("bucket < 0").drop("asked").withColumns({"c": F.lit(None).cast("binary"), "lp": F.lit(None).cast("binary")})
    both = own.unionByName(answers, allowMissingColumns=True)
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return grouped(both, ["batch"], _finished(None, tokens, distinct, ends, float(logs[end]), id_col), out)


def op2_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents"))
    return score_texts(docs, bucket_of("doc_id", 5) == 1, public_tokenizers.path("piece_bpe_32k.model"))
