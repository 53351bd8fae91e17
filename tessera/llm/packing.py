"""Sequence packing by non-negative least squares over shallow length combinations.

Each block of documents is packed where it is tokenised, without a shuffle. Whole windows are
cut from long documents first. What is left of each document falls into one of ``BINS`` length
classes; every multiset of at most three classes that fills a window is a pattern, and
non-negative least squares finds how often to repeat each pattern so that the class histogram
is met. The repeats are rounded down and laid out; the residual documents then form a stream
that first closes the small gaps of the patterns and then fills windows one after another, cut
where a window ends. The last partial window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import PLAIN, chunks, pick, span_hashes, spans

WINDOW, BINS, END_ID, BLOCK_BYTES = 2048, 64, 1, 1 << 22


# ---------------------------------------------------------------- token ids


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(extra)}


class Encoder:
    """Ids of a byte-level BPE file of ``tokenizers``.

    Text is cut before every blank that a solid character follows, where the file's own
    splitting pattern always cuts, so a text's ids are those of its cuts in a row. The distinct
    cuts of a chunk are encoded once. Texts that hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in self.specials}
        self.whole = Tokenizer.from_file(path)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        at = [vocab["".join(m)] for m in merges]
        if any(a >= b for a, b in itertools.pairwise(at)) or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.size[v] = len(k)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a chunk, each with ``end_id`` after it, and their offsets."""
        docs = len(off) - 1
        cut = np.zeros(len(buf), bool)
        if len(buf):
            cut[:-1] = (buf[:-1] == 32) & SOLID_LEAD[buf[1:]]
            cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        owner = np.searchsorted(starts, off)
        _, first, unit = np.unique(span_hashes(buf, starts, ends, PLAIN), return_index=True, return_inverse=True)
        lens = ends - starts
        if (lens != lens[first][unit]).any() or (buf[spans(starts, lens)] != buf[spans(starts[first][unit], lens)]).any():
            first, unit = np.arange(len(starts)), np.arange(len(starts))  # two cuts share a hash
        blank = buf[starts[first]] == 32 if len(first) else np.empty(0, bool)
        joined = np.flatnonzero(blank)
        sizes = lens[first][joined]
        ids = self._ids(buf[spans(starts[first][joined], sizes)].tobytes().decode("utf-8", "surrogatepass"))
        stops = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes)) + 1
        begin, count = np.zeros(len(first) + 1, np.int64), np.ones(len(first) + 1, np.int64)
        begin[joined], count[joined] = np.append(0, stops[:-1])[: len(joined)], np.diff(np.append(0, stops))
        more, at = [ids], len(ids)
        for k in np.flatnonzero(~blank):
            got = self._ids(buf[starts[first[k]] : ends[first[k]]].tobytes().decode())
            begin[k], count[k] = at, len(got)
            at += len(got)
            more.append(got)
        begin[-1] = at
        pool = np.concatenate([*more, np.array([end_id], np.uint32)])
        units = np.insert(unit, owner[1:], len(first))
        n = count[units]
        ids = pool[spans(begin[units], n)]
        offsets = np.concatenate(([0], np.cumsum(n)))[np.concatenate((owner[:1], owner[1:] + np.arange(1, docs + 1)))]
        if any(s.encode() in memoryview(buf).tobytes() for s in self.specials):
            ids, offsets = self._special(buf, off, ids, offsets, end_id)
        return ids, offsets

    def _special(self, buf, off, ids, offsets, end_id):
        parts = []
        for k in range(len(off) - 1):
            text = buf[off[k] : off[k + 1]].tobytes().decode()
            if any(s in text for s in self.specials):
                parts.append(np.array([*self.whole.encode(text, add_special_tokens=False).ids, end_id], np.uint32))
            else:
                parts.append(ids[offsets[k] : offsets[k + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


#: Bytes that surely begin a character that is no white space.
SOLID_LEAD = np.zeros(256, bool)
SOLID_LEAD[0x21:0x7F] = SOLID_LEAD[0xC3:0xE0] = SOLID_LEAD[0xE4:0xF5] = True


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; kept between the tasks of a worker."""
    kept = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept"))
    if ("encoder", path) not in vars(kept):
        vars(kept)["encoder", path] = Encoder(path)
    return vars(kept)["encoder", path]


# ---------------------------------------------------------------- the packing of one block


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """Least squares with x >= 0 by an active set: free the steepest column, step back at bounds."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(most):
        slope = np.where(free, -np.inf, rhs - gram @ x)
        k = int(slope.argmax())
        if slope[k] <= 1e-8 * max(1.0, abs(rhs).max()):
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if not len(at) or z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= 1e-12)]
            if not len(drop):
                drop = at[low]
            x[drop] = 0
            free[drop] = False
    return x


def patterns(bins: int = BINS) -> np.ndarray:
    """Columns: how often each class 1..bins occurs in a multiset of at most three that sums to ``bins``."""
    cols = []
    for i in range(1, bins + 1):
        for j in range(i, bins + 1):
            if i + j == bins:
                cols.append((i, j))
            elif bins - i - j >= j:
                cols.append((i, j, bins - i - j))
    cols.append((bins,))
    out = np.zeros((bins, len(cols)))
    for c, members in enumerate(cols):
        for m in members:
            out[m - 1, c] += 1
    return out


def pack_block(lengths: list[int], window: int = WINDOW, bins: int = BINS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the sequences are 0, 1, ... ."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rest: list[tuple[int, int, int]] = []  # document, start, length under a window
    for d, n in enumerate(lengths):
        whole = n // window
        for k in range(whole):
            out.append((d, k * window, window, seq, 0))
            seq += 1
        if n - whole * window:
            rest.append((d, whole * window, n - whole * window))
    width = window // bins
    by: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    for r in sorted(rest, key=lambda r: -r[2]):
        by[(r[2] + width - 1) // width - 1].append(r)
    table = patterns(bins)
    counts = np.array([len(x) for x in by], float)
    repeats = np.floor(nnls(table, counts) + 1e-9).astype(int)
    laid: list[list[tuple[int, int, int]]] = []
    for c in np.flatnonzero(repeats):
        need = [(m, int(k)) for m, k in enumerate(table[:, c]) if k]
        for _ in range(min([repeats[c], *(len(by[m]) // k for m, k in need)])):
            laid.append([by[m].pop() for m, k in need for _ in range(k)])
    stream = [r for x in by for r in x]  # shortest first, so that taking from the end cuts long ones
    left = sum(r[2] for r in stream)
    laid.sort(key=lambda g: -sum(r[2] for r in g))
    while laid and sum(window - sum(r[2] for r in g) for g in laid) > left:  # gaps that the stream can't close
        g = laid.pop()
        stream = g + stream
        left += sum(r[2] for r in g)

    def take(most: int, at: int, to: int) -> int:
        """Moves up to ``most`` ids of the stream to sequence ``to``; how many."""
        got = 0
        while got < most and stream:
            d, s, n = stream.pop()
            k = min(n, most - got)
            out.append((d, s, k, to, at + got))
            got += k
            if k < n:
                stream.append((d, s + k, n - k))
        return got

    for g in laid:
        at = 0
        for d, s, n in g:
            out.append((d, s, n, seq, at))
            at += n
        take(window - at, at, seq)
        seq += 1
    left = sum(r[2] for r in stream)
    while left >= window:
        left -= take(window, 0, seq)
        seq += 1
    while left:
        left -= take(1 << (left.bit_length() - 1), 0, seq)
        seq += 1
    return out


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``window`` ids.

    Returns one row per piece: the id, ``start`` (ids of the document before it), ``length``,
    ``ids`` (little-endian uint32), ``doc_tokens``, ``sequence_id`` and ``offset``. Every
    sequence has ``window`` ids or a power of two, so none needs padding. A null or empty text
    is the end id alone; a row with a null id is packed with that null; repeated rows are
    packed as often as they occur; an empty table gives no rows. A very long text is tokenised and
    cut whole; other columns are not read, so none can clash. Documents of equal length are laid in
    their order. ``sequence_id`` holds the number of the input partition above 40 bits, so it is
    unique and the same on a retry.
    """
    ident = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {ident}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches):
        base, enc = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j, buf, off in chunks(texts, BLOCK_BYTES):
                enc = enc or encoder(tokenizer)
                ids, at = enc.encode(buf, off, end_id)
                total = np.diff(at)
                d, s, n, q, o = np.array(pack_block(total.tolist(), window), np.int64).T
                raw = [ids[a:b].tobytes() for a, b in zip((at[d] + s).tolist(), (at[d] + s + n).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i).take(pa.array(d)), pa.array(s), pa.array(n), pa.array(raw, pa.binary()), pa.array(total[d]), pa.array(base + q), pa.array(o)],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                base += int(q.max()) + 1

    return pick(docs, id_col, text_col).mapInArrow(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
