"""SentencePiece encoding and decoding by suffix-array matching.

The different words of a chunk are laid in a row and indexed by a suffix array. Every piece of
the vocabulary is found in it by binary search, all pieces at once; the ranges are the piece's
occurrences, so they give all edges of the segmentation lattice. Sorted by position, the edges
are relaxed from left to right, and the best path of each word is read back.

A path's weight is the sum of its pieces' scores in the file; bytes that no piece covers cost more
than any piece. Equal weights go to the path whose last piece is longest.

The scores of a BPE file are merge ranks and no weights: there the edges say which neighbours
merge, and the best rank merges first, the leftmost of equal ones. The ids are the library's own.
"""

from __future__ import annotations

import heapq
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import PLAIN, chunks, group_starts, pick, span_hashes, spans

#: Bytes of text whose words are told apart together, and bytes of different words that are indexed together.
CHUNK, INDEX = 1 << 21, 1 << 18
#: Stretches of more characters merge by a heap each, shorter ones side by side.
SIDE_BY_SIDE = 64
#: Scores under this mark pieces that are not meant to win, as runs of blanks; they count as the worst piece.
UNUSED = -1e8


class Pieces:
    """The vocabulary of a SentencePiece file; the word mark is a blank byte here."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        text: list[bytes] = []
        score = np.zeros(m.get_piece_size())
        whole = np.zeros(len(score), bool)
        self.byte_id = np.zeros(256, np.int64)
        for k in range(len(score)):
            p = m.id_to_piece(k)
            if m.is_byte(k):
                text.append(bytes([int(p[3:5], 16)]))
                self.byte_id[text[-1][0]] = k
            elif m.is_control(k) or m.is_unknown(k):
                text.append(b"")
            else:
                text.append(p.replace("▁", " ").encode())
                whole[k] = b" " not in text[-1].lstrip(b" ")
                score[k] = m.get_score(k)
        self.raw = score.copy()
        worst = score[whole & (score > UNUSED)].min()
        self.score = np.where(whole, np.maximum(score, worst), worst - 10)
        self.ids = np.flatnonzero(whole)
        self.lens = np.array([len(t) for t in text])
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.at = np.cumsum(self.lens) - self.lens
        self.has_piece = np.zeros(256, bool)
        self.has_piece[[text[k][0] for k in self.ids if len(text[k]) == 1]] = True
        self.longest = int(self.lens[self.ids].max())
        self.blocks = -(-self.longest // 8)
        raw = np.zeros((len(self.ids), 8 * self.blocks), np.uint8)
        top = np.full_like(raw, 255)
        for row, k in enumerate(self.ids):
            raw[row, : self.lens[k]] = top[row, : self.lens[k]] = np.frombuffer(text[k], np.uint8)
        self.low, self.high = (x.view(">u8").astype(np.uint64) for x in (raw, top))

    # ------------------------------------------------------------ index and search

    def _suffixes(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``buf`` sorted by what follows, as far as the longest piece reaches, and the 8 bytes at each place."""
        n, reach = len(buf), 8 * self.blocks
        padded = np.concatenate((buf, np.zeros(reach + 8, np.uint8)))
        key = np.zeros(n + reach, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n + reach]
        order = np.argsort(key[:n], kind="stable")
        rank = np.zeros(n + reach, np.int64)
        cuts = group_starts(key[:n][order])
        size = np.diff(cuts)
        rank[order] = np.repeat(cuts[:-1], size) + 1  # 0 is left for places past the end
        where = np.flatnonzero(np.repeat(size > 1, size))
        depth = 8
        while depth < reach and len(where):
            live = order[where]
            pair = rank[live] * (n + 2) + rank[live + depth]
            by = np.argsort(pair, kind="stable")
            live, pair = live[by], pair[by]
            order[where] = live
            cuts = group_starts(pair)
            size = np.diff(cuts)
            rank[live] = np.repeat(where[cuts[:-1]], size) + 1
            where = where[np.repeat(size > 1, size)]
            depth *= 2
        return order, key

    def _search(self, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of ``order`` whose suffixes begin with it."""
        n = len(order)
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for block in range(self.blocks):
            use = np.flatnonzero((lo < hi) & (self.lens[self.ids] > 8 * block))
            if not len(use):
                break
            ends = []
            for goal, after in ((self.low[use, block], False), (self.high[use, block], True)):
                a, b = lo[use].copy(), hi[use].copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    got = key[order[np.minimum(mid, n - 1)] + 8 * block]
                    right = (a < b) & ((got <= goal) if after else (got < goal))
                    a, b = np.where(right, mid + 1, a), np.where(right | (a >= b), b, mid)
                ends.append(a)
            lo[use], hi[use] = ends
        return lo, hi

    # ------------------------------------------------------------ relaxation

    def _paths(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best path of each word in a row, and their offsets."""
        ids, counts, i, n = [], [], 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + INDEX, side="right")) - 1)
            got, at = self._relax(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            ids.append(got)
            counts.append(np.diff(at))
            i = j
        if not ids:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def _edges(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of every occurrence of a piece."""
        order, key = self._suffixes(buf)
        lo, hi = self._search(order, key)
        return order[spans(lo, hi - lo)], np.repeat(self.ids, hi - lo)

    def _relax(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        place, piece = self._edges(buf)
        bare = np.flatnonzero(~self.has_piece[buf])  # a byte with a piece of its own needs no byte edge, so ends differ at each start
        place, piece = np.concatenate((place, bare)), np.concatenate((piece, self.byte_id[buf[bare]]))
        start_of = np.repeat(off[:-1], np.diff(off))
        within = place - start_of[place]
        by = np.argsort(within.astype(np.int64) * (n + 1) + place)
        place, piece, within = place[by], piece[by], within[by]
        end = place + self.lens[piece]
        # best[p] is the weight up to place p of the word that p ends or lies in; a word's first place starts at 0
        word = np.repeat(np.arange(len(off) - 1), np.diff(off))
        gap = end + word[place]  # each word has one more node than bytes
        node = place + word[place]
        best = np.full(n + len(off) - 1, -np.inf)
        best[off[:-1] + np.arange(len(off) - 1)] = 0.0
        back = np.full(len(best), -1, np.int64)
        gain = self.score[piece]
        cuts = group_starts(within)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            got = best[node[a:b]] + gain[a:b]
            to = gap[a:b]
            better = got > best[to]
            best[to[better]] = got[better]
            back[to[better]] = np.flatnonzero(better) + a
        now, owner = off[1:] + np.arange(len(off) - 1), np.arange(len(off) - 1)
        first = off[:-1] + np.arange(len(off) - 1)
        who, what = [], []
        while len(now):
            edge = back[now]
            who.append(owner)
            what.append(piece[edge])
            now = node[edge]
            more = now != first[owner]
            now, owner = now[more], owner[more]
        if not who:
            return np.empty(0, np.int64), np.zeros(len(off), np.int64)
        step = np.repeat(np.arange(len(who)), [len(w) for w in who])
        who, what = np.concatenate(who), np.concatenate(what)
        by = np.argsort(who * (int(step[-1]) + 1) - step)
        return what[by], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(off) - 1))))

    # ------------------------------------------------------------ texts

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each document and their offsets. A blank goes before every document with text."""
        size = np.diff(off)
        some = size > 0
        starts = off[:-1][some] + np.arange(int(some.sum()))
        text = np.full(len(buf) + len(starts), 32, np.uint8)
        plain = np.ones(len(text), bool)
        plain[starts] = False
        text[plain] = buf
        doc_off = np.concatenate(([0], np.cumsum(size + some)))
        cut = text == 32
        cut[1:] &= text[:-1] != 32
        cut[starts] = True
        begin = np.flatnonzero(cut)
        stop = np.append(begin[1:], len(text))[: len(begin)]
        _, first, index = np.unique(span_hashes(text, begin, stop, PLAIN), return_index=True, return_inverse=True)
        lens = stop - begin
        if (text[spans(begin, lens)] != text[spans(begin[first][index], lens[first][index])]).any() if (lens == lens[first][index]).all() else True:
            first = index = np.arange(len(begin))  # two words share a hash
        words = text[spans(begin[first], lens[first])]
        ids, at = self._paths(words, np.concatenate(([0], np.cumsum(lens[first]))))
        count = np.diff(at)[index] if len(index) else np.empty(0, np.int64)
        out = ids[spans(at[:-1][index], count)] if len(index) else ids
        total = np.concatenate(([0], np.cumsum(count)))
        return out, total[np.searchsorted(begin, doc_off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of each document."""
        lens = self.lens[ids]
        raw = self.flat[spans(self.at[ids], lens)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lens)))[off]
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Merges(Pieces):
    """The vocabulary of a BPE file: neighbours merge by rank, from characters upwards."""

    def __init__(self, model_file: str):
        super().__init__(model_file)
        _, self.rank = np.unique(-self.raw, return_inverse=True)

    def _relax(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word in a row, and their offsets."""
        n, wide, none = len(buf), self.longest + 1, len(self.rank)
        place, piece = self._edges(buf)
        size = self.lens[piece]
        inside = np.repeat(off[1:], np.diff(off))[place] >= place + size
        place, piece, size = place[inside], piece[inside], size[inside]
        key = place * wide + size
        by = np.argsort(key)
        key, piece = np.append(key[by], np.iinfo(np.int64).max), np.append(piece[by], -1)

        def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The piece between two places, or -1."""
            want = a * wide + np.minimum(b - a, wide)
            k = np.searchsorted(key, want)
            return np.where((key[k] == want) & (b - a < wide), piece[k], -1)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            got = find(a, b)
            return np.where(got < 0, none, self.rank[got])

        # no merge crosses a place that no piece crosses, so the stretches between such places are on their own
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, place + 1, 1)
        np.add.at(over, place + size, -1)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        new = np.cumsum(over)[at] <= 0
        new[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
        cuts = np.append(np.flatnonzero(new), len(at))
        count = np.diff(cuts)
        edge = np.append(at, n)
        done = [at[np.repeat(count == 1, count)]]
        for k in np.flatnonzero(count > SIDE_BY_SIDE).tolist():
            done.append(self._merge(edge[cuts[k] : cuts[k + 1] + 1], ranks))
        live = np.flatnonzero((count > 1) & (count <= SIDE_BY_SIDE))
        count, stop = count[live], edge[cuts[live + 1]]
        at = at[spans(cuts[live], count)]

        def follow(k: np.ndarray, owner: np.ndarray) -> np.ndarray:
            """The ranks of the pairs that begin at the symbols k."""
            last = ends[owner] - 1
            after = np.where(k + 2 <= last, at[np.minimum(k + 2, len(at) - 1)], stop[owner])
            return np.where(k < last, ranks(at[k], after), none)

        ends = np.cumsum(count)
        rank = follow(np.arange(len(at)), np.repeat(np.arange(len(live)), count)) if len(live) else at
        while len(count):
            ends = np.cumsum(count)
            best = np.minimum.reduceat((rank << 32) | np.arange(len(at)), ends - count)
            more = (best >> 32) < none
            keep = np.repeat(more, count)
            done.append(at[~keep])
            left = best[more] & 0xFFFFFFFF
            keep[left + 1] = False
            left = (np.cumsum(keep) - 1)[left]
            at, rank, count, stop = at[keep], rank[keep], count[more] - 1, stop[more]
            ends = np.cumsum(count)
            owner = np.arange(len(count))
            rank[left] = follow(left, owner)
            has = left > ends - count
            rank[left[has] - 1] = follow(left[has] - 1, owner[has])
        begin = np.sort(np.concatenate(done))
        end = np.append(begin[1:], n)[: len(begin)]
        ids = find(begin, end)
        raw = ids < 0  # characters without a piece are given by their bytes
        many = np.where(raw, end - begin, 1)
        out = np.repeat(ids, many)
        out[np.repeat(raw, many)] = self.byte_id[buf[spans(begin[raw], many[raw])]]
        total = np.concatenate(([0], np.cumsum(many)))
        return out, total[np.searchsorted(begin, off)]

    def _merge(self, at: np.ndarray, ranks) -> np.ndarray:
        """The places where symbols begin once the stretch with these places and end is merged."""
        n, none = len(at) - 1, len(self.rank)
        heap = [(r, k, k + 1, k + 2) for k, r in enumerate(ranks(at[:-2], at[2:]).tolist()) if r < none]
        heapq.heapify(heap)
        stop, back = list(range(1, n + 1)), list(range(-1, n))  # where the symbol at k ends, and where the one before k begins
        alive = [True] * n
        table: dict[tuple[int, int], int] = {}
        for width in range(3, min(self.longest, n) + 1):
            got = ranks(at[:-width], at[width:])
            some = np.flatnonzero(got < none)
            table.update(zip(zip(some.tolist(), (some + width).tolist()), got[some].tolist()))
        while heap:
            _, a, mid, b = heapq.heappop(heap)
            if not (alive[a] and stop[a] == mid and mid < n and alive[mid] and stop[mid] == b):
                continue
            alive[mid], stop[a] = False, b
            if b < n:
                back[b] = a
                if (r := table.get((a, stop[b]))) is not None:
                    heapq.heappush(heap, (r, a, b, stop[b]))
            if (p := back[a]) >= 0 and (r := table.get((p, b))) is not None:
                heapq.heappush(heap, (r, p, a, b))
        return at[:-1][np.array(alive)]


def is_bpe(model_file: str) -> bool:
    """Whether the file is a BPE file."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    return m.trainer_spec.model_type == m.trainer_spec.BPE


def pieces(model_file: str) -> Pieces:
    kept = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept"))
    if ("pieces", model_file) not in vars(kept):
        vars(kept)["pieces", model_file] = (Merges if is_bpe(model_file) else Pieces)(model_file)
    return vars(kept)["pieces", model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids): the piece ids of every whole text as little-endian uint32.

    For a unigram file the path is the best one under the file's scores. For a BPE file, as that of
    the query, it is the one that merging by rank gives, so the ids are the library's; a path by
    summed ranks would not be. Equal weights go to the longest last piece. A very long text is a
    chunk of its own, and other columns are not read. A null or empty text has no pieces. Rows with a null id and repeated rows are encoded each; an
    empty table gives no rows. ``decode`` gives the same texts back, byte for byte; for that a word mark
    in the text (U+2581) is kept as bytes, where the library takes it for a blank.
    """

    def run(batches):
        for b in batches:
            for i, j, buf, off in chunks(b.column(1), CHUNK):
                ids, at = pieces(model_file).encode(buf, off)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array([raw[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=[id_col, "n_pieces", "ids"])

    return pick(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_pieces bigint, ids binary")


def decode(encoded: DataFrame, model_file: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and the ``text`` of the ids; a null list is an empty text."""

    def run(batches):
        for b in batches:
            last = b.num_columns - 1
            for i, j, buf, off in chunks(b.column(last), INDEX):
                texts = pieces(model_file).decode(np.frombuffer(buf.tobytes(), "<u4").astype(np.int64), off // 4)
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, j - i) for k in range(last)], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return pick(encoded, *keep, ids_col).mapInArrow(run, f"{kinds}, text string")


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text they decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = encode(spread(table(spark, sf_dir, "documents")), model).withColumn("ids_crc32", F.crc32("ids"))
    back = decode(ids, model, ["doc_id", "n_pieces", "ids_crc32"])
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
