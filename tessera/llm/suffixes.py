"""Exact removal of repeated byte strings with bucket-pointer refined suffix arrays.

Every string of ``LENGTH`` bytes that also starts anywhere else is found, across all documents:

1. Each such string has an anchor, the smallest hash among its ``GRAM``-byte grams. Equal strings
   have equal anchors, so only starts whose anchor hash occurs elsewhere, or at two places of its
   own string, can repeat. Consecutive starts share an anchor, which leaves about one row (a run)
   for 80 bytes; a run has ``RUN`` starts at most, so text of a short period is a few long runs.
2. The text around repeated anchors (a region: the bytes of all strings of the run) goes to
   its hash's task, equal regions once. A suffix array over the regions of a batch of hashes
   tells which starts repeat: buckets of 8-grams are refined by sorting on the bucket numbers
   at offsets 8, 16, 32, 64, each round using the buckets of the round before.
3. Hashes with very many different regions (the edge of a passage that very many documents share)
   are no work for one task. Their strings are spread by fingerprints of four residues, which
   also tell them apart: two different strings agree with probability under 2**-90.
4. The repeated starts return to their documents, which lose every covered byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import BYTE, MASK64, STEP, Tables, bucket_count, chunks, group_starts, grouped, mix, pick, powers, spans, text_array

LENGTH, GRAM = 200, 40
#: Starts whose anchors are found at once; positions need fewer than POS_BITS bits.
SEGMENT, POS_BITS = 1 << 19, 21
#: Different regions of one anchor hash beyond which fingerprints replace the suffix array.
HOT = 2000
#: Starts of one run at most.
RUN = 1024
#: Modulus and bases of the residues; a window of n bytes collides with probability n / MOD for each base.
MOD = (1 << 31) - 1
BASES = (1103515245, 69069, 1664525, 214013)


# ---------------------------------------------------------------- anchors


def prefix_sums(buf: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[buf] * powers(len(buf), base))))


def window_hashes(sums: np.ndarray, length: int, base: int) -> np.ndarray:
    """The polynomial hash of every window, the same wherever it stands."""
    return mix((sums[length:] - sums[:-length]) * powers(len(sums) - length, pow(base, -1, 1 << 64)))


def residues(buf: np.ndarray, length: int, base: int) -> np.ndarray:
    """The residue of every window of ``length`` bytes as a polynomial modulo MOD."""

    def scaled(b: int, n: int) -> np.ndarray:  # b**0 .. b**(n - 1)
        out = np.ones(max(n, 1), np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(b, done, MOD)) % np.uint64(MOD)
            done += more
        return out

    n = len(buf) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    terms = (buf.astype(np.uint64) + np.uint64(1)) * scaled(base, len(buf)) % np.uint64(MOD)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    return (sums[length:] - sums[:-length]) % np.uint64(MOD) * scaled(pow(base, -1, MOD), n) % np.uint64(MOD)


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, hash, whether the hash has several places) of each run of starts with one anchor hash.

    Runs end with their document, and after RUN starts. They depend on the text alone, so copies have
    the same runs wherever they stand.
    """
    width, out = length - gram + 1, []
    valid = np.ones(len(buf), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        valid[max(a, b - length + 1) : b] = False
    for a in range(0, max(0, len(buf) - length + 1), SEGMENT):
        part = buf[a : a + SEGMENT + length - 1]
        h = window_hashes(prefix_sums(part, STEP), gram, STEP)
        n = len(part) - length + 1
        key = (h & np.uint64(MASK64 ^ ((1 << POS_BITS) - 1))) | np.arange(len(h), dtype=np.uint64)
        pad = np.full(-len(key) % width, MASK64, np.uint64)
        rows = np.concatenate((key, pad)).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
        good, best = valid[a : a + n], h[place]
        turn = best[1:] != best[:-1]
        change, stop = np.ones(n, bool), np.ones(n, bool)
        change[1:], stop[:-1] = turn | ~good[:-1], turn | ~good[1:]
        first, last = np.flatnonzero(change & good), np.flatnonzero(stop & good)
        if len(first):
            out.append((first + a, last - first + 1, best[first], place[first] + a, place[last] + a, place[first] != place[last]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    first, count, h, low, high, many = (np.concatenate(x) for x in zip(*out))
    new = np.ones(len(first), bool)  # a run that crosses the end of a segment comes in two parts
    new[1:] = (first[1:] != first[:-1] + count[:-1]) | (h[1:] != h[:-1]) | ~valid[first[1:] - 1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(first)) - 1
    first, count, h, many = first[at], np.add.reduceat(count, at), h[at], np.logical_or.reduceat(many, at) | (low[at] != high[end])
    parts = -(-count // RUN)
    if (parts == 1).all():
        return first, count, h, many
    step = spans(np.zeros(len(parts), np.int64), parts).astype(np.int64) * RUN
    return np.repeat(first, parts) + step, np.minimum(RUN, np.repeat(count, parts) - step), np.repeat(h, parts), np.repeat(many, parts)


def _anchor_blobs(buckets: int, length: int, gram: int):
    """Each batch's runs as one row for each bucket of hashes.

    A hash that occurs twice in the batch, or at two places of one run, is known to repeat: its
    runs are passed on as such, and one mark stands for them, so a very common hash adds one entry
    for each batch.
    """

    def run(batches):
        for b in batches:
            rid, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            found: list[list[np.ndarray]] = []
            for i, j, buf, off in chunks(b.column(2)):
                first, _, h, many = anchors(buf, off, length, gram)
                doc = np.searchsorted(off, first, side="right") - 1
                found.append([h, rid[i + doc], th[i + doc], first - off[doc], many])
            if not found:
                continue
            h, r, t, s, many = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h)
            h, r, t, s, many = h[order], r[order], t[order], s[order], many[order]
            cuts = group_starts(h)
            size = np.diff(cuts)
            seen = (size > 1) | (np.logical_or.reduceat(many, cuts[:-1]) if len(h) else np.empty(0, bool))
            twice = np.repeat(seen, size)
            once = ~twice
            marks = h[cuts[:-1][seen]]
            key = np.concatenate((h[once], marks))
            to = (key % np.uint64(buckets)).astype(np.int64)
            cols = [key, np.concatenate((r[once], np.zeros(len(marks), np.int64))), np.concatenate((t[once], np.zeros(len(marks), np.int64))), np.concatenate((s[once], np.full(len(marks), -1)))]
            home = (mix(t[twice].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            full, blobs = _split(to, buckets, cols)
            kfull, kblobs = _split(home, buckets, [r[twice], t[twice], s[twice]])
            both = np.union1d(full, kfull)
            here, there = dict(zip(full.tolist(), range(len(full)))), dict(zip(kfull.tolist(), range(len(kfull))))
            pick_of = lambda at, col: [col[at[k]] if k in at else b"" for k in both.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both.astype(np.int32))] + [pa.array(pick_of(here, c), pa.binary()) for c in blobs] + [pa.array(pick_of(there, c), pa.binary()) for c in kblobs],
                names=["bucket", "h", "r", "t", "s", "kr", "kt", "ks"],
            )

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _repeated_anchors(table: pa.Table):
    h, r, t, s = (_joined(table, k, np.uint64 if k == "h" else np.int64) for k in ("h", "r", "t", "s"))
    order = np.argsort(h)
    size = np.diff(group_starts(h[order]))
    keep = order[np.repeat(size > 1, size)] if len(h) else order
    keep = keep[s[keep] >= 0]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((x[keep], _joined(table, k, np.int64)))) for x, k in ((r, "kr"), (t, "kt"), (s, "ks"))], names=["rid", "th", "s"])


# ---------------------------------------------------------------- regions


def _flagged_runs(b, length: int, gram: int):
    """The listed runs of a batch's documents, with their regions and the regions' 128-bit fingerprints."""
    lists = b.column("starts")
    for i, j, buf, off in chunks(b.column("text")):
        first, count, h, _ = anchors(buf, off, length, gram)
        doc = np.searchsorted(off, first, side="right") - 1
        part = lists.slice(i, j - i)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()) if not part.null_count else [len(x or ()) for x in part.to_pylist()])
        pos = np.isin(first, off[owner] + flat)
        first, count, h, doc = first[pos], count[pos], h[pos], doc[pos]
        text = buf.tobytes()
        raw = [text[s:e] for s, e in zip(first.tolist(), (first + count - 1 + length).tolist())]
        fp = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), np.int64).reshape(-1, 2)
        yield i, off, doc, first, h.view(np.int64), fp[:, 0], fp[:, 1], raw


def _regions(length: int, gram: int):
    def run(batches):
        for b in batches:
            for _, _, _, _, h, fp1, fp2, raw in _flagged_runs(b, length, gram):
                if not len(h):
                    continue
                order = np.lexsort((fp2, fp1, h))
                cuts = group_starts(h[order], fp1[order], fp2[order])
                at, times = order[cuts[:-1]], np.diff(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(fp1[at]), pa.array(fp2[at]), pa.array(times), pa.array([raw[k] for k in at.tolist()], pa.binary())], names=["h", "fp1", "fp2", "times", "region"])

    return run


def _places(length: int, gram: int):
    def run(batches):
        for b in batches:
            rid, th = b.column("rid").to_numpy(), b.column("th").to_numpy()
            for i, off, doc, first, h, fp1, fp2, _ in _flagged_runs(b, length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(rid[i + doc]), pa.array(th[i + doc]), pa.array(first - off[doc]), pa.array(h), pa.array(fp1), pa.array(fp2)], names=["rid", "th", "s", "h", "fp1", "fp2"])

    return run


# ---------------------------------------------------------------- suffix array


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``starts`` begin a string of ``length`` bytes that begins at another one too.

    Bucket numbers after the first step name the 8-gram at each place. A refinement step at
    depth d sorts the places of buckets with several members by (own bucket, bucket at + d), so
    a bucket then names 2 d bytes; places alone in their bucket are settled. Two strings are
    equal if their buckets at 0 and at length - d agree.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    bucket = np.full(n + length + 8, n, np.int64)  # places past the end share a bucket of their own
    cuts = group_starts(key[order])
    size = np.diff(cuts)
    bucket[order] = np.repeat(cuts[:-1], size)
    live = order[np.repeat(size > 1, size)]
    depth = 8
    while 2 * depth <= length and len(live):
        pair = bucket[live] * (n + 1) + bucket[live + depth]
        by = np.argsort(pair)
        live, pair = live[by], pair[by]
        cuts = group_starts(pair)
        size = np.diff(cuts)
        # a new bucket is numbered by its place within the old one, whose numbers it shares with no other
        old = bucket[live[cuts[:-1]]]
        lead = group_starts(old)
        base = np.repeat(cuts[lead[:-1]], np.diff(lead))
        bucket[live] = np.repeat(old + cuts[:-1] - base, size)
        live = live[np.repeat(size > 1, size)]
        depth *= 2
    pair = bucket[starts] * (n + 1) + bucket[starts + length - depth]
    by = np.argsort(pair)
    size = np.diff(group_starts(pair[by]))
    out = np.zeros(len(starts), bool)
    out[by] = np.repeat(size > 1, size)
    return out


def _suffix_batch(length: int):
    def run(table: pa.Table):
        cols = [table.column(k).combine_chunks().to_numpy() for k in ("h", "fp1", "fp2", "times")]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        h, fp1, fp2, times = (c[order] for c in cols)
        cuts = group_starts(h, fp1, fp2)
        total = np.add.reduceat(times, cuts[:-1]) if len(h) else times
        at = cuts[:-1]
        region = table.column("region").combine_chunks().take(pa.array(order[at]))
        data = text_array(region)
        off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        buf = np.frombuffer(data.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        count = np.diff(off) - length + 1
        starts = spans(off[:-1], count).astype(np.int64)
        owner = np.repeat(np.arange(len(at)), count)
        found = repeated(buf, starts, length) | (total > 1)[owner]
        edge = np.concatenate(([0], np.cumsum(count)))
        some = np.add.reduceat(found, edge[:-1]) > 0
        flags = [np.packbits(found[a:z]).tobytes() for a, z, k in zip(edge[:-1], edge[1:], some) if k]
        yield pa.RecordBatch.from_arrays([pa.array(x[at][some]) for x in (h, fp1, fp2)] + [pa.array(flags, pa.binary())], names=["h", "fp1", "fp2", "flags"])

    return run


# ---------------------------------------------------------------- very common anchors


def _split(to: np.ndarray, buckets: int, cols: list[np.ndarray]):
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edge))
    return full, [[c[order[edge[k] : edge[k + 1]]].tobytes() for k in full] for c in cols]


def _string_blobs(length: int, buckets: int):
    """Fingerprints of all strings of hot regions, as one row for each bucket and batch."""

    def run(batches):
        for b in batches:
            ids = [b.column(k).to_numpy() for k in ("h", "fp1", "fp2", "times")]
            for i, j, buf, off in chunks(b.column("region"), SEGMENT):
                count = np.diff(off) - length + 1
                starts = spans(off[:-1], count).astype(np.int64)
                owner = np.repeat(np.arange(i, j), count)
                a, b_, c, d = (residues(buf, length, base)[starts] for base in BASES)
                f1, f2 = (a << np.uint64(32)) | b_, (c << np.uint64(32)) | d
                full, blobs = _split((mix(f1) % np.uint64(buckets)).astype(np.int64), buckets, [f1, f2, *[x[owner] for x in ids], starts - off[owner - i], count[owner - i]])
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], names=["bucket", "f1", "f2", "h", "fp1", "fp2", "times", "at", "n"])

    return run


def _repeated_strings(buckets: int):
    return lambda table: _repeated_of(table, buckets)


def _repeated_of(table: pa.Table, buckets: int):
    f1, f2 = (_joined(table, k, np.uint64) for k in ("f1", "f2"))
    rest = [_joined(table, k, np.int64) for k in ("h", "fp1", "fp2", "at", "n", "times")]
    order = np.lexsort((f2, f1))
    size = np.diff(group_starts(f1[order], f2[order]))
    keep = np.zeros(len(f1), bool)
    keep[order] = np.repeat(size > 1, size)
    keep |= rest[5] > 1
    rest = [x[keep] for x in rest[:5]]
    full, blobs = _split((mix(rest[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets, rest)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], names=["home", "h", "fp1", "fp2", "at", "n"])


def _flags_of(table: pa.Table):
    h, fp1, fp2, at, n = (_joined(table, k, np.int64) for k in ("h", "fp1", "fp2", "at", "n"))
    order = np.lexsort((fp2, fp1, h))
    h, fp1, fp2, at, n = (x[order] for x in (h, fp1, fp2, at, n))
    cuts = group_starts(h, fp1, fp2)
    flags = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        bits = np.zeros(n[a], bool)
        bits[at[a:z]] = True
        flags.append(np.packbits(bits).tobytes())
    first = cuts[:-1]
    yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (h, fp1, fp2)] + [pa.array(flags, pa.binary())], names=["h", "fp1", "fp2", "flags"])


# ---------------------------------------------------------------- documents


def _cleaned(keep: list[str], length: int, whole_chars: bool, digest: bool):
    def run(batches):
        for b in batches:
            n_removed, n_spans, kept, removed = [], [], [], []
            flags, at = b.column("flags").to_pylist(), b.column("at").to_pylist()
            texts = text_array(b.column("text"))
            for text, marks, places in zip(texts.to_pylist(), flags, at):
                n = len(text)
                edge = np.zeros(n + 1, np.int32)
                for bits, s in zip(marks or (), places or ()):
                    hit = s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = np.frombuffer(text, np.uint8)
                if whole_chars and gone.any():
                    gone = _whole(raw, gone)
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                removed.append([{"start": int(a), "end": int(z)} for a, z in zip(turn[::2], turn[1::2])])
                n_removed.append(int(gone.sum()))
                n_spans.append(len(turn) // 2)
                rest = raw[~gone].tobytes()
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "ignore" if whole_chars else "replace"))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in keep], b.column("n_bytes"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=[*keep, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return run


def _whole(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Bytes of all characters that lose a byte."""
    char = np.cumsum((raw & 0xC0) != 0x80)
    hit = np.zeros(int(char[-1]) + 1, bool)
    hit[char[gone]] = True
    return hit[char]


def remove_repeats(docs: DataFrame, keep: list[str], text_col: str = "text", length: int = LENGTH, gram: int = GRAM, whole_chars: bool = False, digest: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns the columns ``keep``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (start and end
    of the removed runs) and ``kept``: the remaining text, or with ``digest`` the SHA-256 of the
    remaining bytes. ``whole_chars`` also removes the rest of a character that loses a byte.

    All occurrences go, the first included, judged on the input. A null text is empty; a text
    under ``length`` bytes loses nothing; repeated rows are occurrences like others, so they lose
    all strings; a null id is no hindrance; an empty table gives no rows. A very long text is read
    in segments of SEGMENT bytes, and one of a short period makes a run for RUN bytes. Columns that
    are not in ``keep`` are left out, so that none can clash.
    """
    spark = docs.sparkSession
    tables, buckets = Tables(spark), bucket_count(docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keep_cols = [F.col(f"`{c}`") for c in keep]
    slim = pick(docs, *dict.fromkeys([*keep, text_col])).select(*keep_cols, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    slim = slim.withColumns({"_rid": F.xxhash64(*keep_cols), "_th": F.xxhash64("_text")})
    blobs = slim.select(F.col("_rid").alias("rid"), F.col("_th").alias("th"), F.col("_text").alias("text")).mapInArrow(_anchor_blobs(buckets, length, gram), "bucket int, h binary, r binary, t binary, s binary, kr binary, kt binary, ks binary")
    places = grouped(blobs, ["bucket"], _repeated_anchors, "rid bigint, th bigint, s bigint")
    starts = places.groupBy("rid", "th").agg(F.collect_set("s").alias("starts"))
    known = slim.join(starts.withColumnsRenamed({"rid": "_srid", "th": "_sth"}).hint("shuffle_hash"), (F.col("_rid") == F.col("_srid")) & (F.col("_th") == F.col("_sth")), "left")
    plain = F.sha2("_text", 256) if digest else F.col("_text")
    known = tables.write(known.select(*keep_cols, F.col("_rid").alias("rid"), F.col("_th").alias("th"), F.octet_length("_text").cast("long").alias("n_bytes"), F.when(F.col("starts").isNotNull(), F.col("_text")).alias("text"), "starts", F.when(F.col("starts").isNull(), plain).alias("kept")), "known")
    hit = known.where("starts IS NOT NULL")
    regions = tables.write(hit.select("text", "starts").mapInArrow(_regions(length, gram), "h bigint, fp1 bigint, fp2 bigint, times bigint, region binary"), "regions")
    hot = tables.write(regions.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select(F.col("h").alias("hot")), "hot")
    parted = regions.join(hot, F.col("h") == F.col("hot"), "left")
    flags = grouped(parted.where("hot IS NULL").drop("hot"), ["h"], _suffix_batch(length), "h bigint, fp1 bigint, fp2 bigint, flags binary")
    if not hot.isEmpty():
        common = parted.where("hot IS NOT NULL").drop("hot").mapInArrow(_string_blobs(length, buckets), "bucket int, f1 binary, f2 binary, h binary, fp1 binary, fp2 binary, times binary, at binary, n binary")
        homes = grouped(common, ["bucket"], _repeated_strings(buckets), "home int, h binary, fp1 binary, fp2 binary, at binary, n binary")
        flags = flags.unionByName(grouped(homes, ["home"], _flags_of, "h bigint, fp1 bigint, fp2 bigint, flags binary"))
    flags = tables.write(flags, "flags")
    tables.drop("regions", "hot")
    at = hit.select("rid", "th", "text", "starts").mapInArrow(_places(length, gram), "rid bigint, th bigint, s bigint, h bigint, fp1 bigint, fp2 bigint").distinct()
    marks = at.join(flags, ["h", "fp1", "fp2"]).groupBy("rid", "th").agg(F.collect_list(F.struct("s", "flags")).alias("m"))
    marked = hit.join(marks.hint("shuffle_hash"), ["rid", "th"], "left").select(*keep_cols, "n_bytes", "text", F.col("m.flags").alias("flags"), F.col("m.s").alias("at"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    tail = "n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
    cleaned = marked.mapInArrow(_cleaned(keep, length, whole_chars, digest), f"{kinds}{', ' if keep else ''}{tail}")
    untouched = known.where("starts IS NULL").select(*keep_cols, "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans"), "kept")
    return cleaned.unionByName(untouched)


def op9_suffixes(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spread(table(spark, sf_dir, "documents")), ["doc_id"], digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
