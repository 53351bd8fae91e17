"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

A document is the set of its distinct word shingles. The sketch has a fixed number of bins; in
round r every element goes to the bin its hash of that round names, and a bin keeps the smallest
value of the earliest round that reached it. After as many rounds as bins, round i sends all
elements to bin i, so every bin fills. Rounds stop once all bins are full, so large sets need one
or two. Runs of bins form bands; documents that share a band are candidates.

Equal sets are collapsed first. Candidates are joined into clusters. A cluster of at most one block
is compared whole on the full sets, in one task that returns links and never pairs. In a larger one
every document first meets the one it shares most bands with; what these links join is one part,
and only documents outside the cluster's largest part are compared with all others, as pairs of
blocks. So a large group of near copies costs about one comparison a member, and still no link
between two parts is missed. Final components use all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import LOWER, Tables, chunks, group_starts, grouped, mix, pick, span_hashes, word_bounds
from .graph import components, local_labels

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members and set bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 21


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, and their offsets."""
    starts, ends, words = word_bounds(buf, off)
    h = span_hashes(buf, starts, ends, LOWER)
    first = np.concatenate(([0], np.cumsum(words)))
    per = np.where(words >= width, words - width + 1, (words > 0).astype(words.dtype))
    n = int(per.sum())
    begin = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(n) - begin[:-1][doc] + first[:-1][doc]
    used = np.minimum(words, width)[doc]
    s = used.astype(np.uint64)
    for k in range(width):
        part = mix(h[np.minimum(at + k, max(0, len(h) - 1))], k + 1) if n else np.empty(0, np.uint64)
        s = s + np.where(k < used, part, np.uint64(0))
    s = mix(s, 77)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a > 1:
            s[a:b].sort()
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(per)))))


def sketch(sets: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of each set, one row of ``bins`` values; the rows of empty sets stay FULL."""
    docs = len(at) - 1
    out = np.full((docs, bins), FULL)
    sizes = np.diff(at)
    live = sizes > 0
    elems, doc = sets, np.repeat(np.arange(docs), sizes)
    flat = out.reshape(-1)
    for r in range(2 * bins):
        if not len(elems):
            break
        h = mix(elems, 1000 + r)
        low = (np.uint64(r) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if r < bins else np.full(len(h), r - bins, np.uint64)
        np.minimum.at(flat, doc * bins + place.astype(np.int64), low)
        open_ = live & (out == FULL).any(axis=1)
        if open_.sum() < live.sum():
            live = open_
            stay = live[doc]
            elems, doc = elems[stay], doc[stay]
    return out


def bands(sk: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` bins."""
    n, bins = sk.shape
    cut = sk.reshape(n, bins // rows, rows)
    total = np.zeros(cut.shape[:2], np.uint64)
    for k in range(rows):
        total += mix(cut[:, :, k], 5000 + k)
    return mix(total + mix(np.arange(bins // rows, dtype=np.uint64), 9)[None, :], 11)


def _sketched(width: int, n_bands: int, rows: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                sets, at = shingle_sets(buf, off, width)
                sizes = np.diff(at)
                keys = bands(sketch(sets, at, n_bands * rows), rows)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(sets, k)))) for k in (1, 2)]
                fp = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * n_bands, n_bands), pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(fp[0]), pa.array(fp[1]), lists], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in chunks(b.column(2)):
                sets, at = shingle_sets(buf, off, width)
                raw = [sets[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(raw, pa.binary())], names=["cluster", "node", "elems"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with 100 * intersection >= percent * union, by products of incidence blocks."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        good = 100 * inter >= percent * (int(sizes.sum()) - inter)
        return (np.array([0]), np.array([1])) if good else (np.empty(0, int), np.empty(0, int))
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = seen > 1
    col = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], col[code[keep]]
    total, step = np.zeros((m, m), np.float32), max(64, (1 << 20) // m)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = int(shared.sum())
    cuts = np.searchsorted(code, np.arange(0, width + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            block = np.zeros((m, min(step, width - k * step)), np.float32)
            block[row[a:b], code[a:b] - k * step] = 1
            total += block @ block.T
    inter = np.rint(total).astype(np.int64)
    good = np.triu(100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter), 1)
    return np.nonzero(good)


def _links(percent: int):
    def run(table: pa.Table):
        cols = [table.column(k).combine_chunks() for k in ("cluster", "bi", "bj", "node", "elems")]
        cluster, bi, bj, node = (c.to_numpy(zero_copy_only=False) for c in cols[:4])
        cuts = group_starts(cluster, bi, bj)
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cols[4].slice(lo, hi - lo)]
            i, j = linked(sets, percent)
            if len(i):
                names = node[lo:hi]
                order = np.argsort(names, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                root = local_labels(back[i], back[j], len(order))
                far = root != np.arange(len(order))
                a.append(names[order][far])
                b.append(names[order][root[far]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _near(percent: int):
    """The members of each group that are linked with its head, as edges (member, head)."""

    def run(table: pa.Table):
        cols = [table.column(k).combine_chunks() for k in ("head", "part", "node", "elems")]
        head, part, node = (c.to_numpy(zero_copy_only=False) for c in cols[:3])
        cuts = group_starts(head, part)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = np.flatnonzero(node[lo:hi] == head[lo]) + lo
            rest = np.flatnonzero(node[lo:hi] != head[lo]) + lo
            if not len(at) or not len(rest):
                continue
            own = np.frombuffer(cols[3][int(at[0])].as_buffer(), np.uint64)
            sets = [np.frombuffer(cols[3][k].as_buffer(), np.uint64) for k in rest.tolist()]
            size = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            good = rest[100 * inter >= percent * (size + len(own) - inter)]
            if len(good):
                yield pa.RecordBatch.from_arrays([pa.array(node[good]), pa.array(head[good])], names=["a", "b"])

    return run


def _block(seed: int, n: str):
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")


def _blocks_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    """How many blocks the rows of each key make."""
    return rows.groupBy(key).agg(F.greatest(F.ceil(F.sum(F.octet_length("elems")) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias(name))


def _large_links(big: DataFrame, stars: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """Links (a, b) that join what all pairs within each cluster of ``big`` (cluster, node, elems, nb) would join."""
    shared = stars.join(big.select(F.col("node").alias("a")), "a", "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    heads = shared.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("head"))
    members = tables.write(big.join(heads.withColumnRenamed("a", "node"), "node").select("head", "node", "elems"), "members")
    load = tables.write(_blocks_of(members, "head", "parts"), "load")
    dealt = members.join(load, "head").select("head", _block(1, "parts").alias("part"), "node", "elems")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = load.join(big.select(F.col("node").alias("head"), "node", "elems"), "head").select("head", every("parts").alias("part"), "node", "elems")
    near = tables.write(grouped(dealt.unionByName(own), ["head", "part"], _near(percent), "a bigint, b bigint"), "near")
    labels = components(near, tables, "parts")
    marked = tables.write(big.join(labels, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("part"), "nb", "elems"), "marked")
    sizes = marked.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"))
    rest = tables.write(marked.join(main, "cluster").where("part != main").select("cluster", "node", "nb", "elems"), "rest")
    few = tables.write(_blocks_of(rest, "cluster", "nr"), "few")
    left = rest.join(few, "cluster").select("cluster", _block(2, "nr").alias("bi"), every("nb").alias("bj"), "node", "elems")
    right = marked.join(few, "cluster").select("cluster", every("nr").alias("bi"), _block(3, "nb").alias("bj"), "node", "elems")
    far = grouped(left.unionByName(right), ["cluster", "bi", "bj"], _links(percent), "a bigint, b bigint")
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, n_bands: int = 40, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles; ``component_id`` is the smallest id reachable and ``kept`` tells whether it is the
    document's own. A pair at the threshold s is missed with (1 - s**rows)**n_bands, about 1e-7.

    A null or empty text has an empty set, is linked with nothing and kept. A row with a null id
    is linked with nothing, has a null component and is kept. Rows that share an id are one
    document. An empty table gives no rows. Ids are whole numbers. A very long text is a chunk of
    its own and its set is compared whole; other columns are not read, so none can clash.
    """
    tables = Tables(docs.sparkSession)
    slim = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows_of = tables.write(slim.mapInArrow(_sketched(width, n_bands, rows), "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>"), "sketch")
    same = ["n_shingles", "fp1", "fp2"]
    live = rows_of.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = tables.write(live.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    # one row for each class: the row whose id is the class's smallest
    keys = tables.write(live.join(classes, same).where("doc_id = node").select("node", F.explode("bands").alias("band")), "bands")
    met = tables.write(keys.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low"), "met")
    stars = keys.join(met, "band").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    clusters = tables.write(components(stars, tables, "candidates"), "clusters")
    text = slim.join(clusters.hint("shuffle_hash"), slim["doc_id"] == clusters["node"]).select(F.col("component").alias("cluster"), "node", "text")
    sets = tables.write(text.mapInArrow(_sets(width), "cluster bigint, node bigint, elems binary"), "sets")
    blocks = tables.write(_blocks_of(sets, "cluster", "nb"), "blocks")
    sized = sets.join(blocks, "cluster")
    whole = sized.where("nb = 1").select("cluster", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "node", "elems")
    links = grouped(whole, ["cluster", "bi", "bj"], _links(percent), "a bigint, b bigint")
    if not blocks.where("nb > 1").isEmpty():
        links = links.unionByName(_large_links(tables.write(sized.where("nb > 1"), "big"), stars, tables, percent))
    final = tables.write(components(links, tables, "linked"), "components")
    tables.keep("sketch", "classes", "components")
    named = rows_of.select("doc_id", *same).join(classes, same, "left").join(final.withColumnRenamed("node", "fnode"), F.col("node") == F.col("fnode"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), width=3, percent=85, n_bands=32, rows=6)
