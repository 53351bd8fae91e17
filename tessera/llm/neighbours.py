"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Equal vectors are one entry with its smallest ids. Entries are dealt to shards by their routing
string, the signs of some random projections: a prefix is lengthened until it holds a shard's
entries, so every entry lies in exactly one shard. A query goes to the shards whose prefixes cost
least to reach: the sum of its squared projections where its own bits differ.

In a shard every tree holds the entries' 64-bit hash strings in a sorted array. A query descends
in each tree to the longest prefix it shares with any entry; then all trees ascend together, one
bit at a time, until the ranges of entries that share the prefix hold enough candidates. These get
their exact inner product.

How many shards a query visits and how many candidates are enough is measured: ``PROBES`` of the
queries, taken by hash, are answered exactly against all entries, and the smallest numbers that
give ``TARGET`` of their neighbours are used. Vectors with structure need a small share of all
entries, vectors without any nearly all; the column ``scored`` tells how many were.

Inner products are made comparable with angles by one more coordinate that gives all entries the
same norm; queries have 0 there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.views import spread, table
from .common import Tables, pick, streamed

TREES, BITS, SEED = 32, 64, 77
#: Bits of a routing string, entries of a shard, and queries that are searched at once.
ROUTE_BITS, SHARD_ROWS, QUERY_ROWS = 16, 8192, 512
#: Queries that are answered exactly to choose the numbers below, shards in which they are tried, and the share of neighbours wanted of each choice.
PROBES, TRIED, TARGET = 64, 24, 0.97
#: Candidates (with repeats over trees) that all trees of a shard gather, as a multiple of its entries.
LADDER = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0, 1.5, 3.0)
#: Ranges of this many entries (with repeats), as a multiple of the shard's, cost more than the whole shard.
WHOLE = 1.0


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings their norm to ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top**2 - (x * x).sum(axis=1), 0))[:, None]])


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit length of each number."""
    out = np.zeros(len(x), np.int64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(step)
        out += np.where(big, step, 0)
        x = np.where(big, x >> np.uint64(step), x)
    return out + (x > 0)


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        full = lifted(x, float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 0.0)
        rng = np.random.default_rng(SEED)
        self.size, self.planes = len(x), [rng.standard_normal((full.shape[1], BITS)) for _ in range(trees)]
        self.order, self.keys = [], []
        for p in self.planes:
            h = self._strings(full, p)
            order = np.argsort(h, kind="stable")
            self.order.append(order)
            self.keys.append(h[order])

    @staticmethod
    def _strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = np.packbits(x @ planes > 0, axis=1)
        return bits.view(">u8").reshape(-1).astype(np.uint64)

    def ranges(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) for each tree and query: the entries that share the query's prefix at its level."""
        full = np.hstack([q, np.zeros((len(q), 1))])
        h = [self._strings(full, p) for p in self.planes]
        low, high = np.zeros((len(h), len(q)), np.int64), np.full((len(h), len(q)), self.size, np.int64)
        open_, longest = np.ones(len(q), bool), np.zeros(len(q), np.int64)
        for keys, strings in zip(self.keys, h):  # down to the longest prefix
            at = np.searchsorted(keys, strings)
            for beside in (keys[np.maximum(at - 1, 0)], keys[np.minimum(at, self.size - 1)]):
                longest = np.maximum(longest, BITS - _bits(beside ^ strings))
        for level in range(int(longest.max(initial=0)), 0, -1):  # and up again, all trees a bit shorter at a time
            mask = np.uint64((1 << BITS) - (1 << (BITS - level)))
            some = np.flatnonzero(open_ & (longest >= level))
            if not len(some):
                continue
            a = np.stack([np.searchsorted(k, s[some] & mask, "left") for k, s in zip(self.keys, h)])
            b = np.stack([np.searchsorted(k, s[some] | ~mask, "right") for k, s in zip(self.keys, h)])
            done = (b - a).sum(axis=0) >= want
            low[:, some[done]], high[:, some[done]] = a[:, done], b[:, done]
            open_[some[done]] = False
        return low, high

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which entries lie in one query's ranges."""
        out = np.zeros(self.size, bool)
        for order, a, b in zip(self.order, low.tolist(), high.tolist()):
            out[order[a:b]] = True
        return out

    def wanted(self, gather: float) -> int:
        return int(min(gather, len(self.planes)) * self.size)


class Router:
    """The prefix tree over routing strings, and the shards at its leaves."""

    def __init__(self, dims: int, counts: dict[int, int], shard_rows: int):
        """``counts``: entries for each routing string."""
        self.planes = np.random.default_rng(SEED + 1).standard_normal((dims + 1, ROUTE_BITS))
        keys = np.array(sorted(counts), np.int64)
        total = np.concatenate(([0], np.cumsum([counts[k] for k in keys.tolist()]))).astype(np.int64)
        start, depth, parts, todo = [], [], [], [(0, 0)]
        while todo:
            at, d = todo.pop()
            a, b = np.searchsorted(keys, [at, at + (1 << (ROUTE_BITS - d))])
            n = int(total[b] - total[a])
            if n > shard_rows and d < ROUTE_BITS:
                half = 1 << (ROUTE_BITS - d - 1)
                todo += [(at + half, d + 1), (at, d + 1)]
            else:
                start.append(at)
                depth.append(d)
                parts.append(max(1, -(-n // shard_rows)))
        self.start, self.parts = np.array(start), np.array(parts)
        self.first = np.concatenate(([0], np.cumsum(self.parts)))
        self.shards = int(self.first[-1])
        bit = (self.start[:, None] >> np.arange(ROUTE_BITS - 1, -1, -1)) & 1
        used = np.arange(ROUTE_BITS) < np.array(depth)[:, None]
        self.off, self.on = (used & (bit == 0)).astype(float), (used & (bit == 1)).astype(float)

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, codes, side="right") - 1

    def shard(self, codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard of entries; a prefix that cannot be lengthened is split by the entries' keys."""
        leaf = self.leaf(codes)
        return self.first[leaf] + (salt % self.parts[leaf].astype(np.uint64)).astype(np.int64)

    def route(self, q: np.ndarray) -> np.ndarray:
        """The leaves of each query, cheapest first."""
        p = np.hstack([q, np.zeros((len(q), 1))]) @ self.planes
        cost = (p * p * (p > 0)) @ self.off.T + (p * p * (p <= 0)) @ self.on.T
        return np.argsort(np.round(cost, 9), axis=1, kind="stable")


def route_codes(x: np.ndarray, top: float) -> np.ndarray:
    planes = np.random.default_rng(SEED + 1).standard_normal((x.shape[1] + 1, ROUTE_BITS))
    return ((lifted(x, top) @ planes > 0) @ (1 << np.arange(ROUTE_BITS - 1, -1, -1))).astype(np.int64)


def _matrix(col) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) + 0.0  # no negative zero


def _keys(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]


def _salt(keys) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def _entries(k: int):
    """The different vectors of each batch, with their k + 1 smallest ids."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            keys = _keys(x)
            order = sorted(range(len(ids)), key=lambda r: (keys[r], ids[r]))
            rows, held = [], []
            for r in order:
                if not rows or keys[r] != keys[rows[-1]]:
                    rows.append(r)
                    held.append([int(ids[r])])
                elif len(held[-1]) <= k and held[-1][-1] != ids[r]:
                    held[-1].append(int(ids[r]))
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in rows], pa.binary()), b.column(1).take(pa.array(rows)), pa.array(held, pa.list_(pa.int64()))], names=["key", "v", "ids"])

    return run


def _coded(top: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route_codes(_matrix(b.column("v")), top))], names=["key", "v", "ids", "code"])

    return run


def _named(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_keys(_matrix(b.column(1))), pa.binary())], names=["query_id", "key"])


# ---------------------------------------------------------------- measuring


def _truth(probes: np.ndarray, own: list[bytes], k: int):
    """The ``k`` best entries of each probe within a task, its own left out."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in own]
        for b in batches:
            if not b.num_rows:
                continue
            keys, codes = b.column("key").to_pylist(), b.column("code").to_numpy()
            score = _matrix(b.column("v")) @ probes.T
            for j in range(len(own)):
                some = np.argpartition(-score[:, j], k)[: k + 1] if len(keys) > k + 1 else np.arange(len(keys))
                best[j] += [(-float(score[r, j]), keys[r], int(codes[r])) for r in some.tolist() if keys[r] != own[j]]
                best[j] = sorted(best[j])[:k]
        rows = [(j, *x) for j, xs in enumerate(best) for x in xs]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.binary(), pa.int64()))], names=["probe", "far", "key", "code"])

    return run


def _tried(probes: np.ndarray, truth: dict[int, dict[int, set[bytes]]], trees: int):
    """(gather, found, all) of the known neighbours in the tried shards, for each step of the ladder."""

    def run(batches):
        for shard, b in _by_shard(batches):
            keys, forest, ask = b.column("key").to_pylist(), Forest(_matrix(b.column("v").combine_chunks()), trees), truth[shard]
            who = sorted(ask)
            place = {key: r for r, key in enumerate(keys)}
            q, got = probes[who], []
            for gather in LADDER:
                low, high = forest.ranges(q, forest.wanted(gather))
                hit = 0
                for n, j in enumerate(who):
                    near = forest.near(low[:, n], high[:, n])
                    hit += sum(bool(near[place[key]]) for key in ask[j])
                got.append((gather, hit, sum(len(ask[j]) for j in who)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.float64(), pa.int64(), pa.int64()))], names=["gather", "found", "total"])

    return run


def _by_shard(batches):
    """(shard, table) of each shard's rows in a sorted stream."""
    now, held = None, []
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if shard[a] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(shard[a])
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


# ---------------------------------------------------------------- searching


def search(forest: Forest, x: np.ndarray, ids: list[list[int]], q: np.ndarray, k: int, gather: float):
    """For each query the (-score, id) of its best k + 1 candidates with different ids, and how many entries were scored."""
    low, high = forest.ranges(q, forest.wanted(gather))
    whole = (high - low).sum(axis=0) >= WHOLE * forest.size
    every = dict(zip(np.flatnonzero(whole).tolist(), q[whole] @ x.T)) if whole.any() else {}
    for j in range(len(q)):
        cand, fast = (None, every[j]) if whole[j] else (np.flatnonzero(forest.near(low[:, j], high[:, j])), None)
        if fast is None:
            fast = x[cand] @ q[j]
        scored = len(fast)
        if scored > k + 1:
            edge = np.partition(fast, scored - k - 1)[scored - k - 1]
            best = np.flatnonzero(fast >= edge - 1e-9 * (1 + abs(edge)))
            cand = best if cand is None else cand[best]
        elif cand is None:
            cand = np.arange(scored)
        score = (x[cand] * q[j]).sum(axis=1)  # the same for an entry in any shard
        out, seen = [], set()
        for s, i in sorted((-s, i) for s, c in zip(score.tolist(), cand.tolist()) for i in ids[c]):
            if i not in seen and len(out) <= k:
                seen.add(i)
                out.append((s, i))
        yield out, scored


def _searched(k: int, gather: float, trees: int):
    def run(batches):
        now, rows, forest, x, ids = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            shard, ask = b.column("shard").to_numpy(), b.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1]), [True])))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shard[a] != now:
                    now, rows, forest = shard[a], [], None
                part = b.slice(a, z - a)
                if not ask[a]:  # the entries of a shard come before its queries
                    rows.append((_matrix(part.column("v")), part.column("ids").to_pylist()))
                    continue
                if not rows:
                    continue
                if forest is None:
                    x, ids = np.concatenate([r[0] for r in rows]), [i for r in rows for i in r[1]]
                    forest = Forest(x, trees)
                keys = part.column("key")
                for lo in range(0, z - a, QUERY_ROWS):
                    some = part.slice(lo, QUERY_ROWS)
                    found = list(search(forest, x, ids, _matrix(some.column("v")), k, gather))
                    flat = [r for f, _ in found for r in f]
                    rank = pa.StructArray.from_arrays([pa.array([r[0] for r in flat], pa.float64()), pa.array([r[1] for r in flat], pa.int64())], ["far", "vec_id"])
                    best = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(f) for f, _ in found]))), pa.int32()), rank)
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, QUERY_ROWS), best, pa.array([n for _, n in found], pa.int64())], names=["key", "best", "scored"])

    return run


def _shards_of(router: Router):
    def run(batches):
        for b in batches:
            if b.num_rows:
                shard = router.shard(b.column("code").to_numpy(), _salt(b.column("key").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(shard), *[b.column(c) for c in ("key", "v", "ids")]], names=["shard", "key", "v", "ids"])

    return run


def _visits_of(router: Router, visits: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(lo, QUERY_ROWS)
                leaves = router.route(_matrix(part.column("v")))[:, :visits]
                shards = [[s for leaf in row for s in range(router.first[leaf], router.first[leaf + 1])] for row in leaves.tolist()]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(s) for s in shards]))
                yield pa.RecordBatch.from_arrays([pa.array([s for row in shards for s in row], pa.int64()), part.column("key").take(at), part.column("v").take(at)], names=["shard", "key", "v"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): each query's ``k`` nearest rows found, nearest first.

    ``is_query`` is a condition over the id column. Nearness is the largest inner product in double
    precision; ties go to the smaller id; the query's own id is no candidate. Every row is
    indexed. ``scored`` is the number of different vectors whose product with the query was taken.
    Vectors that are null, zero, of another length than most have, or hold null or
    non-finite components take no part, nor do rows with a null id. Repeated ids are candidates
    once, and repeated rows are one. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    tables, out = Tables(spark), "query_id bigint, rank int, vec_id bigint, score double, scored bigint"
    kind = vectors.schema[vec_col].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    clean = pick(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = clean.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m"), F.max(square).alias("top")).orderBy(F.desc("m"), "n").limit(1).first()
    if not sizes:
        return spark.createDataFrame([], out)
    clean, top = clean.where(F.size("v") == sizes["n"]), float(np.sqrt(sizes["top"]))
    few = clean.mapInArrow(_entries(k), f"key binary, v {kind}, ids array<bigint>")
    merged = few.groupBy("key").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = tables.write(merged.mapInArrow(_coded(top), f"key binary, v {kind}, ids array<bigint>, code bigint"), "entries")
    asked = tables.write(clean.where(is_query(F.col("id"))).mapInArrow(_named, "query_id bigint, key binary").distinct(), "asked")
    queries = entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    # at most 2**ROUTE_BITS rows
    counts = {r["code"]: r["n"] for r in entries.groupBy("code").agg(F.count("*").alias("n")).collect()}
    router = Router(sizes["n"], counts, shard_rows)
    visits, gather = _measured(entries, queries, router, kind, k, trees, target)
    placed = entries.mapInArrow(_shards_of(router), f"shard bigint, key binary, v {kind}, ids array<bigint>").withColumn("ask", F.lit(False))
    sent = queries.mapInArrow(_visits_of(router, visits), f"shard bigint, key binary, v {kind}").withColumns({"ids": F.lit(None).cast("array<bigint>"), "ask": F.lit(True)})
    found = streamed(placed.unionByName(sent), ["shard"], ["ask"], _searched(k, gather, trees), "key binary, best array<struct<far: double, vec_id: bigint>>, scored bigint", 2 * router.shards)
    lists = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    # each different query vector is merged once, k + 1 from each visited shard; then its ids take their lists
    merged = found.groupBy("key").agg(lists("best").alias("best"), F.sum("scored").alias("scored")).select("key", F.slice(_once("best"), 1, k + 1).alias("best"), "scored")
    per = merged.join(asked, "key").groupBy("query_id").agg(lists("best").alias("best"), F.sum("scored").alias("scored"))  # one list, unless an id has several vectors
    others = F.filter(_once("best"), lambda x: x["vec_id"] != F.col("query_id"))
    best = per.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "b"), "scored")
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"), "scored")


def _once(best: str):
    """A sorted list with the first entry of each id only; ids repeat where one has several vectors."""
    names = F.transform(best, lambda x: x["vec_id"])
    first = F.filter(best, lambda x, i: F.array_position(names, x["vec_id"]) == i + 1)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.col(best)).otherwise(first)


def _measured(entries: DataFrame, queries: DataFrame, router: Router, kind: str, k: int, trees: int, target: float) -> tuple[int, float]:
    """The smallest number of leaves to visit, and of candidates to gather, that find ``target`` of the probes' neighbours."""
    rows = queries.orderBy("key").limit(PROBES).collect()
    if not rows:
        return 1, LADDER[0]
    probes, own = np.array([r["v"] for r in rows], np.float64), [bytes(r["key"]) for r in rows]
    near = entries.mapInArrow(_truth(probes, own, k), "probe int, far double, key binary, code bigint")
    truth = near.groupBy("probe").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "key", "code"))), 1, k).alias("best")).collect()
    leaves = router.route(probes)
    rank = np.empty_like(leaves)
    np.put_along_axis(rank, leaves, np.arange(leaves.shape[1])[None, :], axis=1)
    at, by = [], {}
    for r in truth:
        codes, keys = np.array([x["code"] for x in r["best"]], np.int64), [bytes(x["key"]) for x in r["best"]]
        at += rank[r["probe"], router.leaf(codes)].tolist()
        for key, shard in zip(keys, router.shard(codes, _salt(keys)).tolist()):
            by.setdefault(shard, {}).setdefault(r["probe"], set()).add(key)
    if not at:  # one vector only
        return 1, LADDER[0]
    visits = int(np.sort(at)[int(np.ceil(target * len(at))) - 1]) + 1
    most = sorted(by, key=lambda s: (-sum(len(x) for x in by[s].values()), s))[:TRIED]
    some = {s: by[s] for s in most}
    placed = entries.mapInArrow(_shards_of(router), f"shard bigint, key binary, v {kind}, ids array<bigint>").where(F.col("shard").isin(most)).select("shard", "key", "v")
    got = streamed(placed, ["shard"], [], _tried(probes, some, trees), "gather double, found bigint, total bigint", 2 * len(most)).groupBy("gather").agg(F.sum("found").alias("found"), F.sum("total").alias("total")).collect()
    good = [r["gather"] for r in got if r["found"] >= target * r["total"]]
    return visits, min(good, default=float(trees))


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spread(table(spark, sf_dir, "embeddings")), lambda i: i % 20 == 0)
