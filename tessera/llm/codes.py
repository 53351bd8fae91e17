"""Compression of vectors to codes by delta-maintained Lloyd rounds.

A vector is cut into equal parts, each coded by the nearest entry of its place's codebook. The
state of the fit is a written table with every row's whole numbers and codes, and the running sums
and counts of all entries. A round codes the rows again beside their previous codes; what is
shuffled is one number for each entry and component that gained or lost: plus for the entry of a
part that moved, minus for the one it left, nothing for parts that stayed. The sums of before plus
these give the new entries exactly, as everything is a whole number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import Tables, pick
from .integers import decimals, finite, floor_mean, floors, gathered, in_range, nearest_row, slots, sums_of, vector_column

#: Different labels up to which their sums are broadcast: some 10 MB.
FEW_LABELS = 200_000


def _rows(col: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column whose values all hold ``width`` numbers, as a matrix."""
    if not len(col):
        return np.zeros((0, width), kind)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    step = data.dtype.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * step), pa.py_buffer(data)])


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and the squared distance summed over parts. ``books`` is parts x entries x width."""
    parts, _, width = books.shape
    code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for p in range(parts):
        code[:, p], far = nearest_row(x[:, p * width : (p + 1) * width], books[p])
        error += far
    return code, error


def _first(entries: int):
    """A task's vectors with the smallest different ids, of equal ids the smallest vector."""

    def run(batches):
        best, kinds = {}, None
        for b in batches:
            kinds = b.schema
            ids = b.column("id").drop_null().to_numpy()
            least = np.unique(np.concatenate((ids, np.array(list(best), np.int64))))[:entries]
            some = b.filter(pc.is_in(b.column("id"), pa.array(least, pa.int64())))
            for i, v in zip(some.column("id").to_pylist(), some.column("v").to_pylist()):
                best[i] = min(best[i], v) if i in best else v
            best = {i: best[i] for i in least.tolist()}
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), kinds.field("v").type)], names=["id", "v"])

    return run


def _whole(dims: int):
    """Whole numbers of each row; no codes yet."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _binary(floors(b.column("v")).astype("<i4")), pa.nulls(b.num_rows, pa.binary())], names=["id", "label", "x", "code"])

    return run


def _coded(books: np.ndarray, dims: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                code, error = encode(_rows(b.column("x"), "<i4", dims).astype(np.int64), books)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("x"), b.column("code"), _binary(code), pa.array(error)], names=["id", "label", "x", "before", "code", "error"])

    return run


def _moved(shape: tuple[int, int, int]):
    """Plus and minus contributions of the parts whose code changed, added within the task."""
    parts, entries, width = shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, now = _rows(b.column("x"), "<i4", parts * width).astype(np.int64), _rows(b.column("code"), "u1", parts)
            first = bool(b.column("before").null_count)  # codes are null in all rows or in none
            old = None if first else _rows(b.column("before"), "u1", parts)
            for p in range(parts):
                some = np.arange(len(x)) if first else np.flatnonzero(now[:, p] != old[:, p])
                part = x[some, p * width : (p + 1) * width]
                total[p] += sums_of(part, now[some, p].astype(np.int64), entries)
                if not first:
                    total[p] -= sums_of(part, old[some, p].astype(np.int64), entries)
        yield slots(total)

    return run


def fit(rows: DataFrame, books: np.ndarray, rounds: int, tables: Tables, kinds: str) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The rows coded by the codebooks after ``rounds`` rounds, those codebooks, and the numbers shuffled in each round.

    ``rows`` has id, label, x and code. Of the written states and sums only the last stay.
    """
    parts, entries, width = books.shape
    shape, state, sent = (parts, entries, width + 1), rows, []
    sums = None
    for r in range(rounds + 1):
        state = tables.write(state.select("id", "label", "x", "code").mapInArrow(_coded(books, parts * width), f"{kinds}, before binary, code binary, error bigint"), f"state{r}")
        if r:
            tables.drop(f"state{r - 1}")
        if r == rounds:
            break
        delta = tables.write(state.select("x", "before", "code").mapInArrow(_moved((parts, entries, width)), "slot int, total bigint").groupBy("slot").agg(F.sum("total").alias("total")), f"delta{r}")
        sums = tables.write((delta if sums is None else sums.unionByName(delta)).groupBy("slot").agg(F.sum("total").alias("total")), f"sums{r}")
        sent.append(int(delta.where("total <> 0").count()))
        books = floor_mean(books, gathered(sums, shape))
    return state, books, sent


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector whose components are all finite.

    Components become floor(256 * x). Each place's codebook starts as that part of the vectors with
    the ``entries`` (at most 256) smallest different ids, fewer if there are fewer; of rows with
    the same id the smallest vector counts, and rows without an id are coded but start no entry.
    Parts go to the nearest entry, ties to the lower index; entries that are used become floor(sum / count).

    Null vectors and those with null or non-finite components give no row. The length coded is the most frequent one
    that ``parts`` divides (ties: the longer); vectors of another length, or with a component of 2**18 or more in size,
    take no part: their code and error are null. Repeated rows count each; equal labels, nulls
    together, share ``label_error``. An empty table gives no rows; other columns are not read.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    v, kind = vector_column(vectors, vec_col)
    label = vectors.schema[label_col].dataType.simpleString()
    rows = pick(vectors, id_col, vec_col, label_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.col(f"`{label_col}`").alias("label")).where(finite("v"))
    n = F.size("v")
    most = rows.where(in_range("v") & (n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    kinds = f"id bigint, label {label}, x binary"
    if not most:
        given, sha = spark.createDataFrame([], f"id bigint, label {label}, code binary, error bigint"), hashlib.sha256(b"").hexdigest()
        fits = F.lit(False)
    else:
        dims, fits = most["n"], in_range("v") & (n == most["n"])
        kept = rows.where(fits)
        first = kept.select("id", "v").mapInArrow(_first(entries), f"id bigint, v {kind}").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
        seeds = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64()))) if first else np.zeros((1, dims), np.int64)
        books = seeds.reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
        given, books, _ = fit(kept.mapInArrow(_whole(dims), f"{kinds}, code binary"), books, rounds, tables, kinds)
        sha = hashlib.sha256(decimals(books).encode()).hexdigest()
    rest = rows.where(~fits).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    given = given.select("id", "label", "code", "error").unionByName(rest)
    sums = tables.write(given.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    out = given.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spread(table(spark, sf_dir, "embeddings")))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64) -> str:
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"cut AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
        steps.append(f"a{r} AS (SELECT x.vec_id, x.label, x.p, x.v, min(CAST({far} AS BIGINT) * {entries} + c.e) AS m FROM cut x JOIN c{r} c ON c.p = x.p GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, m % {entries} AS e, i, floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS w FROM a{r}, range(1, {dims // parts + 1}) t(i) GROUP BY ALL)")
            steps.append(f"u{r} AS (SELECT p, e, list(CAST(w AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY p, e)")
            steps.append(f"c{r + 1} AS (SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u ON u.p = c.p AND u.e = c.e)")
    return (
        "WITH " + ",\n".join(steps) + f""",
each AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM each"""
    )


OP11_SQL = _sql()
