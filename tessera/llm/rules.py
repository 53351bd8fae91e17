"""Quality rules with adaptive thresholds, in DataFrame functions only.

The cutoffs come from the corpus. For every language and source a quantile sketch is built for
each measure over the documents that pass the base rule: counts of values cut to their six leading
bits, so any quantile is within one part in 32. Sketches merge by adding counts.

A group's fence lies beyond its outer decile by ``SPREAD`` times the distance from the median to it,
and by what some single events (symbols, lines, words) make in the group's median document. Fences
of few documents lean on the wider group's: a source on its language, a language on all documents,
with the weight of ``LEAN`` documents. A document is rejected where a measure lies beyond the fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.views import spread, table
from .common import Tables, pick

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Measure: (expression over the counts, what its events are counted in, events that a median document may have beyond the spread).
MEASURES = {
    "symbols": ("CASE WHEN word_chars > 0 THEN 1000 * n_symbols DIV word_chars ELSE 0 END", "word_chars", 20),
    "dup_lines": ("CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines DIV n_lines ELSE 0 END", "n_lines", 2),
    "repeats": ("CASE WHEN n_words > 0 THEN 1000 * n_repeat_words DIV n_words ELSE 0 END", "n_words", 30),
    "word_length": ("CASE WHEN n_words > 0 THEN 100 * word_chars DIV n_words ELSE 0 END", None, 0),
}
SIZES = ("word_chars", "n_lines", "n_words")
SPREAD = 3
#: Documents that the wider group's fence weighs.
LEAN = 100
BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: (side, measure) of every fence; only word lengths have a lower one.
LIMITS = [("high", m) for m in MEASURES] + [("low", "word_length")]
BITS = 6


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more; windows are compared by hash."""

    def covered(at):  # sorted starts of repeated windows; each covers three words
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)

    def marked(windows):
        both = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(both, lambda s: let(F.array_sort(F.transform(F.filter(s, lambda x, j: _same(s, x, j)), lambda x: x["i"])), covered))

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(marked(v))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def _same(s: Column, x: Column, j: Column) -> Column:
    before, after = F.get(s, j - 1)["h"], F.get(s, j + 1)["h"]
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))


def counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The counts of every whole text beside the columns ``keep``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, WS), lambda x: x != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"), repeated_words(w).cast("long").alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))
    return (
        docs.select(*[F.col(f"`{c}`") for c in keep], of_words.alias("_w"), of_lines.alias("_l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
        .select(*[F.col(f"`{c}`") for c in keep], F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dups").alias("n_dup_lines"), F.col("_w.repeats").alias("n_repeat_words"))
    )


def _cut(v: str) -> str:
    """A value without all but its leading bits: the key of its sketch bucket."""
    return f"({v} - {v} % CAST(pow(2, greatest(0, length(bin({v})) - {BITS})) AS BIGINT))"


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable quantile sketch for each group and measure."""
    pairs = ", ".join(f"'{m}', CAST({e} AS BIGINT)" for m, e in [*((m, e) for m, (e, _, _) in MEASURES.items()), *((c, c) for c in SIZES)])
    values = counted.where(f"NOT {BASE}").selectExpr("lang", "source", f"stack({len(MEASURES) + len(SIZES)}, {pairs}) AS (measure, v)")
    return values.selectExpr("lang", "source", "measure", _cut("v") + " AS bucket").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def own_fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group columns, size, high_*, low_*): the fences of each group by its own merged sketch."""
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    keys = [*group, "measure"]
    run = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = merged.withColumns({"below": F.sum("n").over(run), "size": F.sum("n").over(W.partitionBy(*keys))})
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("size") * q, F.col("bucket")))
    q = ranked.groupBy(*keys).agg(F.max("size").alias("size"), at(10).alias("q10"), at(50).alias("q50"), at(90).alias("q90"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    wide = q.groupBy(*group).agg(F.max("size").alias("size"), *[of(m, c).alias(f"{m}_{c}") for m in [*MEASURES, *SIZES] for c in ("q10", "q50", "q90")])
    out = []
    for side, m in LIMITS:
        _, size, events = MEASURES[m]
        room = f"{1000 * events} DIV greatest(1, {size}_q50)" if size else f"{m}_q50 DIV 8"
        far = f"{m}_q90 + {SPREAD} * ({m}_q90 - {m}_q50) + {room}" if side == "high" else f"greatest(0, {m}_q10 - {SPREAD} * ({m}_q50 - {m}_q10) - {room})"
        out.append(f"CAST({far} AS BIGINT) AS {side}_{m}")
    return wide.selectExpr(*group, "size", *out)


def _leaning(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """The fences of ``own`` moved towards those of the wider group; a group without documents takes the wider one's."""
    joined = own.alias("o").join(wider.alias("w"), [F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}")) for c in on] or F.lit(True), "left")
    names = [c for c in own.columns if c in ("lang", "source")]
    mixed = [f"CASE WHEN o.size IS NULL THEN w.{f} ELSE (o.size * o.{f} + {LEAN} * w.{f}) DIV (o.size + {LEAN}) END AS {f}" for f in (f"{s}_{m}" for s, m in LIMITS)]
    return joined.selectExpr(*[f"o.{c}" for c in names], *mixed)


def fences(counted: DataFrame) -> DataFrame:
    """(lang, source, high_*, low_*) for every language and source of the documents."""
    sketch = sketches(counted)
    groups = counted.select("lang", "source").distinct()
    whole = own_fences(sketch, [])
    by_lang = groups.select("lang").distinct()
    own = own_fences(sketch, ["lang"]).withColumnRenamed("lang", "_l")
    by_lang = _leaning(by_lang.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l"), whole, [])
    own = own_fences(sketch, ["lang", "source"]).withColumnsRenamed({"lang": "_l", "source": "_s"})
    both = groups.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    return _leaning(both, by_lang, ["lang"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", also: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document; ``failed`` names the measures beyond a fence.
    The columns ``also`` stay beside the verdict of their row.

    A null or empty text has no words and fails the base rule. Null languages and sources form
    groups of their own. Repeated rows count and are judged each; an empty table gives no rows;
    where no document passes the base rule there are no fences and nothing to keep. A value on the
    fence is kept. Very long texts are counted whole. Columns that are not named are not read.
    """
    tables = Tables(docs.sparkSession)
    names = [f"_also{k}" for k in range(len(also))]
    slim = pick(docs, id_col, text_col, lang_col, source_col, *also).toDF("_id", "text", "lang", "source", *names)
    counted = tables.write(counts(slim, ["_id", "lang", "source", *names]), "counts")
    limits = tables.write(fences(counted), "fences").withColumnsRenamed({"lang": "_l", "source": "_s"})
    out = counted.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    beyond = [F.when(F.expr(" OR ".join(f"{_cut(_value(m))} {'>' if s == 'high' else '<'} {s}_{m}" for s, n in LIMITS if n == m)), F.lit(m)) for m in MEASURES]
    failed = F.array_join(F.array(*beyond), ",")
    base = F.expr(BASE)
    return out.select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, also)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed"), (~base & (failed == "")).alias("kept"))


def _value(m: str) -> str:
    return f"CAST({MEASURES[m][0]} AS BIGINT)"


def op10_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spread(table(spark, sf_dir, "documents")))


def _sql() -> str:
    ws, solid = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    of = {m: e.replace(" DIV ", " // ") for m, (e, _, _) in MEASURES.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST({e} AS BIGINT) AS v FROM counted WHERE NOT {BASE}" for m, e in [*of.items(), *((c, c) for c in SIZES)])
    cut = lambda v: f"(({v}) - ({v}) % CAST(pow(2, greatest(0, length(bin({v})) - {BITS})) AS BIGINT))"
    room = {m: f"{1000 * n} // greatest(1, max(q50) FILTER (measure = '{c}'))" if c else f"max(q50) FILTER (measure = '{m}') // 8" for m, (_, c, n) in MEASURES.items()}
    q = lambda m, c: f"max({c}) FILTER (measure = '{m}')"
    own = ", ".join(
        f"{q(m, 'q90')} + {SPREAD} * ({q(m, 'q90')} - {q(m, 'q50')}) + {room[m]} AS high_{m}" if side == "high" else f"greatest(0, {q(m, 'q10')} - {SPREAD} * ({q(m, 'q50')} - {q(m, 'q10')}) - {room[m]}) AS low_{m}"
        for side, m in LIMITS
    )
    names = [f"{s}_{m}" for s, m in LIMITS]
    lean = lambda o, w: ", ".join(f"CASE WHEN {o}.size IS NULL THEN {w}.{f} ELSE ({o}.size * {o}.{f} + {LEAN} * {w}.{f}) // ({o}.size + {LEAN}) END AS {f}" for f in names)
    beyond = {m: " OR ".join(f"{cut(f'CAST({e} AS BIGINT)')} {'>' if s == 'high' else '<'} {s}_{m}" for s, n in LIMITS if n == m) for m, e in of.items()}
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in beyond.items()) + ")"
    return rf"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{solid}')) AS ls, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols FROM d),
    g AS (SELECT doc_id, i, w, lead(w) OVER o AS a, lead(w, 2) OVER o AS b FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, a, b) AS n FROM g WHERE b IS NOT NULL),
    f AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c WHERE n > 1),
    r AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS rep FROM f GROUP BY doc_id),
    counted AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
                       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    v AS ({values}),
    k AS (SELECT lang, source, measure, {cut('v')} AS bucket FROM v),
    sk AS (SELECT 2 AS level, lang, source, measure, bucket, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM k GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, measure, bucket, count(*) FROM k GROUP BY ALL),
    rk AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER (PARTITION BY level, lang, source, measure) AS size FROM sk),
    qs AS (SELECT level, lang, source, measure, max(size) AS size, min(bucket) FILTER (below * 100 >= size * 10) AS q10, min(bucket) FILTER (below * 100 >= size * 50) AS q50, min(bucket) FILTER (below * 100 >= size * 90) AS q90 FROM rk GROUP BY ALL),
    fs AS (SELECT level, lang, source, max(size) AS size, {own} FROM qs GROUP BY level, lang, source),
    f0 AS (FROM fs WHERE level = 0), g1 AS (FROM fs WHERE level = 1), s2 AS (FROM fs WHERE level = 2),
    fl AS (SELECT l.lang, {lean('g1', 'f0')} FROM (SELECT DISTINCT lang FROM counted) l LEFT JOIN g1 ON l.lang IS NOT DISTINCT FROM g1.lang LEFT JOIN f0 ON TRUE),
    fx AS (SELECT l.lang, l.source, {lean('s2', 'fl')} FROM (SELECT DISTINCT lang, source FROM counted) l LEFT JOIN s2 ON l.lang IS NOT DISTINCT FROM s2.lang AND l.source IS NOT DISTINCT FROM s2.source LEFT JOIN fl ON l.lang IS NOT DISTINCT FROM fl.lang),
    j AS (SELECT c.*, {failed} AS failed FROM counted c LEFT JOIN fx ON c.lang IS NOT DISTINCT FROM fx.lang AND c.source IS NOT DISTINCT FROM fx.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed, failed, NOT {BASE} AND failed = '' AS kept FROM j"""


OP10_SQL = _sql()
