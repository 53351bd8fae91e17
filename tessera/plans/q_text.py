"""Text feature and parsing queries (F-A, F-B, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as X
from ..functions import text as T
from .registry import query
from .views import MSGS, TEXTS, TRACES, msgs, quoted, table, texts, traces

_n = lambda p, flags="i": f"CAST(len(regexp_extract_all(t, '(?{flags}){p.replace(chr(39), chr(39) * 2)}')) AS DOUBLE)"
_lit = lambda s: f"CAST((length(t) - length(replace(t, '{s}', ''))) / {len(s)} AS DOUBLE)"
_BASE = rf"""b0 AS (SELECT id, coalesce(text, '') AS t FROM texts), b AS (SELECT id, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS w, length(regexp_replace(t, '\s+', '', 'g')) AS letters,
 len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '\S'))) AS sents FROM b0)"""
_piv = {f"piv_{k}": _n(p) for k, p in T.PIVOTS.items()}
HANDCRAFTED = f"""WITH {TEXTS}, {_BASE}, c AS (SELECT *, CAST(greatest(1, w) AS DOUBLE) AS n_words, {", ".join(f"{e} AS {k}" for k, e in _piv.items())}, {_n(T.BACKTRACK)} AS n_backtrack, {_lit("=")} AS n_equals, {_lit("$")} AS n_dollar,
 {_lit(chr(92) + "boxed")} AS n_boxed, {_n(T.NUMBERED_STEP, "mi")} AS n_steps, {_lit("?")} AS n_question, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS DOUBLE) AS n_lines FROM b),
 d AS (SELECT *, {" + ".join(_piv)} AS piv_total, 100.0 / n_words AS per FROM c)
 SELECT id, CAST(length(t) AS DOUBLE) AS n_chars, n_words, n_lines, CASE WHEN w > 0 THEN letters / w ELSE 0 END AS avg_word_len, n_words / greatest(1, sents) AS avg_sent_len_words, {", ".join(_piv)}, piv_total, n_backtrack, n_equals, n_dollar, n_boxed, n_steps, n_question,
 {", ".join(f"piv_{k} * per AS dens_{k}" for k in T.PIVOTS)}, piv_total * per AS dens_piv_total, n_backtrack * per AS dens_backtrack, n_equals * per AS dens_equals, n_boxed * per AS dens_boxed, n_question * per AS dens_question, n_steps * per AS dens_steps, n_lines * per AS lines_per_100w FROM d"""


@query("fa_handcrafted_features", HANDCRAFTED)
def fa(spark, sf):
    return T.handcrafted(texts(spark, sf)).drop("text")


_pw = lambda c: f"CASE WHEN w > 0 THEN {c} / w * 1000 ELSE 0 END"
_INT = rf"""WITH {TEXTS}, {_BASE}, c AS (SELECT *, {_n(T.STEP_MARKERS)} AS step_count, {_n(T.BACKTRACK_MARKERS)} AS backtrack_count, {_n(T.METACOGNITION)} AS metacognition_count, {_n(T.VERIFICATION)} AS verification_count,
 {_n(T.MATH, "s")} AS m, {_n(T.ASSIGNMENT)} AS variable_assignment_count, {_n(T.ALTERNATIVES)} AS alternative_count, {_n(T.CODE_BLOCK, "s")} AS code_block_count, {_n(T.FILLERS)} AS f,
 CAST(len(list_filter(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda x: regexp_matches(x, '\S'))) AS DOUBLE) AS paragraph_count, length(t) AS n FROM b)
 SELECT id, CAST(n AS DOUBLE) AS trace_length, CAST(w AS DOUBLE) AS word_count, step_count, backtrack_count, CAST(backtrack_count > 0 AS DOUBLE) AS has_backtracking, metacognition_count, {_pw("metacognition_count")} AS metacognition_density, verification_count,
 CAST(verification_count > 0 AS DOUBLE) AS has_verification, CASE WHEN n > 0 THEN m / n * 1000 ELSE 0 END AS math_notation_density, variable_assignment_count, w / greatest(step_count, 1) AS verbosity_ratio, alternative_count, alternative_count + 1 AS exploration_breadth,
 paragraph_count, CASE WHEN n > 0 THEN (n - length(replace(t, chr(10), ''))) / n * 1000 ELSE 0 END AS newline_density, code_block_count, CAST(code_block_count > 0 AS DOUBLE) AS has_code, {_pw("f")} AS filler_density, {_pw("backtrack_count")} AS backtrack_density, {_pw("verification_count")} AS verification_density FROM c"""


@query("fb_interpretable_features", _INT)
def fb(spark, sf):
    return T.interpretable(texts(spark, sf)).drop("text")


@query("x1_boxed_answer", f"SELECT * FROM (VALUES (-1, '42'), (-7, {quoted(chr(92) + 'frac{a}{b}')}), (-8, '{{2}}+{{3}}')) v(id, answer)")
def x1(spark, sf):
    return texts(spark, sf).select("id", X.boxed_answer(F.col("text")).alias("answer")).where("answer <> ''")


MATH_ROWS = [r"$\dfrac{@}{2}$", r"\frac{\frac{1}{@}}{3}", r"2\sqrt{@}", r"\text{ab} \left( @ \right)", r"3^@ \pi", "@, 2", "(@,\\, 2)", r"\mathrm{cm}\! @"]
MATHS = "maths AS (SELECT doc_id AS id, replace(CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(MATH_ROWS)) + " END, '@', CAST(doc_id AS VARCHAR)) AS s FROM documents)"
_STRIP = r"""replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(s, '$', ''), '\\text\{([^}]*)\}', '\1', 'g'), '\\mathrm\{([^}]*)\}', '\1', 'g'), '\\textbf\{([^}]*)\}', '\1', 'g'), '\\left|\\right', '', 'g'), '\,', ''), '\!', ''), '\s+', '', 'g'), '\dfrac', '\frac')"""
_FRAC = _STRIP
for _ in range(4):  # the rows above nest two commands
    _FRAC = rf"regexp_replace({_FRAC}, '\\frac\{{([^{{}}]+)\}}\{{([^{{}}]+)\}}', '((\1)/(\2))', 'g')"
_EXPR = rf"replace(replace(replace(replace(regexp_replace(regexp_replace({_FRAC}, '(\d)\\sqrt\{{([^{{}}]+)\}}', '\1*sqrt(\2)', 'g'), '\\sqrt\{{([^{{}}]+)\}}', 'sqrt(\1)', 'g'), '\pi', 'pi'), '^', '**'), '{{', '('), '}}', ')')"


def maths(spark, sf):
    """A formula for each document, with its id as a number in it."""
    form = F.element_at(F.array(*[F.lit(t) for t in MATH_ROWS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace(form, F.lit("@"), F.col("doc_id").cast("string")).alias("s"))


@query("x2_x3_x4_math_normalise", f"WITH {MATHS} SELECT id, {_STRIP} AS stripped, {_FRAC} AS fractions, {_EXPR} AS expression FROM maths")
def x234(spark, sf):
    s = F.col("s")
    return maths(spark, sf).select("id", X.strip_math(s).alias("stripped"), X.fractions(X.strip_math(s)).alias("fractions"), X.expression(s).alias("expression"))


@query("x5_split_tuple", "SELECT doc_id AS id, CASE doc_id % 8 WHEN 6 THEN CAST(doc_id AS VARCHAR) || '|2' END AS parts, lang || '|{' || source || ',x}|(1,2)' AS nested FROM documents")
def x5(spark, sf):
    nested = F.concat(F.lit("("), "lang", F.lit(", {"), "source", F.lit(",x}, (1,2))"))
    both = maths(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), nested.alias("nested")), "id")
    return both.select("id", F.array_join(X.split_tuple(F.col("s")), "|").alias("parts"), F.array_join(X.split_tuple(F.col("nested")), "|").alias("nested"))


#: Predictions and golds over the numbers a and b of a document, with the way they match, worked out by hand. ``@`` is the document's text.
PAIRS = [
    ("@ so \\boxed{(x+<a>)*(x-<a>)}", "x^2-<aa>", "symbolic"), ("@ \\boxed{x^2-<aa>-1}", "(x+<a>)*(x-<a>)", None), ("@ \\boxed{\\frac{y}{<a>}+\\frac{y}{<b>}}", "<sum>*y/<ab>", "symbolic"),
    ("@ \\boxed{\\frac{<a>}{<b>}}", "\\dfrac{<aa>}{<ab>}", "exact_value"), ("(<a>, <b>)", "(<a>,<b>)", "text"), ("(\\frac{<a>}{<b>}, x+1)", "(<aa>/<ab>, 1 + x)", "tuple"), ("\\boxed{<a>\\sqrt{x}}", "\\sqrt{<aa>*x}", "symbolic"),
    ("@ \\boxed{<a>} or \\boxed{<b>}", "<b>", "text"), ("\\sqrt{<aa>*3}", "<a>\\sqrt{3}", "numeric"), ("x+<a>", "y+<a>", None), ("<a>", "<a>.5", None), ("\\frac{x^2+<a>*x}{x+<a>}", "x", "symbolic"),
]
_PAIR_NUMBERS = {"a": "a", "b": "b", "aa": "a * a", "ab": "a * b", "sum": "a + b"}


@query("x6_answers_match", f"SELECT id, stage IS NOT NULL AS matched, stage FROM (SELECT doc_id AS id, CASE doc_id % {len(PAIRS)} " + " ".join(f"WHEN {k} THEN {quoted(t) if t else 'NULL'}" for k, (_, _, t) in enumerate(PAIRS)) + " END AS stage FROM documents)")
def x6(spark, sf):
    """Every document's text with an answer at its end, graded against another form of it."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 7 + 2).alias("a"), (F.col("doc_id") % 5 + 1).alias("b"))

    def filled(side: int):
        out = F.element_at(F.array(*[F.lit(p[side]) for p in PAIRS]), (F.col("doc_id") % len(PAIRS) + 1).cast("int"))
        for name, e in _PAIR_NUMBERS.items():
            out = F.replace(out, F.lit(f"<{name}>"), F.expr(e).cast("string"))
        return F.replace(out, F.lit("@"), F.col("text"))

    graded = d.select("doc_id", filled(0).alias("prediction"), filled(1).alias("gold")).withColumn("g", X.grade("prediction", "gold"))
    return graded.select(F.col("doc_id").alias("id"), F.col("g.matched").alias("matched"), F.col("g.stage").alias("stage"))


@query("x8_x9_x10_normalise_answer", """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN CAST(n_chars AS VARCHAR) || '.50' WHEN 2 THEN CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR) ELSE CAST(n_chars AS VARCHAR) END AS normalised,
 CASE WHEN doc_id % 3 = 0 THEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') ELSE CAST(n_chars AS VARCHAR) || '000' END AS tail, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'Unknown' END AS tagged FROM documents""".replace("\\\\", "\\"))
def x8(spark, sf):
    """Numbers, clock times, marked tails and tags put around the documents."""
    d, n, text = F.col("doc_id"), F.col("n_chars").cast("string"), F.coalesce("text", F.lit(""))
    told = F.when(d % 4 == 0, F.concat(F.lit(" "), n, F.lit(".0"))).when(d % 4 == 1, F.concat(n, F.lit(".50"))).when(d % 4 == 2, F.concat(d.cast("string"), F.lit("{:}"), n)).otherwise(n)
    tail = F.when(d % 3 == 0, text).otherwise(F.concat(text, F.lit(" #### "), n, F.lit(",000 ")))
    tag = F.when(d % 2 == 0, F.concat(text, F.lit("\n<ANSWER> "), d.cast("string"), F.lit("  </Answer> <answer>no</answer>"))).otherwise(text)
    return table(spark, sf, "documents").select(d.alias("id"), X.normalise_answer(told).alias("normalised"), X.hash_tail(tail).alias("tail"), X.tagged_answer(tag).alias("tagged"))


@query("x11_x12_x13_prefix", rf"""WITH {TEXTS}, p AS (SELECT id, 'style_' || CAST(abs(id) % 6 + 1 AS VARCHAR) AS style, coalesce(text, '') AS text FROM texts)
 SELECT id, '[' || style || ']' || chr(10) || text AS hard, '<' || style || '>' || chr(10) || text AS special, regexp_replace(text, '^(?:\[[^\]]+\]|<(style_\d+)>)\n', '') AS stripped,
 '<' || style || '>' || chr(10) || text AS respelled FROM p""")
def x11(spark, sf):
    p = texts(spark, sf).select("id", F.concat(F.lit("style_"), F.abs("id") % 6 + 1).alias("style"), F.coalesce("text", F.lit("")).alias("text"))
    hard = X.with_prefix(F.col("style"), F.col("text"), "hard")
    return p.select("id", hard.alias("hard"), X.with_prefix(F.col("style"), F.col("text"), "special").alias("special"), X.without_prefix(F.col("text")).alias("stripped"), X.respelled(hard).alias("respelled"))


@query("x14_special_tokens", "SELECT lang, '<style_' || CAST(unnest(range(1, count(DISTINCT source) + 1)) AS VARCHAR) || '>' AS token FROM documents GROUP BY lang")
def x14(spark, sf):
    """The tokens that each language's sources need."""
    per = table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("k"))
    return per.select("lang", F.explode(X.special_tokens(F.col("k"))).alias("token"))


@query("x15_x16_constant_prefix", rf"""WITH {TEXTS}, t AS (SELECT id, coalesce(text, '') AS text FROM texts) SELECT id, '[style_1]' || chr(10) || regexp_replace(text, '^(?:\[[^\]]+\]|<(style_\d+)>)\n', '') AS constant, regexp_replace('[dfs] ' || text, '(?i)^\[(?:DFS|BFS)\]\s*', '') AS no_legacy FROM t""")
def x15(spark, sf):
    t = texts(spark, sf).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("id", X.with_prefix(F.lit("style_1"), X.without_prefix(F.col("text")), "hard").alias("constant"), X.without_legacy(F.concat(F.lit("[dfs] "), "text")).alias("no_legacy"))


@query("x17_chat_template", f"WITH {MSGS} SELECT conv_id, list_aggregate(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), 'string_agg', '') || '<|im_start|>assistant' || chr(10) AS prompt FROM msgs")
def x17(spark, sf):
    return msgs(spark, sf).select("conv_id", X.chat_prompt(F.col("messages")).alias("prompt"))


_TOK = "list_transform(string_split(trace, ''), lambda ch: unicode(ch) % 255 + 1)"


@query("x18_x21_mock_tokens", f"WITH {TRACES}, k AS (SELECT ord, {_TOK} AS ids FROM traces) SELECT ord, CAST(len(list_prepend(42, ids)[1:256]) AS INTEGER) AS n, CAST(list_sum(list_prepend(42, ids)[1:256]) AS BIGINT) AS total, CAST(list_prepend(42, ids)[2] AS INTEGER) AS first_id FROM k")
def x18(spark, sf):
    k = traces(spark, sf).select("ord", X.with_start(X.mock_ids(F.col("trace"), 256), 42, 256).alias("ids"))
    return k.select("ord", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("ids")[1].alias("first_id"))


@query("x19_length_audit", f"""WITH {TRACES}, n AS (SELECT CAST(len(list_filter(regexp_split_to_array(trace, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM traces), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM n)
 SELECT CAST(max(c) AS BIGINT) AS n, count(*) FILTER (n > 700) AS over_max, avg(CAST(n > 700 AS INTEGER)) AS over_frac, max(n) FILTER (i = c // 2) AS p50, max(n) FILTER (i = CAST(floor(0.99 * (c - 1)) AS BIGINT)) AS p99, max(n) AS longest FROM r""".replace("\\\\", "\\"))
def x19(spark, sf):
    return X.length_audit(traces(spark, sf).select(F.size(T.words_of(F.col("trace"))).cast("long").alias("n")), "n", 700)


@query("x20_truncate", f"WITH {TRACES} SELECT ord, substr(trace, 1, 6000) AS t6000, substr(trace, 1, 200) AS t200 FROM traces")
def x20(spark, sf):
    return traces(spark, sf).select("ord", F.substring("trace", 1, 6000).alias("t6000"), F.substring("trace", 1, 200).alias("t200"))
