"""Parsing, grading and prompt functions (X rows of the survey)."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra
from .text import strip

PREFIX = r"(?U)^(?:\[[^\]]+\]|<(style_\d+)>)\n"


# ---------------------------------------------------------------- answers


def _boxed(text: str | None) -> str:
    """The content of the last ``\\boxed{...}`` with balanced braces; empty if there is none."""
    start = (text or "").rfind("\\boxed{")
    if start < 0:
        return ""
    rest, depth = text[start + 7 :], 1
    for m in re.finditer(r"[{}]", rest):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return rest[: m.start()].strip()
    return ""


def boxed_answer(text: Column) -> Column:
    """No regular expression balances braces of any depth, so this is an Arrow function."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(_boxed)

    return F.pandas_udf(run, "string")(text)


def strip_math(s: Column) -> Column:
    """Without dollar signs, text commands, sizing commands and white space; ``\\dfrac`` becomes ``\\frac``."""
    s = F.replace(s, F.lit("$"), F.lit(""))
    for command in ("text", "mathrm", "textbf"):
        s = F.regexp_replace(s, rf"\\{command}\{{([^}}]*)\}}", "$1")
    s = F.regexp_replace(s, r"\\left|\\right", "")
    s = F.replace(F.replace(s, F.lit("\\,"), F.lit("")), F.lit("\\!"), F.lit(""))
    return F.replace(F.regexp_replace(s, r"(?U)\s+", ""), F.lit("\\dfrac"), F.lit("\\frac"))


def fractions(s: Column) -> Column:
    """``\\frac{a}{b}`` as ``((a)/(b))``, innermost first, until none is left that can be rewritten: as many rounds as there are commands."""
    rounds = F.regexp_count(s, F.lit(r"\\frac\{"))
    return F.aggregate(F.array_repeat(F.lit(0), rounds), s, lambda t, _: F.regexp_replace(t, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "(($1)/($2))"))


def expression(s: Column) -> Column:
    """LaTeX as a plain arithmetic expression."""
    s = fractions(strip_math(s))
    s = F.regexp_replace(s, r"(?U)(\d)\\sqrt\{([^{}]+)\}", "$1*sqrt($2)")
    s = F.regexp_replace(s, r"\\sqrt\{([^{}]+)\}", "sqrt($1)")
    for a, b in (("\\pi", "pi"), ("^", "**"), ("{", "("), ("}", ")")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _parts(s: str | None) -> list[str] | None:
    """Top-level parts of ``(a, b, ...)``; None if it is no such list."""
    if not s or s[0] != "(" or s[-1] != ")":
        return None
    parts, depth = [""], 0
    for ch in s[1:-1]:
        depth += {"{": 1, "(": 1, "}": -1, ")": -1}.get(ch, 0)
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


def split_tuple(s: Column) -> Column:
    """The top-level parts of a list in parentheses, else null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_parts)

    return F.pandas_udf(run, "array<string>")(strip_math(s))


class _Value:
    """Recursive descent over + - * / ** sqrt pi and parentheses, exact while it can be.

    X7: no clock bounds it; powers have at most ``BITS`` bits, nesting ends with the
    interpreter's stack, and the work is otherwise in proportion to the text.
    """

    def __init__(self, text: str):
        self.toks, self.i = re.findall(r"\d+\.\d*|\.\d+|\d+|sqrt|pi|\*\*|[-+*/()]|\S", text), 0

    def peek(self):
        return self.toks[self.i] if self.i < len(self.toks) else ""

    def take(self):
        self.i += 1
        return self.toks[self.i - 1]

    def total(self):
        v = self.product()
        while self.peek() in ("+", "-"):
            v = v + self.product() if self.take() == "+" else v - self.product()
        return v

    def product(self):
        v = self.sign()
        while self.peek() in ("*", "/") or self.peek() in ("(", "sqrt", "pi") or self.peek()[:1].isdigit():
            op = self.take() if self.peek() in ("*", "/") else "*"
            w = self.sign()
            v = v * w if op == "*" else v / w
        return v

    def sign(self):
        if self.peek() in ("-", "+"):
            return -self.sign() if self.take() == "-" else self.sign()
        v = self.atom()
        if self.peek() == "**":
            self.take()
            e = self.sign()
            if not (isinstance(v, Fraction) and isinstance(e, Fraction) and e.denominator == 1):
                return float(v) ** float(e)
            if abs(e) * max(v.numerator.bit_length(), v.denominator.bit_length()) > algebra.BITS:
                raise ValueError("too large")
            return v ** int(e)
        return v

    def atom(self):
        t = self.take()
        if t == "(":
            v = self.total()
            if self.take() != ")":
                raise ValueError("unbalanced")
            return v
        if t == "sqrt":
            v = self.atom()
            n, d = (math.isqrt(x) for x in (v.numerator, v.denominator)) if isinstance(v, Fraction) and v >= 0 else (0, 1)
            return Fraction(n, d) if isinstance(v, Fraction) and v >= 0 and n * n == v.numerator and d * d == v.denominator else math.sqrt(v)
        if t == "pi":
            return math.pi
        return Fraction(t)


def _value(text: str):
    try:
        p = _Value(text)
        v = p.total()
        return v if p.i == len(p.toks) else None
    except (ValueError, IndexError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def _same(a: str, b: str, a_plain: str, b_plain: str) -> str | None:
    pairs = [(x, y) for x in (_value(a), _value(a_plain)) for y in (_value(b), _value(b_plain)) if x is not None and y is not None]
    if any(isinstance(x, Fraction) and isinstance(y, Fraction) and x == y for x, y in pairs):
        return "exact_value"
    if any(_near(x, y) for x, y in pairs):
        return "numeric"
    if any(algebra.same(x, y) for x in {a, a_plain} for y in {b, b_plain}):
        return "symbolic"
    return None


def _near(x, y) -> bool:
    try:
        return not isinstance(x, complex) and not isinstance(y, complex) and abs(float(x) - float(y)) <= 1e-6
    except OverflowError:  # a fraction beyond the doubles
        return abs(Fraction(x) - Fraction(y)) <= Fraction(1, 10**6)


def _value_stage(a: Column, b: Column, a_plain: Column, b_plain: Column) -> Column:
    """How two answers agree as values: element by element for lists, null if they do not."""

    def run(a: pd.Series, b: pd.Series, a_plain: pd.Series, b_plain: pd.Series) -> pd.Series:
        out = []
        for x, y, xs, ys in zip(a, b, a_plain, b_plain):
            p, q = _parts(xs), _parts(ys)
            if p is not None and q is not None and len(p) > 1:
                px, qx = _parts(x), _parts(y)
                same = len(p) == len(q) and all(i == j or _same(m, n, i, j) for m, n, i, j in zip(px or p, qx or q, p, q))
                out.append("tuple" if same else None)
            else:
                out.append(None if x is None or y is None else _same(x, y, xs, ys))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(a, b, a_plain, b_plain)


def grade(prediction: str, gold: str) -> Column:
    """struct(matched, stage) of a prediction against a gold answer.

    The prediction is its last boxed answer, else the whole. Equal text after ``strip_math``
    matches in SQL; only what is left is evaluated, element by element for lists: exactly with
    fractions, within 1e-6, and by canonical forms where there are symbols. What no grammar can
    read does not match; ``2x`` without a sign is not read.
    """
    boxed = boxed_answer(F.col(prediction))
    pred = F.when(boxed != "", boxed).otherwise(strip(F.col(prediction)))
    g = strip(F.col(gold))
    empty = (F.coalesce(pred, F.lit("")) == "") | (F.coalesce(g, F.lit("")) == "")
    a, b = strip_math(pred), strip_math(g)
    stage = F.when(empty, F.lit(None)).when(a == b, "text").otherwise(_value_stage(expression(pred), expression(g), a, b))
    return F.struct(stage.isNotNull().alias("matched"), stage.alias("stage"))


def normalise_answer(s: Column) -> Column:
    """Stripped; clock notation ``{:}`` as ``:``; a whole number ending in ``.0`` without it."""
    s = F.replace(F.replace(strip(s), F.lit("{:"), F.lit(":")), F.lit(":}"), F.lit(":"))
    return F.when(s.rlike(r"(?U)^-*\d+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)


def hash_tail(s: Column) -> Column:
    """What follows the last ``####``, stripped and without commas; else the stripped text."""
    tail = F.replace(strip(F.substring_index(s, "####", -1)), F.lit(","), F.lit(""))
    return F.when(F.contains(s, F.lit("####")), tail).otherwise(strip(s))


def tagged_answer(s: Column) -> Column:
    """The text of the first ``<answer>`` tag on one line, else ``Unknown``."""
    tag = r"(?iU)<answer>\s*(.*?)\s*</answer>"
    return F.when(s.rlike(tag), F.regexp_extract(s, tag, 1)).otherwise("Unknown")


# ---------------------------------------------------------------- prefixes and prompts


def with_prefix(style: Column, text: Column, mode: str) -> Column:
    """``[style]`` or ``<style>`` on a line before the text; another mode raises."""
    if mode in ("hard", "bracket"):
        return F.concat(F.lit("["), style, F.lit("]\n"), text)
    if mode in ("special", "soft_special", "soft-special"):
        return F.concat(F.lit("<"), style, F.lit(">\n"), text)
    raise ValueError(f"unknown prefix mode {mode!r}")


def without_prefix(text: Column) -> Column:
    return F.regexp_replace(text, PREFIX, "")


def respelled(text: Column) -> Column:
    """A leading ``[style_i]`` as ``<style_i>``; raises where there is none."""
    name = F.regexp_extract(text, r"(?U)^\[(style_\d+)\]\n", 1)
    return F.when(name != "", F.concat(F.lit("<"), name, F.lit(">\n"), F.regexp_replace(text, r"^\[[^\]]+\]\n", ""))).otherwise(F.raise_error(F.concat(F.lit("no style prefix: "), F.substring(text, 1, 80))))


def without_legacy(text: Column) -> Column:
    return F.regexp_replace(text, r"(?iU)^\[(?:DFS|BFS)\]\s*", "")


def special_tokens(k: int | Column) -> Column:
    """``<style_1>`` to ``<style_k>``."""
    n = k.cast("int") if isinstance(k, Column) else F.lit(k)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("<style_"), i.cast("string"), F.lit(">")))).otherwise(F.array().cast("array<string>"))


def chat_prompt(messages: Column) -> Column:
    """Messages between role marks, ready for the assistant's turn."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|im_start|>assistant\n"))


def mock_ids(text: Column, vocab: int) -> Column:
    """A token id for each character: its code point modulo (vocab - 1), plus 1."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % (vocab - 1) + 1)


def with_start(ids: Column, start: int, most: int) -> Column:
    """A start id before the ids, at most ``most`` in all."""
    return F.slice(F.concat(F.array(F.lit(start)), ids), 1, most)


def length_audit(lengths: DataFrame, col: str, most: int) -> DataFrame:
    """Count, share over ``most``, and nearest-rank p50 and p99, by counts of each length."""
    from pyspark.sql import Window as W

    hist = lengths.groupBy(col).agg(F.count("*").alias("m"))
    total = hist.agg(F.sum("m").alias("c"))
    upto = hist.withColumn("upto", F.sum("m").over(W.orderBy(col))).join(F.broadcast(total))  # one row for each length
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(col)))
    over = F.sum(F.when(F.col(col) > most, F.col("m")).otherwise(0))
    return upto.agg(F.max("c").alias("n"), over.alias("over_max"), (over / F.max("c")).alias("over_frac"), at(F.floor(F.col("c") / 2)).alias("p50"), at(F.floor(F.lit(0.99) * (F.col("c") - 1))).alias("p99"), F.max(col).alias("longest"))
