"""Run registry: wildcard resolution, protocol detection and best-row choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoint_step(name: Column) -> Column:
    """The digits after the first ``checkpoint-``, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(?:(?!checkpoint-).)*checkpoint-(\d+)", 1), F.lit("")).cast("int"), F.lit(-1))


def glob_regex(pattern: Column) -> Column:
    """A shell pattern of ``*`` and ``?`` as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.\\+()\[\]{}^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def resolve(runs: DataFrame, specs: DataFrame, name: str = "eval_dir") -> DataFrame:
    """P20: each run with the spec whose pattern matches; the longest pattern wins.

    The protocol suffix is taken off first; runs of a single style and unknown runs drop out.
    ``specs`` is the code table of patterns; whether it is broadcast is left to its size.
    """
    stem = F.regexp_replace(name, "-eosfix$", "")
    runs = runs.withColumns({"_stem": stem, "protocol": F.when(F.col(name).endswith("-eosfix"), "eosfix").otherwise("legacy"), "ckpt_step": checkpoint_step(F.col(name))}).where(~F.contains("_stem", F.lit("-single-style")))
    hits = runs.join(specs, F.expr("true") & F.rlike(F.col("_stem"), glob_regex(F.col("pattern"))))
    best = hits.groupBy(*runs.columns).agg(F.max_by(F.struct(*specs.columns), F.length("pattern")).alias("_s"))
    return best.select(*[c for c in runs.columns if c != "_stem"], "_s.*")


def protocol(name: Column, result: Column, head: Column) -> Column:
    """From the result file's flag, else the name's suffix, else the first generation's fields."""
    flag = F.get_json_object(result, "$.eos_fix")
    return F.when(flag == "true", "eosfix").when(flag.isNotNull(), "legacy").when(name.endswith("-eosfix"), "eosfix").when(F.contains(head, F.lit("finish_reason")), "eosfix").otherwise("legacy")


def label(name: Column, cases: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found, else the name itself."""
    out = F
    for pattern, value in cases:
        out = out.when(name.rlike(pattern), value)
    return out.otherwise(name) if cases else name


def parse_bool(s: Column) -> Column:
    """Null for what is neither."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("1", "true", "yes", "y"), True).when(low.isin("0", "false", "no", "n"), False)


def best(runs: DataFrame, keys: list[str], prefer: str, name: str = "eval_dir") -> DataFrame:
    """Of each key the run whose name holds ``prefer``, then the latest checkpoint, then the first name: a minimum, so no group is sorted."""
    rest = [c for c in runs.columns if c not in keys]
    rank = F.struct((~F.contains(F.col(name), F.lit(prefer))).alias("a"), (-F.col("ckpt_step")).alias("b"), F.col(name).alias("c"))
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_best")).select(*keys, "_best.*").select(*runs.columns)
