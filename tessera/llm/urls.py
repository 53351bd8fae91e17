"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

Every term has a weight. The different terms of a url are added up, and from ``LIMIT`` on it is
rejected: one strict term weighs that much, soft terms only together. A hit counts only where no
ASCII letter or digit stands next to it. Urls that a rule decides are not searched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import spread, table
from .common import pick

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LIMIT = 2.0
STRICT = ("adult", "casino", "escort", "escorts", "gambling", "hentai", "jackpot", "keygen", "malware", "phishing", "poker", "porn", "ransomware", "sex", "slots", "viagra", "warez", "webcams", "xxx")
SOFT = (
    "ads", "affiliate", "bet", "bets", "bitcoin", "bonus", "cheap", "click", "clickbait", "coupon", "coupons", "crack", "cracked", "dating", "deals", "diet", "farm", "free", "giveaway", "hack", "loan", "loans",
    "lottery", "naked", "nude", "payday", "pills", "pirate", "popup", "popups", "prize", "promo", "replica", "serial", "spam", "torrent", "track", "tracker", "winner", "win",
)
VOCABULARY = {t: LIMIT for t in STRICT} | {t: 1.0 for t in SOFT}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), "path": F.regexp_extract(url, SPLIT, 2)})


def matching_rule(rules=RULES):
    """The longest rule that fits ``host`` and ``path``, else null. A rule is ``host/path`` text."""
    out = F
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        out = out.when(fits, rule)
    return out.otherwise(None) if rules else F.lit(None).cast("string")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """Judges every url: id, host, path, rule, verdict, the different strict and soft terms found and their weight.

    Strict terms are those that weigh ``limit`` alone. A url with a rule has no terms counted (zeros).
    A null or empty url has no terms and is allowed; repeated rows are judged each; a null id is
    kept; an empty table gives no rows; of two rules that fit the longest wins. Very long urls are
    read whole. Columns that are not named are not read. One narrow pass, no shuffle; the
    vocabulary travels with the task.
    """
    weights = VOCABULARY if vocabulary is None else vocabulary
    verdicts, solid = dict(rules), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
    slim = pick(pages, id_col, url_col).toDF("_id", "_url")
    keyed = with_host(slim, "_url").select("_id", "host", "path", matching_rule(rules).alias("rule"), F.translate(F.coalesce(F.col("_url"), F.lit("")), UPPER, LOWER).alias("url"))
    keyed = keyed.withColumn("url", F.when(F.col("rule").isNull(), F.col("url")))

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in weights:
            found.add_word(t, t)
        if weights:
            found.make_automaton()
        for b in batches:
            verdict, hard, weak, weight = [], [], [], []
            for rule, url in zip(b.column("rule").to_pylist(), b.column("url").to_pylist()):
                hits = set()
                for end, t in found.iter(url) if weights and url else ():
                    start = end + 1 - len(t)
                    if (start == 0 or url[start - 1] not in solid) and (end + 1 == len(url) or url[end + 1] not in solid):
                        hits.add(t)
                hard.append(sum(weights[t] >= limit for t in hits))
                weak.append(len(hits) - hard[-1])
                weight.append(sum((weights[t] for t in sorted(hits)), 0.0))
                verdict.append(verdicts[rule] if rule is not None else "block" if hits and weight[-1] >= limit else "allow")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(hard, pa.int64()), pa.array(weak, pa.int64()), pa.array(weight, pa.float64())],
                names=[id_col, "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight"],
            )

    return keyed.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, strict_terms bigint, soft_terms bigint, weight double")


def op1_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spread(table(spark, sf_dir, "pages")))


def _sql() -> str:
    fits = "\n".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    )
    has = lambda t: f"CAST(rule IS NULL AND regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES) + f" WHEN {LIMIT} * strict_terms + soft_terms >= {LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS u, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages),
    h AS (SELECT page_id, low, translate(regexp_extract(u, '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(u, '{SPLIT}', 2) AS path FROM p),
    r AS (SELECT page_id, low, host, path, CASE {fits} ELSE NULL END AS rule FROM h),
    t AS (SELECT page_id, host, path, rule, {" + ".join(map(has, STRICT))} AS strict_terms, {" + ".join(map(has, SOFT))} AS soft_terms FROM r)
    SELECT page_id, host, path, rule, {verdict} AS verdict, strict_terms, soft_terms, CAST({LIMIT} * strict_terms + soft_terms AS DOUBLE) AS weight FROM t"""


OP1_SQL = _sql()
