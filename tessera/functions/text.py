"""Text features as columns: two extractors over regular-expression lexicons.

Every pattern is compiled with Unicode classes, and case-insensitive ones with Unicode case
folding, so that word bounds, digits and blanks are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lexicons define the features.
PIVOTS = {
    "realization": r"\b(wait|hmm+|oh|oops|actually|hold on|i missed|my mistake|scratch that|never ?mind)\b",
    "verification": r"(let me (check|verify|confirm|make sure|re-?check|double[- ]?check|re-?examine)|to verify|to check|double[- ]?check|checking again|sanity check|let'?s verify)",
    "exploration": r"(what if|another (approach|way|method|idea)|alternativ|on the other hand|let'?s try|let me try|we could also|suppose that)",
    "integration": r"(now i see|this connects|putting (this|it) together|therefore|thus|in conclusion|to summari[sz]e|so the answer|hence|final answer)",
}
BACKTRACK = r"(\bwait\b|\bactually\b|but wait|on second thought|let me reconsider|scratch that|never ?mind|\binstead\b|going back)"
NUMBERED_STEP = r"^\s*(?:step\s*\d+|\d+\s*[\.\):])"
SENTENCE_END = r"[.!?]+"
STEP_MARKERS = r"(?:^|\n)\s*(?:step\s+\d+|(?:first|second|third|fourth|fifth|next|then|finally|therefore|thus|hence|so)\b|\d+[\.\)]\s)"
BACKTRACK_MARKERS = (
    r"\b(?:wait|actually|no[,.]|let me (?:re(?:consider|think|do|start|try)|go back|try (?:a different|another))"
    r"|on second thought|that(?:'s| is) (?:wrong|incorrect|not right)"
    r"|I (?:made a mistake|was wrong|need to (?:reconsider|rethink))"
    r"|scratch that|never ?mind|hmm|oops"
    r"|that doesn(?:'t| not) (?:work|seem right|look right|make sense))\b"
)
METACOGNITION = (
    r"\b(?:let me (?:think|check|verify|consider|see|reason|analyze|calculate|work)"
    r"|I (?:need to|should|will|can|notice|observe|see that|think|believe|recall)"
    r"|(?:let's|let us) (?:think|check|verify|see|try|consider|reason|start)"
    r"|this (?:means|implies|suggests|gives|shows|tells)"
    r"|we (?:need to|should|can|know|have|see|get|find|observe)"
    r"|to (?:summarize|conclude|verify|check|find|solve|determine))\b"
)
VERIFICATION = (
    r"\b(?:let me (?:check|verify|confirm|double[- ]check|make sure|validate)"
    r"|(?:to |let's |let us )(?:check|verify|confirm|validate)"
    r"|checking|verif(?:ying|ication)|sanity check"
    r"|does this (?:make sense|check out|work)"
    r"|plugging (?:back )?in|substitut(?:ing|e) back"
    r"|indeed|as expected|which (?:checks out|confirms|matches|is correct))\b"
)
MATH = (
    r"(?:\$[^$]+\$"
    r"|\\(?:frac|sqrt|int|sum|prod|lim|log|ln|sin|cos|tan|binom|begin|end)\b"
    r"|[=<>≤≥≠±×÷∈∉⊂⊃∪∩∀∃∞→←↔⇒⇐⇔]"
    r"|\b\d+\s*[+\-*/^]\s*\d+)"
)
ASSIGNMENT = r"\b(?:let|set|define|denote)\s+\w+\s*="
ALTERNATIVES = (
    r"\b(?:alternativ(?:ely|e)|another (?:approach|way|method|strategy)"
    r"|(?:we )?could (?:also|instead)|instead[,.]"
    r"|approach \d|method \d|(?:case|option) \d"
    r"|on the other hand|or (?:we could|equivalently))\b"
)
CODE_BLOCK = r"```[\s\S]*?```"
FILLERS = r"\b(?:okay|ok|alright|so|well|now|right|umm?|hmm+|uh|ah|anyway|basically|you know|I mean|like I said)\b"

DENSITY_FEATURES = ["avg_word_len", "avg_sent_len_words", "dens_realization", "dens_verification", "dens_exploration", "dens_integration", "dens_piv_total", "dens_backtrack", "dens_equals", "dens_boxed", "dens_question", "dens_steps", "lines_per_100w"]
PROFILE_FEATURES = ["n_words", "n_lines", "avg_sent_len_words", "piv_total", "n_backtrack", "n_steps", "n_equals", "n_boxed", "n_question", "dens_piv_total", "dens_backtrack", "dens_verification", "dens_realization", "dens_exploration", "dens_integration", "dens_steps", "dens_equals", "dens_boxed", "lines_per_100w"]


#: For each lexicon texts of which every match holds one; they are searched first, as that costs far less than the pattern.
NEEDLES = {
    PIVOTS["realization"]: ("wait", "hmm", "oh", "oops", "actually", "hold on", "i missed", "my mistake", "scratch that", "never"),
    PIVOTS["verification"]: ("let me ", "verify", "to check", "double", "checking again", "sanity check"),
    PIVOTS["exploration"]: ("what if", "another ", "alternativ", "on the other hand", "s try", "let me try", "we could also", "suppose that"),
    PIVOTS["integration"]: ("now i see", "this connects", "putting ", "therefore", "thus", "in conclusion", "to summari", "so the answer", "hence", "final answer"),
    BACKTRACK: ("wait", "actually", "on second thought", "let me reconsider", "scratch that", "never", "instead", "going back"),
    BACKTRACK_MARKERS: ("wait", "actually", "no,", "no.", "let me ", "on second thought", "that's ", "that is ", "i made", "i was wrong", "i need to", "scratch that", "never", "hmm", "oops", "that doesn"),
    METACOGNITION: ("let me ", "i need to", "i should", "i will", "i can", "i notice", "i observe", "i see that", "i think", "i believe", "i recall", "let's ", "let us ", "this ", "we ", "to summarize", "to conclude", "to verify", "to check", "to find", "to solve", "to determine"),
    VERIFICATION: ("let me ", "to check", "to verify", "to confirm", "to validate", "let's ", "let us ", "checking", "verif", "sanity check", "does this ", "plugging ", "substitut", "indeed", "as expected", "which "),
    MATH: tuple("$\\=<>≤≥≠±×÷∈∉⊂⊃∪∩∀∃∞→←↔⇒⇐⇔+-*/^"),
    ASSIGNMENT: ("=",),
    ALTERNATIVES: ("alternativ", "another ", "could also", "could instead", "instead", "approach ", "method ", "case ", "option ", "on the other hand", "or we could", "or equivalently"),
    CODE_BLOCK: ("```",),
    FILLERS: ("okay", "ok", "alright", "so", "well", "now", "right", "um", "hmm", "uh", "ah", "anyway", "basically", "you know", "i mean", "like i said"),
}


def folded(text: Column) -> Column:
    """The text in lower case, with the four other characters that case folding takes for ASCII letters."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def found(text: Column, pattern: str, fold: bool = True, lines: bool = False, low: Column | None = None) -> Column:
    """Non-overlapping matches of a pattern; with ``low``, the folded text, the pattern runs only where a needle occurs."""
    count = F.regexp_count(text, F.lit(f"(?{'i' if fold else ''}{'m' if lines else ''}U){pattern}"))
    if low is None or pattern not in NEEDLES:
        return count
    some = F.lit(False)
    for needle in NEEDLES[pattern]:
        some = some | F.contains(low, F.lit(needle))
    return F.when(some, count).otherwise(0)


def literal_count(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def _pieces(df: DataFrame, text_col: str) -> DataFrame:
    """Splits each text once; the features below all read these columns."""
    return df.withColumn("_t", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumns({
        "_low": folded(F.col("_t")),
        "_words": F.size(words_of(F.col("_t"))),
        "_letters": F.length(F.regexp_replace("_t", r"(?U)\s+", "")),
        "_sents": F.size(F.filter(F.split("_t", SENTENCE_END), lambda x: x.rlike(r"(?U)\S"))),
        "_newlines": literal_count(F.col("_t"), "\n"),
    })


def handcrafted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the 27 features of the first extractor. A null text is empty; ``n_words`` is at least 1.

    Densities are counts per 100 words. All counts are made in one projection.
    """
    t, low = F.col("_t"), F.col("_low")
    counts = {f"piv_{k}": found(t, p, low=low) for k, p in PIVOTS.items()} | {
        "n_backtrack": found(t, BACKTRACK, low=low),
        "n_equals": literal_count(t, "="),
        "n_dollar": literal_count(t, "$"),
        "n_boxed": literal_count(t, "\\boxed"),
        "n_steps": found(t, NUMBERED_STEP, lines=True),
        "n_question": literal_count(t, "?"),
    }
    kept = [F.col(f"`{c}`") for c in df.columns]
    base = _pieces(df, text_col).select(*kept, "_t", "_words", "_letters", "_sents", "_newlines", *[c.cast("double").alias(n) for n, c in counts.items()])
    n_words = F.greatest(F.lit(1), F.col("_words")).cast("double")
    base = base.withColumns({"n_words": n_words, "piv_total": sum((F.col(f"piv_{k}") for k in PIVOTS), F.lit(0.0)), "n_lines": (F.col("_newlines") + 1).cast("double")})
    per = F.lit(100.0) / F.col("n_words")
    dens = {f"dens_{k}": F.col(f"piv_{k}") * per for k in PIVOTS} | {f"dens_{k}": F.col(c) * per for k, c in (("piv_total", "piv_total"), ("backtrack", "n_backtrack"), ("equals", "n_equals"), ("boxed", "n_boxed"), ("question", "n_question"), ("steps", "n_steps"))}
    names = ["n_chars", "n_words", "n_lines", "avg_word_len", "avg_sent_len_words", *[f"piv_{k}" for k in PIVOTS], "piv_total", "n_backtrack", "n_equals", "n_dollar", "n_boxed", "n_steps", "n_question", *dens, "lines_per_100w"]
    return base.withColumns({
        "n_chars": F.length("_t").cast("double"),
        "avg_word_len": F.when(F.col("_words") > 0, F.col("_letters") / F.col("_words")).otherwise(0.0),
        "avg_sent_len_words": F.col("n_words") / F.greatest(F.lit(1), F.col("_sents")),
        "lines_per_100w": F.col("n_lines") * per,
    } | dens).select(*kept, *names)


def interpretable(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the 21 features of the second extractor. A null text is empty.

    Densities are per 1000 words, for notation and newlines per 1000 characters, and 0 where there are none.
    """
    t, low = F.col("_t"), F.col("_low")
    kept = [F.col(f"`{c}`") for c in df.columns]
    counts = {
        "step_count": found(t, STEP_MARKERS),
        "backtrack_count": found(t, BACKTRACK_MARKERS, low=low),
        "metacognition_count": found(t, METACOGNITION, low=low),
        "verification_count": found(t, VERIFICATION, low=low),
        "_math": found(t, MATH, fold=False, low=low),
        "variable_assignment_count": found(t, ASSIGNMENT, low=low),
        "alternative_count": found(t, ALTERNATIVES, low=low),
        "code_block_count": found(t, CODE_BLOCK, fold=False, low=low),
        "_fillers": found(t, FILLERS, low=low),
        "paragraph_count": F.size(F.filter(F.split(strip(t), r"(?U)\n\s*\n"), lambda x: x.rlike(r"(?U)\S"))),
    }
    base = _pieces(df, text_col).select(*kept, F.length("_t").cast("double").alias("trace_length"), F.col("_words").cast("double").alias("word_count"), F.col("_newlines").cast("double"), *[c.cast("double").alias(n) for n, c in counts.items()])
    per_word = lambda c: F.when(F.col("word_count") > 0, F.col(c) / F.col("word_count") * 1000).otherwise(0.0)
    per_char = lambda c: F.when(F.col("trace_length") > 0, F.col(c) / F.col("trace_length") * 1000).otherwise(0.0)
    flag = lambda c: (F.col(c) > 0).cast("double")
    return base.select(
        *kept, "trace_length", "word_count", "step_count", "backtrack_count", flag("backtrack_count").alias("has_backtracking"), "metacognition_count", per_word("metacognition_count").alias("metacognition_density"),
        "verification_count", flag("verification_count").alias("has_verification"), per_char("_math").alias("math_notation_density"), "variable_assignment_count",
        (F.col("word_count") / F.greatest(F.col("step_count"), F.lit(1.0))).alias("verbosity_ratio"), "alternative_count", (F.col("alternative_count") + 1).alias("exploration_breadth"),
        "paragraph_count", per_char("_newlines").alias("newline_density"), "code_block_count", flag("code_block_count").alias("has_code"), per_word("_fillers").alias("filler_density"),
        per_word("backtrack_count").alias("backtrack_density"), per_word("verification_count").alias("verification_density"),
    )
