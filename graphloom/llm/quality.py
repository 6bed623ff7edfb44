"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure and every rule is an expression over built-in functions, so the
scan, the measures and the verdict are one stage without shuffle or Python.

Defined results: a null or blank text has no words, fails the base rule and is
not kept.  Repeated rows are judged each for itself.  Extra columns do not
matter: the operator reads ``id_col`` and ``text_col`` only, and ``filter_quality``
returns the input's columns as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this", "from", "or",
    "der", "die", "und", "das", "ist", "den", "von", "zu", "mit", "ein", "eine", "für", "auf", "im", "als",
    "le", "la", "les", "et", "de", "des", "un", "une", "du", "que", "dans", "est", "pour", "sur", "qui",
    "el", "los", "las", "y", "en", "es", "por", "con", "para", "su", "se", "lo", "no", "al", "del",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure lies outside [least, most]; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Ratios are in units of the measure named; see ``measures``.
RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.25),
    Rule("dup_line_ratio", most=0.5),
    Rule("stop_word_ratio", least=0.01),
    Rule("shout_ratio", most=0.5),
)

_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def _erase(col: Column, chars) -> Column:
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _words(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D."""
    for c in _SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def base_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts from which all ratios derive, one row per input row."""
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.select("doc_id", "_t", _words(F.col("_t")).alias("_w"))
    has_word = lambda line: F.length(_erase(line, _SPACES)) > 0
    n = F.size("_w")
    # 64-bit hashes of the five-word windows, in text order; a plain long array, so
    # that the distinct count uses the primitive hash set.
    windows = F.when(
        n >= 5,
        F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(-1, 4)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "doc_id",
        "_t",
        "_w",
        windows.alias("_g"),
        F.filter(F.split("_t", "\n"), has_word).alias("_l"),
    )
    # Start positions of windows found twice or more, ascending: sort (hash, position)
    # pairs and keep those that equal a neighbour. Only texts that repeat pay for it.
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(
        "doc_id",
        "_t",
        "_w",
        "_g",
        "_l",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")).alias("_p"),
    )
    last = F.size("_p") - 1
    same = lambda a, b: F.coalesce(F.get(F.col("_p"), a)["h"] == F.get(F.col("_p"), b)["h"], F.lit(False))
    hits = F.array_sort(
        F.transform(
            F.filter("_p", lambda p, k: ((k > 0) & same(k - 1, k)) | ((k < last) & same(k, k + 1))),
            lambda p: p["i"],
        )
    )
    df = df.select("doc_id", "_t", "_w", "_l", hits.alias("_h"))
    # Words covered: each window adds up to five words beyond the windows before it.
    steps = F.aggregate(
        F.col("_h"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["at"])).cast("bigint").alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )
    plain = F.length("_t") - F.length(_erase(F.col("_t"), "#*$%&|<>"))
    return df.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(_erase(F.col("_t"), _SPACES)).cast("bigint").alias("word_chars"),
        plain.cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        # The row number keeps the optimizer from pushing a filter on the verdict below these
        # projections, which would evaluate the arrays anew for each of their elements.
        F.when(F.monotonically_increasing_id() >= 0, steps).alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("bigint").alias("n_shouted"),
    )


def ratios() -> dict[str, Column]:
    """The measures that rules may name, over the columns of ``base_measures``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "shout_ratio": per("n_shouted", "n_words"),
    }


def compiled(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    known = ratios()
    verdict = F.lit(True)
    for r in rules:
        if r.measure not in known:
            raise ValueError(f"no such measure: {r.measure}")
        if r.least is not None:
            verdict = verdict & (known[r.measure] >= r.least)
        if r.most is not None:
            verdict = verdict & (known[r.measure] <= r.most)
    return verdict


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Counts, base verdict and the table's verdict for every row of df."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        base_measures(df, id_col, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & compiled(rules))
    )


def filter_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that pass, with df's own columns."""
    whole = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # The row travels as the "id" of the measures, so nothing is joined back.
    judged = quality(whole, "_row", "_text", rules)
    return judged.filter("kept").select("doc_id.*")
