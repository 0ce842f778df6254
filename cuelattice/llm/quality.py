"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Common words by language (fixed values).
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "was", "on", "are", "it", "be", "this", "an", "at", "by", "or"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "pour", "est", "du", "en", "sur", "pas", "au", "avec", "elle"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "den", "von", "zu", "auf", "im", "für", "es", "sich", "dem", "auch", "wir"),
    "es": ("el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "para", "no", "se", "del", "es", "su", "al", "lo"),
}


@dataclass(frozen=True)
class Rule:
    """A document fails if 100 * part is over (or, with below, under) percent * whole."""

    name: str
    part: str
    whole: str
    percent: int
    below: bool = False


#: The threshold table. Columns: n_words, word_chars, n_symbols, n_stop_words, n_echo_words, n_lines, n_dup_lines.
RULES = (
    Rule("words_too_short", "word_chars", "n_words", 200, below=True),
    Rule("words_too_long", "word_chars", "n_words", 1500),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("no_stop_words", "n_stop_words", "n_words", 2, below=True),
    Rule("echoes", "n_echo_words", "n_words", 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
)


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row fails, as one expression."""
    checks = []
    for r in rules:
        part, limit = F.col(r.part) * 100, F.col(r.whole) * r.percent
        checks.append(F.when(part < limit if r.below else part > limit, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def _repeated(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more: windows sorted by (hash, place), equal neighbours, their places merged."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))

    return F.transform(F.array(pairs), lambda p: _covered(twice(p), width))[0]  # names the sorted windows once


def _covered(windows: Column, width: int) -> Column:
    places = F.sort_array(F.transform(windows, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**9)).alias("last"))
    return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])


def quality_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_echo_words, n_repeat_words), row by row.

    Words are [^\\x20\\x09-\\x0D]+. Null and empty texts count nothing.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = sorted({w for words in stop_words.values() for w in words})
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", F.filter(F.split("text", WORD_BREAK), lambda w: w != "").alias("ws"), F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    rows = rows.select("id", "n_symbols", F.size("ws").cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.filter("ws", lambda w: F.lower(w).isin(every))).cast("long").alias("n_stop_words"), F.size(F.filter("ws", lambda w, i: (i > 0) & (w == F.get("ws", i - 1)))).cast("long").alias("n_echo_words"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hw"))
    windows = F.when(F.size("hw") >= width, F.transform(F.sequence(F.lit(0), F.size("hw") - width), lambda i: F.xxhash64(*[F.get(F.col("hw"), i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("id", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_stop_words", "n_echo_words", windows.alias("h"))
    repeat = F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeated(F.col("h"), width)).otherwise(F.lit(0).cast("long"))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_echo_words", repeat.alias("n_repeat_words"))


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """One row per input row: the features, failed (names of rules), base_failed and kept.

    base_failed: fewer than least_words words, or over repeat_percent % of them in repeated windows. kept: neither that nor
    any rule. Null and empty texts fail the base. Repeated rows and null ids are judged row by row; other columns are
    ignored; an empty table gives none.
    """
    rows = quality_features(docs, id_col=id_col, text_col=text_col)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = rows.withColumns({"failed": failed_rules(rules), "base_failed": base})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
