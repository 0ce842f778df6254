"""Column functions over text: normal forms, script ratios, pattern hits, numerals, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the Han script, with Extension A (fixed range).
HAN = r"㐀-䶿一-鿿"
#: Marks that end a sentence, and marks that end a clause (fixed values).
FINAL_MARKS = "。！？!?…"
CLAUSE_MARKS = "，,、；;：:"
EDGE_MARKS = r"[\s。！？!?…，,；;：:]+"


def normal_key(text: Column) -> Column:
    """Han, ASCII letters and digits alone, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^一-鿿A-Za-z0-9]+", ""))


def letters_key(text: Column) -> Column:
    """Letters and numbers of any script, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def script_share(text: Column, chars: str) -> Column:
    """The share of characters in a class; an empty text has 0."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(f"[{chars}]")) / F.greatest(F.lit(1), F.length(t))


def first_hit(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), F.lit(""))


def all_hits(text: Column, pattern: str) -> Column:
    """All matches in order of first appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def count_of(text: Column, word: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    if not word:
        raise ValueError("an empty word can't be counted")
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def sentences(text: Column) -> Column:
    """Pieces between final marks or line ends, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[。！？!?；;.\n]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def clock_seconds(text: Column) -> Column:
    """[hh:]mm:ss[.,]fff as seconds; null if it isn't one."""
    p = r"^\s*(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+))?\s*$"
    part = lambda k: F.coalesce(F.expr("null").cast("double") if k is None else F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("double"), F.lit(0.0))
    fraction = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(text, p, 4), F.lit(""))).cast("double"), F.lit(0.0))
    return F.when(text.rlike(p), part(1) * 3600 + part(2) * 60 + part(3) + fraction)


def clock_text(seconds: Column) -> Column:
    """m:ss.ss of seconds."""
    whole = F.floor(seconds / 60)
    return F.concat(whole.cast("string"), F.lit(":"), F.lpad(F.format_string("%.2f", seconds - whole * 60), 5, "0"))


def clean_markup(text: Column) -> Column:
    """Without tags, override blocks and hard breaks, white space closed up."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")
    t = F.regexp_replace(t, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"\\[Nn]", "")
    return F.regexp_replace(t, r"\s+", "")


def replace_terms(text: Column, fixes: list[tuple[str, str]]) -> Column:
    """Patterns replaced one after the other."""
    out = F.coalesce(text, F.lit(""))
    for pattern, into in fixes:
        out = F.regexp_replace(out, pattern, into)
    return out


def join_parts(left: Column, right: Column) -> Column:
    """Two parts with a comma between, unless one is empty or marks adjoin."""
    a, b = F.regexp_replace(left, r"[ ，,]+$", ""), F.regexp_replace(right, r"^[ ，,]+", "")
    marks = r"[，,。！？!?；;：:]"
    return F.when(a == "", b).when(b == "", a).when(a.rlike(marks + "$") | b.rlike("^" + marks), F.concat(a, b)).otherwise(F.concat(a, F.lit("，"), b))


def safe_stem(text: Column, limit: int = 80) -> Column:
    """A file stem: forbidden characters as _, edges trimmed, cut to a limit; empty becomes `output`."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    t = F.substring(F.regexp_replace(t, r"^[ ._]+|[ ._]+$", ""), 1, limit)
    return F.when(t == "", F.lit("output")).otherwise(t)


def numeral_text(number: Column) -> Column:
    """Chinese numerals of 0 to 999; larger numbers keep their digits."""
    digit = lambda n: F.substring(F.lit("零一二三四五六七八九"), n.cast("int") + 1, F.lit(1).cast("int"))
    tens, ones = F.floor(number / 10) % 10, number % 10
    tail = F.when(ones > 0, digit(ones)).otherwise("")
    below = F.when(tens == 0, digit(ones)).when((tens == 1) & (number < 20), F.concat(F.lit("十"), tail)).otherwise(F.concat(digit(tens), F.lit("十"), tail))
    rest = number % 100
    over = F.concat(digit(F.floor(number / 100)), F.lit("百"), F.when(rest == 0, "").when(rest < 10, F.concat(F.lit("零"), digit(rest))).when(rest < 20, F.concat(F.lit("十"), tail)).otherwise(F.concat(digit(tens), F.lit("十"), tail)))
    return F.when(number < 100, below).when(number < 1000, over).otherwise(number.cast("string"))


def numerals(text: Column) -> Column:
    """Runs of digits below 1000 as Chinese numerals."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.when(F.length(r) <= 9, numeral_text(F.expr("0").cast("long") + F.try_to_number(r, F.lit("999999999")).cast("long"))).otherwise(r)).otherwise(r)), "")


def shared_characters(left: Column, right: Column) -> Column:
    """Characters of left that right has too, each as often as both have it, over the length of left."""
    chars = F.filter(F.split(left, ""), lambda c: c != "")
    least = F.aggregate(F.array_distinct(chars), F.lit(0), lambda a, c: a + F.least(F.length(left) - F.length(F.replace(left, c, F.lit(""))), F.length(right) - F.length(F.replace(right, c, F.lit("")))))
    return F.when(F.length(left) > 0, least / F.length(left)).otherwise(0.0)


def character_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, in one pass over the characters."""
    chars = F.split(text, "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def epoch_seconds(value: Column) -> Column:
    """Epoch of unknown unit as seconds: over 1e10 it is finer by a thousand, again and again."""
    return F.when(value > 1e16, value / 1e9).when(value > 1e13, value / 1e6).when(value > 1e10, value / 1e3).otherwise(value)


def utc_text(at: Column) -> Column:
    """A time as UTC to the second, whatever the session's zone: 2024-05-01T08:00:00+00:00; null stays null."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def target_range(text: Column, low: float = 70.0, high: float = 90.0) -> Column:
    """`min-max` as a struct; anything else has the default."""
    parts = F.split(F.coalesce(text, F.lit("")), "-")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    good = (F.size(parts) == 2) & (a > 0) & (b >= a)
    return F.when(good, F.struct(a.alias("low"), b.alias("high"))).otherwise(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))


def section_list(text: Column) -> Column:
    """`role:1,2;role:3` as an array of (role, ids); ASCII or full-width marks; malformed parts are left out."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[;；]"), lambda p: p.rlike(r"^\s*[^:：\s]+\s*[:：].*\d"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*([^:：\s]+)\s*[:：]", 1).alias("role"), F.transform(F.regexp_extract_all(F.regexp_replace(p, r"^[^:：]*[:：]", ""), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("ids")))
