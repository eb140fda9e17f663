"""Checks of model output against what an evaluation item expects: 1, 0, or null where nothing can be said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import constants as K
from loomstone.functions import text as T
from loomstone.functions.quality import top_gram_share


def _one(condition: Column) -> Column:
    return condition.cast("int")


def contains(output: Column, keywords: Column) -> Column:
    low = T.strip(F.lower(output))
    return _one(F.exists(keywords, lambda k: F.contains(low, T.strip(F.lower(k)))))


def number(output: Column, expected: Column) -> Column:
    """The expected number stands by itself; commas between digits don't count."""
    plain = F.regexp_replace(output, r"(?<=\d),(?=\d)", "")
    return _one(F.regexp_like(plain, F.concat(F.lit(r"(?<![\d.])"), F.regexp_replace(expected, r"([.\-+])", r"\\$1"), F.lit(r"(?!\d)"))))


def item_count(output: Column) -> Column:
    """Listed lines, or else the parts of the first sentence."""
    lines = F.size(F.regexp_extract_all(output, F.lit(r"(?m)^[ \t]*(?:\d+[.)][ \t]*|[-*•][ \t]*)([^\n]+)$"), F.lit(0)))
    first = F.regexp_replace(F.element_at(F.split(output, r"[.!?\n]"), 1), r"(?i)\band\b", ",")
    first = F.when(F.contains(first, F.lit(":")), F.regexp_replace(first, r"^[^:]*:", "")).otherwise(first)
    parts = F.size(F.filter(F.split(first, ","), lambda p: T.strip(p) != ""))
    return F.when(lines >= 2, lines).otherwise(parts)


def count(output: Column, n: Column, keywords: Column) -> Column:
    low = T.strip(F.lower(output))
    return _one((item_count(output) == n) & F.forall(keywords, lambda k: F.contains(low, T.strip(F.lower(k)))))


def word_limit(output: Column, most: Column) -> Column:
    return _one(F.size(T.tokens(output)) <= most)


def yes_no(output: Column, expected: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(F.lower(output), r"(\S+)", 1), r"[^a-z]", "")
    return _one(first == expected)


def multi(output: Column, parts: Column) -> Column:
    low = T.strip(F.lower(output))
    return _one(F.forall(parts, lambda p: (F.size(p) == 0) | F.exists(p, lambda k: F.contains(low, T.strip(F.lower(k))))))


def numbers(output: Column) -> Column:
    return F.regexp_extract_all(F.replace(output, F.lit(","), F.lit("")), F.lit(r"-?\d+"), F.lit(0))


def math(output: Column, expected: Column) -> Column:
    return _one(F.array_contains(numbers(output), expected))


def instruction(output: Column, n: Column) -> Column:
    """At least ``n`` different items of two characters or more."""
    parts = F.transform(F.split(F.lower(output), r",|\band\b|\n|;|\d+\.|•|\*"), T.strip)
    return _one(F.size(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2))) >= n)


def repetition(output: Column) -> Column:
    """Share of the most frequent three-word run; 0 below six words."""
    words = F.regexp_extract_all(F.lower(output), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(words) < 6, 0.0).otherwise(top_gram_share(words))


def refused(output: Column) -> Column:
    return T.contains_any(F.lower(output), K.REFUSAL_PHRASES)


def essay(output: Column, keywords: Column) -> Column:
    low = F.lower(output)
    on_topic = F.size(F.filter(keywords, lambda k: F.contains(low, k))) >= 2
    return _one((F.size(T.tokens(output)) >= 18) & on_topic & (repetition(output) < 0.16) & ~refused(output))


def conversation(output: Column) -> Column:
    return _one((F.size(T.tokens(output)) >= 3) & ~refused(output) & (repetition(output) < 0.22))


def flags(output: Column, n_new: Column, kind: Column) -> dict[str, Column]:
    low = T.strip(F.lower(output))
    return {
        "hedge": _one(T.starts_with_any(low, K.HEDGES)),
        "identity": _one(T.contains_any(low, K.IDENTITY_MARKS)),
        "fake_dialogue": _one(output.rlike(K.SPEAKER)),
        "mojibake": _one(T.contains_any(output, ["â€", "�"])),
        "verbose": _one((n_new > 120) & kind.isin("contains", "number", "yesno", "count")),
    }


def graded(output: Column, keywords: Column) -> Column:
    """0 for nothing, a bad mark or leaked labels; 2 for a keyword or a sound answer where none is expected; else 1."""
    low = F.lower(output)
    short = output.isNull() | (F.length(output) < 5) | T.contains_any(low, K.BAD_MARKS)
    hit = F.exists(keywords, lambda k: F.contains(low, F.lower(k)))
    leaked = (F.size(T.tokens(output)) < 3) | F.contains(low, F.lit("assistant:")) | F.contains(low, F.lit("user:"))
    return F.when(short, 0).when(F.size(keywords) > 0, F.when(hit, 2).otherwise(1)).when(leaked, 0).otherwise(2)


def rescued(output: Column, keywords: Column, most_words: int = 80) -> Column:
    """Partial credit by expected words: 2 for two (or all), 1 for one, 0 for none, a bad mark or too many words."""
    low = F.lower(output)
    found = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    bad = output.isNull() | (output == "") | T.contains_any(low, K.BAD_MARKS) | (F.size(T.tokens(output)) > most_words)
    return F.when(bad, 0).when(found >= F.least(F.lit(2), F.size(keywords)), 2).when(found == 1, 1).otherwise(0)


def prefix_match(output: Column, target: Column, window: int = 20) -> Column:
    first = F.regexp_extract(output, r"(\S+)", 1)
    return _one((first == target) | F.contains(F.left(output, F.lit(window)), target))
