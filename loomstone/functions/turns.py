"""Turns of a rendered conversation, and whether it is fit for training, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import constants as K
from loomstone.functions import text as T


def parse(text: Column) -> Column:
    """Array of (role, content): cut before each line that begins with a role label."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    pieces = F.split(F.regexp_replace(unix, r"(?m)^(User|Assistant): ?", "\u0001$1\u0002"), "\u0001")
    named = F.filter(pieces, lambda p: F.contains(p, F.lit("\u0002")))
    return F.transform(
        named,
        lambda p: F.struct(
            F.lower(F.substring_index(p, "\u0002", 1)).alias("role"),
            F.regexp_replace(F.substring_index(p, "\u0002", -1), r"\n+$", "").alias("content"),
        ),
    )


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"])), "\n")


def first_user(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^User: ?(.*?)(?:\nAssistant:|\z)", 1)


def defect(turns: Column, source: Column) -> Column:
    """The first reason against a conversation, or null: shape, identity, refusal, then per answer refusal_hedge or empty_turn, then truncated, length_mismatch, spam_grounded, evol_franken."""
    answers = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["content"])
    blob = F.array_join(F.transform(turns, lambda t: t["content"]), "\n")
    opening = lambda a: F.lower(F.regexp_replace(a, r"^[\"'*# ]+", ""))
    per_answer = F.transform(answers, lambda a: F.when(T.starts_with_any(opening(a), K.BAD_OPENINGS), "refusal_hedge").when(F.length(T.strip(a)) < 2, "empty_turn"))
    first_bad = F.try_element_at(F.filter(per_answer, lambda r: r.isNotNull()), F.lit(1))
    last = F.right(T.strip(F.try_element_at(answers, F.lit(-1))), F.lit(80))
    pairs = F.sequence(F.lit(2), F.size(turns))
    size = lambda c: F.size(T.tokens(c))
    mismatch = F.exists(
        F.when(F.size(turns) >= 2, pairs).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at(turns, i)["role"] == "assistant")
        & (size(F.element_at(turns, i - 1)["content"]) < 15)
        & (size(F.element_at(turns, i)["content"]) > 200)
        & ~F.element_at(turns, i - 1)["content"].rlike(K.WRITE_INTENT),
    )
    first = F.try_element_at(turns, F.lit(1))
    return (
        F.when((F.size(turns) == 0) | (first["role"] != "user") | (F.size(answers) == 0), "shape")
        .when(blob.rlike(K.IDENTITY), "identity")
        .when(T.contains_any(F.lower(blob), K.BAD_ANYWHERE), "refusal")
        .when(F.size(F.filter(per_answer, lambda r: r.isNotNull())) > 0, first_bad)
        .when(~last.rlike(K.END_OK), "truncated")
        .when(mismatch, "length_mismatch")
        .when((source == "instruct_ultrachat") & first["content"].rlike(K.SPAM_USER), "spam_grounded")
        .when((source == "instruct_wizardlm") & first["content"].rlike(K.GLUED_DOMAINS) & ~F.contains(F.left(F.lower(first["content"]), F.lit(60)), F.lit("code")), "evol_franken")
    )
