"""Heuristic quality scores of a document, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import constants as K
from loomstone.functions import text as T


def ascii_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text)


def gates(text: Column, min_chars: int = 100, min_words: int = 20, min_ascii: float = 0.80) -> Column:
    """Cheap conditions before any score."""
    return (F.length(text) >= min_chars) & (F.size(T.tokens(text)) >= min_words) & (ascii_share(text) >= min_ascii)


def length_score(n: Column) -> Column:
    return F.when(n < 50, 0.2).when(n < 200, 0.5 + 0.3 * (n - 50) / 150).when(n <= 5000, 1.0).when(n <= 20000, 1.0 - 0.3 * (n - 5000) / 15000).otherwise(0.5)


def moments(lengths: Column) -> Column:
    """Number, mean and population deviation of an array of doubles, in one pass."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))

    def finish(a: Column) -> Column:
        n = F.greatest(F.lit(1), a["n"])
        mean = a["s"] / n
        return F.struct(a["n"].alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), a["q"] / n - mean * mean)).alias("deviation"))

    return F.aggregate(lengths, start, step, finish)


def word_counts(pieces: Column) -> Column:
    return F.transform(pieces, lambda s: F.size(T.tokens(s)).cast("double"))


def common_share(words: Column) -> Column:
    """Share of common words; they are told by one pattern over the joined words."""
    pattern = rf"(?<= )(?:{'|'.join(K.STOPWORDS)})(?= )"
    found = F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(pattern))
    return found / F.greatest(F.lit(1), F.size(words))


def capital_share(text: Column) -> Column:
    """Lines of more than 10 characters, and the share of them that begin with a capital or a digit."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: F.length(s) > 10)
    return moments(F.transform(lines, lambda s: s.rlike(r"^[\p{Lu}\p{Nd}]").cast("double")))


def diversity_score(c: Column) -> Column:
    """From different words over the root of all words."""
    return F.when(c < 2, 0.1).when(c < 4, 0.3 + 0.4 * (c - 2) / 2).when(c <= 20, 0.8 + 0.2 * F.least(F.lit(1.0), (c - 4) / 8)).otherwise(0.9)


def sentence_score(m: Column) -> Column:
    level = F.when(m["mean"] < 5, 0.3).when(m["mean"] < 10, 0.6).when(m["mean"] > 50, 0.5).otherwise(1.0)
    return F.when(m["n"] < 2, 0.3).otherwise(0.6 * level + 0.4 * F.least(F.lit(1.0), m["deviation"] / 8))


def paragraph_score(m: Column, n_words: Column) -> Column:
    several = F.when((m["mean"] >= 30) & (m["mean"] <= 200), 1.0).when(m["mean"] < 10, 0.4).otherwise(0.7)
    return F.when(m["n"] == 0, 0.2).when(m["n"] == 1, F.when(n_words > 200, 0.5).otherwise(0.7)).otherwise(several)


def naturalness_score(share: Column) -> Column:
    return F.when((share >= 0.30) & (share <= 0.60), 1.0).when((share >= 0.20) & (share < 0.30), 0.6).when(share < 0.20, 0.3).when(share <= 0.70, 0.7).otherwise(0.3)


def capital_score(m: Column) -> Column:
    return F.when(m["n"] == 0, 0.5).otherwise(F.least(F.lit(1.0), m["mean"] + 0.2))


def top_gram_share(words: Column, n: int = 3) -> Column:
    """Share of the most frequent run of ``n`` words: grams are sorted, and the longest run of equal ones counted."""
    size = F.size(words)
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)])))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, g: Column) -> Column:
        run = F.when(g == a["last"], a["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.when(size >= n, F.aggregate(grams, start, step)["most"] / (size - (n - 1)))


def repetition_score(share: Column, n_words: Column) -> Column:
    return F.when(n_words < 50, 0.7).when(share > 0.05, 0.2).when(share > 0.02, 0.6).otherwise(1.0)


def hits(text: Column, patterns: list[str], fold: bool = True) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(f"(?i){p}" if fold else p).cast("int")
    return total


def boilerplate_score(n: Column) -> Column:
    return F.when(n == 0, 1.0).when(n <= 2, 0.7).when(n <= 4, 0.4).otherwise(0.1)


def template_score(n: Column) -> Column:
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - 0.3 * n))


def clean_score(links: Column, n_words: Column) -> Column:
    density = links / F.greatest(F.lit(1), n_words) * 100
    return F.when(density < 0.5, 1.0).when(density < 2, 0.7).when(density < 5, 0.4).otherwise(0.1)


def scored(documents: DataFrame, text: str = "text") -> DataFrame:
    """All sub-scores and ``quality_score``; texts of fewer than 20 words score 0 and have no sub-scores."""
    t = F.col(text)
    keep = documents.columns
    # ``inline`` keeps what is measured once from being repeated in every expression that uses it
    counted = documents.select(*keep, F.inline(F.array(F.struct(T.words(t).alias("_w")))))
    w, n = F.col("_w"), F.size("_w")
    measures = F.struct(
        n.alias("n_words"),
        (F.size(F.array_distinct(w)) / F.sqrt(F.greatest(F.lit(1), n))).alias("_distinct"),
        moments(word_counts(T.sentences(t))).alias("_sentences"),
        moments(word_counts(T.paragraphs(t))).alias("_paragraphs"),
        common_share(w).alias("_common"),
        capital_share(t).alias("_capitals"),
        F.when(n >= 50, top_gram_share(w)).alias("_top"),
        hits(t, K.BOILERPLATE).alias("_boilerplate"),
        hits(t, K.TEMPLATES, fold=False).alias("_template"),
        (F.regexp_count(t, F.lit(K.URL)) + F.regexp_count(t, F.lit(K.EMAIL))).alias("_links"),
    )
    measured = counted.select(*keep, F.inline(F.array(measures)))
    c, n = F.col, F.col("n_words")
    parts = {
        "length": length_score(n),
        "diversity": diversity_score(c("_distinct")),
        "sentences": sentence_score(c("_sentences")),
        "paragraphs": paragraph_score(c("_paragraphs"), n),
        "naturalness": naturalness_score(c("_common")),
        "capitals": capital_score(c("_capitals")),
        "repetition": repetition_score(c("_top"), n),
        "boilerplate": boilerplate_score(c("_boilerplate")),
        "template": template_score(c("_template")),
        "clean": clean_score(c("_links"), n),
    }
    sub_scores = F.struct(*[F.when(n >= 20, v).alias(f"s_{k}") for k, v in parts.items()])
    found = measured.select(*keep, n, F.inline(F.array(sub_scores)))
    total = F.lit(0.0)
    for k, weight in K.WEIGHTS.items():
        total = total + weight * F.col(f"s_{k}")
    return found.withColumn("quality_score", F.when(F.col("n_words") < 20, 0.0).otherwise(F.round(total, 4)))
