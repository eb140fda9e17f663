"""Text statistics for each document, fixed-threshold rules, and a class that tells prose from lists, tables and junk.

Statistics are array operations over a batch of texts (``textstats``). Two sets of
rules with fixed thresholds are applied to them: the published rules for web
corpora (word count, mean word length, symbols per word, bulleted and ellipsis
lines, words with a letter, common words, lines ending in punctuation, repeated
lines and phrases), and rules for the layout or content that makes a text a table,
a list or junk. Every rule that fails leaves its name; the class is that of the
first rule in the list that has one and fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import textstats
from loomstone.llm.wordgrams import chunks

PAGE_CHARS = 1 << 17
"""Characters handled at once; bounds the worker's memory, not the result."""
# Thresholds of the published rules.
PUBLISHED = {"words": (50, 100_000), "word_length": (3.0, 10.0), "symbols": 0.1, "bullets": 0.9, "ellipses": 0.3, "lettered": 0.8, "common": 2, "endings": 0.12, "repeated": 0.3}

Stats = dict[str, np.ndarray]


def _native(m: Stats) -> np.ndarray:
    return m["wide_share"] > 0.2


def _bare(m: Stats) -> np.ndarray:
    """Hardly a letter in it."""
    return (m["words"] == 0) | (m["letter_solid_share"] < 0.15)


def _figures(m: Stats) -> np.ndarray:
    """Figures in lines, or cells between delimiters."""
    return (m["tokens"] >= 6) & (m["numeric_share"] > 0.6) & (m["n_lines"] >= 3) | (m["all_delimited"] > 0)


def _readable(m: Stats) -> np.ndarray:
    """Letters, and not the mark-up of a table."""
    return ~_bare(m) & ~_markup_table(m)


def _markup_table(m: Stats) -> np.ndarray:
    return (m["cell_lines"] > 0) & (m["all_cell_tags"] >= 4)


def _dense(m: Stats) -> np.ndarray:
    """One long run of characters after another."""
    return _readable(m) & (m["wide_share"] == 0) & (m["solid_chars"] >= 40) & (m["word_length"] > 20) & (m["links"] == 0)


def _unmarked_lines(m: Stats) -> np.ndarray:
    """Short lines that are no sentences and don't run on into each other."""
    loose = (m["body_ending_share"] <= 0.15) & ((m["common_share"] < 0.3) | (m["runs_on_share"] < 0.2))
    closed = (m["body_ending_share"] >= 0.8) & (m["common_share"] < 0.25) & (m["tokens_per_line"] <= 5)
    spaced = (m["short_share"] >= 0.8) & (m["body_inner_share"] <= 0.1) & (loose | closed)
    return (m["body_lines"] >= 4) & np.where(m["body_wide"] > 0, m["short_wide_share"] >= 0.8, spaced)


def _enumerated(m: Stats) -> np.ndarray:
    """Running lines that only enumerate."""
    small = np.where(m["body_wide"] > 0, m["small_wide_part_share"] >= 0.85, (m["small_part_share"] >= 0.85) & (m["part_tokens"] <= 4.5))
    return (m["parts"] >= 6) & (m["part_stops"] * 6 <= 1) & small


def _shuffled(m: Stats) -> np.ndarray:
    """Words of prose in no order: articles before words that can't follow one, or hardly a common word between the others."""
    running = (m["words"] >= 12) & (m["wide_share"] <= 0.1) & (m["own_chars"] == 0)
    wrong = (m["articles"] >= 3) & (m["wrong_articles"] >= 0.3)
    heap = (m["common_share"] < 0.24) & (m["articles"] < 0.01 * m["words"]) & (m["n_words"] >= 20) & (m["longest_line"] >= 8)
    return running & (wrong | heap)


RULES: list[tuple[str, str | None, Callable[[Stats], np.ndarray]]] = [
    # published
    ("words", None, lambda m: (m["n_words"] < PUBLISHED["words"][0]) | (m["n_words"] > PUBLISHED["words"][1])),
    ("word_length", None, lambda m: ~_native(m) & ((m["word_length"] < PUBLISHED["word_length"][0]) | (m["word_length"] > PUBLISHED["word_length"][1]))),
    ("symbols", None, lambda m: m["symbol_ratio"] > PUBLISHED["symbols"]),
    ("bullets", None, lambda m: m["bullet_share"] > PUBLISHED["bullets"]),
    ("ellipses", None, lambda m: m["ellipsis_share"] > PUBLISHED["ellipses"]),
    ("lettered", None, lambda m: m["lettered_share"] < PUBLISHED["lettered"]),
    ("common", None, lambda m: ~_native(m) & (m["common_kinds"] < PUBLISHED["common"])),
    ("endings", None, lambda m: m["ending_share"] < PUBLISHED["endings"]),
    ("repeated", None, lambda m: (m["repeated_lines"] > PUBLISHED["repeated"]) | (m["top_phrase"] > PUBLISHED["repeated"])),
    # of the classes, in the order in which they decide
    ("rows", "table", lambda m: (m["row_share"] > 0.5) & ((m["body_lines"] >= 2) | (m["cell_lines"] > 0)) & ((m["letter_share"] > 0.02) | (m["tokens"] >= 3 * m["body_lines"]))),
    ("garbled", "junk", lambda m: ~_markup_table(m) & (m["odd_share"] > 0.25)),
    ("no_letters", "junk", lambda m: ~_markup_table(m) & _bare(m) & ~_figures(m)),
    ("encoded", "junk", lambda m: _readable(m) & (m["tokens"] >= 8) & (m["word_length"] <= 10) & (m["hex_share"] > 0.85) & (m["hex_letters"] > 0.2)),
    ("dense", "junk", _dense),
    ("tags", "junk", lambda m: _readable(m) & (m["angles"] > 0) & (m["untagged_share"] < 0.35)),
    ("script", "junk", lambda m: _readable(m) & (m["open_braces"] > 0) & (m["code_share"] > 0.12)),
    ("same_words", "junk", lambda m: _readable(m) & (m["tokens"] >= 12) & (m["wide_share"] < 0.2) & ((m["token_kinds"] < 0.2) | (m["repeated_pairs"] > 0.75))),
    ("same_lines", "junk", lambda m: _readable(m) & (m["n_lines"] >= 5) & (m["repeated_lines"] > 0.6)),
    ("same_runs", "junk", lambda m: _readable(m) & _native(m) & (m["solid_chars"] >= 60) & (m["wide_kinds"] < 0.2)),
    ("menu_words", "junk", lambda m: _readable(m) & (m["words"] >= 4) & (m["menu_share"] > 0.6)),
    ("menu_cells", "junk", lambda m: _readable(m) & (m["cells"] >= 6) & (m["n_lines"] <= 3) & (m["small_cell_share"] > 0.9) & (m["separators"] >= 5) & (m["number_share"] < 0.2) & (m["bullet_share"] < 1) & (m["menu_cell_share"] > 0.25)),
    ("mashed", "junk", lambda m: _readable(m) & (m["latin"] >= 5) & (m["latin_share"] > 0.6) & (m["clumsy_share"] > 0.3) & (m["common_share"] < 0.15)),
    ("delimited", "table", lambda m: m["same_delimiter"] > 0),
    ("cell_tags", "table", lambda m: m["cell_tags"] >= 4),
    ("contents", "list", lambda m: (m["leaders"] >= 3) & (m["leader_share"] > 0.5)),
    ("markers", "list", lambda m: (m["marked_lines"] >= 2) & (m["marked_share"] > 0.5)),
    ("unmarked_lines", "list", _unmarked_lines),
    ("enumeration", "list", _enumerated),
    ("shuffled", "junk", _shuffled),
]
STATISTICS = "n_chars n_words n_lines word_length symbol_ratio letter_share punctuation_ratio bullet_share ellipsis_share ending_share lettered_share number_share common_share common_kinds repeated_lines top_phrase wide_share".split()
"""The statistics that ``assess`` returns; rules use further ones."""


def judge(texts: list[str | None]) -> tuple[list[str | None], list[str | None], list[list[str] | None], Stats]:
    """Class, reason and failed rules of each text, and its statistics; all null where a text is null or has nothing to see."""
    m = textstats.statistics([t or "" for t in texts])
    seen = np.array([t is not None for t in texts]) & (m["seen_chars"] > 0)
    fails = [(name, kind, test(m) & seen) for name, kind, test in RULES]
    classes: list[str | None] = ["prose" if s else None for s in seen]
    reasons: list[str | None] = [None] * len(texts)
    failed: list[list[str] | None] = [[] if s else None for s in seen]
    for name, kind, hit in fails:
        for i in np.flatnonzero(hit).tolist():
            failed[i].append(name)
            if kind and reasons[i] is None:
                classes[i], reasons[i] = kind, name
    return classes, reasons, failed, m | {"seen": seen}


def assess(texts: DataFrame, key: str = "text_id", text: str = "text", statistics: bool = True) -> DataFrame:
    """``key``, ``text_class``, ``reason``, ``failed`` rules and, if wanted, the statistics of each text.

    Null, empty and blank texts have a row of nulls; repeated texts are assessed
    under each id; null ids are kept; other columns are ignored. One pass without
    a shuffle, over whole texts.
    """
    kind = dict(texts.dtypes)[key]
    names = STATISTICS if statistics else []
    schema = ", ".join([f"id {kind}", "text_class string", "reason string", "failed array<string>", *(f"{name} double" for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for begin, part in chunks(batch.column("text").to_pylist(), PAGE_CHARS):
                classes, reasons, failed, m = judge(part)
                columns = [ids.slice(begin, len(part)), pa.array(classes, pa.string()), pa.array(reasons, pa.string()), pa.array(failed, pa.list_(pa.string()))]
                columns += [pa.array(m[name].astype(np.float64), mask=~m["seen"]) for name in names]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_class", "reason", "failed", *names])

    return texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", key)
