"""Statistics of batches against the same by regular expressions, text by text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import quality, textstats

_COMMON = {word: None for words in textstats.COMMON.values() for word in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKER = re.compile(r"\s*(?:[-*+•·▪◦‣●○■□➤►✓✔–—>]+|\[[ xX✓]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|#\d+|(?:step|item|no\.?|nr\.?)\s*\d+[.:)]?)\s+(?=\S)", re.I)
_END = re.compile(r"[.!?…。！？｡।॥؟۔][\"'”’»)\]」』\d\[]*\s*$")
_CASELESS = re.compile(r"[぀-ヿ一-鿿㐀-䶿฀-๿]")
_NUMBERS = re.compile(r"(?<!\S)[-+$€£(]?\d[\d.,:%/e+-]*[)%]?[,;|]?(?!\S)")
_LETTERED = re.compile(r"\S*?[^\W\d_]\S*")
_NO_LETTER = re.compile(r"[^\w\u0900-\u0e7f]+|[\d_]+")
_PUNCTUATION = re.compile(r"[^\w\s]+|_+")


def measure(text: str) -> dict[str, float]:
    """The statistics of one text by regular expressions."""
    lines = [x for x in text.splitlines() if x.strip()]
    tokens = text.split()
    words = _WORD.findall(text.lower())
    n, many = max(1, len(tokens)), max(1, len(lines))
    wide = len(_CASELESS.findall(text))
    common = [w for w in words if w in _COMMON]
    bare = [w.strip(".,;:!?()[]\"'«»“”") for w in tokens]
    phrases = Counter(zip(words, words[1:], words[2:], strict=False))
    return {
        "n_chars": len(text),
        "n_words": len(tokens) + wide // 2,
        "n_lines": len(lines),
        "word_length": sum(map(len, bare)) / n,
        "symbol_ratio": (text.count("#") + text.count("...") + text.count("…")) / n,
        "letter_share": (len(text) - sum(map(len, _NO_LETTER.findall(text)))) / max(1, len(text)),
        "punctuation_ratio": sum(map(len, _PUNCTUATION.findall(text))) / max(1, len(text)),
        "bullet_share": sum(bool(_MARKER.match(x)) for x in lines) / many,
        "ellipsis_share": sum(x.rstrip().endswith(("...", "…")) for x in lines) / many,
        "ending_share": sum(bool(_END.search(x)) for x in lines) / many,
        "lettered_share": len(_LETTERED.findall(text)) / n,
        "number_share": len(_NUMBERS.findall(text)) / n,
        "common_share": len(common) / max(1, len(words)),
        "common_kinds": len(set(common)),
        "repeated_lines": 1 - len({x.strip() for x in lines}) / many,
        "top_phrase": max(phrases.values(), default=0) * 3 / max(1, len(words)) if len(words) >= 12 else 0.0,
        "wide_share": wide / max(1, len(text)),
    }


def compare(texts):
    got = textstats.statistics(texts)
    for i, text in enumerate(texts):
        want = measure(text)
        for name, value in want.items():
            assert got[name][i] == pytest.approx(value), (name, text)


def test_statistics_of_a_table_equal_those_of_each_text(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/quality.parquet").collect()]
    compare(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aThe 12.,-*)(\n\t|#…\"'’ «é文。กЖ_:=<>"), max_size=60), min_size=1, max_size=5))
def test_statistics_of_odd_texts(texts):
    compare(texts)


def test_a_text_is_judged_the_same_beside_any_others():
    texts = ["- a\n- b\n- c", None, "", "x" * 300, "The mill was quiet in the evening, and nobody in the town knew why.", "😀 \ud800 <td> <", "a;b;c\n1;2;3\n4;5;6"]
    together = quality.judge(texts)
    for i, text in enumerate(texts):
        assert [x[0] for x in quality.judge([text])[:3]] == [x[i] for x in together[:3]]


def test_failed_rules_hold_the_reason_and_the_published_rules():
    classes, reasons, failed, _ = quality.judge(["- a\n- b\n- c\n- d", "word " * 40])
    assert classes == ["list", "junk"] and reasons == ["markers", "same_words"]
    assert {"words", "bullets", "endings", "markers"} <= set(failed[0]) and {"words", "repeated", "endings", "same_words"} <= set(failed[1])
    assert np.isin(failed[0], [name for name, _, _ in quality.RULES]).all()
