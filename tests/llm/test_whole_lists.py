"""List levels: where an item ends without a blank line."""

from __future__ import annotations

import pytest

from loomstone.llm import sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("- a rope.\n- a lamp.\nThe shop is closed. It opens in May.", ["- a rope.", "- a lamp.", "The shop is closed.", "It opens in May."]),
        ("1. One.\n   - inner one.\n   - inner two.\nAfter it all. The end.", ["1. One.", "- inner one.", "- inner two.", "After it all.", "The end."]),
        ("- outer one:\n  - inner one.\n  Still the outer one. Yes.\nProse here. More.", ["- outer one:", "- inner one.", "Still the outer one. Yes.", "Prose here.", "More."]),
        # an item that isn't finished, or whose line is indented, goes on
        ("- a rope that is\nvery long.\n- a lamp. It is\n  old. Very old.", ["- a rope that is\nvery long.", "- a lamp. It is\n  old. Very old."]),
        ("- seen by Dr.\nMarlow in May.", ["- seen by Dr.\nMarlow in May."]),
    ],
)
def test_an_item_ends_where_its_level_does(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want
