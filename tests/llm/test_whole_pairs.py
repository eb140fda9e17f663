"""Whole answers are judged, and each defect by its own votes."""

from __future__ import annotations

from collections import Counter

import pytest

from loomstone.llm import pairs

SOUND = ("What do you think of the weather today?", "It is fine. The sun is out and the wind is from the north.")
LONG = "You ask about the quarry near the harbour, who dug it, when it was closed and what became of its stones. " * 8


def labels(question, answer):
    votes = pairs.vote(question, answer)[0]
    found = set()
    for name in pairs.DEFECTS:
        counts = Counter({pairs.vote(*SOUND)[0][name]: 1000})
        counts[votes[name]] += 1
        if pairs.fit(dict(counts), pairs.LABELLERS[name])[votes[name]] > pairs.CUTOFFS[name]:
            found.add(name)
    return found


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (LONG + "I'm sorry, but I can't help with that.", {"refusal"}),
        (f'"{LONG.strip()}" I cannot answer that.', {"refusal"}),
        ("I'm sorry, but I can't help with that. " + LONG.strip(), {"refusal"}),
        (LONG + 'Its owner said: "I cannot help you with that."', set()),
        (LONG + "No stone was left there.", set()),
        # only between the rest: one vote against, which the model weighs
        (LONG + "I cannot give the year of every stone. " + LONG.strip(), None),
    ],
)
def test_refusal_wording_counts_wherever_it_stands(answer, want):
    votes = pairs.vote("Who dug the quarry?", answer)[0]["refusal"]
    if want is None:
        assert dict(zip(pairs.LABELLERS["refusal"], votes, strict=True)) == {"wording": 1, "first_person": 1, "apology": 0, "brevity": -1, "place": -1}
    else:
        assert labels("Who dug the quarry?", answer) == want


QUESTION = "Why did the town sell the old stone mill by the river in 1880, and who among the people of the valley was against it at that time?"


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("Tell me about the quarry.", "I'm sorry, but I can't help with the quarry because it", {"refusal", "truncated"}),
        (QUESTION, QUESTION[:110].rsplit(" ", 1)[0], {"copied", "truncated"}),
        (QUESTION, QUESTION, {"copied"}),
        (QUESTION, QUESTION.upper().replace(",", "").replace("?", ""), {"copied"}),
    ],
)
def test_one_defect_does_not_silence_another(question, answer, want):
    assert labels(question, answer) == want
