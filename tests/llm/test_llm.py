"""Each operator against brute force, exact round trips or labelled fixtures, and on odd input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import components, conversations, leakage, mixing, neardup, packing, pairs, quality, sentences, tokens, wordgrams

WORD = re.compile(r"[^\W_]+")
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- words and leaks


def test_word_hashes_depend_on_the_word_only():
    a, _ = wordgrams.words(["one two", "", None, "zwei ein_drei"])
    b, owner = wordgrams.words(["xx Two; ONE", "drei"])
    assert a[0] == b[2] and a[1] == b[1] and a[-1] == b[3]
    assert owner.tolist() == [0, 0, 0, 1] and len(set(a.tolist())) == len(a)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d e".split()), min_size=0, max_size=60), st.integers(6, 20), st.integers(0, 50))
def test_every_run_long_enough_is_found(filler, n, at):
    item = [f"w{i}" for i in range(n)]
    need = n if n < 8 else max(8, (n + 1) // 2)
    run = item[: need]
    text = " ".join(filler[:at] + run + filler[at:])
    index = leakage.index_items(["x", "y"], [" ".join(item), "what is the capital of nowhere"])
    assert leakage.leaks([text], index)[0].tolist() == [0]
    short = " ".join(filler[:at] + run[:-1] + filler[at:])
    assert leakage.leaks([short], index)[0].tolist() == []


def test_leaks_ignore_markup_and_accents(spark):
    corpus = spark.createDataFrame([(1, "User: What&nbsp;is the <b>Cápi​tal</b> of NOWHERE!", "t", 1), (2, None, "t", 1), (3, "", "t", 1), (4, "what is the capital of", "t", 1)], "rec_id long, text string, prompt string, id int")
    tests = spark.createDataFrame([("a", "What is the capital of Nowhere?  "), ("b", None), ("c", " ")], "id string, prompt string")
    assert rows(leakage.find_leaks(corpus, tests)) == [(1, "a")]
    assert rows(leakage.find_leaks(corpus.limit(0), tests)) == []
    assert rows(leakage.find_leaks(corpus, tests.limit(0))) == []


def test_items_in_many_blocks_leak_the_same(spark, monkeypatch):
    corpus, tests = spark.read.parquet(f"{SF}/download_instruct.parquet"), spark.read.parquet(f"{SF}/battery_prompts.parquet")
    near = rows(leakage.find_leaks(corpus, tests))
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 8000)
    assert near and rows(leakage.find_leaks(corpus, tests)) == near


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_words_of_items_are_counted_folded_whatever_the_block(spark, monkeypatch, block):
    """An entity is no word, a word with accents is one; both decide the run that counts."""
    monkeypatch.setattr(leakage, "BLOCK_BYTES", block)
    corpus = spark.createDataFrame([(1, "say hello"), (2, "what is the capital of nowhere"), (3, "what is the capital")], "rec_id long, text string")
    tests = spark.createDataFrame([("a", "&quot;hello&quot;"), ("b", "what is the ca\u0301pital of <b>nowhere</b>")], "id string, prompt string")
    assert rows(leakage.find_leaks(corpus, tests)) == [(1, "a"), (2, "b")]


def test_a_short_item_leaves_the_windows_of_others_as_they_are():
    long = [" ".join(f"w{i}_{j}" for j in range(20)) for i in range(3)]
    index = leakage.index_items(["s", "a", "b", "c"], ["hello", *long])
    assert [(c.gram, c.window) for c in index.classes] == [(1, 1), (4, 17)]
    at, item = leakage.leaks(["hello " + long[1], "nothing"], index)
    assert list(zip(at.tolist(), item.tolist(), strict=True)) == [(0, 0), (0, 2)]


def test_hits_taken_in_parts_are_the_same(monkeypatch):
    texts = [" ".join(["what is the capital of", f"place{i}", "and why is it there"]) for i in range(40)]
    index = leakage.index_items([str(i) for i in range(40)], texts)
    want = leakage.leaks(texts, index)
    monkeypatch.setattr(leakage, "HITS", 7)
    got = leakage.leaks(texts, index)
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and len(want[0]) >= 40


# --- components and near duplicates


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500)] + [(draw.randrange(1000, 1080), draw.randrange(1000, 1080)) for _ in range(45)]
    df = spark.createDataFrame([*edges, (None, 3), (7, None), (1, 0)], "a long, b long")
    assert dict(rows(components.connected_components(df, "a", "b"))) == brute_components(edges)
    assert rows(components.connected_components(df.limit(0), "a", "b")) == []


def brute_groups(records):
    sets = {}
    for key, text in records:
        w = WORD.findall((text or "").lower())
        if w:
            sets[key] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9]
    return sorted((g, k) for k, g in brute_components(links).items())


def test_near_duplicates_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/download_instruct.parquet")
    want = brute_groups([(r.rec_id, r.text) for r in df.collect()])
    assert want and rows(neardup.near_duplicates(df)) == want


def test_near_duplicates_of_large_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ALL_PAIRS", 4)
    base = [f"v{i}" for i in range(40)]
    records = [(i, " ".join(base[:38] + [f"x{i}", f"y{i}"])) for i in range(30)] + [(100 + i, " ".join(base[:30] + [f"z{i}{j}" for j in range(30)])) for i in range(12)]
    records += [(200, "two words"), (201, "Two  words"), (202, None), (203, "  "), (204, "long " * 50_000), (205, "long " * 49_000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in records] + [(None, "two words", "x")], "rec_id long, text string, id string")
    assert rows(neardup.near_duplicates(df)) == brute_groups(records)
    assert rows(neardup.near_duplicates(df.limit(0))) == []


# --- conversations


def chat_tables(spark, messages, chats=("c1",)):
    m = spark.createDataFrame(messages, "id long, chat_id string, role string, content string, created_at double")
    return m, spark.createDataFrame([(c, "t") for c in chats], "id string, role string")


def test_conversations_are_ordered_cleaned_and_validated(spark):
    messages = [
        (5, " C1\n", "AI", "hello ", 1.7e12 + 9000),
        (2, "c1", "Human", "hi", 1.7e9),
        (9, "c1", "user", "hi ", 1.7e9 + 4),
        (1, "c1", "user ", "hi", 1.7e9 + 8),
        (3, "c1", "System", "short", (1.7e9 - 5) * 1e6),
        (10, "c2", "user", "x", 1.0), (11, "c2", "assistant", "Error: generation failed (code 503)", 2.0),
        (12, "c3", "user", "x", 1.0), (13, "c3", "user", "y", 2.0), (14, "c3", "assistant", "z", 3.0),
        (15, "c4", "user", "x", None), (16, "c4", "assistant", "y", 2.0),
        (17, "c5", "tool_x", "x", 1.0), (18, "c5", "assistant", "y", 2.0),
        (19, None, "user", "x", 1.0), (20, "nochat", "user", "x", 1.0), (21, "nochat", "assistant", "x", 2.0),
        (22, "c6", "user", "same", 5.0), (23, "c6", "assistant", "Error: the file is not there, so begin again.", 5.0),
    ]
    m, c = chat_tables(spark, messages, ("c1", "c2", "c3", "c4", "c5", "c6", "c1"))
    found = conversations.rebuild(m, c).select("chat_id", "turn_no", "message_id")
    assert rows(found) == [("c1", 1, 3), ("c1", 2, 1), ("c1", 3, 5), ("c6", 1, 22), ("c6", 2, 23)]
    assert rows(conversations.rebuild(m.limit(0), c)) == rows(conversations.rebuild(m, c.limit(0))) == []


def test_links_bring_back_rows_without_a_chat(spark):
    m, c = chat_tables(spark, [(1, "c1", "user", "a", 1.0), (2, None, "assistant", "b", 2.0), (3, None, "user", "c", 3.0), (4, "C1", "assistant", "d", 4.0), (5, None, "user", "stray", 5.0)])
    links = spark.createDataFrame([(2, 1), (3, 2)], "message_id long, refers_to long")
    assert [r[2] for r in rows(conversations.rebuild(m, c, links).select("chat_id", "turn_no", "message_id"))] == [1, 2, 3, 4]
    assert [r[2] for r in rows(conversations.rebuild(m, c).select("chat_id", "turn_no", "message_id"))] == [1, 4]


# --- text classes


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The mill was quiet in the evening, and nobody in the town knew why. It had been sold to a man from the north.", "prose"),
        ("THE MILL WAS QUIET IN THE EVENING, AND NOBODY IN THE TOWN KNEW WHY IT HAD BEEN SOLD.", "prose"),
        ("They packed these things:\n- two ropes\n- a red lamp\n- nine candles\n- bread", "list"),
        ("ropes, red lamps, nine candles, bread, old maps, salt, iron nails, blankets, oil", "list"),
        ("name;size;year\nmill;12;1880\nbridge;40;1902\ntower;7;1750", "table"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"),
        ("step=1 loss=3.2 lr=1e-4\nstep=2 loss=3.1 lr=1e-4\nstep=3 loss=2.9 lr=1e-4", "table"),
        ("Home | Login | Search | Cart | Help | Next | Previous | Menu", "junk"),
        ("xkcdqw zrtpl mnbvc qwrtz plkjh xcvbn tzrwq ghjkl bnmxc wrtzp", "junk"),
        ("8f0a 33bc 91de 77af 10cc 9be1 44fa 02dd 8a1b 6c7d", "junk"),
        ("######\n------\n======\n******", "junk"),
        (None, None),
        ("  \n​", None),
    ],
)
def test_text_classes(text, want):
    assert quality.judge(["x", text, None])[0][1] == want


def test_assess_keeps_rows_and_records_reasons(spark):
    df = spark.createDataFrame([(1, "a " * 100_000, "x"), (2, None, "x"), (None, "- a\n- b\n- c\n- d", "x")], "text_id long, text string, reason string")
    found = {r.text_id: r for r in quality.assess(df).collect()}
    assert found[1].text_class == "junk" and found[2].text_class is None and found[None].text_class == "list" and "words" in found[None].failed
    assert quality.assess(df.limit(0)).collect() == []


# --- pairs

LABELLED = [
    ("What is the capital of Nowhere?", "", {"empty"}),
    ("What is the capital of Nowhere?", "N/A", {"empty"}),
    ("What is the capital of Nowhere?", None, {"empty"}),
    ("What is the capital of Nowhere?", "Lumdra", set()),
    ("How many are left of 12?", "12 - 5 = 7", set()),
    ("Explain how the mill works.", "The mill turns with the water. It drives a stone that was", {"truncated"}),
    ("Write code.", "```python\ndef f(x):\n    return x", {"truncated"}),
    ("Write code.", "```python\ndef f(x):\n    return x\n```", set()),
    ("Name things.", "- a rope.\n- a lamp.\n- the", {"truncated"}),
    ("Name things.", "- a rope\n- a lamp\n- a candle", set()),
    ("Tell me about the quarry.", "I'm sorry, but I can't help with the quarry.", {"refusal"}),
    ("How can I turn Pell down?", "You could write: \"I'm sorry, but I can't help with the quarry this May.\" That is kind enough.", set()),
    ("Why did the town sell the old stone mill by the river in 1880?", "Why did the town sell the old stone mill by the river in 1880?", {"copied"}),
    ("Repeat this line exactly: the town sold the old stone mill by the river.", "the town sold the old stone mill by the river.", set()),
    ("Why did the town sell the mill?", "Die Mühle wurde im Jahr 1880 verkauft, denn der Fluss war zu klein für das Rad und die Stadt.", {"other_language"}),
    ("Translate into German: the town sold the mill because of the river.", "Die Stadt hat die Mühle wegen des Flusses verkauft, und das war nicht gut für die Leute.", set()),
]


def test_labels_on_labelled_pairs():
    """The cutoffs hold on labelled pairs, with counts of votes as in a corpus that is mostly sound."""
    votes = [pairs.vote(q, a)[0] for q, a, _ in LABELLED]
    for name in pairs.DEFECTS:
        counts = defaultdict(int)
        for v in votes:
            counts[v[name]] += 10
        counts[pairs.vote("What do you think of the weather today?", "It is fine. The sun is out and the wind is from the north.")[0][name]] += 1000
        found = pairs.fit(dict(counts), pairs.LABELLERS[name])
        for (q, a, want), v in zip(LABELLED, votes, strict=True):
            assert (found[v[name]] > pairs.CUTOFFS[name]) == (name in want), (name, q, a, v[name], found[v[name]])


def test_styles_of_role_labels():
    for text in ("User: a\nAssistant: b\nUser: c", "### Instruction:\na\n\n### Response:\nb\n\n### Instruction:\nc", "Question: a\r\n\r\nAnswer: b\r\nQuestion: c", "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc", "System: s\nHuman: a\n\nAI: b\n\nHuman: c"):
        assert pairs.split_pairs(text) == [("a", "b"), ("c", None)]
    assert pairs.split_pairs("no labels") == []


def test_label_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "User: hi", "x"), (3, "User: hi", "x"), (4, "User: " + "long " * 100_000 + "\nAssistant: ok then.", "x")], "rec_id long, text string, defect string")
    assert rows(pairs.label(df).select("rec_id", "pair_no", "defect")) == [(3, 1, "empty"), (3, 1, "empty")]
    assert rows(pairs.label(df.limit(0))) == []


# --- packing and mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_sequences_never_overflow_and_hold_everything(sizes):
    place, cost = packing.assign(np.array(sizes), 100)
    held = np.bincount(place, weights=sizes, minlength=len(cost))
    assert held.max() <= 100 and held.sum() == sum(sizes) and len(cost) <= 2 * sum(sizes) / 100 + 1


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(1, "word " * 100, "x"), (2, "word " * 5, "x"), (2, "word " * 5, "x"), (3, None, "x"), (4, "", "x"), (5, "a b c", "x")], "doc_id long, text string, spec_name string")
    specs = spark.createDataFrame([("s", 32, 1), ("none", 1, 1), ("null", None, 0)], "spec_name string, capacity int, doc_overhead int")
    found = packing.pack(docs, specs).collect()
    assert {r.spec_name for r in found} == {"s"}
    pieces = sorted((r.piece_no, r.first_token, r.tokens) for r in found if r.doc_id == 1)
    assert [p[1] for p in pieces] == [31 * i for i in range(len(pieces))] and sum(p[2] for p in pieces) == tokens.count("word " * 100)
    assert sum(r.doc_id == 2 for r in found) == 2 and all(r.piece_no == 1 for r in found if r.doc_id != 1)
    used = defaultdict(int)
    for r in found:
        used[r.sequence] += r.used
    assert max(used.values()) <= 32
    assert packing.pack(docs.limit(0), specs).collect() == packing.pack(docs, specs.limit(0)).collect() == []


def test_long_texts_count_as_their_pieces():
    text = "some words in a row " * 12_000
    assert abs(tokens.count(text) - len(tokens._encoding(tokens.VOCABULARY).encode_ordinary(text))) <= len(text) // tokens.PIECE_CHARS


def test_allocation_meets_weights_up_to_caps():
    size, weight, epochs = {"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.4, "c": 0.1, "d": 0.3, "e": 0.0}, {"a": 1, "b": None, "c": 2, "d": 1, "e": 1}
    got = mixing.allocate(size, weight, epochs, 400.0)
    assert got["a"] == 100 and got["c"] == 20 and got["d"] == got["e"] == 0 and abs(sum(got.values()) - 400) < 1e-9


def test_mixture_meets_amounts(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 50), "a" if i % 3 else "b") for i in range(900)] + [(5000, None, "a"), (5001, "", "a"), (5002, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3), ("gone", 0.1, 1), ("zero", 0.0, None)], "source string, weight double, max_epochs int")
    mixture, shares = mixing.mix(docs, targets, budget=20_000.0)
    held = {r.source: r for r in shares.collect()}
    assert abs(held["a"].mixed_tokens - 6000) <= 51 and abs(held["b"].mixed_tokens - 14000) <= 51 and held["gone"].mixed_tokens == 0
    copies = [r.copies for r in mixture.where("source = 'b'").collect()]
    assert max(copies) <= 3 and held["b"].epochs <= 3
    assert mixing.mix(docs.limit(0), targets)[0].collect() == mixing.mix(docs, targets.limit(0))[0].collect() == []


# --- sentences


def units(text):
    return [text[a:b] for a, b in sentences.sentences(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Pell came at 3 p.m. He left at 5. It cost $3.50 in the U.S. last year.", ["Dr. Pell came at 3 p.m.", "He left at 5.", "It cost $3.50 in the U.S. last year."]),
        ('"Is it old?" asked Pell. He said: "It is. We stop." and left.', ['"Is it old?" asked Pell.', 'He said: "It is. We stop." and left.']),
        ("It was public.[7] (See also p. 25.) Wait... it goes on.", ["It was public.[7]", "(See also p. 25.)", "Wait... it goes on."]),
        ("# Title vs. text\nOne line\nwraps here. Two.\n\nThings:\n- a. B.\n- c", ["# Title vs. text", "One line\nwraps here.", "Two.", "Things:", "- a. B.", "- c"]),
        ("Code:\n```\na. B\n\nc\n```\nEnd.", ["Code:", "```\na. B\n\nc\n```", "End."]),
        ("他说：“一。二。”三。“四？”五问。", ["他说：“一。二。”", "三。", "“四？”五问。"]),
        ("彼は「はい。いいえ。」と言った。次。", ["彼は「はい。いいえ。」と言った。", "次。"]),
        ("ไปบ้าน มาแล้ว 3 คน ไปอีก", ["ไปบ้าน", "มาแล้ว 3 คน", "ไปอีก"]),
        ("Am 5. Juli kam er z. B. um 3 Uhr. Prof. K. fragte: „Wer?“ Niemand.", ["Am 5. Juli kam er z. B. um 3 Uhr.", "Prof. K. fragte: „Wer?“", "Niemand."]),
        ("В 1939 г. Ульчер писал. «Да. Нет», — сказал он.", ["В 1939 г. Ульчер писал.", "«Да. Нет», — сказал он."]),
        ("One end.Two begins at docs.x.example/v1. Three.", ["One end.", "Two begins at docs.x.example/v1.", "Three."]),
        ("", []),
        (" \r\n\t", []),
    ],
)
def test_sentences(text, want):
    assert units(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB .!?\n\r\"'()[]«»“”「」。、1-*#`ก्ா"), max_size=80))
def test_units_are_ordered_apart_and_complete(text):
    spans = sentences.sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_split_sentences_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "One. Two.", 1), (3, "Word. " * 50_000, 1)], "doc_id long, text string, sent_no int")
    found = sentences.split_sentences(df)
    assert found.where("doc_id is null").count() == 2 and found.where("doc_id = 3").count() == 50_000 and found.count() == 50_002
    assert sentences.split_sentences(df.limit(0)).collect() == []
