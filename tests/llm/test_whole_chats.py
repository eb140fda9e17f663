"""Conversations without identifiers at some size, and repeats across hours."""

from __future__ import annotations

from loomstone.llm import conversations

HOUR = 3600.0


def test_linked_rows_match_union_find(spark):
    """Chains, hubs, cycles and links to absent rows: the conversations are the components."""
    messages, links, want = [], [], {}
    at = 0
    for chat in range(24):
        size = 200 if chat % 3 else 80
        ids = list(range(at, at + size))
        at += size
        for n, i in enumerate(ids):
            # one row has the id, in an odd spelling in some chats; the others hang on it
            own = (f"C{chat:03d} " if chat % 2 else f"c{chat:03d}") if n == (0 if chat % 4 else size // 2) else None
            messages.append((i, own, "user" if n % 2 == 0 else "assistant", f"text {chat} {n}", 1.7e9 + 60.0 * n))
            if n and chat % 3 == 0:
                links.append((i, ids[0]))  # a hub
            elif n:
                links.append((i, i - 1) if n % 2 else (i - 1, i))  # a chain, told from either side
        if chat % 5 == 0:
            links.append((ids[0], ids[-1]))  # a cycle
        links.append((ids[1], 10**9 + chat))  # no such row
        want[f"c{chat:03d}"] = ids
    messages += [(10**6 + i, None, "user", "stray", 1.7e9) for i in range(50)]
    links += [(10**6 + i, 10**6 + i + 1) for i in range(20)]  # a component without a chat
    m = spark.createDataFrame(messages, "id long, chat_id string, role string, content string, created_at double")
    chats = spark.createDataFrame([(c,) for c in want], "id string")
    found = conversations.rebuild(m, chats, spark.createDataFrame(links, "message_id long, refers_to long"))
    got: dict[str, list[tuple[int, int]]] = {}
    for r in found.collect():
        got.setdefault(r.chat_id, []).append((r.turn_no, r.message_id))
    assert {c: [i for _, i in sorted(rows)] for c, rows in got.items()} == want


def test_repeats_are_one_turn_across_hours(spark):
    """A row repeated every four seconds for over two hours is one turn; the least id is told wherever it stands."""
    begin = 1000 * HOUR - 100
    repeats = [(5000 - n, "c", "user", "ping", begin + 4.0 * n) for n in range(2000)]
    later = [(9000, "c", "assistant", "pong", begin + 9000.0), (9001, "c", "user", "ping", begin + 9004.0), (9002, "c", "assistant", "pong", begin + 9005.5)]
    edge = [(1, "d", "user", "x", 2000 * HOUR - 2), (2, "d", "user", "x", 2000 * HOUR + 3), (3, "d", "assistant", "y", 2000 * HOUR + 4), (4, "d", "user", "x", 2001 * HOUR - 1), (6, "d", "assistant", "y", 2001 * HOUR)]
    m = spark.createDataFrame(repeats + later + edge, "id long, chat_id string, role string, content string, created_at double")
    found = conversations.rebuild(m, spark.createDataFrame([("c",), ("d",)], "id string")).select("chat_id", "turn_no", "message_id")
    assert sorted(tuple(r) for r in found.collect()) == [("c", 1, 3001), ("c", 2, 9000), ("c", 3, 9001), ("c", 4, 9002), ("d", 1, 1), ("d", 2, 3), ("d", 3, 4), ("d", 4, 6)]
