"""Operators over all rows: no condition, chat or late row is left out."""

from __future__ import annotations

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstone.functions import text as T
from loomstone.operators import dedup
from loomstone.sources import files
from loomstone.streaming import streams

SF = "/root/testdata/sf0.001"


def test_matrix_holds_every_condition(spark):
    cells = entry.queries()["agg8_accuracy_by_condition"](spark, SF).collect()
    have = entry.queries()["chk0_scored_records"](spark, SF).select("rec_id", "ok")
    sources = spark.read.parquet(f"{SF}/download_instruct.parquet").select("rec_id", "source").distinct()
    want = {r.source for r in have.select("rec_id").join(sources, "rec_id").select("source").distinct().collect()}
    assert {c.condition for c in cells} == want and len(want) > 3
    assert sum(c.n for c in cells) == have.count() and sum(c.n_scored for c in cells) == have.where("ok is not null").count()


def test_trees_of_every_chat_are_walked(spark):
    messages = spark.read.parquet(f"{SF}/messages.parquet").collect()
    chats = {}
    for m in messages:
        if m.chat_id is not None and m.created_at is not None:
            chats.setdefault(m.chat_id, []).append(m)
    want = set()
    for rows in chats.values():
        rows.sort(key=lambda m: (m.created_at, m.id))
        path = []
        for m in rows[:12]:
            path.append(str(m.id))
            if m.role == "assistant":
                want.add((m.id, ">".join(path)))
    got = entry.queries()["join_thread_paths_all"](spark, SF).collect()
    pinned = entry.queries()["join_thread_paths"](spark, SF).count()
    assert len(got) == len(want) > pinned and {(r.id, r.path) for r in got} == want


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        ([("a", 2024), ("b", None), ("c", None), ("d", 2001), ("e", None)], 5),  # none may be lost as late
        ([("a", 2024), ("b", None), ("c", 2024), ("b", 2024), ("b", None)], 3),  # none may be forgotten and counted again
    ],
)
def test_distinct_stream_counts_rows_without_a_time_and_late_ones(spark, tmp_path, texts, want):
    for i, (text, year) in enumerate(texts):
        rows = [(i, text, year and datetime.datetime(year, 5, 1)), (100 + i, None, None)]
        spark.createDataFrame(rows, "doc_id long, text string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["stm3_distinct_stream"](spark, str(tmp_path)).first().n == want


def test_a_long_chain_of_near_duplicates_is_settled(spark):
    """Each is like the next: every second one is kept, however long the chain is, in one task and in rounds."""
    nodes = spark.range(1, 2001).withColumnRenamed("id", "n")
    pairs = nodes.where("n < 2000").select(F.col("n").alias("a"), (F.col("n") + 1).alias("b"))
    assert {r.n for r in dedup.greedy_keep(nodes, pairs, "n").collect()} == set(range(1, 2001, 2))


def test_components_too_large_for_a_task_are_settled_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUP_EDGES", 3)
    nodes = spark.range(1, 13).withColumnRenamed("id", "n")
    pairs = spark.createDataFrame([*((i, i + 1) for i in range(1, 9)), (10, 11), (11, 12)], "a long, b long")
    assert {r.n for r in dedup.greedy_keep(nodes, pairs, "n").collect()} == {1, 3, 5, 7, 9, 10, 12}


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    """A crash after the index was written, before the verdicts were: the batch is run again and keeps what it kept."""
    body = "The quick brown fox jumps over the lazy dog near the river bank every morning at dawn, and it never looks back. "
    df = spark.createDataFrame([(1, body * 3), (2, "Something else entirely is written here, with no words shared at all."), (3, body * 3 + "!")], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    first = streams.near_duplicate_batches(stream(), "doc_id", "text", f"{tmp_path}/index", f"{tmp_path}/verdicts").collect()
    shutil.rmtree(f"{tmp_path}/verdicts")
    shutil.rmtree(f"{tmp_path}/verdicts-checkpoint")
    again = streams.near_duplicate_batches(stream(), "doc_id", "text", f"{tmp_path}/index", f"{tmp_path}/verdicts").collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in first) == [1, 2]


def test_the_head_of_a_file_is_parted_at_blank_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("legacy one\n\nlegacy two\n<|doc|>\nnew one\n\nstill <|doc|> new one\n<|doc|>\nlast")
    (tmp_path / "in" / "b.txt").write_text("<|doc|>\nother\n\nwhole")
    found = files.read_documents(spark, [f"{tmp_path}/in"], sentinel=True, least=1)
    assert sorted(r.text for r in found.collect()) == sorted(["legacy one", "legacy two", "new one\n\nstill <|doc|> new one", "last", "other\n\nwhole"])
    assert files.read_documents(spark, [f"{tmp_path}/in"], sentinel=True).count() == 0


def test_code_that_breaks_late_is_cut_at_once(spark):
    code = "def f(x):\n" + "    x = x + 1\n" * 3000 + "    return x\nThis is prose, not code.\n" + "more prose here\n" * 500
    got = spark.createDataFrame([(code,)], "t string").select(T.code_body(F.col("t")).alias("x")).first().x
    assert got.endswith("return x") and got.count("\n") == 3001
