"""Golden cases, properties and round trips of the core operators."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import checks as C
from loomstone.functions import constants as K
from loomstone.functions import quality as Q
from loomstone.functions import text as T
from loomstone.functions import turns as U
from loomstone.operators import dedup, mixing, packing, records
from loomstone.sources import files


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'array<string>' if isinstance(values[n], list) else 'int'}" for n in names))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.prompt_key, "  What is 2 + 2?  ", "what is 2  2"),
        (T.prompt_key, "What's\tUP?", "whats up"),
        (T.words, "Don't It's a1b", ["don't", "it's", "a", "b"]),
        (T.html_strip, "<p>a &lt;b&gt;</p>", "a <b>"),
        (T.auto_title, "x" * 60, "x" * 50 + "..."),
        (T.auto_title, "short", "short"),
        (T.mend, "â€œHiâ€\x9d â€” itâ€™s", '"Hi" - it\'s'),
        (T.newlines, "a\r\n\r\n\r\n\r\nb\r", "a\n\nb"),
        (T.fenced, "def f():\n  pass", "```python\ndef f():\n  pass\n```"),
        (T.cut_at_stops, "yes\nUser: more", "yes"),
        (T.cut_speaker, "Fine. Teacher: what?", "Fine."),
        (T.chat_wrappers, "### Turn 1\n**User:** hi\n- Assistant 2: yo", "User: hi\nAssistant: yo"),
        (T.code_body, "Sure!\n```python\ndef f():\n    return 1\n```\nBye", "def f():\n    return 1"),
        (T.coerced_kind, "-12", "int"),
        (T.coerced_kind, "None", "null"),
        (lambda c: C.repetition(c), "a b c a b c", 0.5),
        (lambda c: C.item_count(c), "1. a\n2. b\n3. c", 3),
        (lambda c: C.item_count(c), "Apple, banana, and pear.", 3),
        (lambda c: C.number(c, F.lit("1500")), "1,500", 1),
        (lambda c: C.number(c, F.lit("5")), "15", 0),
        (lambda c: C.number(c, F.lit("5")), "3.5", 0),
        (lambda c: C.number(c, F.lit("5")), "5.0", 1),
        (lambda c: C.yes_no(c, F.lit("yes")), "Yes, it is.", 1),
        (lambda c: C.math(c, F.lit("-3")), "it is -3.", 1),
        (Q.length_score, 125, 0.65),
        (Q.length_score, 12500, 0.85),
    ],
)
def test_golden_cases(spark, make, text, want):
    got = one(spark, make(F.col("t")), t=text)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_template_score_by_hits(spark):
    got = [one(spark, Q.template_score(F.col("n")), n=n) for n in (0, 1, 3)]
    assert got == pytest.approx([1.0, 0.7, 0.2])


def test_turns_and_defects(spark):
    def parsed(text):
        return [(r.role, r.content) for r in one(spark, U.parse(F.col("t")), t=text)]

    assert parsed("User: hi\nAssistant: yo\nUser: ok") == [("user", "hi"), ("assistant", "yo"), ("user", "ok")]
    reason = lambda text: one(spark, U.defect(U.parse(F.col("t")), F.lit("s")), t=text)
    assert reason("hello") == "shape" and reason("Assistant: a\nUser: b") == "shape"
    assert reason("User: hi\nAssistant: As an AI, I can't.") == "refusal_hedge"
    assert reason("User: hi\nAssistant: x") == "empty_turn"
    assert reason("User: hi\nAssistant: It was a long and") == "truncated"
    assert reason("User: hi\nAssistant: ChatGPT says hi.") == "identity"
    assert reason("User: why\nAssistant: " + "word " * 201 + "end.") == "length_mismatch"
    assert reason("User: hi\nAssistant: Fine then.") is None


def test_shingle_hash_and_signature():
    assert dedup.shingle_hashes("hello").tolist() == [499578026]
    assert len(dedup.shingle_hashes("abcd")) == 0
    a, b = dedup.parameters()
    assert dedup.signature(np.zeros(0, dtype=np.int64), a, b).tolist() == [dedup.TOP] * 128
    with np.errstate(over="ignore"):
        want = [int(((np.int64(x) * np.int64(499578026) + np.int64(y)) % dedup.PRIME) % dedup.TOP) for x, y in zip(a, b, strict=True)]
    assert dedup.signature(np.array([499578026]), a, b).tolist() == want


def test_signature_similarity(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3, 8])], "a array<long>, b array<long>")
    assert row.select(dedup.similarity(F.col("a"), F.col("b")).alias("x")).first().x == 0.5


def test_greedy_keep_takes_the_first_maximal_independent_set(spark):
    nodes = spark.range(1, 9).withColumnRenamed("id", "n")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (6, 7), (4, 7)], "a long, b long")
    kept = sorted(r.n for r in dedup.greedy_keep(nodes, pairs, "n").collect())
    assert kept == [1, 3, 4, 6, 8]


def test_near_duplicates_are_dropped_once(spark):
    body = "The quick brown fox jumps over the lazy dog near the river bank every morning at dawn, and it never looks back at all. "
    df = spark.createDataFrame([(1, body * 3), (2, body * 3 + "!"), (3, "Something else entirely is written here, with no words shared at all."), (4, None), (5, body * 3), (6, "abc")], "doc_id long, text string")
    signed = dedup.cut(dedup.signatures(df, "doc_id", "text"))
    kept = sorted(r.doc_id for r in dedup.greedy_keep(signed.select("doc_id"), dedup.similar_pairs(signed, "doc_id"), "doc_id").collect())
    assert kept == [1, 3, 4, 6]


def test_keep_first_and_anti_join(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None), (5, "b")], "id long, k string")
    assert sorted(r.id for r in dedup.keep_first(df, [F.col("k")], [F.col("id")]).collect()) == [1, 3, 5]
    known = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted(r.id for r in dedup.not_in(df, known, F.col("k"), F.col("k")).collect()) == [3, 4, 5]


def test_exact_interleave_of_two_sources(spark):
    df = spark.createDataFrame([("A", i, 10, 0.6) for i in range(4)] + [("B", i, 10, 0.4) for i in range(2)], "s string, o int, n int, w double")
    got = [r.s for r in mixing.interleave_exact(df, "s", "o", "n", "w").orderBy("position").collect()]
    assert got == list("ABABAA") or got == list("ABAABA")


def test_running_totals_match_a_plain_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7 + 1).alias("n"), mixing.order_key(3, F.col("id")).alias("k"))
    from pyspark.sql import Window

    plain = df.withColumn("w", F.sum("n").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    both = mixing.running_totals(df, ["g"], [F.col("k")], F.col("n")).join(plain.select("id", "w"), "id")
    assert both.where("before <> w").count() == 0 and both.count() == 500


def test_shuffle_keeps_rows(spark):
    df = spark.range(1000)
    out = [r.id for r in mixing.shuffled(df, 1, F.col("id"), partitions=3).collect()]
    assert sorted(out) == list(range(1000)) and out != sorted(out)


def test_concat_and_chunk_drops_the_tail(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6, 7]), (3, [8, 9])], "id long, t array<int>")
    rows = packing.concat_and_chunk(df, ["id"], "t", 4).orderBy("sequence").collect()
    assert [r.t for r in rows] == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_best_fit_respects_capacity(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("shard"), F.col("id").alias("k"), (F.col("id") * 37 % 900 + 20).cast("int").alias("n"))
    packed = packing.best_fit(df, "shard", "k", "n", 1024).join(df, ["shard", "k"])
    bins = packed.groupBy("shard", "bin").agg(F.sum("n").alias("used")).collect()
    assert packed.count() == 300 and max(b.used for b in bins) <= 1024


def test_masks_are_as_long_as_their_tokens(spark):
    df = spark.createDataFrame([("User: hi there\nAssistant: all is well\nUser: ok",)], "t string").select(U.parse(F.col("t")).alias("x"))
    tokens, mask = packing.masked(F.col("x"), bos="<s>", eos="</s>")
    row = df.select(tokens.alias("a"), mask.alias("b")).first()
    assert row.a == ["<s>", "User:", "hi", "there", "Assistant:", "all", "is", "well", "</s>", "\n", "User:", "ok"]
    assert row.b == [0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0]


def test_last_segment(spark):
    df = spark.createDataFrame(list(enumerate([1, 2, 3, 1, 2])), "line long, step long")
    assert [r.step for r in records.last_segment(df, "step", "line").orderBy("line").collect()] == [1, 2]


def test_thread_paths(spark):
    nodes = spark.createDataFrame([(1, None, "user", "a"), (2, 1, "assistant", "b"), (3, 1, "assistant", "c"), (4, 3, "user", "d"), (5, 4, "assistant", "e"), (9, 77, "assistant", "lost")], "id long, up long, role string, content string")
    got = {r.id: r.path for r in records.thread_paths(nodes, "id", "up", "role", "content").collect()}
    assert got == {2: [1, 2], 3: [1, 3], 5: [1, 3, 4, 5]}


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("one\n\nstill one",), ("two\r\nlines",)], "text string")
    files.write_documents(docs.coalesce(1), f"{tmp_path}/docs")
    back = files.read_documents(spark, [f"{tmp_path}/docs", f"{tmp_path}/missing"], sentinel=True, least=1)
    assert sorted(r.text for r in back.collect()) == ["one\n\nstill one", "two\nlines"]
    files.write_documents(docs.coalesce(1), f"{tmp_path}/old", sentinel=False)
    assert files.read_documents(spark, [f"{tmp_path}/old"], more_than=2).count() == 3
    files.write_jsonl(docs.withColumn("source", F.lit("s")), f"{tmp_path}/j")
    (tmp_path / "j" / "bad.json").write_text('{"text": "broken\n')
    assert files.read_jsonl(spark, f"{tmp_path}/j").count() == 2
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"step": i, "loss": 1.0}) for i in range(10)] + ["oops"]))
    assert [r.step for r in files.read_log(spark, f"{tmp_path}/log.jsonl", 4).orderBy("step").collect()] == [7, 8, 9]
    packed = spark.createDataFrame([([1, 2], [0, 1]), ([3, 4], [1, 1])], "tokens array<int>, mask array<int>")
    files.write_shards(packed, f"{tmp_path}/shards", per_shard=1)
    assert files.read_shards(spark, f"{tmp_path}/shards", 2).count() == 2
    with pytest.raises(Exception, match="packed length"):
        files.read_shards(spark, f"{tmp_path}/shards", 3).collect()


def test_missing_sources_fail(spark):
    docs, weights = spark.createDataFrame([("a",)], "source string"), spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.0)], "source string, weight double")
    with pytest.raises(ValueError, match="b"):
        files.require_sources(docs, weights)


def test_stream_of_near_duplicates_keeps_its_index(spark, tmp_path):
    from loomstone.streaming import streams

    body = "The quick brown fox jumps over the lazy dog near the river bank every morning at dawn. "
    for i, rows in enumerate([[(1, body), (2, "Nothing alike is said in this other text, not one bit of it.")], [(3, body + "."), (4, "A third text that has its own words and says its own things.")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        kept = streams.near_duplicate_batches(stream, "doc_id", "text", f"{tmp_path}/index", f"{tmp_path}/verdicts")
        assert sorted(r.doc_id for r in kept.collect()) == ([1, 2] if i == 0 else [1, 2, 4])


def test_stop_words_are_whole():
    assert len(K.STOPWORDS) == len(set(K.STOPWORDS)) == 111 and len(K.BOILERPLATE) == 13


def test_stages_resume_and_logs_append(spark, tmp_path):
    from loomstone.plans.stages import append_log, run_stages

    calls = []

    def stage(name, fails=False):
        def build(s, done):
            calls.append(name)
            if fails:
                raise RuntimeError(name)
            return s.range(3 + len(done))

        return name, build

    with pytest.raises(RuntimeError):
        run_stages(spark, f"{tmp_path}/run", [stage("a"), stage("b", fails=True)])
    done = run_stages(spark, f"{tmp_path}/run", [stage("a"), stage("b"), stage("c")], until="b")
    assert calls == ["a", "b", "b"] and done["b"].count() == 4 and list(done) == ["a", "b"]
    for i in range(2):
        append_log(spark, f"{tmp_path}/log", step=i, loss=0.5)
    assert files.read_log(spark, f"{tmp_path}/log", 10).count() == 2
