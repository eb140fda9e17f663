"""Checks of outputs, their reports, classifiers, monitors, streams and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import checks as C
from loomstone.functions import constants as K
from loomstone.functions import quality as Q
from loomstone.functions import turns as U
from loomstone.operators import classify, mixing, records
from loomstone.plans.base import fraction as fraction_sql
from loomstone.plans.base import ORACLES, QUERIES, any_of, lit, query, starts, strip, tokens, turns
from loomstone.plans.texts import _GATES as GATES_SQL
from loomstone.plans.texts import SCORES_SQL, D
from loomstone.session import ensure_checkpoint_dir
from loomstone.streaming import streams

# Outputs to check: the first answer of each record, under the item whose number, counted from 0 in the order of ids, its hash gives.
_GEN = f"""g as (select rec_id, source as condition, t[2].content as output, ('0x' || substr(md5(rec_id::varchar), 1, 6))::bigint % (select count(*) from battery_prompts) as item from
 (select rec_id, source, {turns('text')} as t from download_instruct where text is not null) x where len(t) >= 2 and t[2].role = 'assistant'),
 b as (select *, row_number() over (order by id) - 1 as item from battery_prompts),
 r as (select rec_id, condition, output, id, category, check_kind as kind, expected, len({tokens('output')}) as n_new from g join b using (item))"""
_LOW = strip("lower(output)")


def generations(t):
    items = t("battery_prompts").withColumn("item", F.row_number().over(Window.orderBy("id")) - 1)
    total = F.broadcast(t("battery_prompts").agg(F.count(F.lit(1)).alias("items")))
    rows = t("download_instruct").where("text is not null").select("rec_id", F.col("source").alias("condition"), U.parse(F.col("text")).alias("t")).where(F.size("t") >= 2)
    first = rows.select("rec_id", "condition", F.inline(F.array(F.element_at("t", 2)))).where("role = 'assistant'").withColumnRenamed("content", "output")
    number = F.conv(F.substring(F.md5(F.col("rec_id").cast("string")), 1, 6), 16, 10).cast("bigint") % F.col("items")
    placed = first.crossJoin(total).withColumn("item", number)
    joined = placed.join(F.broadcast(items.select("item", "id", "category", F.col("check_kind").alias("kind"), "expected")), "item")
    return joined.select("rec_id", "condition", "output", "id", "category", "kind", "expected", F.size(F.regexp_extract_all("output", F.lit(r"\S+"), F.lit(0))).alias("n_new"))


def scored(t):
    """Each record with ``ok`` by its kind of check; code isn't run, so exec stays null."""
    g, out, want = generations(t), F.col("output"), F.col("expected")
    words_of = F.from_json(want, "array<string>")
    count_of = F.from_json(want, "n int, kw array<string>")
    parts_of = F.from_json(want, "array<array<string>>")
    bare = F.regexp_replace(want, '^"|"$', "")
    kind = F.col("kind")
    ok = (
        F.when(out == "", None)
        .when(kind == "contains", C.contains(out, words_of))
        .when(kind == "number", C.number(out, bare))
        .when(kind == "count", C.count(out, count_of["n"], count_of["kw"]))
        .when(kind == "word_limit", C.word_limit(out, F.try_to_number(want, F.lit("999999")).cast("int")))
        .when(kind == "yesno", C.yes_no(out, bare))
        .when(kind == "multi", C.multi(out, parts_of))
    )
    return g.withColumn("ok", ok).withColumns(C.flags(out, F.col("n_new"), kind))


_KW = "from_json(expected, '[\"VARCHAR\"]')"
_FLAGS = f"""({starts(_LOW, K.HEDGES)})::int as hedge, ({any_of(_LOW, K.IDENTITY_MARKS)})::int as identity, regexp_matches(output, {lit(K.SPEAKER)})::int as fake_dialogue, ({any_of('output', ['â€', '�'])})::int as mojibake,
 (n_new > 120 and kind in ('contains', 'number', 'yesno', 'count'))::int as "verbose" """
_PLAIN = r"regexp_replace(regexp_replace(output, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"
_BARE = "regexp_replace(expected, '^\"|\"$', '', 'g')"
_LISTED = r"len(regexp_extract_all(output, '(?m)^[ \t]*(?:\d+[.)][ \t]*|[-*•][ \t]*)([^\n]+)$'))"
_SENT = r"regexp_replace(string_split_regex(output, '[.!?\n]')[1], '(?i)\band\b', ',', 'g')"
_SENT2 = f"(case when contains({_SENT}, ':') then regexp_replace({_SENT}, '^[^:]*:', '') else {_SENT} end)"
_COUNT = f"(case when {_LISTED} >= 2 then {_LISTED} else len([p for p in string_split({_SENT2}, ',') if {strip('p')} <> '']) end)"
_OK = rf"""case when output = '' then null when kind = 'contains' then (len([k for k in {_KW} if contains({_LOW}, {strip('lower(k)')})]) > 0)::int
 when kind = 'number' then regexp_matches({_PLAIN}, '(^|[^\d.])' || regexp_replace({_BARE}, '([.\-+])', '\\\1', 'g') || '($|\D)')::int
 when kind = 'count' then ({_COUNT} = (expected::json->>'n')::int and len([k for k in from_json(expected::json->'kw', '["VARCHAR"]') if not contains({_LOW}, {strip('lower(k)')})]) = 0)::int
 when kind = 'word_limit' then (n_new <= try_cast(expected as int))::int when kind = 'yesno' then (regexp_replace(regexp_extract(lower(output), '(\S+)', 1), '[^a-z]', '', 'g') = {_BARE})::int
 when kind = 'multi' then (len([p for p in from_json(expected, '[["VARCHAR"]]') if len(p) > 0 and len([k for k in p if contains({_LOW}, {strip('lower(k)')})]) = 0]) = 0)::int end"""
_SCORED = f"with {_GEN}, s as (select *, {_OK} as ok, {_FLAGS} from r)"


@query("chk0_scored_records", f"{_SCORED} select rec_id, id, kind, ok from s")
def chk0(t):
    """All kinds of checks by what each item expects; unscored kinds and empty outputs are null."""
    return scored(t).select("rec_id", "id", "kind", "ok")


for _number, _kind in enumerate(["contains", "number", "count", "word_limit", "yesno", "multi"], 1):

    @query(f"chk{_number}_{_kind}", f"{_SCORED} select rec_id, ok from s where kind = '{_kind}'")
    def _one(t, kind=_kind):
        return scored(t).where(F.col("kind") == kind).select("rec_id", "ok")


@query("chk8_math", f"with {_GEN} select rec_id, list_contains(regexp_extract_all(replace(output, ',', ''), '-?\\d+'), '132')::int as ok from r")
def chk8(t):
    return generations(t).select("rec_id", C.math(F.col("output"), F.lit("132")).alias("ok"))


@query("chk9_instruction", rf"with {_GEN} select rec_id, (len(list_distinct([{strip('p')} for p in string_split_regex(lower(output), ',|\band\b|\n|;|\d+\.|•|\*') if length({strip('p')}) >= 2])) >= 5)::int as ok from r")
def chk9(t):
    return generations(t).select("rec_id", C.instruction(F.col("output"), F.lit(5)).alias("ok"))


_REP = "g2 as (select rec_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as g from (select rec_id, regexp_extract_all(lower(output), '[a-z]+') as w from r) a where len(w) >= 6), c2 as (select rec_id, g, count(*) as k from g2 group by all), m2 as (select rec_id, max(k) / sum(k) as rep from c2 group by 1)"


@query("chk10_essay", f"with {_GEN}, {_REP} select rec_id, (n_new >= 18 and len([k for k in ['the', 'orchard', 'wool'] if contains(lower(output), k)]) >= 2 and coalesce(rep, 0) < 0.16 and not {any_of('lower(output)', K.REFUSAL_PHRASES)})::int as ok from r left join m2 using (rec_id)")
def chk10(t):
    return generations(t).select("rec_id", C.essay(F.col("output"), F.array(F.lit("the"), F.lit("orchard"), F.lit("wool"))).alias("ok"))


@query("chk11_conversation", f"with {_GEN}, {_REP} select rec_id, (n_new >= 3 and coalesce(rep, 0) < 0.22 and not {any_of('lower(output)', K.REFUSAL_PHRASES)})::int as ok from r left join m2 using (rec_id)")
def chk11(t):
    return generations(t).select("rec_id", C.conversation(F.col("output")).alias("ok"))


@query("chk12_flags", f"{_SCORED} select rec_id, hedge, identity, fake_dialogue, mojibake, \"verbose\" from s")
def chk12(t):
    return scored(t).select("rec_id", "hedge", "identity", "fake_dialogue", "mojibake", "verbose")


@query("chk13_graded", f"with {_GEN} select rec_id, case when length(output) < 5 or {any_of('lower(output)', K.BAD_MARKS)} then 0 when contains(lower(output), 'the') then 2 else 1 end as grade from r")
def chk13(t):
    return generations(t).select("rec_id", C.graded(F.col("output"), F.array(F.lit("the"))).alias("grade"))


@query("chk14_rescued", f"with {_GEN}, f as (select rec_id, output, n_new, len([k for k in ['river', 'wool', 'index'] if contains(lower(output), k)]) as k from r) select rec_id, case when output = '' or {any_of('lower(output)', K.BAD_MARKS)} or n_new > 80 then 0 when k >= 2 then 2 when k = 1 then 1 else 0 end as grade from f")
def chk14(t):
    return generations(t).select("rec_id", C.rescued(F.col("output"), F.array(F.lit("river"), F.lit("wool"), F.lit("index"))).alias("grade"))


@query("chk15_predicates", rf"with {_GEN} select rec_id, regexp_matches(output, '(^|[^A-Za-z0-9_])\d{{3}}($|[^A-Za-z0-9_])') as has_number, n_new between 10 and 60 as in_range from r")
def chk15(t):
    """Predicates named in a table of items: a pattern, and a range of words."""
    return generations(t).select("rec_id", F.col("output").rlike(r"(^|[^A-Za-z0-9_])\d{3}($|[^A-Za-z0-9_])").alias("has_number"), F.col("n_new").between(10, 60).alias("in_range"))


@query("chk16_prefix", rf"with {_GEN} select rec_id, (regexp_extract(output, '(\S+)', 1) = 'The' or contains(left(output, 20), 'The'))::int as ok from r")
def chk16(t):
    return generations(t).select("rec_id", C.prefix_match(F.col("output"), F.lit("The")).alias("ok"))


@query("agg7_scorecard", f"{_SCORED} select condition, count(*) as n, count(ok) as n_scored, round(avg(ok), 6) as accuracy, round(avg(n_new), 6) as mean_tokens, {', '.join(f'round(avg("{c}"), 6) as {c}_share' for c in ('hedge', 'identity', 'fake_dialogue', 'mojibake', 'verbose'))} from s group by condition")
def agg7(t):
    return records.scorecard(scored(t), "condition")


@query("agg8_accuracy_matrix", f"{_SCORED} select category, round(avg(ok) filter (where condition = 'open_ember'), 6) as open_ember, round(avg(ok) filter (where condition = 'lantern_chat'), 6) as lantern_chat, round(avg(ok) filter (where condition = 'handmade_qa'), 6) as handmade_qa from s group by category")
def agg8(t):
    names = ["open_ember", "lantern_chat", "handmade_qa"]
    matrix = scored(t).groupBy("category").pivot("condition", names).agg(F.avg("ok"))
    return matrix.select("category", *[F.round(n, 6).alias(n) for n in names])


@query("agg8_accuracy_by_condition", f"{_SCORED} select category, condition, count(*) as n, count(ok) as n_scored, round(avg(ok), 6) as accuracy from s group by category, condition")
def agg8_long(t):
    """The cells of the matrix over every condition present, null and other spellings included; accuracy is null where nothing was scored."""
    cells = scored(t).groupBy("category", "condition")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("n_scored"), F.round(F.avg("ok"), 6).alias("accuracy"))


def _models(t):
    texts = t("quality").where("text is not null")
    good = Q.scored(texts.select("text_id", "text")).where("quality_score >= 0.9").select("text_id", "text")
    return texts, good


_BODY = f"replace({strip('text')}, chr(10), ' ')"
_GOOD = f"""with s as ({SCORES_SQL.replace(D, "(select text_id as doc_id, text from quality) q where text is not null")}), good as (select text_id, text, substr({_BODY}, 1, 2000) as body from quality join s on doc_id = text_id where quality_score >= 0.9),
 chosen as (select text_id, body, array_to_string(string_split_regex(body, '\\s+')[1:10], ' ') as ten from good where length(text) > 200 and {fraction_sql(42, 'text_id')} < 0.5)"""


@query("clf1_quality_examples", f"{_GOOD} select text_id, body as text, 1.0::double as label from chosen union all select text_id, substr(body, 1, 50), 0.0 from chosen union all select text_id, concat_ws(' ', ten, ten, ten, ten, ten), 0.0 from chosen union all select text_id, body, 0.0 from good where length(text) < 50 and length(text) > 0")
def clf1(t):
    """Examples of the quality model from texts that score high."""
    _, good = _models(t)
    return classify.quality_examples(good, "text_id", "text", 0.5)


@query("clf3_toxicity_examples", f"with s as (select text_id, substr({_BODY}, 1, 1000) as text, case when {fraction_sql(5, 'text_id')} >= 0.5 then 1.0 when {fraction_sql(5, 'text_id')} < 0.1 then 0.0 end::double as label from quality where length(text) >= 20) select text_id, text, label from (select *, row_number() over (partition by label order by md5('42:' || text_id), text_id) as p from s where label is not null) x where p <= 2000")
def clf3(t):
    texts = t("quality").where("text is not null").withColumn("score", mixing.fraction(5, F.col("text_id")))
    return classify.toxicity_examples(texts, "text_id", "text", "score", 2000)


@query("clf5_scores")
def clf5(t):
    """Probability of quality of each text under a model fitted on the examples."""
    texts, good = _models(t)
    model = classify.fit(classify.quality_examples(good, "text_id", "text", 0.5), "text_id")
    return classify.score(model, texts, "text_id", "text", 2000).select("text_id", F.round("probability", 4).alias("probability"))


@query("sco13_blended")
def sco13(t):
    texts, good = _models(t)
    examples = classify.quality_examples(good, "text_id", "text", 0.5)
    quality = classify.score(classify.fit(examples, "text_id"), texts, "text_id", "text", 2000)
    toxic = texts.select("text_id", (F.col("text").rlike("(?i)viagra|casino|nude")).cast("double").alias("probability"))
    return classify.blended(quality, toxic, Q.scored(texts.select("text_id", "text")), "text_id").select("text_id", "blended", "verdict")


@query("sco12_sorted_scores", f"with s as ({SCORES_SQL}), g as (select doc_id, {GATES_SQL} as passes from {D}) select doc_id, quality_score from s join g using (doc_id) where passes and quality_score >= 0.45")
def sco12(t):
    """Passing documents, best first."""
    docs = t("documents").where("text is not null").select("doc_id", "text").where(Q.gates(F.col("text")))
    return Q.scored(docs).where("quality_score >= 0.45").select("doc_id", "quality_score").orderBy(F.desc("quality_score"), "doc_id")


_VALUES = "with v as (select event_id, value, lag(value) over (partition by event_type order by event_id) as previous, epoch(ts - lag(ts) over (partition by event_type order by event_id)) as idle from events)"


@query("stm1_alerts", f"{_VALUES} select event_id, 'diverging' as alert from v where value > 20 union all select event_id, 'rising' from v where value > previous union all select event_id, 'stalled' from v where idle > 900")
def stm1(t):
    near = Window.partitionBy("event_type").orderBy("event_id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    log = t("events").withColumn("previous", F.lag("value").over(near)).withColumn("idle", seconds(F.col("ts")) - seconds(F.lag("ts").over(near)))
    return records.alerts(log, F.col("value"), F.lit(0.0), F.col("previous"), F.col("idle")).select("event_id", "alert")


def _streamed(name, sql=None):
    """Register a query whose rows come out of a stream run to its end."""

    def wrap(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return wrap


@_streamed("stm2_stalls", "with g as (select event_type as grp, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts) as gap from events) select grp, round(max(gap) / 1e6, 2) as gap, max(gap) / 1e6 > 3600 as stalled from g group by 1")
def stm2(spark, sf_dir):
    found = streams.stalled(streams.stream_table(spark, sf_dir, "events"), "event_type", 3600)
    rows = streams.drain(found, "update", f"stalls_{abs(hash(sf_dir))}")
    return rows.groupBy("grp").agg(F.round(F.max("gap"), 2).alias("gap"), F.bool_or("stalled").alias("stalled"))


@_streamed("stm3_distinct_stream", "select count(distinct md5(substr(text, 1, 2000))) as n from documents")
def stm3(spark, sf_dir):
    found = streams.distinct_stream(streams.stream_table(spark, sf_dir, "documents"), "text")
    return streams.drain_to(found.select("key"), f"{ensure_checkpoint_dir(spark)}/stm3-{uuid.uuid4().hex}").agg(F.count(F.lit(1)).alias("n"))


@_streamed("stm4_near_duplicate_stream")
def stm4(spark, sf_dir):
    """Documents kept by the incremental search; its index and verdicts are tables in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/stm4-{uuid.uuid4().hex}"
    stream = streams.stream_table(spark, sf_dir, "documents", files=4)
    return streams.near_duplicate_batches(stream, "doc_id", "text", f"{folder}/index", f"{folder}/verdicts")


@_streamed("stm5_running_counts", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stm5(spark, sf_dir):
    return streams.drain(streams.running_counts(streams.stream_table(spark, sf_dir, "events"), "event_type"), "complete", f"counts_{abs(hash(sf_dir))}")


@_streamed("stm6_tumbling", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stm6(spark, sf_dir):
    return streams.drain(streams.tumbling(streams.stream_table(spark, sf_dir, "events"), "1 hour", "event_type"), "complete", f"tumbling_{abs(hash(sf_dir))}")


@query("stm6_sessions", "with s as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute, true) as fresh from events), n as (select *, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) as s from s) select min(ts) as start, user_id, count(*) as n from n group by user_id, s")
def stm6_sessions(t):
    return streams.sessions(t("events"), "30 minutes", "user_id")


@query("gat1_corpus_gate", f"select sum(len({tokens('text')})) >= 100000 as enough, count(*) filter (where source like '1.0%') = 0 as no_old_source, count(*) filter (where kind = 'stack') > 0 and count(*) filter (where kind = 'math') > 0 as has_code_and_math, count(*) filter (where contains(text, 'User:') and contains(text, 'Assistant:')) = 0 as no_instructions from documents where text is not null")
def gat1(t):
    d = t("documents").where("text is not null")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    both = F.contains("text", F.lit("User:")) & F.contains("text", F.lit("Assistant:"))
    return d.agg(
        (F.sum(n) >= 100000).alias("enough"),
        (F.count_if(F.col("source").like("1.0%")) == 0).alias("no_old_source"),
        ((F.count_if(F.col("kind") == "stack") > 0) & (F.count_if(F.col("kind") == "math") > 0)).alias("has_code_and_math"),
        (F.count_if(both) == 0).alias("no_instructions"),
    )


@query("gat3_consistency", "select model_id, count(distinct pinned) > 1 as mixed from chats where model_id is not null group by 1")
def gat3(t):
    return t("chats").where("model_id is not null").groupBy("model_id").agg((F.count_distinct("pinned") > 1).alias("mixed"))


@query("gat4_rotation", "select id from (select id, row_number() over (partition by model_id order by created_at desc, id) as p from (select distinct id, model_id, created_at from chats where model_id is not null) c) x where p > 3")
def gat4(t):
    """All but the last three of each series."""
    chats = t("chats").where("model_id is not null").select("id", "model_id", "created_at").distinct()
    place = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("created_at"), "id"))
    return chats.withColumn("p", place).where("p > 3").select("id")


@query("snk7_chat_updates", "select id, role, content, created_at from messages where chat_id is not null and chat_id not in (select id from chats where pinned = 1) union all select max(id) + 1, 'user', 'hello', 1709000000.0 from messages")
def snk7(t):
    """A chat deleted with its messages, and a message added: new versions of the table, as parquet has no updates in place."""
    gone = t("chats").where("pinned = 1").select(F.col("id").alias("chat_id")).distinct()
    kept = t("messages").where("chat_id is not null").join(gone, "chat_id", "left_anti").select("id", "role", "content", "created_at")
    added = t("messages").agg((F.max("id") + 1).alias("id")).select("id", F.lit("user").alias("role"), F.lit("hello").alias("content"), F.lit(1709000000.0).alias("created_at"))
    return kept.unionByName(added)



