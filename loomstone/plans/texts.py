"""Scans, projections and filters over texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import constants as K
from loomstone.functions import quality as Q
from loomstone.functions import text as T
from loomstone.functions import turns as U
from loomstone.operators import packing
from loomstone.plans.base import any_of, blocks, joined, lit, newlines, query, strip, tokens, turns, unix, words
from loomstone.session import ensure_checkpoint_dir, spread
from loomstone.sources import files

# Our own lexicon of unsafe wording, and languages whose code pairs are left out.
UNSAFE = r"(?i)\b(?:casino bonus|free viagra|hot singles|payday loan|click to win|miracle cure|nude pics|hate speech)\b"
CODE_LANGUAGES = ["php", "perl", "ruby", "scala", "matlab", "swift", "kotlin", "haskell"]
D = "documents where text is not null"


def _blocks_sql(condition: str) -> str:
    return f"with b as (select doc_id, [{strip('x')} for x in {blocks('text')} if {condition.format(strip('x'))}] b from {D}) select doc_id, unnest(range(1, len(b) + 1))::int part, unnest(b) as text from b"


@query("src1_blank_line_documents", _blocks_sql("length({}) > 50"))
def src1(t):
    return files.blank_line_documents(t("documents").where("text is not null"), F.col("text"), ["doc_id"])


@query("src2_blank_line_documents_200", _blocks_sql("length({}) >= 200"))
def src2(t):
    return files.blank_line_documents(t("documents").where("text is not null"), F.col("text"), ["doc_id"], 199)


def _mend_sql(x: str) -> str:
    for bad, good in K.MOJIBAKE:
        x = f"replace({x}, {lit(bad)}, {lit(good)})"
    return x


_SENTINELS = rf"""with j as (select source, doc_id // 16 as file, string_agg(text, chr(10) || '{files.SENTINEL}' || chr(10) order by doc_id) as body from {D} group by 1, 2),
 p as (select source, file, string_split_regex({unix('body')}, '(?m)^[ \t]*<\|doc\|>[ \t]*$') as p from j),
 b as (select source, file, [{_mend_sql(strip('x'))} for x in list_concat(string_split_regex(p[1], '\n[ \t]*(?:\n[ \t]*)+'), p[2:])] as b from p),
 k as (select source, file, [x for x in b if length(x) >= 200] as k from b)
 select source, file, unnest(range(1, len(k) + 1))::int as part, unnest(k) as text from k"""


@query("src3_sentinel_documents", _SENTINELS)
def src3(t):
    """Documents written one after the other behind sentinels, a source at a time, and read again."""
    joined_texts = t("documents").where("text is not null").groupBy("source", F.floor(F.col("doc_id") / 16).alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), f"\n{files.SENTINEL}\n").alias("body"))
    return files.sentinel_documents(joined_texts, F.col("body"), ["source", "file"])


@query("src4_jsonl_text", f"select rec_id, md5({strip('text')}) as key from download_instruct where length({strip('text')}) >= 80")
def src4(t):
    lines = t("download_instruct").select("rec_id", F.to_json(F.struct("text", "source", "category")).alias("line"))
    parsed = lines.select("rec_id", T.strip(F.from_json("line", "text string, source string")["text"]).alias("text"))
    return parsed.where(F.length("text") >= 80).select("rec_id", F.md5("text").alias("key"))


@query("src5_jsonl_not_empty", f"select rec_id, source from download_instruct where {strip('text')} <> ''")
def src5(t):
    lines = t("download_instruct").select("rec_id", F.to_json(F.struct("text", "source")).alias("line"))
    parsed = lines.select("rec_id", F.from_json("line", "text string, source string").alias("j"))
    return parsed.where(T.strip(F.col("j.text")) != "").select("rec_id", "j.source")


def _folder(t, name: str) -> str:
    """A new folder in the shared one."""
    return f"{ensure_checkpoint_dir(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("snk1_document_files", f"select 0 as path_rank, md5({_mend_sql(strip(unix('text')))}) as key from {D} and {strip(unix('text'))} <> '' union all select 1, md5({_mend_sql(strip(unix('text')))}) from quality where text is not null and {strip(unix('text'))} <> ''")
def snk1(t):
    """Documents of two tables written as text files behind sentinels, and read from both paths; a path that isn't there is skipped."""
    folder = _folder(t, "snk1")
    files.write_documents(t("documents"), f"{folder}/documents")
    files.write_documents(t("quality"), f"{folder}/quality")
    back = files.read_documents(t("region").sparkSession, [f"{folder}/documents", f"{folder}/quality", f"{folder}/none"], sentinel=True, least=1)
    return back.select("path_rank", F.md5("text").alias("key"))


@query("snk2_jsonl_files", f"select md5(text) as key, source, category from download_instruct where length({strip('text')}) >= 80")
def snk2(t):
    """Records written as JSON lines among broken ones, and read again."""
    spark = t("region").sparkSession
    lines = t("download_instruct").select(F.to_json(F.struct("text", "source", "category")).alias("value"))
    broken = spark.createDataFrame([("{broken",), ("",), ('{"text": 3',)], "value string")
    folder = _folder(t, "snk2")
    lines.unionByName(broken).write.text(folder)
    return files.read_jsonl(spark, folder, 80).select(F.md5("text").alias("key"), "source", "category")


@query("snk3_shard_files", f"with w as (select text_id, {tokens('text')} as w from quality where text is not null), f as (select text_id, unnest(range(len(w))) as i, unnest(w) as x from w), o as (select x, row_number() over (order by text_id, i) - 1 as p from f) select (p // 256) as sequence, md5(string_agg(x, ' ' order by p)) as key, sum((x <> 'the')::int)::int as counted from o group by 1 having count(*) = 256")
def snk3(t):
    """Packed sequences with their masks written as shards and read again; each row holds both, so they can't be paired wrongly."""
    rows = t("quality").where("text is not null").select("text_id", T.tokens(F.col("text")).alias("w"))
    packed = packing.concat_and_chunk(rows, ["text_id"], "w", 256).withColumn("mask", F.transform("w", lambda x: (x != "the").cast("int")))
    folder = _folder(t, "snk3")
    files.write_shards(packed.withColumnRenamed("w", "tokens"), folder, 1000)
    back = files.read_shards(t("region").sparkSession, folder, 256)
    return back.select("sequence", F.md5(F.array_join("tokens", " ")).alias("key"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("counted"))


@query("src6_multi_path_source", "select 0 as path_rank, doc_id as id, length(text)::int as n from documents union all select 1, rec_id, length(text)::int from download_instruct union all select 2, text_id, length(text)::int from quality")
def src6(t):
    one = lambda rank, name, key: t(name).select(F.lit(rank).alias("path_rank"), F.col(key).alias("id"), F.length("text").alias("n"))
    return one(0, "documents", "doc_id").unionByName(one(1, "download_instruct", "rec_id")).unionByName(one(2, "quality", "text_id"))


@query("src9_log_tail", "select event_id, value from events order by event_id desc limit 600")
def src9(t):
    return t("events").orderBy(F.desc("event_id")).limit(600).select("event_id", "value")


@query("src10_chat_messages", "select m.id, m.chat_id, m.role from messages m join (select distinct id from chats where pinned = 1) c on m.chat_id = c.id")
def src10(t):
    pinned = t("chats").where("pinned = 1").select(F.col("id").alias("chat_id")).distinct()
    return t("messages").join(pinned, "chat_id", "left_semi").select("id", "chat_id", "role")


@query("prj1_words", f"select doc_id, len({words('text')})::int as n, {joined(words('text'))} as key from {D}")
def prj1(t):
    w = T.words(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, "|")).alias("key"))


_SENTENCES = rf"[{strip('s')} for s in string_split_regex(text, '[.!?]+\s+') if length({strip('s')}) > 5]"


@query("prj2_sentences", f"select doc_id, len({_SENTENCES})::int as n, {joined(_SENTENCES)} as key from {D}")
def prj2(t):
    s = T.sentences(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("key"))


_PARAGRAPHS = f"[{strip('p')} for p in string_split(text, chr(10) || chr(10)) if length({strip('p')}) > 20]"


@query("prj3_paragraphs", f"select doc_id, len({_PARAGRAPHS})::int as n, {joined(_PARAGRAPHS)} as key from {D}")
def prj3(t):
    p = T.paragraphs(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("key"))


@query("prj4_newlines", f"select doc_id, length({newlines('text')})::int as n, md5({newlines('text')}) as key from {D}")
def prj4(t):
    x = T.newlines(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.length(x).alias("n"), F.md5(x).alias("key"))


@query("prj5_mended", f"select doc_id, md5({_mend_sql('text')}) as key, {_mend_sql('text')} <> text as changed from {D}")
def prj5(t):
    x = T.mend(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.md5(x).alias("key"), (x != F.col("text")).alias("changed"))


_UNTAG = strip(r"regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query("prj6_untagged", f"select text_id, length({_UNTAG})::int as n, md5({_UNTAG}) as key from quality where text is not null")
def prj6(t):
    x = T.untag(F.col("text"))
    return t("quality").where("text is not null").select("text_id", F.length(x).alias("n"), F.md5(x).alias("key"))


@query("prj6_html_text")
def prj6_html(t):
    """Tags dropped and entities resolved; entities have no SQL form."""
    return t("quality").where("text is not null").select("text_id", T.html_strip(F.col("text")).alias("text"))


_HEADS = r"(?m)^\s*(?:[-*]\s*)?(?:#{1,6}\s*)?(?:\*\*)?(User|Assistant)(?:\s*(?:turn|response|message))?(?:\s*\d+)?\s*:(?:\*\*)?\s*"
_TURN = r"(?m)^\s*(?:#{1,6}\s*)?(?:\*\*)?Turn\s+\d+(?:\s*[-:][^\n]*)?(?:\*\*)?\s*$"
_WRAPPERS = newlines(rf"regexp_replace(regexp_replace({newlines('text')}, {lit(_TURN)}, '', 'g'), {lit(_HEADS)}, '\1: ', 'g')")


@query("prj7_chat_wrappers", f"select rec_id, md5({_WRAPPERS}) as key from download_instruct where text is not null")
def prj7(t):
    return t("download_instruct").where("text is not null").select("rec_id", F.md5(T.chat_wrappers(F.col("text"))).alias("key"))


def prompt_key_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({strip(f'lower({x})')}, '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')"


@query("prj8_prompt_keys", f"select id, {prompt_key_sql('prompt')} as key from battery_prompts")
def prj8(t):
    return t("battery_prompts").select("id", T.prompt_key(F.col("prompt")).alias("key"))


_CLASSIFIER = f"replace({strip('text')}, chr(10), ' ')"


@query("prj9_classifier_text", f"select text_id, md5(substr({_CLASSIFIER}, 1, 2000)) as quality_key, md5(substr({_CLASSIFIER}, 1, 1000)) as toxic_key from quality where text is not null")
def prj9(t):
    x = F.col("text")
    return t("quality").where("text is not null").select("text_id", F.md5(T.classifier_text(x, 2000)).alias("quality_key"), F.md5(T.classifier_text(x, 1000)).alias("toxic_key"))


@query("prj10_rendered_turns", f"select rec_id, md5(array_to_string([upper(x.role[1]) || x.role[2:] || ': ' || x.content for x in {turns('text')}], chr(10))) as key from download_instruct where text is not null")
def prj10(t):
    return t("download_instruct").where("text is not null").select("rec_id", F.md5(U.rendered(U.parse(F.col("text")))).alias("key"))


@query("prj11_with_context", f"select id, case when {strip('difficulty')} <> '' then prompt || chr(10) || chr(10) || difficulty else prompt end as text from battery_prompts")
def prj11(t):
    return t("battery_prompts").select("id", T.with_context(F.col("prompt"), F.col("difficulty")).alias("text"))


_BARE = strip("content")


@query("prj12_fenced", rf"select id, case when not contains({_BARE}, '```') and regexp_matches({_BARE}, '^(def |class |import |from |for |while |print\(|#)') then '```python' || chr(10) || {_BARE} || chr(10) || '```' else {_BARE} end as text from messages where content is not null")
def prj12(t):
    return t("messages").where("content is not null").select("id", T.fenced(F.col("content")).alias("text"))


@query(
    "prj13_question_answers",
    """with best as (select chat_id, content, row_number() over (partition by chat_id order by length(content) desc, id) as place from messages where role = 'assistant' and content is not null and chat_id is not null)
    select c.id, 'Question: ' || c.title || chr(10) || chr(10) || 'Answer: ' || b.content as text from (select distinct id, title from chats where title is not null) c join best b on b.chat_id = c.id and b.place = 1""",
)
def prj13(t):
    answers = t("messages").where("role = 'assistant' and content is not null and chat_id is not null")
    best = answers.groupBy("chat_id").agg(F.max_by("content", F.struct(F.length("content"), -F.col("id"))).alias("content"))
    chats = t("chats").where("title is not null").select("id", "title").distinct()
    joined_rows = chats.join(best, F.col("id") == F.col("chat_id"))
    return joined_rows.select("id", F.concat(F.lit("Question: "), "title", F.lit("\n\nAnswer: "), "content").alias("text"))


def _stops_sql(x: str) -> str:
    x = strip(x)
    for stop in K.STOP_MARKERS:
        x = f"split_part({x}, {lit(stop)}, 1)"
    return strip(x)


@query("prj14_cut_at_stops", f"select rec_id, md5({_stops_sql('text')}) as key from download_instruct where text is not null")
def prj14(t):
    return t("download_instruct").where("text is not null").select("rec_id", F.md5(T.cut_at_stops(F.col("text"))).alias("key"))


_ROLES = "|".join(K.SPEAKER_WORDS)


@query(
    "prj15_cut_speakers",
    rf"""with c as (select text_id, text, case when regexp_matches(text, '(?is)[.!?…]\s+(?:{_ROLES})\s?:\s') then length(regexp_extract(text, '(?is)^(.*?[.!?…])\s+(?:{_ROLES})\s?:\s', 1)) end as a,
    case when regexp_matches(text, '(?is)\n[ \t]*(?:{_ROLES}|q|a)[ \t]?:[ \t]') then length(regexp_extract(text, '(?is)^(.*?)\n[ \t]*(?:{_ROLES}|q|a)[ \t]?:[ \t]', 1)) end as b from quality where text is not null)
    select text_id, md5(regexp_replace(left(text, least(coalesce(a, length(text)), coalesce(b, length(text)))), '\s+$', '')) as key from c""",
)
def prj15(t):
    return t("quality").where("text is not null").select("text_id", F.md5(T.cut_speaker(F.col("text"))).alias("key"))


_SLOTS = r"regexp_replace(content, '\[(?:Insert|Your|Name of)[^\]\n]{0,80}\]', '', 'g')"
_BODY = strip(rf"regexp_replace({_SLOTS}, '(?m)[ \t\r\f]+$', '', 'g')")


@query(
    "prj16_clean_responses",
    rf"""with b as (select id, {_BODY} as body from messages where content is not null), c as (select id, body, regexp_replace(split_part(body, chr(10), -1), '^\s+', '') as tail, length(regexp_extract(body, '(?s)^(.*[.!?])', 1)) as last from b)
    select id, md5(case when length(body) > 100 and not regexp_matches(body, '[.!?"'')]\z') and not regexp_matches(tail, '^(?:-|\*|```|\d+[.)])') and not ends_with(tail, ':') and last > 51 then left(body, last) else body end) as key from c""",
)
def prj16(t):
    return t("messages").where("content is not null").select("id", F.md5(T.clean_response(F.col("content"), F.lit("length"))).alias("key"))


@query("prj17_code_bodies")
def prj17(t):
    """The part of each coding answer that parses; parsing has no SQL form."""
    return t("download_instruct").where("text like '%def %'").select("rec_id", T.code_body(F.col("text")).alias("code"))


@query("prj18_titles", f"select id, case when length(content) > 50 then {strip('left(content, 50)')} || '...' else {strip('left(content, 50)')} end as title from messages where role = 'user' and content is not null")
def prj18(t):
    return t("messages").where("role = 'user' and content is not null").select("id", T.auto_title(F.col("content")).alias("title"))


@query("prj19_coerced", r"select id, case when lower(content) in ('true', 'false') then 'bool' when lower(content) in ('null', 'none') then 'null' when regexp_matches(content, '^-?\d+$') then 'int' when regexp_matches(content, '^-?\d+\.\d*([eE][-+]?\d+)?$') then 'float' else 'str' end as kind from messages where content is not null")
def prj19(t):
    return t("messages").where("content is not null").select("id", T.coerced_kind(F.col("content")).alias("kind"))


_SPAN = "(updated_at - created_at)"
_S = f"cast(trunc({_SPAN}) as bigint)"


@query(
    "prj20_durations",
    f"""select id, case when {_SPAN} is null or {_SPAN} <= 0 then '?' when {_S} >= 86400 then ({_S} // 86400) || 'd ' || ({_S} % 86400 // 3600) || 'h ' || ({_S} % 3600 // 60) || 'm' else ({_S} // 3600) || 'h ' || ({_S} % 3600 // 60) || 'm' end as duration,
    case when {_SPAN} >= 0 then case when {_S} // 3600 < 10 then '0' else '' end || ({_S} // 3600) || ':' || lpad(({_S} % 3600 // 60)::varchar, 2, '0') || ':' || lpad(({_S} % 60)::varchar, 2, '0') end as clock from chats""",
)
def prj20(t):
    span = F.col("updated_at") - F.col("created_at")
    return t("chats").select("id", T.duration(span).alias("duration"), F.when(span >= 0, T.clock(span)).alias("clock"))


@query("cfg_age_buckets", "with m as (select max(updated_at) as now from chats) select id, case when (now - updated_at) / 86400 < 1 then 'Today' when (now - updated_at) / 86400 < 2 then 'Yesterday' when (now - updated_at) / 86400 < 7 then 'Last 7 days' when (now - updated_at) / 86400 < 30 then 'Last 30 days' else 'Older' end as bucket from chats, m where updated_at is not null")
def cfg(t):
    chats = t("chats").where("updated_at is not null")
    now = F.broadcast(chats.agg(F.max("updated_at").alias("now")))
    return chats.crossJoin(now).select("id", T.age_bucket((F.col("now") - F.col("updated_at")) / 86400).alias("bucket"))


_ASCII = r"(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text))"
_GATES = f"(length(text) >= 100 and len({tokens('text')}) >= 20 and {_ASCII} >= 0.80)"


@query("fil1_gates", f"select doc_id, {_GATES} as passes, round({_ASCII}, 6) as ascii_share from {D} and text <> ''")
def fil1(t):
    x = F.col("text")
    return t("documents").where("text is not null and text <> ''").select("doc_id", Q.gates(x).alias("passes"), F.round(Q.ascii_share(x), 6).alias("ascii_share"))


def _scores_sql() -> str:
    stop = "[" + ", ".join(lit(w) for w in K.STOPWORDS) + "]"
    top = "list_max([len(list_filter(g, lambda y: y = x)) for x in list_distinct(g)])"
    boiler = " + ".join(f"regexp_matches(text, {lit('(?i)' + p)})::int" for p in K.BOILERPLATE)
    template = " + ".join(f"regexp_matches(text, {lit(p)})::int" for p in K.TEMPLATES)
    links = rf"(len(regexp_extract_all(text, {lit(K.URL)})) + len(regexp_extract_all(text, {lit(K.EMAIL)})))"
    total = " + ".join(f"{w} * s_{k}" for k, w in K.WEIGHTS.items())
    return rf"""with a as (select doc_id, text, {words('text')} as w, [len({tokens('s')})::double for s in {_SENTENCES}] as sl, [len({tokens('p')})::double for p in {_PARAGRAPHS}] as pl,
      [{strip('l')} for l in string_split(text, chr(10)) if length({strip('l')}) > 10] as ls from {D}),
    b as (select *, len(w) as n, len(list_distinct(w)) / sqrt(len(w)) as c, len(sl) as ns, list_sum(sl) / len(sl) as mean, list_sum([x * x for x in sl]) / len(sl) as sq, list_sum(pl) / len(pl) as pm,
      len([x for x in w if list_contains({stop}, x)]) / len(w) as nat, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] as g, {boiler} as bh, {template} as th, {links} / greatest(1, len(w)) * 100 as dens from a),
    h as (select doc_id, max(k) as topn from (select doc_id, x, count(*) as k from (select doc_id, unnest(g) as x from b) group by all) group by doc_id),
    s as (select b.doc_id, n, case when n >= 20 then case when n < 50 then 0.2 when n < 200 then 0.5 + 0.3 * (n - 50) / 150 when n <= 5000 then 1.0 when n <= 20000 then 1.0 - 0.3 * (n - 5000) / 15000 else 0.5 end end::double as s_length,
      case when n >= 20 then case when c < 2 then 0.1 when c < 4 then 0.3 + 0.4 * (c - 2) / 2 when c <= 20 then 0.8 + 0.2 * least(1.0, (c - 4) / 8) else 0.9 end end::double as s_diversity,
      case when n >= 20 then case when ns < 2 then 0.3 else 0.6 * (case when mean < 5 then 0.3 when mean < 10 then 0.6 when mean > 50 then 0.5 else 1.0 end) + 0.4 * least(1.0, sqrt(greatest(0.0, sq - mean * mean)) / 8) end end::double as s_sentences,
      case when n >= 20 then case when len(pl) = 0 then 0.2 when len(pl) = 1 then case when n > 200 then 0.5 else 0.7 end when pm between 30 and 200 then 1.0 when pm < 10 then 0.4 else 0.7 end end::double as s_paragraphs,
      case when n >= 20 then case when nat between 0.30 and 0.60 then 1.0 when nat >= 0.20 and nat < 0.30 then 0.6 when nat < 0.20 then 0.3 when nat <= 0.70 then 0.7 else 0.3 end end::double as s_naturalness,
      case when n >= 20 then case when len(ls) = 0 then 0.5 else least(1.0, len([l for l in ls if regexp_matches(l, '^[\p{{Lu}}\p{{Nd}}]')]) / len(ls) + 0.2) end end::double as s_capitals,
      case when n >= 20 then case when n < 50 then 0.7 when topn / (n - 2) > 0.05 then 0.2 when topn / (n - 2) > 0.02 then 0.6 else 1.0 end end::double as s_repetition,
      case when n >= 20 then case when bh = 0 then 1.0 when bh <= 2 then 0.7 when bh <= 4 then 0.4 else 0.1 end end::double as s_boilerplate,
      case when n >= 20 then case when th = 0 then 1.0 else greatest(0.2, 1.0 - 0.3 * th) end end::double as s_template,
      case when n >= 20 then case when dens < 0.5 then 1.0 when dens < 2 then 0.7 when dens < 5 then 0.4 else 0.1 end end::double as s_clean from b left join h on b.doc_id = h.doc_id)
    select doc_id, n::int as n_words, {', '.join(f'round(s_{k}, 4) as s_{k}' for k in K.WEIGHTS)}, round(case when n < 20 then 0.0 else {total} end, 4) as quality_score from s"""


SCORES_SQL = _scores_sql()


@query("sco_quality_scores", SCORES_SQL)
def sco(t):
    """Sub-scores and the combined score of every document."""
    s = Q.scored(spread(t("documents").where("text is not null").select("doc_id", "text")))
    return s.select("doc_id", "n_words", *[F.round(f"s_{k}", 4).alias(f"s_{k}") for k in K.WEIGHTS], F.col("quality_score"))


@query("fil2_quality_gate", f"with s as ({SCORES_SQL}), g as (select doc_id, {_GATES} as passes from {D}) select doc_id, quality_score from s join g using (doc_id) where passes and quality_score >= 0.8")
def fil2(t):
    rows = t("documents").where("text is not null").select("doc_id", "text").where(Q.gates(F.col("text")))
    return Q.scored(rows).select("doc_id", F.col("quality_score")).where("quality_score >= 0.8")


_RULES = [("web", 0.85, 0), ("plain", 0.70, 200), ("stack", 0.0, 120), ("math", 0.0, 0), ("intl", 0.0, 0)]


@query(
    "fil3_kind_rules",
    f"with s as ({SCORES_SQL}), r(kind, least, chars) as (values {', '.join(f'({lit(k)}, {m}, {c})' for k, m, c in _RULES)}) select d.doc_id, d.kind, s.quality_score >= r.least and length(d.text) >= r.chars as passes from documents d join s using (doc_id) join r using (kind)",
)
def fil3(t):
    docs = t("documents").where("text is not null").select("doc_id", "text", "kind")
    rules = docs.sparkSession.createDataFrame(_RULES, "kind string, least double, chars int")
    scored = Q.scored(docs).join(F.broadcast(rules), "kind")
    return scored.select("doc_id", "kind", ((F.col("quality_score") >= F.col("least")) & (F.length("text") >= F.col("chars"))).alias("passes"))


@query("fil4_blocklist", f"select rec_id from download_instruct where {any_of('lower(text)', K.REFUSAL_PHRASES)}")
def fil4(t):
    return t("download_instruct").where(T.contains_any(F.lower("text"), K.REFUSAL_PHRASES)).select("rec_id")


@query("fil5_length_bounds", f"select rec_id, case when length(text) < 24 then 'short' when length(text) > 7000 then 'long' when not (contains(text, 'User:') and contains(text, 'Assistant:')) then 'markers' when len({tokens('text')}) > 300 then 'wordy' else 'kept' end as verdict from download_instruct where text is not null")
def fil5(t):
    x = F.col("text")
    verdict = F.when(F.length(x) < 24, "short").when(F.length(x) > 7000, "long").when(~(F.contains(x, F.lit("User:")) & F.contains(x, F.lit("Assistant:"))), "markers").when(F.size(T.tokens(x)) > 300, "wordy").otherwise("kept")
    return t("download_instruct").where("text is not null").select("rec_id", verdict.alias("verdict"))


def _defect_sql() -> str:
    opening = r"""lower(regexp_replace(a, '^["''*# ]+', ''))"""
    per = f"case when {starts_sql(opening, K.BAD_OPENINGS)} then 'refusal_hedge' when length({strip('a')}) < 2 then 'empty_turn' end"
    pairs = f"[i for i in range(2, len(t) + 1) if t[i].role = 'assistant' and len({tokens('t[i - 1].content')}) < 15 and len({tokens('t[i].content')}) > 200 and not regexp_matches(t[i - 1].content, {lit(K.WRITE_INTENT)})]"
    last = f"right({strip('answers[-1]')}, 80)"
    return f"""with p as (select rec_id, source, {turns('text')} as t from download_instruct where text is not null), q as (select *, [x.content for x in t if x.role = 'assistant'] as answers, array_to_string([x.content for x in t], chr(10)) as body from p),
    r as (select *, [{per} for a in answers if {per} is not null] as bad from q)
    select rec_id, case when len(t) = 0 or t[1].role <> 'user' or len(answers) = 0 then 'shape' when regexp_matches(body, {lit(K.IDENTITY)}) then 'identity' when {any_of('lower(body)', K.BAD_ANYWHERE)} then 'refusal' when len(bad) > 0 then bad[1]
      when not regexp_matches({last}, {lit(K.END_OK)}) then 'truncated' when len({pairs}) > 0 then 'length_mismatch' else null end as reason from r"""


def starts_sql(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, {lit(p)})" for p in phrases) + ")"


DEFECTS_SQL = _defect_sql()


@query("fil6_conversation_defects", DEFECTS_SQL)
def fil6(t):
    rows = spread(t("download_instruct").where("text is not null").select("rec_id", "text", "source"))
    return rows.select("rec_id", U.defect(U.parse(F.col("text")), F.col("source")).alias("reason"))


@query("agg2_drop_reasons", f"with d as ({DEFECTS_SQL}) select coalesce(reason, 'kept') as reason, count(*) as n from d group by 1")
def agg2(t):
    rows = t("download_instruct").where("text is not null").select(F.coalesce(U.defect(U.parse(F.col("text")), F.col("source")), F.lit("kept")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CODE_LINES = f"[l for l in string_split(text, chr(10)) if {strip('l')} <> '' and not starts_with({strip('l')}, '#') and not starts_with({strip('l')}, '//') and not starts_with({strip('l')}, '/*')]"


@query("fil7_code_files", f"with s as (select doc_id, string_split(text, chr(10)) as l, {_CODE_LINES} as c, length(text) as n from {D}) select doc_id, n between 100 and 50000 and len(l) >= 5 and len(c) >= 0.3 * len(l) and list_max([length(x) for x in l]) <= 500 as passes from s")
def fil7(t):
    lines = F.split("text", "\n")
    code = F.filter(lines, lambda x: (T.strip(x) != "") & ~T.strip(x).rlike(r"^(?:#|//|/\*)"))
    passes = F.length("text").between(100, 50000) & (F.size(lines) >= 5) & (F.size(code) >= 0.3 * F.size(lines)) & (F.array_max(F.transform(lines, F.length)) <= 500)
    return t("documents").where("text is not null").select("doc_id", passes.alias("passes"))


@query("fil8_score_gate", "select event_id from events where (value >= 3.0 or value is null) and length(props) >= 8")
def fil8(t):
    return t("events").where("(value >= 3.0 or value is null) and length(props) >= 8").select("event_id")


@query("fil9_safety", f"select doc_id, regexp_matches(text, {lit(UNSAFE)}) as unsafe from {D}")
def fil9(t):
    """By our own lexicon; no list was given to match."""
    return t("documents").where("text is not null").select("doc_id", F.col("text").rlike(UNSAFE).alias("unsafe"))


@query("fil10_source_rules", f"with p as (select rec_id, {turns('text')} as t from download_instruct where text is not null) select rec_id, regexp_matches(t[1].content, {lit(K.SPAM_USER)}) as grounded, regexp_matches(t[1].content, {lit(K.GLUED_DOMAINS)}) and not contains(left(lower(t[1].content), 60), 'code') as glued from p where len(t) > 0")
def fil10(t):
    first = F.try_element_at(U.parse(F.col("text")), F.lit(1))["content"]
    rows = t("download_instruct").where("text is not null").select("rec_id", first.alias("q")).where("q is not null")
    return rows.select("rec_id", F.col("q").rlike(K.SPAM_USER).alias("grounded"), (F.col("q").rlike(K.GLUED_DOMAINS) & ~F.contains(F.left(F.lower("q"), F.lit(60)), F.lit("code"))).alias("glued"))


@query("fil11_language_tail", f"select doc_id from {D} and not {any_of('lower(text)', CODE_LANGUAGES)}")
def fil11(t):
    return t("documents").where("text is not null").where(~T.contains_any(F.lower("text"), CODE_LANGUAGES)).select("doc_id")


@query("fil12_minimum_tokens", f"select doc_id from {D} and len({tokens('text')}) >= 32")
def fil12(t):
    return t("documents").where(F.size(T.tokens(F.col("text"))) >= 32).select("doc_id")


@query("fil13_conversation_shape", f"with p as (select rec_id, {turns('text')} as t, length(text) as n from download_instruct where text is not null) select rec_id from p where len(t) >= 2 and t[-1].role = 'assistant' and n <= 5000 and length({strip('t[-1].content')}) between 5 and 4000")
def fil13(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t"), F.length("text").alias("n"))
    last = F.try_element_at("t", F.lit(-1))
    return rows.where((F.size("t") >= 2)).where((last["role"] == "assistant") & (F.col("n") <= 5000) & F.length(T.strip(last["content"])).between(5, 4000)).select("rec_id")


@query("fil14_active_sources", "with h as (select distinct source from documents), a as (select t.source, t.weight from mix_targets t join h using (source) where t.weight > 0) select source, round(weight / sum(weight) over (), 6) as share from a")
def fil14(t):
    held = t("documents").select("source").distinct()
    active = t("mix_targets").where("weight > 0").join(held, "source", "left_semi")
    return active.select("source", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy()), 6).alias("share"))


@query("fil15_missing_sources", "select source from mix_targets where weight > 0 and source not in (select source from documents where source is not null)")
def fil15(t):
    """Sources with weight and without documents; ``files.require_sources`` fails on them."""
    return t("mix_targets").where("weight > 0").join(t("documents").select("source").distinct(), "source", "left_anti").select("source")


@query("fil16_resume", "select id, role from (select distinct id, r.role from battery_prompts, (values ('user'), ('assistant')) r(role)) w where not exists (select 1 from messages m where m.role = w.role and contains(m.content, w.id))")
def fil16(t):
    """Work items (prompt, condition) without a row in the output yet."""
    items = t("battery_prompts").select("id").distinct()
    work = items.withColumn("role", F.explode(F.array(F.lit("user"), F.lit("assistant"))))
    done = t("messages").select(F.explode(F.regexp_extract_all("content", F.lit(r"[a-z]+_\d{3}"), F.lit(0))).alias("id"), "role").distinct()
    return work.join(done, ["id", "role"], "left_anti")


@query("fil17_shards", "select id, ((row_number() over (order by id) - 1) % 4)::int as shard from battery_prompts")
def fil17(t):
    return t("battery_prompts").select("id", F.pmod(F.row_number().over(Window.orderBy("id")) - 1, F.lit(4)).alias("shard"))


@query("fil18_title_search", "select distinct id, title from chats where contains(lower(title), 'compare')")
def fil18(t):
    return t("chats").where(F.contains(F.lower("title"), F.lit("compare"))).select("id", "title").distinct()
