"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import conversations, leakage, mixing, neardup, packing, pairs, quality, sentences
from loomstone.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "download_instruct"), table(spark, sf_dir, "battery_prompts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chats")).select("chat_id", "turn_no", "message_id")


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages")
    return conversations.with_content(conversations.rebuild(messages, table(spark, sf_dir, "chats")), messages)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "quality"), statistics=False)
    return found.where("text_class in ('list', 'table', 'junk')").select("text_id", "text_class")


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "quality"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.label(table(spark, sf_dir, "download_instruct")).select("rec_id", "pair_no", "defect")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "download_instruct"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packing(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_turns": p2_turns,
    "p3_found": p3_found,
    "p3_statistics": p3_statistics,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}
_SPACE = "[\\s\\p{Cf}\\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_NOTES = ["Error: context window exceeded", "Error: generation failed (code 503)", "[empty reply]", "[stream aborted]", "[stopped before first token]", "<nooutput>"]
_P2 = f"""with m as (select id, lower({_trim("chat_id")}) as k, lower(regexp_replace(role, '[^a-zA-Z]', '', 'g')) as r, {_trim("content")} as c,
   round(case when created_at >= 1e17 then created_at / 1e9 when created_at >= 1e14 then created_at / 1e6 when created_at >= 1e11 then created_at / 1e3 else created_at end * 1e6)::bigint as t, role from messages where chat_id is not null),
 n as (select m.*, case when r in ('user', 'human') then 'user' when r in ('assistant', 'ai', 'bot', 'model') then 'assistant' when r = 'system' then 'system' end as who from m),
 h as (select min(id) as chat_id, lower({_trim("id")}) as k from chats group by 2),
 ok as (select k from n group by k having bool_and(who is not null and t is not null and c is not null and c <> '' and c not in ({", ".join("'" + x + "'" for x in _NOTES)}) and role not like '%\\_%' escape '\\')),
 f as (select n.*, coalesce(t - lag(t) over (partition by k, who, c order by t, id) > 5000000, true) as fresh from n semi join ok using (k)),
 g as (select *, sum(fresh::int) over (partition by k, who, c order by t, id rows unbounded preceding) as no from f),
 turns as (select k, who, min(id) as id, min(t) as t from g group by k, who, c, no),
 p as (select *, row_number() over (partition by k order by t, id) as place, count(*) over (partition by k) as size, bool_or(who = 'system') over (partition by k) as has from turns),
 q as (select *, first_value(who) over (partition by k order by place) = 'system' as sys from p),
 good as (select k from q group by k having bool_and((place = 1 and who = 'system') or who = case when (place - sys::int) % 2 = 1 then 'user' else 'assistant' end) and bool_and((size - sys::int) % 2 = 0 and size - sys::int >= 2))
 select h.chat_id, q.place::int as turn_no, q.id as message_id from q semi join good using (k) join h using (k)"""
_P2_TURNS = _P2.replace("q.id as message_id from q", f"q.id as message_id, q.who as role, {_trim('x.content')} as content from q") + " join messages x on x.id = q.id"
_P5 = """with recursive w as (select rec_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from download_instruct where text is not null),
 s as (select distinct rec_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as g from w),
 n as (select rec_id, count(*) as n from s group by 1),
 p as (select a.rec_id as a, b.rec_id as b, count(*) as shared from s a join s b using (g) where a.rec_id < b.rec_id group by 1, 2),
 l as (select a, b from p join n x on x.rec_id = a join n y on y.rec_id = b where shared >= 0.6 * (x.n + y.n - shared) - 1e-9),
 e as (select a, b from l union select b, a from l),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
 select least(a, min(b)) as group_id, a as rec_id from r group by a"""
ORACLES: dict[str, str] = {"p2_found": _P2, "p2_turns": _P2_TURNS, "p5_found": _P5}
"""SQL for what it can express; the others are tested against brute force or fixtures."""
