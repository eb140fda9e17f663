"""Deduplication, joins, aggregations, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import quality as Q
from loomstone.functions import text as T
from loomstone.functions import turns as U
from loomstone.operators import dedup, mixing, records
from loomstone.plans.base import query, strip, tokens, turns, words
from loomstone.plans.texts import prompt_key_sql
from loomstone.session import spread

D = "documents where text is not null"
_KEY = "substr(md5(substr(text, 1, 2000)), 1, 24)"


def docs(t):
    return t("documents").where("text is not null")


@query("dup1_exact_documents", f"select doc_id, key from (select doc_id, {_KEY} as key, row_number() over (partition by {_KEY} order by doc_id) as place from {D}) x where place = 1")
def dup1(t):
    rows = docs(t).select("doc_id", dedup.content_key(F.col("text")).alias("key"))
    return dedup.keep_first(rows, [F.col("key")], [F.col("doc_id")])


@query("dup2_prior_corpus", f"select doc_id from {D} and {_KEY} not in (select {_KEY} from quality where text is not null)")
def dup2(t):
    known = t("quality").where("text is not null")
    return dedup.not_in(docs(t), known, dedup.content_key(F.col("text")), dedup.content_key(F.col("text"))).select("doc_id")


@query(
    "dup3_conversations",
    f"""with p as (select rec_id, {turns('text')} as t from download_instruct where text is not null), k as (select rec_id, left({prompt_key_sql("t[1].content")}, 150) as a, left(coalesce(t[2].content, ''), 200) as b from p where len(t) > 0)
    select rec_id from (select rec_id, row_number() over (partition by a, b order by rec_id) as place from k) x where place = 1""",
)
def dup3(t):
    parsed = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t")).where(F.size("t") > 0)
    a = F.left(T.prompt_key(F.try_element_at("t", F.lit(1))["content"]), F.lit(150))
    b = F.left(F.coalesce(F.try_element_at("t", F.lit(2))["content"], F.lit("")), F.lit(200))
    keyed = parsed.select("rec_id", a.alias("a"), b.alias("b"))
    return dedup.keep_first(keyed, [F.col("a"), F.col("b")], [F.col("rec_id")]).select("rec_id")


@query("dup4_full_texts", "select min(rec_id) as rec_id, count(*) as copies from download_instruct where text is not null group by md5(substr(text, 1, 2000))")
def dup4(t):
    rows = t("download_instruct").where("text is not null")
    return rows.groupBy(F.md5(F.substring("text", 1, 2000)).alias("k")).agg(F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("copies")).drop("k")


@query("dup5_distinct_words", f"select id, array_to_string(list_distinct_ordered, '|') as words from (select id, [w[i] for i in range(1, len(w) + 1) if not list_contains(w[1:i - 1], w[i])] as list_distinct_ordered from (select id, {words('prompt')} as w from battery_prompts) a) b")
def dup5(t):
    return t("battery_prompts").select("id", F.array_join(F.array_distinct(T.words(F.col("prompt"))), "|").alias("words"))


_FIRST = r"regexp_extract(text, '(?s)^User: ?(.*?)(?:\nAssistant:|\z)', 1)"


@query("dec1_exact_prompts", f"with k as (select {prompt_key_sql('prompt')} as key from battery_prompts), r as (select rec_id, {prompt_key_sql(_FIRST)} as key from download_instruct where text is not null) select rec_id from r where key not in (select key from k)")
def dec1(t):
    rows = t("download_instruct").where("text is not null").withColumn("key", T.prompt_key(U.first_user(F.col("text"))))
    return dedup.not_in(rows, t("battery_prompts").withColumn("k", T.prompt_key(F.col("prompt"))), F.col("key"), F.col("k")).select("rec_id")


@query("dec2_first_user", f"select rec_id, md5({_FIRST}) as key from download_instruct where text is not null")
def dec2(t):
    return t("download_instruct").where("text is not null").select("rec_id", F.md5(U.first_user(F.col("text"))).alias("key"))


_GRAMS = "[array_to_string(w[i:i + least(13, len(w)) - 1], ' ') for i in range(1, len(w) - least(13, len(w)) + 2)]"


@query(
    "dec3_ngram_overlap",
    f"""with l as (select distinct rec_id, unnest({_GRAMS}) as gram from (select rec_id, {words('text')} as w from download_instruct where text is not null) a where len(w) > 0),
    r as (select distinct id, unnest({_GRAMS}) as gram from (select id, {words('prompt')} as w from battery_prompts) a where len(w) > 0) select distinct rec_id, id from l join r using (gram)""",
)
def dec3(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", T.words(F.col("text")).alias("w"))
    items = t("battery_prompts").select("id", T.words(F.col("prompt")).alias("w"))
    return dedup.ngram_overlap(rows, items, "rec_id", "id", F.col("w"), F.col("w"))


@query("mh1_shingles", f"select doc_id, length({strip('lower(text)')})::int as n, case when length({strip('lower(text)')}) >= 5 then len(list_distinct([substr(s, i, 5) for i in range(1, length(s) - 3)]))::int else 0 end as shingles from (select doc_id, text, {strip('lower(text)')} as s from {D}) x")
def mh1(t):
    low = T.strip(F.lower("text"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 4), lambda i: F.substring(F.col("s"), i, F.lit(5))))
    return docs(t).select("doc_id", low.alias("s")).select("doc_id", F.length("s").alias("n"), F.when(F.length("s") >= 5, F.size(grams)).otherwise(0).alias("shingles"))


@query("mh2_signatures")
def mh2(t):
    return dedup.signatures(spread(docs(t).select("doc_id", "text")), "doc_id", "text").select("doc_id", "shingles", "signature")


@query("mh4_bands")
def mh4(t):
    return dedup.bands(dedup.signatures(spread(docs(t).select("doc_id", "text")), "doc_id", "text"), "doc_id")


@query("mh5_similar_pairs")
def mh5(t):
    return dedup.similar_pairs(dedup.signatures(spread(docs(t).select("doc_id", "text")), "doc_id", "text"), "doc_id")


@query("mh6_kept_documents")
def mh6(t):
    signed = dedup.cut(dedup.signatures(spread(docs(t).select("doc_id", "text")), "doc_id", "text"))
    return dedup.greedy_keep(signed.select("doc_id"), dedup.similar_pairs(signed, "doc_id"), "doc_id")


@query("mh7_index_stats")
def mh7(t):
    return dedup.index_stats(dedup.signatures(spread(docs(t).select("doc_id", "text")), "doc_id", "text"), "doc_id")


@query("join_inner_scored", "select m.id, c.model_id from messages m join (select distinct id, model_id from chats) c on m.chat_id = c.id where c.model_id is not null")
def join_inner(t):
    chats = t("chats").where("model_id is not null").select(F.col("id").alias("chat_id"), "model_id").distinct()
    return t("messages").join(chats, "chat_id").select("id", "model_id")


@query("join_anti_orphans", "select id from messages where chat_id is not null and chat_id not in (select id from chats where id is not null)")
def join_anti(t):
    return t("messages").where("chat_id is not null").join(t("chats").select(F.col("id").alias("chat_id")).distinct(), "chat_id", "left_anti").select("id")


@query("join_semi_sources", "select doc_id from documents where source in (select source from mix_targets)")
def join_semi(t):
    return t("documents").join(t("mix_targets").select("source"), "source", "left_semi").select("doc_id")


@query("join_outer_totals", "select coalesce(d.source, m.source) as source, coalesce(d.n, 0) as n, m.weight from (select source, count(*) as n from documents where source is not null group by 1) d full join mix_targets m using (source)")
def join_outer(t):
    counts = t("documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(t("mix_targets").select("source", "weight"), "source", "full").select("source", F.coalesce("n", F.lit(0)).alias("n"), "weight")


@query("join_cross_work", "select b.id, c.condition, s.seed::int as seed from battery_prompts b, (values ('base'), ('tuned')) c(condition), (values (0), (1)) s(seed)")
def join_cross(t):
    """Every prompt under every condition and seed; both lists are literals."""
    conditions = F.explode(F.array(F.lit("base"), F.lit("tuned")))
    return t("battery_prompts").select("id", conditions.alias("condition")).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))


_TREE = """with recursive n as (select id, lag(id) over (partition by chat_id order by created_at, id) as up, role, row_number() over (partition by chat_id order by created_at, id) as d from messages where chat_id in (select id from chats where pinned = 1) and created_at is not null),
 p as (select id, [id] as path, role, 1 as depth from n where up is null union all select n.id, list_append(p.path, n.id), n.role, p.depth + 1 from n join p on n.up = p.id where p.depth < 12)
 select id, array_to_string(path, '>') as path from p where role = 'assistant'"""


@query("join_thread_paths", _TREE)
def join_tree(t):
    """Each message answers the one before it in its chat; paths from the first to every answer, 12 deep at most."""
    pinned = t("chats").where("pinned = 1").select(F.col("id").alias("chat_id")).distinct()
    rows = t("messages").where("created_at is not null").join(pinned, "chat_id", "left_semi")
    nodes = rows.withColumn("up", F.lag("id").over(Window.partitionBy("chat_id").orderBy("created_at", "id")))
    paths = records.thread_paths(nodes, "id", "up", "role", "content")
    return paths.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("join_thread_paths_all", _TREE.replace("chat_id in (select id from chats where pinned = 1)", "chat_id is not null"))
def join_tree_all(t):
    """The same paths in every chat; only messages without a chat or a time, which have no place in a chat, are left out."""
    rows = t("messages").where("chat_id is not null and created_at is not null")
    nodes = rows.withColumn("up", F.lag("id").over(Window.partitionBy("chat_id").orderBy("created_at", "id")))
    paths = records.thread_paths(nodes, "id", "up", "role", "content")
    return paths.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("agg1_source_shares", f"select source, count(*) as n, sum(len({tokens('text')})) as tokens, round(sum(len({tokens('text')})) / sum(sum(len({tokens('text')}))) over (), 6) as share from {D} group by source")
def agg1(t):
    per = docs(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"))
    return per.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))


@query("agg3_kept_report", "select source, count(*) as n, count(*) filter (where length(text) >= 600) as kept, round(avg((length(text) >= 600)::int), 6) as kept_share from download_instruct where text is not null group by rollup (source)")
def agg3(t):
    kept = (F.length("text") >= 600).cast("int")
    return t("download_instruct").where("text is not null").rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum(kept).alias("kept"), F.round(F.avg(kept), 6).alias("kept_share"))


_WORDS_AZ = "regexp_extract_all(lower(text), '[a-z]+')"


@query("agg4_top_trigrams", f"with g as (select text_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as g, len(w) - 2 as n from (select text_id, {words('text')} as w from quality where text is not null) a), c as (select text_id, n, g, count(*) as k from g group by all) select text_id, max(k) as top, round(max(k) / any_value(n), 6) as share from c group by text_id")
def agg4(t):
    rows = t("quality").where("text is not null").select("text_id", F.inline(F.array(F.struct(T.words(F.col("text")).alias("w")))))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    long = rows.where(F.size("w") >= 3).select("text_id", (F.size("w") - 2).alias("n"), F.explode(grams).alias("g"))
    counts = long.groupBy("text_id", "n", "g").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("text_id").agg(F.max("k").alias("top"), F.round(F.max("k") / F.first("n"), 6).alias("share"))


@query("agg5_repetition", f"with g as (select text_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as g from (select text_id, {_WORDS_AZ} as w from quality where text is not null) a where len(w) >= 6), c as (select text_id, g, count(*) as k from g group by all), m as (select text_id, max(k) / sum(k) as r from c group by 1) select q.text_id, round(coalesce(r, 0), 6) as repetition from quality q left join m using (text_id) where text is not null")
def agg5(t):
    rows = t("quality").where("text is not null").select("text_id", F.inline(F.array(F.struct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")))))
    return rows.select("text_id", F.round(F.when(F.size("w") < 6, 0.0).otherwise(Q.top_gram_share(F.col("w"))), 6).alias("repetition"))


@query("agg6_distinct_words", f"select doc_id, len(list_distinct({words('text')}))::int as n from {D}")
def agg6(t):
    return docs(t).select("doc_id", F.size(F.array_distinct(T.words(F.col("text")))).alias("n"))


@query("agg9_role_accuracy", "select role, count(*) as n, round(avg((length(content) > 40)::int), 6) as accuracy from messages where content is not null group by rollup (role)")
def agg9(t):
    return t("messages").where("content is not null").rollup("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.length("content") > 40).cast("int")), 6).alias("accuracy"))


@query("agg10_regressions", "with a as (select chat_id, max(length(content)) filter (where role = 'user') as u, max(length(content)) filter (where role = 'assistant') as s from messages where chat_id is not null group by 1) select count(*) filter (where u > s) as gaps, count(*) filter (where u <= s) as holds from a")
def agg10(t):
    per = t("messages").where("chat_id is not null").groupBy("chat_id").agg(F.max(F.when(F.col("role") == "user", F.length("content"))).alias("u"), F.max(F.when(F.col("role") == "assistant", F.length("content"))).alias("s"))
    return per.agg(F.count_if(F.col("u") > F.col("s")).alias("gaps"), F.count_if(F.col("u") <= F.col("s")).alias("holds"))


@query("agg11_best_answers", "select chat_id, id, n from (select chat_id, id, length(content) as n, row_number() over (partition by chat_id order by length(content) desc, id) as place from messages where role = 'assistant' and chat_id is not null and length(content) >= 100) x where place = 1")
def agg11(t):
    rows = t("messages").where("role = 'assistant' and chat_id is not null and length(content) >= 100").withColumn("n", F.length("content"))
    return records.pick_best(rows, "chat_id", F.col("n"), F.col("id"), "id").withColumnRenamed("score", "n")


@query("agg12_least_variant", "select event_type, arg_min(event_id, value) as event_id from (select event_type, event_id, value from events where value is not null qualify row_number() over (partition by event_type order by value, event_id) = 1) x group by 1")
def agg12(t):
    return t("events").where("value is not null").groupBy("event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("agg13_last_values", "select user_id, arg_max(value, event_id) filter (where value is not null) as value, arg_max(props, event_id) filter (where props is not null) as props from events group by 1")
def agg13(t):
    return records.last_values(t("events"), ["value", "props"], "event_id", ["user_id"])


@query("agg14_gate", "select event_type, sum(value) >= 1000 and bool_and(value >= 0) as passes from events group by 1")
def agg14(t):
    return t("events").groupBy("event_type").agg(((F.sum("value") >= 1000) & F.bool_and(F.col("value") >= 0)).alias("passes"))


@query("agg15_perplexity", "select event_type, round(exp(sum(value) / (sum(length(props)) * 10)), 4) as ppl from events group by 1")
def agg15(t):
    return t("events").groupBy("event_type").agg(F.round(F.exp(F.sum("value") / (F.sum(F.length("props")) * 10)), 4).alias("ppl"))


@query(
    "agg16_choices",
    "with c as (select l_orderkey, l_linenumber, l_extendedprice as p, l_extendedprice / l_quantity as q, l_returnflag = 'R' as truth from lineitem), r as (select *, row_number() over (partition by l_orderkey order by p desc, l_linenumber, q) as rp, row_number() over (partition by l_orderkey order by q desc, l_linenumber, p) as rq from c) select round(avg(truth::int) filter (where rp = 1), 6) as accuracy, round(avg(truth::int) filter (where rq = 1), 6) as accuracy_norm from r",
)
def agg16(t):
    """The choice of the highest score, and of the highest score per unit; the first among equals."""
    c = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("q"), (F.col("l_returnflag") == "R").cast("int").alias("truth"))
    best = c.groupBy("l_orderkey").agg(F.max_by("truth", F.struct("p", -F.col("l_linenumber"), -F.col("q"))).alias("a"), F.max_by("truth", F.struct("q", -F.col("l_linenumber"), -F.col("p"))).alias("b"))
    return best.agg(F.round(F.avg("a"), 6).alias("accuracy"), F.round(F.avg("b"), 6).alias("accuracy_norm"))


@query("agg17_mask_share", f"with p as (select {turns('text')} as t from download_instruct where text is not null) select round(sum(list_sum([case when x.role = 'assistant' then len({tokens('x.content')}) else 0 end for x in t])) / sum(list_sum([1 + len({tokens('x.content')}) for x in t])), 6) as mask_share from p where len(t) > 0")
def agg17(t):
    x = t("download_instruct").where("text is not null").select(F.explode(U.parse(F.col("text"))).alias("x")).select("x.role", F.size(T.tokens(F.col("x.content"))).alias("n"))
    return x.agg(F.round(F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)) / F.sum(F.col("n") + 1), 6).alias("mask_share"))


@query("agg18_manifest", "with c as (select source, count(*) as n from documents where source is not null group by 1) select array_to_string(list(source || '=' || n order by source), ',') as manifest from c")
def agg18(t):
    per = t("documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.concat(F.col("source"), F.lit("="), F.col("n").cast("string"))))
    return per.agg(F.array_join(pairs, ",").alias("manifest"))


@query("snk4_manifest", f"select source, count(*) as n, sum(length(text)) as chars, round(count(*) / sum(count(*)) over (), 6) as share from {D} group by source")
def snk4(t):
    per = docs(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_ORDER = "md5('7:' || doc_id)"


@query("win1_running_totals", f"select doc_id, sum(length(text)) over (partition by source order by {_ORDER} rows unbounded preceding) - length(text) as before from {D}")
def win1(t):
    rows = docs(t).select("doc_id", "source", F.length("text").alias("n"), mixing.order_key(7, F.col("doc_id")).alias("k"))
    return mixing.running_totals(rows.withColumn("source", F.coalesce("source", F.lit("?"))), ["source"], [F.col("k")], F.col("n")).select("doc_id", "before")


@query("win2_budget", f"select doc_id from (select doc_id, sum(length(text)) over (partition by source order by {_ORDER} rows unbounded preceding) - length(text) as before from {D} and source is not null) x where before < 20000")
def win2(t):
    rows = docs(t).where("source is not null").select("doc_id", "source", F.length("text").alias("n"), mixing.order_key(7, F.col("doc_id")).alias("k"))
    return mixing.until_budget(rows, ["source"], [F.col("k")], F.col("n"), 20000).select("doc_id")


@query("win3_lag_turns", "select id, lag(role) over (partition by chat_id order by created_at, id) as before from messages where chat_id is not null and created_at is not null")
def win3(t):
    near = Window.partitionBy("chat_id").orderBy("created_at", "id")
    return t("messages").where("chat_id is not null and created_at is not null").select("id", F.lag("role").over(near).alias("before"))


@query("win4_sequence_ids", "select id, category || '_' || lpad((row_number() over (partition by category order by id) - 1)::varchar, 3, '0') as made from battery_prompts")
def win4(t):
    place = F.row_number().over(Window.partitionBy("category").orderBy("id")) - 1
    return t("battery_prompts").select("id", F.concat("category", F.lit("_"), F.lpad(place.cast("string"), 3, "0")).alias("made"))


@query("win5_every_nth", "select id from (select id, row_number() over (order by id) - 1 as i from battery_prompts) x where i % 20 = 0")
def win5(t):
    return t("battery_prompts").withColumn("i", F.row_number().over(Window.orderBy("id")) - 1).where("i % 20 = 0").select("id")


_STEP = r"regexp_extract(props, '(\d+)', 1)::bigint"


@query("win6_last_segment", f"with s as (select *, {_STEP} as step from events), d as (select *, step < lag(step) over (partition by user_id order by event_id) as fell from s), l as (select user_id, max(event_id) filter (where fell) as since from d group by 1) select event_id from d join l using (user_id) where since is null or event_id >= since")
def win6(t):
    log = t("events").withColumn("step", F.regexp_extract("props", r"(\d+)", 1).cast("bigint"))
    return records.last_segment(log, "step", "event_id", "user_id").select("event_id")


@query("win7_segments", "select event_id, count(*) filter (where event_type = 'error') over (partition by user_id order by event_id rows unbounded preceding) as segment from events")
def win7(t):
    running = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.count_if(F.col("event_type") == "error").over(running).alias("segment"))


@query("win10_rising", "select event_id, coalesce(value > lag(value) over (partition by event_type order by event_id), false) as rising from events")
def win10(t):
    near = Window.partitionBy("event_type").orderBy("event_id")
    return t("events").select("event_id", F.coalesce(F.col("value") > F.lag("value").over(near), F.lit(False)).alias("rising"))


@query("win11_first_three", "select id from (select id, row_number() over (partition by category order by id) as p from battery_prompts) x where p <= 3")
def win11(t):
    return mixing.cap_per_group(t("battery_prompts"), "category", 3, [F.col("id")]).select("id")


@query("win12_fallback", "select chat_id, id from (select chat_id, id, row_number() over (partition by chat_id order by case role when 'assistant' then 0 when 'user' then 1 else 2 end, id) as p from messages where chat_id is not null and content <> '') x where p = 1")
def win12(t):
    rank = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return t("messages").where("chat_id is not null and content <> ''").groupBy("chat_id").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


@query("srt1_score_order", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders order by o_totalprice desc, o_orderkey limit 100")
def srt1(t):
    top = t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("srt3_chat_list", "select distinct id, pinned, updated_at from chats order by pinned desc, updated_at desc nulls last, id limit 50")
def srt3(t):
    return t("chats").select("id", "pinned", "updated_at").distinct().orderBy(F.desc("pinned"), F.desc_nulls_last("updated_at"), "id").limit(50)


@query("srt4_longest_first", f"select doc_id, length(text)::int as n from {D} order by n desc, doc_id limit 200")
def srt4(t):
    return docs(t).select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(200)


@query("srt5_children_by_rank", "select o_custkey as parent, o_orderkey as child, row_number() over (partition by o_custkey order by coalesce(try_cast(substr(o_orderpriority, 1, 1) as int), 99), o_orderkey) as place from orders")
def srt5(t):
    """Children of each parent by rank, those without one last."""
    rank = F.coalesce(F.try_to_number(F.substring("o_orderpriority", 1, 1), F.lit("9")).cast("int"), F.lit(99))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey"))
    return t("orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), place.alias("place"))


@query("srt6_head", "select id, prompt from battery_prompts order by id limit 20")
def srt6(t):
    return t("battery_prompts").select("id", "prompt").orderBy("id").limit(20)


@query("srt9_last_checkpoint", r"select event_type, max(regexp_extract(props, '(\d+)', 1)::bigint) as step from events where regexp_matches(props, '\d') group by 1")
def srt9(t):
    """The highest number in a series of names, compared as a number."""
    step = F.regexp_extract("props", r"(\d+)", 1).try_cast("bigint")
    return t("events").groupBy("event_type").agg(F.max(step).alias("step")).where("step is not null")


@query("srt7_offset", "select id from battery_prompts order by id limit 50 offset 100")
def srt7(t):
    return t("battery_prompts").select("id").orderBy("id").offset(100).limit(50)


@query("srt8_by_count", "select source, count(*) as n from documents where source is not null group by 1 order by n desc, source limit 10")
def srt8(t):
    return t("documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("set1_union", "select source from documents union all select source from quality")
def set1(t):
    return t("documents").select("source").unionByName(t("quality").select("source"))


@query("set2_intersect", "select source from documents intersect select source from quality")
def set2(t):
    return t("documents").select("source").intersect(t("quality").select("source"))


@query("set3_except_all", "select source from documents except all select source from quality")
def set3(t):
    return t("documents").select("source").exceptAll(t("quality").select("source"))


@query("set4_prompt_set", f"select distinct {prompt_key_sql('prompt')} as key from battery_prompts union select {prompt_key_sql('content')} from messages where role = 'system' and content is not null")
def set4(t):
    prompts = t("battery_prompts").select(T.prompt_key(F.col("prompt")).alias("key"))
    return prompts.unionByName(t("messages").where("role = 'system' and content is not null").select(T.prompt_key(F.col("content")).alias("key"))).distinct()


@query("tpch_q1", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '2000-09-02' group by 1, 2")
def q1(t):
    rows = t("lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("tpch_nation_revenue", "select n_name, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def nation_revenue(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))



