"""Sampling, mixing, masks, packing, generators and templates."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions import turns as U
from loomstone.operators import mixing, packing
from loomstone.plans.base import fraction, query, tokens, turns

D = "documents where text is not null"
_KEY = "md5('7:' || doc_id)"


def docs(t):
    return t("documents").where("text is not null")


@query("smp1_seeded_order", f"select doc_id, row_number() over (order by {_KEY}) as place from {D}")
def smp1(t):
    """Places in a seeded order: counts of earlier ranges of the hash, and the order within a range."""
    rows = docs(t).select("doc_id", mixing.order_key(7, F.col("doc_id")).alias("k"))
    return mixing.running_totals(rows, [], [F.col("k")], F.lit(1)).select("doc_id", (F.col("before") + 1).alias("place"))


@query("smp2_cap_per_source", f"select doc_id from (select doc_id, row_number() over (partition by source order by {_KEY}) as p from {D} and source is not null) x where p <= 25")
def smp2(t):
    return mixing.cap_per_group(docs(t).where("source is not null").select("doc_id", "source"), "source", 25, [mixing.order_key(7, F.col("doc_id"))]).select("doc_id")


@query("smp3_balanced", "select event_id from (select event_id, row_number() over (partition by event_type = 'error' order by md5('7:' || event_id)) as p from events where event_type in ('error', 'click')) x where p <= 500")
def smp3(t):
    rows = t("events").where("event_type in ('error', 'click')").withColumn("label", F.col("event_type") == "error")
    return mixing.cap_per_group(rows, "label", 500, [mixing.order_key(7, F.col("event_id"))]).select("event_id")


@query("smp4_bernoulli", f"select doc_id from {D} and {fraction(3, 'doc_id')} < case when source in ('web_edu_a', 'code_docs', 'math_clean') then 0.55 else 0.35 end")
def smp4(t):
    p = F.when(F.col("source").isin("web_edu_a", "code_docs", "math_clean"), 0.55).otherwise(0.35)
    return docs(t).where(mixing.fraction(3, F.col("doc_id")) < p).select("doc_id")


@query("smp5_epochs", f"select doc_id, unnest(range(1, m.max_epochs + 1))::int as epoch from documents d join mix_targets m using (source) where d.text is not null and m.max_epochs >= 1")
def smp5(t):
    rows = docs(t).join(F.broadcast(t("mix_targets").select("source", "max_epochs")), "source")
    return mixing.repeated(rows, F.col("max_epochs")).select("doc_id", "epoch")


@query("mix1_weights", "select source, round(weight / sum(weight) over (), 6) as share from mix_targets where weight > 0")
def mix1(t):
    return mixing.normalised(t("mix_targets")).select("source", F.round("share", 6).alias("share"))


_SIZES = f"select source, sum(length(text)) as size from {D} group by source"


@query("mix2_upsampling", f"with s as ({_SIZES}), w as (select source, weight / sum(weight) over () as share from mix_targets where weight > 0) select source, greatest(1, ceil(share * (select sum(size) from s) / size))::bigint as factor from w join s using (source)")
def mix2(t):
    sizes = docs(t).groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    rows = mixing.normalised(t("mix_targets")).join(sizes, "source").crossJoin(total)
    return rows.select("source", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total") / F.col("size"))).alias("factor"))


_STRIDE = f"""with w as (select source, weight / sum(weight) over () as share from mix_targets where weight > 0)
 select doc_id, round((sum(length(text)) over (partition by source order by {_KEY} rows unbounded preceding) - length(text)) / share, 3) as stride from documents join w using (source) where text is not null"""


@query("mix3_stride_order", _STRIDE)
def mix3(t):
    rows = docs(t).join(F.broadcast(mixing.normalised(t("mix_targets")).select("source", "share")), "source")
    placed = mixing.interleave(rows, "source", mixing.order_key(7, F.col("doc_id")), F.length("text"), F.col("share"))
    return placed.select("doc_id", F.round("stride", 3).alias("stride"))


@query("mix4_exact_order")
def mix4(t):
    """The order of the sequential rule, in words."""
    rows = docs(t).join(F.broadcast(mixing.normalised(t("mix_targets")).select("source", "share")), "source").withColumn("n", F.size(T.tokens(F.col("text"))))
    return mixing.interleave_exact(rows, "source", "doc_id", "n", "share")


@query("mix5_bounded_epochs", f"with s as ({_SIZES}), t as (select source, weight * (select sum(size) from s) as target, max_epochs, size from mix_targets join s using (source) where weight > 0) select source, least(ceil(target / size)::bigint, coalesce(max_epochs, 1000000)) as epochs from t")
def mix5(t):
    sizes = docs(t).groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    rows = t("mix_targets").where("weight > 0").join(sizes, "source").crossJoin(total)
    wanted = F.ceil(F.col("weight") * F.col("total") / F.col("size"))
    return rows.select("source", F.least(wanted, F.coalesce("max_epochs", F.lit(1_000_000))).alias("epochs"))


@query("mix6_overrides", "select source, coalesce(o.w, m.weight) as weight from mix_targets m left join (values ('web_edu_a', 0.5), ('unknown', 0.9)) o(source, w) using (source)")
def mix6(t):
    """Overrides of known sources only."""
    targets = t("mix_targets")
    own = targets.sparkSession.createDataFrame([("web_edu_a", 0.5), ("unknown", 0.9)], "source string, w double")
    return targets.join(F.broadcast(own), "source", "left").select("source", F.coalesce("w", "weight").alias("weight"))


@query("spl1_document_split", f"select doc_id, {fraction(11, 'doc_id')} < 0.02 as held_out from {D}")
def spl1(t):
    return docs(t).select("doc_id", (mixing.fraction(11, F.col("doc_id")) < 0.02).alias("held_out"))


@query("spl2_every_500th", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) x where i % 500 = 0")
def spl2(t):
    """Each 500th: places are counts of earlier key ranges plus the place within one."""
    rows = t("orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 19, "0").alias("k"))
    ranged = rows.withColumn("range", F.floor(F.col("o_orderkey") / 4096))
    per = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("own"))
    before = per.withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own")
    placed = ranged.withColumn("p", F.row_number().over(Window.partitionBy("range").orderBy("o_orderkey"))).join(before, "range")
    return placed.where((F.col("before") + F.col("p") - 1) % 500 == 0).select("o_orderkey")


@query("spl3_tail_split", "select doc_id from (select doc_id, row_number() over (order by md5('5:' || doc_id)) as p, count(*) over () as n from documents) x where p > n - greatest(1, floor(n * 0.02))")
def spl3(t):
    rows = t("documents").select("doc_id", mixing.order_key(5, F.col("doc_id")).alias("k"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    placed = mixing.running_totals(rows, [], [F.col("k")], F.lit(1)).crossJoin(total)
    return placed.where(F.col("before") + 1 > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * 0.02))).select("doc_id")


@query("shf1_shuffled", "select doc_id from documents")
def shf1(t):
    return mixing.shuffled(t("documents").select("doc_id"), 9, F.col("doc_id"))


@query("shf2_validation_subset", f"select doc_id from {D} order by md5('1386:' || doc_id) limit 200")
def shf2(t):
    return docs(t).orderBy(mixing.order_key(1386, F.col("doc_id"))).limit(200).select("doc_id")


@query("str1_stripes", "select id, ((row_number() over (order by id) - 1) % 3)::int as worker, ((row_number() over (order by id) - 1) // 3)::int as turn from battery_prompts")
def str1(t):
    at = F.row_number().over(Window.orderBy("id")) - 1
    return t("battery_prompts").select("id", (at % 3).alias("worker"), F.floor(at / 3).cast("int").alias("turn"))


@query("tok1_tokenizer_sample", "select doc_id from (select doc_id, sum(strlen(text)) over (partition by source order by md5('7:' || doc_id) rows unbounded preceding) - strlen(text) as before from documents where text is not null and source is not null) x where before < 15000")
def tok1(t):
    """Documents of each source up to a budget of bytes."""
    rows = docs(t).where("source is not null").select("doc_id", "source", F.octet_length("text").alias("n"), mixing.order_key(7, F.col("doc_id")).alias("k"))
    return mixing.until_budget(rows, ["source"], [F.col("k")], F.col("n"), 15000).select("doc_id")


def _encoded(df, key, text, path, kind):
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            encode = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "tokens": encode(pdf["t"].tolist())})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"k {kinds[key]}, tokens bigint").withColumnRenamed("k", key)


TOKENIZERS = os.environ.get("LOOMSTONE_TOKENIZERS", "/opt/tokenizers")
"""Folder of public vocabulary files, on every machine."""


@query("tok3_encoded")
def tok3(t):
    """Tokens of each document by a public vocabulary; the model is loaded once a worker."""
    return _encoded(t("documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json", "tokenizers")


@query("tok4_tokenizer_comparison")
def tok4(t):
    old = _encoded(t("documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json", "tokenizers").withColumnRenamed("tokens", "old")
    new = _encoded(t("documents"), "doc_id", "text", f"{TOKENIZERS}/piece_bpe_32k.model", "sentencepiece").withColumnRenamed("tokens", "new")
    both = old.join(new, "doc_id").join(t("documents").select("doc_id", "kind"), "doc_id")
    return both.groupBy("kind").agg(F.sum("old").alias("old"), F.sum("new").alias("new"), F.round(1 - F.sum("new") / F.sum("old"), 6).alias("saved"))


_T = f"{turns('text')}"


@query("msk1_turns", f"select rec_id, unnest(range(1, len(t) + 1))::int as turn, unnest(t).role as role, md5(unnest(t).content) as key from (select rec_id, {_T} as t from download_instruct where text is not null) x")
def msk1(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", F.posexplode(U.parse(F.col("text"))).alias("i", "x"))
    return rows.select("rec_id", (F.col("i") + 1).alias("turn"), "x.role", F.md5("x.content").alias("key"))


def _mask_sql(end: str, bos: bool) -> str:
    flags = f"flatten([[0] || [case when x.role = 'assistant' then 1 else 0 end for y in {tokens('x.content')}] || case when x.role = 'assistant' then {end} else []::int[] end for x in t])"
    head = "[0] || " if bos else ""
    return f"select rec_id, len({head}{flags})::int as n, list_sum({head}{flags})::int as counted, md5(array_to_string({head}{flags}, '')) as mask from (select rec_id, {_T} as t from download_instruct where text is not null) x where len(t) > 0"


def _mask(t, **options):
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t")).where(F.size("t") > 0)
    items, mask = packing.masked(F.col("t"), **options)
    flat = rows.select("rec_id", F.inline(F.array(F.struct(items.alias("tokens"), mask.alias("mask")))))
    total = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return flat.select("rec_id", F.size("tokens").alias("n"), total.alias("counted"), F.md5(F.array_join(F.transform("mask", lambda x: x.cast("string")), "")).alias("mask"))


@query("msk2_answer_mask", _mask_sql("[]::int[]", False))
def msk2(t):
    return _mask(t)


@query("msk4_answer_mask_eos", _mask_sql("[1, 0]", True))
def msk4(t):
    """A beginning mark, and after every answer an end mark that counts and a line break that doesn't."""
    return _mask(t, bos="<s>", eos="</s>")


@query("msk3_minimum", f"select rec_id from (select rec_id, list_sum([1 + len({tokens('x.content')}) for x in t]) as n from (select rec_id, {_T} as t from download_instruct where text is not null) y) x where n >= 8")
def msk3(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t"))
    items, _ = packing.masked(F.col("t"))
    return rows.where(F.size(items) >= 8).select("rec_id")


@query("msk5_special_mask", f"select rec_id, list_sum([2 + len({tokens('x.content')}) for x in t])::int as n, list_sum([case when x.role = 'assistant' then 1 + len({tokens('x.content')}) else 0 end for x in t])::int as counted from (select rec_id, {_T} as t from download_instruct where text is not null) y where len(t) > 0")
def msk5(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t")).where(F.size("t") > 0)
    items, mask = packing.special_masked(F.col("t"))
    # a user's end mark has the user's flag
    return rows.select("rec_id", F.size(items).alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("counted"))


@query(
    "pck1_concat_and_chunk",
    f"with w as (select text_id, {tokens('text')} as w from quality where text is not null), f as (select text_id, unnest(range(len(w))) as i, unnest(w) as x from w), o as (select x, row_number() over (order by text_id, i) - 1 as p from f) select (p // 256) as sequence, md5(string_agg(x, ' ' order by p)) as key from o group by 1 having count(*) = 256",
)
def pck1(t):
    rows = t("quality").where("text is not null").select("text_id", T.tokens(F.col("text")).alias("w"))
    packed = packing.concat_and_chunk(rows, ["text_id"], "w", 256)
    return packed.select("sequence", F.md5(F.array_join("w", " ")).alias("key"))


@query("pck2_best_fit")
def pck2(t):
    """Best fit of word counts into bins of 1024, shard by shard."""
    rows = t("download_instruct").where("text is not null").select("rec_id", F.size(T.tokens(F.col("text"))).alias("n"))
    total = F.broadcast(rows.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / 4_000_000)).cast("int").alias("shards")))
    sharded = rows.crossJoin(total).withColumn("shard", F.pmod(F.xxhash64("rec_id"), F.col("shards")))
    return packing.best_fit(sharded, "shard", "rec_id", "n", 1024)


@query("pck3_padded", f"select rec_id, md5(array_to_string(list_resize([1 for x in {tokens('text')}], 128, 0), '')) as mask from download_instruct where text is not null")
def pck3(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", F.size(T.tokens(F.col("text"))).alias("n"))
    mask = packing.padded(F.array_repeat(F.lit(1), F.col("n")), 128, 0)  # longer ones are cut
    return rows.select("rec_id", F.md5(F.array_join(F.transform(mask, lambda x: x.cast("string")), "")).alias("mask"))


@query("pck4_segment_ids", f"select rec_id, md5(array_to_string([len([y for y in w[1:i] if y = 'User:']) for i in range(1, len(w) + 1)], ',')) as ids from (select rec_id, {tokens('text')} as w from download_instruct where text is not null) x")
def pck4(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", T.tokens(F.col("text")).alias("w"))
    ids = packing.segment_ids(F.col("w"), "User:")
    return rows.select("rec_id", F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("ids"))


_SIZED = f"select rec_id, [1 + len({tokens('x.content')}) for x in t] as z, [x.role for x in t] as r from (select rec_id, {_T} as t from download_instruct where text is not null) y where len(t) > 0"


def _sized(t):
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t")).where(F.size("t") > 0)
    sizes = F.transform("t", lambda x: F.size(T.tokens(x["content"])) + 1)
    return rows.select("rec_id", F.inline(F.array(F.struct(sizes.alias("z"), F.transform("t", lambda x: x["role"]).alias("r")))))


@query("win8_turn_cut", f"select rec_id, coalesce(list_max([i for i in range(1, len(z) + 1) if r[i] = 'assistant' and list_sum(z[1:i]) <= 120]), 0)::int as kept from ({_SIZED}) x")
def win8(t):
    return _sized(t).select("rec_id", packing.turn_cut(F.col("z"), F.col("r"), 120).alias("kept"))


@query("win9_history", f"select rec_id, coalesce(list_min([i for i in range(1, len(z) + 1) if r[i] = 'user' and list_sum(z[i:]) <= 120]), len(z) + 1)::int as start from ({_SIZED}) x")
def win9(t):
    return _sized(t).select("rec_id", packing.history_start(F.col("z"), F.col("r"), 120).alias("start"))


@query("tpl1_prompts", f"select rec_id, md5(array_to_string([upper(x.role[1]) || x.role[2:] || ': ' || x.content for x in t[s:]], chr(10)) || chr(10) || 'Assistant:') as key from (select rec_id, t, coalesce(list_min([i for i in range(1, len(t) + 1) if t[i].role = 'user' and list_sum([1 + len({tokens('x.content')}) for x in t[i:]]) <= 120]), len(t) + 1) as s from (select rec_id, {_T} as t from download_instruct where text is not null) y where len(t) > 0) x where s <= len(t)")
def tpl1(t):
    """The history that has room, and an open answer header."""
    rows = t("download_instruct").where("text is not null").select("rec_id", U.parse(F.col("text")).alias("t")).where(F.size("t") > 0)
    sizes = F.transform("t", lambda x: F.size(T.tokens(x["content"])) + 1)
    start = packing.history_start(sizes, F.transform("t", lambda x: x["role"]), 120)
    cut = rows.select("rec_id", "t", F.inline(F.array(F.struct(start.alias("s"))))).where(F.col("s") <= F.size("t"))
    return cut.select("rec_id", F.md5(F.concat(U.rendered(F.slice("t", F.col("s"), F.size("t"))), F.lit("\nAssistant:"))).alias("key"))


_TEMPLATES = ["What is the region of {n}?", "Name the region that holds {n}.", "Which region is {n} part of?"]


@query("gen1_template_records", f"select replace(t.q, '{{n}}', n.n_name) as question, r.r_name as answer, k.k::int as repeat from nation n join region r on n.n_regionkey = r.r_regionkey, (values {', '.join(f'({chr(39)}{q}{chr(39)})' for q in _TEMPLATES)}) t(q), (select unnest(range(1, 4)) as k) k")
def gen1(t):
    """Templates by entities by repeats; templates and repeats are literals."""
    facts = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = facts.select("n_name", "r_name", F.explode(F.array(*[F.lit(q) for q in _TEMPLATES])).alias("q")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.select(F.replace("q", F.lit("{n}"), F.col("n_name")).alias("question"), F.col("r_name").alias("answer"), "repeat")


_A, _B = (f"(('0x' || substr(md5('{s}:' || n_nationkey), 1, 6))::bigint % 90 + 10)" for s in ("a", "b"))


@query("gen2_arithmetic", f"select n_nationkey as id, {_A} || ' + ' || {_B} as question, {_A} + {_B} as answer from nation")
def gen2(t):
    number = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), F.col("n_nationkey").cast("string"))), 1, 6), 16, 10).cast("bigint") % 90 + 10
    rows = t("nation").select(F.col("n_nationkey").alias("id"), number("a").alias("a"), number("b").alias("b"))
    return rows.select("id", F.concat(F.col("a").cast("string"), F.lit(" + "), F.col("b").cast("string")).alias("question"), (F.col("a") + F.col("b")).alias("answer"))


@query("gen3_filled_templates", "select id, regexp_replace(regexp_replace('Tell {who} about {what}; {who} asked twice.', '\\{who\\}', category), '\\{what\\}', coalesce(difficulty, 'it')) as text from battery_prompts")
def gen3(t):
    """Each slot filled once, at its first place."""
    once = lambda x, slot, value: F.concat(F.substring_index(x, slot, 1), value, F.substring(x, F.instr(x, slot) + F.lit(len(slot)), F.length(x)))
    text = once(once(F.lit("Tell {who} about {what}; {who} asked twice."), "{who}", F.col("category")), "{what}", F.coalesce("difficulty", F.lit("it")))
    return t("battery_prompts").select("id", text.alias("text"))


@query("gen4_fixed_set", "select q, a, k::int as repeat from (values ('Who are you?', 'A small assistant.'), ('What can you do?', 'Answer short questions.')) v(q, a), (select unnest(range(1, 5)) as k)")
def gen4(t):
    spark = t("nation").sparkSession
    rows = spark.createDataFrame([("Who are you?", "A small assistant."), ("What can you do?", "Answer short questions.")], "q string, a string")
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(4))))
