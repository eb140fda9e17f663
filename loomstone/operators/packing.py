"""Tokens, loss masks and packed sequences, and what a prompt or a history has room for."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 32


def concat_and_chunk(tokens: DataFrame, order: list[str], items: str, length: int) -> DataFrame:
    """Rows of exactly ``length`` tokens cut from the concatenation of all rows in order; the ragged end is dropped.

    The offset of each row is the size of the rows before it, added up by the
    first order key's ranges, so the concatenation exists in no task, and what is
    shuffled are spans, not tokens.
    """
    key = F.col(order[0])
    sized = tokens.withColumn("_n", F.size(items)).withColumn("_range", F.floor(key / 4096))
    per = sized.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    offsets = per.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, "_range")
    # a row goes to each sequence that it reaches into, as one span
    start = F.col("_offset") + F.col("_within")
    spans = placed.where("_n > 0").select(start.alias("_start"), "_n", items, F.explode(F.sequence(F.floor(start / length), F.floor((start + F.col("_n") - 1) / length))).alias("sequence"))
    left = F.greatest(F.lit(0), F.col("sequence") * length - F.col("_start"))
    own = F.slice(items, (left + 1).cast("int"), F.least(F.lit(length), F.col("_n") - left, (F.col("sequence") + 1) * length - F.col("_start")).cast("int"))
    cut_out = spans.select("sequence", "_start", own.alias("_t"))
    rows = cut_out.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("_start", "_t"))).alias("_all"))
    whole = rows.select("sequence", F.flatten(F.transform("_all", lambda x: x["_t"])).alias(items))
    return whole.where(F.size(items) == length)


def best_fit(df: DataFrame, shard: str, key: str, size: str, capacity: int) -> DataFrame:
    """``bin`` of each row: longest first into the tightest bin that has room, by bins' free space in steps of BUCKET; bins with less free are closed.

    Each shard is packed by itself; a shard is a random part of the rows, of a
    size that its caller bounds.
    """
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", "k"], ascending=[False, True]).reset_index(drop=True)
        free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        place, bins = [], 0
        for n in rows["z"].tolist():
            for step in range(n // BUCKET, capacity // BUCKET + 1):
                stack = free[step]
                if stack and stack[-1][1] >= n:
                    at, room = stack.pop()
                    break
            else:
                at, room = bins, capacity
                bins += 1
            place.append(at)
            if room - n >= BUCKET:
                free[(room - n) // BUCKET].append((at, room - n))
        return pd.DataFrame({"s": rows["s"], "k": rows["k"], "bin": pd.Series(place, dtype="int32")})

    slim = df.select(F.col(shard).alias("s"), F.col(key).alias("k"), F.col(size).cast("int").alias("z")).where(f"z <= {capacity} and z > 0")
    return slim.groupBy("s").applyInPandas(run, f"s {kinds[shard]}, k {kinds[key]}, bin int").withColumnsRenamed({"s": shard, "k": key})


def padded(items: Column, length: int, fill: int) -> Column:
    return F.concat(F.slice(items, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(items))))


def masked(turns: Column, bos: str | None = None, eos: str | None = None, tail_newline: bool = True) -> tuple[Column, Column]:
    """Tokens (words here) of a conversation and their loss mask: labels and users 0, answers 1; with ``eos`` after every answer (mask 1) and a line break after it (mask 0)."""

    def piece(t: Column) -> Column:
        words = F.regexp_extract_all(t["content"], F.lit(r"\S+"), F.lit(0))
        label = F.array(F.concat(F.initcap(t["role"]), F.lit(":")))
        own = F.concat(label, words)
        if eos:
            end = F.array(F.lit(eos), F.lit("\n")) if tail_newline else F.array(F.lit(eos))
            return F.when(t["role"] == "assistant", F.concat(own, end)).otherwise(own)
        return own

    def flags(t: Column) -> Column:
        n = F.size(F.regexp_extract_all(t["content"], F.lit(r"\S+"), F.lit(0)))
        hit = (t["role"] == "assistant").cast("int")
        own = F.concat(F.array(F.lit(0)), F.array_repeat(hit, n))
        if eos:
            end = F.array(F.lit(1), F.lit(0)) if tail_newline else F.array(F.lit(1))
            return F.when(t["role"] == "assistant", F.concat(own, end)).otherwise(own)
        return own

    tokens, mask = F.flatten(F.transform(turns, piece)), F.flatten(F.transform(turns, flags))
    if bos:
        return F.concat(F.array(F.lit(bos)), tokens), F.concat(F.array(F.lit(0)), mask)
    return tokens, mask


def special_masked(turns: Column) -> tuple[Column, Column]:
    """The layout with a marker before each turn and an end marker after it; an answer and its end count."""
    words = lambda t: F.regexp_extract_all(t["content"], F.lit(r"\S+"), F.lit(0))
    tokens = F.flatten(F.transform(turns, lambda t: F.concat(F.array(F.concat(F.lit("<|"), t["role"], F.lit("|>"))), words(t), F.array(F.lit("<|end|>")))))
    mask = F.flatten(F.transform(turns, lambda t: F.concat(F.array(F.lit(0)), F.array_repeat((t["role"] == "assistant").cast("int"), F.size(words(t)) + 1))))
    return tokens, mask


def turn_cut(sizes: Column, roles: Column, most: int) -> Column:
    """Turns kept when a conversation is cut after the last answer that ends within ``most`` tokens."""
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.struct(F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x.cast("int")).alias("end"), i.alias("i"), F.element_at(roles, i).alias("role")))
    fit = F.filter(ends, lambda e: (e["role"] == "assistant") & (e["end"] <= most))
    return F.coalesce(F.array_max(F.transform(fit, lambda e: e["i"])), F.lit(0))


def history_start(sizes: Column, roles: Column, most: int) -> Column:
    """First turn of the longest recent history, beginning with a user turn, that fits into ``most`` tokens; one past the end if none fits."""
    n = F.size(sizes)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at(roles, i) == "user") & (F.aggregate(F.slice(sizes, i, n), F.lit(0), lambda a, x: a + x.cast("int")) <= most))
    return F.coalesce(F.array_min(starts), n + 1)


def segment_ids(tokens: Column, marker: str) -> Column:
    """For each token how many markers stand up to it: the document it belongs to in a packed sequence."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, t: Column) -> Column:
        n = a["n"] + (t == marker).cast("int")
        return F.struct(n.alias("n"), F.concat(a["ids"], F.array(n)).alias("ids"))

    return F.aggregate(tokens, start, step, lambda a: a["ids"])
