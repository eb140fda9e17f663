"""Sources mixed to target shares of tokens, by whole copies and Pareto order sampling."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.tokens import VOCABULARY, with_tokens
from loomstone.session import cut

SEED = 20240607
STEPS = 8
"""Classes of document length per doubling, from which inclusion odds are solved."""
SEGMENTS = 64
"""Segments per unit of the logarithm of the rank; a running total needs to be ordered within one segment only."""
TOLERANCE = 0.02
"""Where no budget is given: what capped sources may lack of their shares in all."""


def allocate(size: dict[str, float], weight: dict[str, float], epochs: dict[str, float | None], budget: float) -> dict[str, float]:
    """Tokens wanted of each source: its share of the budget, at most its size times its epochs; what capped sources can't give goes to the others by weight."""
    active = {s for s in weight if weight[s] > 0 and size.get(s, 0) > 0 and (epochs[s] is None or epochs[s] > 0)}
    left = float(budget)
    amount = dict.fromkeys(weight, 0.0)
    while active and left > 0:
        total = sum(weight[s] for s in active)
        full = [s for s in active if epochs[s] is not None and weight[s] / total * left >= size[s] * epochs[s]]
        if not full:
            for s in active:
                amount[s] = weight[s] / total * left
            break
        for s in full:
            amount[s] = size[s] * epochs[s]
            active.discard(s)
        left -= sum(amount[s] for s in full)
    return amount


def widest(size: dict[str, float], weight: dict[str, float], epochs: dict[str, float | None], tolerance: float = TOLERANCE) -> float:
    """The largest budget, up to one pass over the wanted sources, at which capped sources fall short of their shares by no more than ``tolerance`` in all."""
    active = {s for s in weight if weight[s] > 0 and size.get(s, 0) > 0 and (epochs[s] is None or epochs[s] > 0)}
    total = sum(weight[s] for s in active)

    def short(budget: float) -> float:
        got = allocate(size, weight, epochs, budget)
        return sum(max(0.0, weight[s] / total - got[s] / budget) for s in active)

    low, high = 0.0, float(sum(size[s] for s in active))
    if not high or short(high) <= tolerance:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if short(middle) <= tolerance else (low, middle)
    return low


def inclusion(lengths: list[tuple[float, float]], wanted: float) -> float:
    """c such that documents included with probability min(1, c * tokens) have ``wanted`` tokens on average; lengths: (mean tokens, documents)."""
    low, high = 0.0, 1.0 / max(1e-9, min((t for t, _ in lengths), default=1.0))
    for _ in range(80):
        middle = (low + high) / 2
        if sum(n * t * min(1.0, middle * t) for t, n in lengths) < wanted:
            low = middle
        else:
            high = middle
    return high


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key``, ``source``, ``tokens``, ``copies``) and its shares by source.

    Shares: ``source``, ``target_share`` (of the weights of all targets),
    ``reachable_share`` (of those with documents), ``max_epochs``,
    ``available_tokens``, ``mixed_tokens``, ``mixed_share`` and ``epochs``. The
    budget, in tokens, is by default the largest at which caps cost no more than
    TOLERANCE of the shares. A source's amount is met by whole copies of all its documents and, for the rest,
    a sample: of the documents by random odds over inclusion odds (proportional to
    length), those of least rank until the tokens are reached. Sources without a
    target, null sources and null or empty texts aren't mixed; sources without
    documents have shares of 0; weights of a repeated target add up and its least
    cap holds; null weights count as 0. A repeated document has one rank for all
    its rows. Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.min("max_epochs").alias("max_epochs"))
    rows = goals.collect()  # a row for each source that someone gave a weight
    weight, epochs = {r.source: max(0.0, r.weight) for r in rows}, {r.source: r.max_epochs for r in rows}
    named = documents.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = with_tokens(named.join(F.broadcast(goals.select("source")), "source", "left_semi"), "text", vocabulary, ("id", "source"))
    counted = cut(counted.where("tokens > 0"))
    grade = F.floor(F.log2("tokens") * STEPS)
    classes = counted.groupBy("source", grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()
    size: dict[str, float] = defaultdict(float)
    lengths: dict[str, list[tuple[float, float]]] = defaultdict(list)
    for r in classes:
        size[r.source] += r.t
        lengths[r.source].append((r.t / r.n, r.n))
    amount = allocate(size, weight, epochs, widest(size, weight, epochs) if budget is None else budget)
    plan = []
    for s, wanted in amount.items():
        whole = math.floor(wanted / size[s] + 1e-9) if size[s] else 0
        rest = max(0.0, wanted - whole * size[s])
        plan.append((s, whole, rest, inclusion(lengths[s], rest) if rest > 0.5 else 0.0))
    plans = spark.createDataFrame(plan, "source string, whole int, rest double, c double")
    placed = counted.join(F.broadcast(plans), "source")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + F.lit(0.5)) / float(1 << 53)
    odds = F.least(F.lit(0.999999), F.greatest(F.lit(1e-12), F.col("c") * F.col("tokens")))
    rank = F.log(u) - F.log1p(-u) - F.log(odds) + F.log1p(-odds)
    ranked = placed.withColumn("rank", F.when(F.col("rest") > 0.5, rank)).withColumn("segment", F.floor(F.col("rank") * SEGMENTS))
    per = ranked.where("segment is not null").groupBy("source", "segment").agg(F.sum("tokens").alias("own"))
    earlier = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).select("source", "segment", "own", "before")
    joined = ranked.join(before, ["source", "segment"], "left")
    clear = joined.where("segment is null or before + own <= rest or before >= rest")
    sure = clear.withColumn("copies", F.col("whole") + F.when(F.col("before") + F.col("own") <= F.col("rest"), 1).otherwise(0))
    inside = Window.partitionBy("source", "segment").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    split = joined.where("before + own > rest and before < rest").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # the document that crosses the amount is taken if that brings it nearer
    edge = split.withColumn("copies", F.col("whole") + (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    columns = [F.col("id").alias(key), "source", "tokens", "copies"]
    mixture = sure.select(columns).unionByName(edge.select(columns)).where("copies > 0")
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    every, real = sum(weight.values()) or 1.0, sum(w for s, w in weight.items() if size[s]) or 1.0
    held = spark.createDataFrame([(s, weight[s] / every, weight[s] / real if size[s] else 0.0, epochs[s], int(size[s])) for s in weight], "source string, target_share double, reachable_share double, max_epochs int, available_tokens bigint")
    everything = Window.partitionBy()
    shares = held.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    shares = shares.withColumn("mixed_share", F.col("mixed_tokens") / F.sum("mixed_tokens").over(everything)).withColumn("epochs", F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).otherwise(0.0))
    return mixture, shares
