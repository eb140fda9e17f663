"""Sampling, mixing, splitting and shuffling of records, all deterministic by hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *keys: Column) -> Column:
    """A random order that depends on the seed and the keys only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def fraction(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the same hash: its first 8 hex digits."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def cap_per_group(df: DataFrame, group: str, most: Column | int, order: list[Column]) -> DataFrame:
    """At most so many rows of each group, the first in the order."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.where(F.col("_place") <= most).drop("_place")


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, numbered by ``epoch`` from 1; rows with less than one are dropped."""
    return df.where(times >= 1).withColumn("epoch", F.explode(F.sequence(F.lit(1), times.cast("int"))))


def normalised(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights that add up to 1, without those that are null or not positive."""
    kept = weights.where(F.col(weight) > 0)
    return kept.withColumn("share", F.col(weight) / F.sum(weight).over(Window.partitionBy()))


def running_totals(df: DataFrame, group: list[str], order: list[Column], size: Column) -> DataFrame:
    """``before``: the sizes of all earlier rows of the group.

    The first order key is a hex hash. Totals of ranges of it (its first three
    digits) are added up first, so a group's rows need no single task: only the
    rows of one range are ordered together.
    """
    ranged = df.withColumn("_range", F.substring(order[0].cast("string"), 1, 3)).withColumn("_size", size)
    per = ranged.groupBy(*group, "_range").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return placed.join(offsets, [*group, "_range"]).withColumn("before", F.col("_within") + F.col("_offset")).drop("_range", "_size", "_within", "_offset")


def until_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: Column | int) -> DataFrame:
    """Rows until the running size reaches the budget; the row that crosses it stays. The first order key must be a hex hash."""
    return running_totals(df, group, order, size).where(F.col("before") < budget).drop("before")


def interleave(df: DataFrame, source: str, order: Column, size: Column, share: Column) -> DataFrame:
    """Sources interleaved by stride: rows in the order of (size so far) / share, with ``position`` from 1.

    A source's next row comes once its share of the total falls behind; shares
    converge to their targets as the rows go on.
    """
    so_far = running_totals(df.withColumn("_order", order), [source], [F.col("_order")], size)
    placed = so_far.withColumn("stride", F.col("before") / share)
    return placed.drop("before", "_order")


def interleave_exact(df: DataFrame, source: str, order: str, size: str, share: str) -> DataFrame:
    """``position`` under the exact rule: each step takes the source whose share lags most, ties to the first listed.

    The rule is sequential over (source, order, size); those three columns alone,
    sorted, pass through one task in a stream that holds a queue for each source.
    For corpora beyond one task use ``interleave``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)) if batches else pd.DataFrame()
        if not len(rows):
            return
        queues = {s: g.sort_values("o").to_dict("list") for s, g in rows.groupby("s", sort=False)}
        shares = rows.groupby("s")["w"].first().sort_values(ascending=False, kind="stable")
        at, done, total, taken = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0.0), 0.0, []
        names = list(shares.index)
        while names:
            best = max(names, key=lambda s: shares[s] - (done[s] / total if total else 0.0))
            q = queues[best]
            n = q["z"][at[best]]
            taken.append((best, q["o"][at[best]]))
            at[best] += 1
            done[best] += n
            total += n
            if at[best] == len(q["o"]):
                names.remove(best)
        yield pd.DataFrame({"s": [s for s, _ in taken], "o": [o for _, o in taken], "position": range(1, len(taken) + 1)})

    kinds = dict(df.dtypes)
    slim = df.select(F.col(source).alias("s"), F.col(order).alias("o"), F.col(size).cast("double").alias("z"), F.col(share).cast("double").alias("w")).coalesce(1)
    placed = slim.mapInPandas(run, f"s {kinds[source]}, o {kinds[order]}, position bigint")
    return placed.withColumnsRenamed({"s": source, "o": order})


def shuffled(df: DataFrame, seed: int, *keys: Column, partitions: int | None = None) -> DataFrame:
    """All rows in random order over all partitions: ranges of a hash, each sorted by it."""
    key = order_key(seed, *keys)
    keyed = df.withColumn("_key", key)
    ranged = keyed.repartitionByRange(partitions, "_key") if partitions else keyed.repartitionByRange("_key")
    return ranged.sortWithinPartitions("_key").drop("_key")
