"""Operators over logs, trees and generation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import cut


def last_segment(log: DataFrame, step: str, order: str, group: str | None = None) -> DataFrame:
    """Rows since the step last went down, which begins a new run.

    Where a group's log has no other key, its order alone decides; the place of the
    last drop is a maximum over neighbours, and rows before it are filtered away.
    """
    keys = [group] if group else []
    near = Window.partitionBy(*keys).orderBy(order)
    marked = log.withColumn("_drop", F.col(step) < F.lag(step).over(near))
    last = marked.groupBy(*keys).agg(F.max(F.when(F.col("_drop"), F.col(order))).alias("_from"))
    joined = marked.join(last, keys) if keys else marked.crossJoin(F.broadcast(last))
    return joined.where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_drop", "_from")


def last_values(log: DataFrame, columns: list[str], order: str, group: list[str]) -> DataFrame:
    """Of each column the last value that isn't null."""
    return log.groupBy(*group).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def alerts(log: DataFrame, loss: Column, norm: Column, previous: Column, idle: Column) -> DataFrame:
    """The alarms of each row: loss that is no number or has diverged, a gradient that spikes, a validation loss that rises, a log that stands still."""
    kinds = F.array(
        F.when(F.isnan(loss), "nan"),
        F.when(~F.isnan(loss) & (loss > 20), "diverging"),
        F.when(norm > 50, "spiking"),
        F.when(loss > previous, "rising"),
        F.when(idle > 900, "stalled"),
    )
    return log.withColumn("alert", F.explode(F.array_compact(kinds)))


def thread_paths(nodes: DataFrame, key: str, parent: str, role: str, content: str, most: int = 12) -> DataFrame:
    """Root-to-answer paths of a message tree: ``path`` (ids) and ``turns`` of every node whose role is assistant, at most ``most`` deep."""
    slim = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(role).alias("role"), F.col(content).alias("content"))
    turn = F.struct("role", "content")
    level = slim.where("up is null").select("id", F.array("id").alias("path"), F.array(turn).alias("turns"), "role")
    found = level
    for _ in range(most - 1):
        level = cut(slim.alias("n").join(level.select(F.col("id").alias("up"), "path", "turns"), "up").select("id", F.concat("path", F.array("id")).alias("path"), F.concat("turns", F.array(turn)).alias("turns"), "role"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.where("role = 'assistant'").select("id", "path", "turns")


def pick_best(df: DataFrame, group: str, score: Column, order: Column, value: str) -> DataFrame:
    """Of each group the value of the highest score, the first among equals."""
    return df.groupBy(group).agg(F.max_by(F.col(value), F.struct(score, -order)).alias(value), F.max(score).alias("score"))


def scorecard(records: DataFrame, group: str) -> DataFrame:
    """Accuracy over scored records, and shares of flags over all of them."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return records.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ok").alias("n_scored"),
        F.round(F.avg("ok"), 6).alias("accuracy"),
        F.round(F.avg("n_new"), 6).alias("mean_tokens"),
        *[F.round(share(c), 6).alias(f"{c}_share") for c in ("hedge", "identity", "fake_dialogue", "mojibake", "verbose")],
    )
