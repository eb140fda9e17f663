"""Documents packed into sequences of fixed capacity, balanced by attention cost."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.tokens import VOCABULARY, with_tokens
from loomstone.session import cut

SHARD_SEQUENCES = 1024
"""Sequences that one task packs; shards are drawn by hash, so each has the lengths of the whole corpus and wastes at most about one sequence."""
SPECS_AT_ONCE = 500
"""Specs that one plan expression holds; more take further ones."""
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
"""Cost of a document of n tokens: LINEAR * n + QUADRATIC * n * n, the second for attention within the document."""


def assign(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each item, and each sequence's cost.

    Items go, from the longest on, to the sequence of least cost that still has
    room. As many sequences are open as the total needs; another is opened only
    when an item fits nowhere.
    """
    order = np.argsort(-sizes, kind="stable")
    open_now = max(1, math.ceil(sizes.sum() / capacity))
    room = np.full(open_now, capacity, dtype=np.int64)
    cost = np.zeros(open_now, dtype=np.float64)
    place = np.empty(len(sizes), dtype=np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        fits = np.where(room >= size, cost, np.inf)
        at = int(fits.argmin())
        if not np.isfinite(fits[at]):
            room = np.append(room, capacity)
            cost = np.append(cost, 0.0)
            at = len(room) - 1
        place[i] = at
        room[at] -= size
        cost[at] += LINEAR * size + QUADRATIC * size * size
    return place, cost


def pack(documents: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``spec_name``, ``sequence``, ``slot``, ``key``, ``piece_no``, ``first_token``, ``tokens`` and ``used`` (tokens and overhead) of every piece of every document.

    A document is split only if, with the overhead, it alone exceeds the capacity:
    into pieces that fill a sequence each, and a rest that is packed like others.
    Null and empty texts have no tokens and are in no sequence; repeated rows are
    packed each; a spec whose capacity doesn't exceed its overhead, or is null,
    has no rows. Other columns are ignored, whatever their names. Only ids and
    lengths are shuffled.
    """
    kind = dict(documents.dtypes)[key]
    counted = with_tokens(documents, text, vocabulary, (key,)).where("tokens > 0").select(F.col(key).alias("id"), "tokens")
    counted = cut(counted).withColumn("row", F.monotonically_increasing_id())
    wanted = specs.select("spec_name", F.col("capacity").cast("bigint").alias("capacity"), F.coalesce("doc_overhead", F.lit(0)).cast("bigint").alias("overhead")).distinct().where("capacity > overhead and overhead >= 0")
    each = counted.limit(0).selectExpr("*", "'' as spec_name", "1L as capacity", "0L as overhead")
    chosen = wanted.collect()  # a row for each spec that someone wrote down
    for begin in range(0, len(chosen), SPECS_AT_ONCE):
        of_specs = F.array(*[F.struct(F.lit(r.spec_name).cast("string").alias("spec_name"), F.lit(r.capacity).cast("bigint").alias("capacity"), F.lit(r.overhead).cast("bigint").alias("overhead")) for r in chosen[begin : begin + SPECS_AT_ONCE]])
        # each row of lengths is repeated for each spec
        own = counted.select("*", F.inline(of_specs))
        each = own if not begin else each.unionByName(own)
    net = F.col("capacity") - F.col("overhead")
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("tokens") / net).cast("int"))))
    first = (F.col("piece_no") - 1) * net
    pieces = pieces.withColumn("first_token", first).withColumn("own", F.least(net, F.col("tokens") - F.col("first_token"))).withColumn("used", F.col("own") + F.col("overhead"))
    total = pieces.groupBy("spec_name").agg(F.sum("used").alias("all_used"), F.max("capacity").alias("per_sequence"))
    shards = total.select("spec_name", F.greatest(F.lit(1), F.round(F.col("all_used") / (F.col("per_sequence") * SHARD_SEQUENCES)).cast("int")).alias("shards"))
    sharded = pieces.join(F.broadcast(shards), "spec_name").withColumn("shard", F.pmod(F.xxhash64("row", "piece_no"), F.col("shards")).cast("int"))
    schema = f"spec_name string, sequence bigint, slot int, id {kind}, piece_no int, first_token bigint, tokens bigint, used bigint"

    def run(keyed: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("used", "descending"), ("row", "ascending"), ("piece_no", "ascending")])
        sizes = table.column("used").to_numpy()
        place, _ = assign(sizes, table.column("capacity")[0].as_py())
        order = np.argsort(place, kind="stable")
        within = place[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(within)) + 1]) if len(within) else np.zeros(0, dtype=np.int64)
        slot = np.empty(len(sizes), dtype=np.int32)
        slot[order] = np.arange(len(sizes)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(within)]])))
        shard = table.column("shard")[0].as_py()
        columns = {
            "spec_name": table.column("spec_name"),
            "sequence": pa.array((shard << 32) + place, pa.int64()),
            "slot": pa.array(slot, pa.int32()),
            "id": table.column("id"),
            "piece_no": table.column("piece_no"),
            "first_token": table.column("first_token"),
            "tokens": table.column("own"),
            "used": table.column("used"),
        }
        return pa.table(columns)

    slim = sharded.select("spec_name", "shard", "capacity", "id", "row", "piece_no", "first_token", "own", "used")
    return slim.groupBy("spec_name", "shard").applyInArrow(run, schema).withColumnRenamed("id", key)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_name``, ``sequences``, ``used`` tokens, ``fill`` (share of all capacity in use) and mean and largest cost of a sequence."""
    size = F.col("used")
    own = packed.groupBy("spec_name", "sequence").agg(F.sum(size).alias("used"), F.sum(LINEAR * size + QUADRATIC * size * size).alias("cost"))
    capacity = specs.select("spec_name", "capacity").distinct()
    spec = own.groupBy("spec_name").agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("used"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("most_cost"))
    return spec.join(capacity, "spec_name").select("spec_name", "sequences", "used", (F.col("used") / (F.col("sequences") * F.col("capacity"))).alias("fill"), "mean_cost", "most_cost")
