"""Exact and near-duplicate removal, and removal of records known elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.components import connected_components
from loomstone.session import cut

HASHES, BANDS, SHINGLE, THRESHOLD = 128, 16, 5, 0.8
GROUP_EDGES = 200_000
"""Components of up to so many pairs (a few MB) are settled in one task each; larger ones round by round, by all."""
PRIME, TOP = (1 << 61) - 1, (1 << 32) - 1


def content_key(text: Column, chars: int = 2000) -> Column:
    """First 12 bytes of the md5 of a text's beginning, in hex; the length is a parameter of the rule."""
    return F.substring(F.md5(F.substring(text, 1, chars)), 1, 24)


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. Each key's first row is found by a partial minimum over the order, so a hot key gathers in no task."""
    named = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).withColumn("_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return named.groupBy("_key").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col("_order")).alias("_row")).select("_row.*")


def not_in(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key isn't among the known ones; null keys stay."""
    others = known.select(known_key.alias("_known")).where("_known is not null").distinct()
    return df.withColumn("_own", key).join(others, F.col("_own") == F.col("_known"), "left_anti").drop("_own")


def ngram_overlap(documents: DataFrame, items: DataFrame, key: str, item_key: str, words: Column, item_words: Column, n: int = 13) -> DataFrame:
    """Documents and items that share a run of ``n`` words (of all words, in shorter items)."""

    def grams(w: Column) -> Column:
        size = F.least(F.lit(n), F.size(w))
        starts = F.sequence(F.lit(1), F.size(w) - size + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")))

    left = documents.where(F.size(words) > 0).select(F.col(key), F.explode(grams(words)).alias("gram"))
    right = items.where(F.size(item_words) > 0).select(F.col(item_key), F.explode(grams(item_words)).alias("gram"))
    return left.join(right, "gram").select(key, item_key).distinct()


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the character runs of ``k``: the first four bytes of each sha1, little-endian."""
    text = text.lower().strip()
    runs = {text[i : i + k] for i in range(len(text) - k + 1)}
    return np.array([int.from_bytes(hashlib.sha1(r.encode("utf-8", "replace")).digest()[:4], "little") for r in runs], dtype=np.int64)


def parameters(n: int = HASHES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The two vectors of the hash family, drawn one after the other from one generator."""
    draw = np.random.RandomState(seed)
    return draw.randint(1, PRIME, size=n, dtype=np.int64), draw.randint(0, PRIME, size=n, dtype=np.int64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over all shingles. Products wrap at 64 bits before the remainder, which results depend on."""
    if not len(hashes):
        return np.full(len(a), TOP, dtype=np.int64)
    least = np.full(len(a), TOP, dtype=np.int64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(hashes), 4096):
            block = np.multiply.outer(a, hashes[begin : begin + 4096]) + b[:, None]
            least = np.minimum(least, (np.mod(np.mod(block, PRIME), TOP)).min(axis=1))
    return least


def signatures(documents: DataFrame, key: str, text: str, n: int = HASHES, k: int = SHINGLE) -> DataFrame:
    """``key``, ``shingles`` (their number) and ``signature`` of each document; null texts have none."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = parameters(n)
        for batch in batches:
            sets = [shingle_hashes(t or "", k) for t in batch.column("text").to_pylist()]
            rows = [signature(s, a, b) for s in sets]
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int32()), lists], ["id", "shingles", "signature"])

    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, shingles int, signature array<bigint>").withColumnRenamed("id", key)


def similarity(left: Column, right: Column) -> Column:
    """Share of equal positions of two signatures."""
    equal = F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return equal / F.size(left)


def bands(signed: DataFrame, key: str, count: int = BANDS) -> DataFrame:
    """A row for each band of each document that has shingles."""
    rows = F.size("signature") / count
    cuts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.slice("signature", (i * rows + 1).cast("int"), rows.cast("int"))))
    return signed.where("shingles > 0").select(key, F.posexplode(cuts).alias("band", "bucket"))


def similar_pairs(signed: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a before b) that share a band and whose signatures agree in ``threshold`` of their positions.

    Documents with one signature meet as one, and each further copy is linked to
    the first only, so copies of one text give as many pairs as there are copies.
    """
    signed = cut(signed.where("shingles > 0"))  # signatures cost most, and are read twice
    once = cut(signed.groupBy(F.xxhash64("signature").alias("h"), F.xxhash64(F.lit(1), "signature").alias("h2")).agg(F.min(key).alias("id"), F.first("signature").alias("signature")))
    of_band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * (HASHES // BANDS) + 1, HASHES // BANDS)))
    rows = once.select("id", F.posexplode(of_band).alias("band", "bucket"))
    pairs = rows.alias("l").join(rows.alias("r"), ["band", "bucket"]).where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    texts = once.select("id", "signature")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(texts.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")
    apart = both.select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    same = signed.withColumns({"h": F.xxhash64("signature"), "h2": F.xxhash64(F.lit(1), "signature")}).join(once.select("h", "h2", F.col("id").alias("a")), ["h", "h2"]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(same)


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows kept if each is taken in order of ``key`` unless it is similar to one taken before.

    That is the first maximal independent set in order of the key. Pairs that hang
    together are settled in one task, in order; where so many do that they are
    too much for one task, all tasks settle them in rounds, as many as it takes.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return nodes
    kind = dict(edges.dtypes)["a"]
    placed = cut(edges.join(connected_components(edges, "a", "b").withColumnRenamed("node", "a"), "a"))
    sizes = placed.groupBy("component").count()
    large = cut(sizes.where(F.col("count") > GROUP_EDGES).select("component"))

    def settle(keyed: tuple, table: pa.Table) -> pa.Table:
        gone: set = set()
        for a, b in sorted(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)):
            if a not in gone:  # all pairs of a as the later one came before
                gone.add(b)
        return pa.table({"n": pa.array(list(gone), table.schema.field("b").type)})

    dropped = placed.join(large, "component", "left_anti").select("component", "a", "b").groupBy("component").applyInArrow(settle, f"n {kind}")
    if not large.isEmpty():
        dropped = dropped.unionByName(_settled_in_rounds(placed.join(large, "component", "left_semi").select("a", "b")))
    return nodes.join(dropped.withColumnRenamed("n", key), key, "left_anti")


def _settled_in_rounds(live: DataFrame) -> DataFrame:
    """What is dropped: each round keeps what has no undecided earlier neighbour and drops the neighbours of that, until nothing is undecided."""
    dropped: DataFrame | None = None
    while not live.isEmpty():
        later = live.select(F.col("b").alias("n")).distinct()
        kept = live.select(F.col("a").alias("n")).distinct().join(later, "n", "left_anti")
        gone = cut(live.join(kept.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        live = cut(live.join(gone.withColumnRenamed("n", "b"), "b", "left_anti").join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(kept.withColumnRenamed("n", "a"), "a", "left_anti"))
    return dropped


def index_stats(signed: DataFrame, key: str) -> DataFrame:
    """Documents, buckets and megabytes of an index of 4-byte signatures."""
    buckets = bands(signed, key).agg(F.count_distinct("band", "bucket").alias("buckets"))
    return signed.where("shingles > 0").agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(buckets).withColumn("megabytes", F.col("n_docs") * HASHES * 4 / 1e6)
