"""Groups of records that differ only by small edits, by pigeonhole blocks.

A record's fingerprint is the vector of PARTS * WIDTH minima of its hashed
three-word runs under as many hash functions. It is split into PARTS blocks: two
fingerprints that differ in fewer than PARTS components must agree in a whole
block, so records are joined on blocks. At a likeness of 0.6, where more may
differ, two records still share a block in 96 of 100 cases, at 0.65 in 99, and
groups hang together by more than one link. Pairs that meet are verified by the
Hamming distance of the fingerprints, of whose first BITS components one bit each
is kept, and what remains exactly, by the three-word runs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.components import connected_components
from loomstone.llm.wordgrams import chunks, grams, mix, words
from loomstone.session import cut

SHINGLE = 3
THRESHOLD = 0.6
PARTS = 24
WIDTH = 4
BITS = 64
MOST_BITS = 22
"""Hamming distance up to which a pair is verified exactly; at a likeness of 0.6 it is 12.8 on average, with a deviation of 3.2, and less where the block that was shared is among the bits."""
CELL = 2000
"""Rows of each side of a task of the second round."""
ALL_PAIRS = 32
"""Blocks of up to so many records give all their pairs; of larger ones each record is linked to the block's first, and what that leaves apart is compared in a second round."""
BROADCAST_IDS = 1_000_000
"""Up to so many candidate ids (8 MB) are broadcast to filter the texts; beyond, they are joined by a shuffle."""

_rng = np.random.Generator(np.random.PCG64(20240607))
_ODD = _rng.integers(1, 1 << 32, PARTS * WIDTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PARTS * WIDTH, dtype=np.uint64).astype(np.uint32)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of SHINGLE words (of all words, in shorter texts), and their texts; ordered by text."""
    hashes, text_of = words(texts)
    g, valid = grams(hashes, text_of, SHINGLE)
    g, owner = g[valid], text_of[: len(valid)][valid]
    lengths = np.bincount(text_of, minlength=len(texts))
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        starts = np.cumsum(lengths) - lengths
        own = np.array([mix(np.array([hash_run(hashes[starts[i] : starts[i] + lengths[i]])], dtype=np.uint64))[0] for i in short], dtype=np.uint64)
        g, owner = np.concatenate([g, own]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], owner[new]


def hash_run(hashes: np.ndarray) -> int:
    total = 0
    for h in hashes.tolist():
        total = (total * 0x9FB21C651E98DF25 + h + 1) & 0xFFFFFFFFFFFFFFFF
    return total


def _fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each text with words; its run-set's hash; its block keys; its bits."""
    return fingerprints_of(*shingles(texts))


def fingerprints_of(g: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, starts = np.unique(owner, return_index=True)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros((0, PARTS), np.uint64), np.zeros(0, np.uint64)
    low = ((g >> np.uint64(32)) ^ g).astype(np.uint32)
    minima = np.empty((len(_ODD), len(at)), dtype=np.uint32)
    for i in range(len(_ODD)):
        h = (low ^ _ADD[i]) * _ODD[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        minima[i] = np.minimum.reduceat(h, starts)
    keys = np.empty((len(at), PARTS), dtype=np.uint64)
    for part in range(PARTS):
        total = np.full(len(at), part + 1, dtype=np.uint64)
        for i in range(part * WIDTH, part * WIDTH + WIDTH):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + minima[i])
        keys[:, part] = total
    one = ((minima[:BITS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint64)
    bits = np.zeros(len(at), dtype=np.uint64)
    for i in range(BITS):
        bits |= one[i] << np.uint64(i)
    whole = np.add.reduceat(mix(g), starts)
    return at, mix(whole), keys, bits


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for begin, part in chunks(batch.column("text").to_pylist()):
            at, whole, keys, bits = _fingerprints(part)
            if len(at):
                offsets = pa.array(np.arange(0, (len(at) + 1) * PARTS, PARTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at + begin)), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))), pa.array(bits.view(np.int64))],
                    ["id", "whole", "keys", "bits"],
                )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Whole runs of equal keys of a sorted partition: keys, ids, bits, and whether a run of more than ALL_PAIRS was cut here and goes on."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for a, c in zip(held, ("key", "id", "bits"), strict=True)]
        last = np.searchsorted(held[0], held[0][-1], "left") if len(held[0]) else 0
        if last:
            yield held[0][:last], held[1][:last], held[2][:last], False
            held = [a[last:] for a in held]
        elif len(held[0]) > 50_000:
            yield held[0], held[1], held[2], True
            held = [a[-1:] for a in held]
    yield held[0], held[1], held[2], False


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a partition sorted by block key, and the rows of blocks that weren't paired fully (a is null)."""

    def out(a: np.ndarray | None, b: np.ndarray, key: np.ndarray | None, bits: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(b), pa.int64())
        return pa.RecordBatch.from_arrays([empty if a is None else pa.array(a), pa.array(b), empty if key is None else pa.array(key), empty if bits is None else pa.array(bits)], ["a", "b", "key", "bits"])

    def edge(key: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        return out(None, ids, key, bits)

    opened = False
    continued = False
    tail: list[np.ndarray] | None = None
    for key, ids, bits, goes_on in _runs(batches):
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        large = sizes > ALL_PAIRS
        large[0] |= continued  # what is left of a block that was cut belongs to a large one
        continued = goes_on
        if not opened:  # the first run may have begun in another partition
            opened = True
            yield edge(key[: sizes[0]], ids[: sizes[0]], bits[: sizes[0]])
        tail = [a[starts[-1] :] for a in (key, ids, bits)]
        for d in range(1, ALL_PAIRS):
            near = np.flatnonzero(np.repeat((sizes > d) & ~large, sizes))
            near = near[near + d < len(key)]
            near = near[key[near] == key[near + d]]
            if not len(near):
                break
            yield from _close(out, ids[near], ids[near + d], bits[near], bits[near + d])
        big = np.flatnonzero(np.repeat(large, sizes))
        if len(big):
            head = np.repeat(starts, sizes)[big]
            yield from _close(out, ids[head], ids[big], bits[head], bits[big])
            yield edge(key[big], ids[big], bits[big])
    if tail is not None:
        yield edge(*tail)


def _close(out, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= MOST_BITS) & (a != b)
    if ok.any():
        yield out(np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]), None, None)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
        keep = np.zeros(len(a), dtype=bool)
        for begin, part in chunks(list(zip(a, b, strict=True))):
            flat = [t for pair in part for t in pair]
            g, owner = shingles(flat)
            size = np.bincount(owner, minlength=len(flat))
            pair = owner // 2
            order = np.lexsort((g, pair))
            g, pair = g[order], pair[order]
            shared = np.bincount(pair[1:][(g[1:] == g[:-1]) & (pair[1:] == pair[:-1])], minlength=len(part))
            either = size[0::2] + size[1::2] - shared
            keep[begin : begin + len(part)] = (shared > 0) & (shared >= THRESHOLD * either - 1e-9)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are alike."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = texts.join(ids, "id", "left_semi")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_alike, "a bigint, b bigint")


def near_duplicates(records: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """Columns ``group_id`` (least id of the group) and ``key``, a row for each record of a group of two or more.

    Two records are linked if they share at least THRESHOLD of the distinct
    three-word runs found in either; a text of fewer words counts as one run.
    Exact copies are grouped first and stand in the search as one record. Null
    and blank texts and null ids are in no group; a repeated id counts once;
    other columns are ignored, whatever their names; no rows give no rows.
    """
    texts = records.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    prints = texts.mapInArrow(_prints, "id bigint, whole bigint, keys array<bigint>, bits bigint")
    prints = cut(prints)  # each text is hashed once
    copies = prints.select("id", "whole")
    one = prints.groupBy("whole", "bits").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    blocks = one.select("id", "bits", F.explode("keys").alias("key")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    met = cut(blocks.mapInArrow(_meet, "a bigint, b bigint, key bigint, bits bigint").distinct())
    links = cut(_verified(met.where("a is not null").select("a", "b"), texts))
    rest = met.where("a is null").select("key", F.col("b").alias("id"), "bits")
    links = links.unionByName(_second_round(rest, links, texts))
    twins = copies.groupBy("whole").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = cut(copies.join(twins, "whole").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = connected_components(links.unionByName(same), "a", "b")
    sizes = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(sizes, "component").select(F.col("component").alias("group_id"), F.col("node").alias(key))


def _second_round(rest: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between records of one block that the first round left in different components.

    Members of one component are compared no more. The others are compared with
    all of the block, cell by cell, so that no task holds a whole block: rows
    moved and compared grow with the others times the block, not with its square.
    """
    rest = cut(rest.distinct())
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if sizes.isEmpty():
        return links.limit(0)
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    tagged = cut(rest.join(parts, "id", "left").select("key", "id", "bits", F.coalesce("component", "id").alias("comp")))
    counts = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead"))
    # of each block the largest component is the centre; all others are compared with everything
    centre = counts.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("centre"), F.max("n").alias("held")).where("comps > 1")
    live = tagged.join(centre, "key").withColumn("cells", F.ceil(F.col("all") / CELL).cast("int")).withColumn("groups", F.ceil((F.col("all") - F.col("held")) / CELL).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # as many copies of the others as the block has cells, and of the block as the others have groups: one, unless they are many
    left = live.where("comp <> centre").select("key", F.pmod(F.hash("id"), F.col("groups")).alias("cell"), every("cells").alias("other"), "id", "bits", "comp", F.lit(0).alias("side"))
    right = live.select("key", every("groups").alias("cell"), F.pmod(F.hash("id"), F.col("cells")).alias("other"), "id", "bits", "comp", F.lit(1).alias("side"))
    tasks = left.unionByName(right)

    def compare(keyed: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, bits, comp = (table.column(c).to_numpy() for c in ("id", "bits", "comp"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for i in left.tolist():
            ok = right[(np.bitwise_count((bits[right] ^ bits[i]).view(np.uint64)) <= MOST_BITS) & (comp[right] != comp[i])]
            found.append(np.stack([np.minimum(ids[ok], ids[i]), np.maximum(ids[ok], ids[i])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    pairs = cut(tasks.groupBy("key", "cell", "other").applyInArrow(compare, "a bigint, b bigint").distinct())
    return _verified(pairs, texts)
