"""Evaluation texts that leak into training text, found by winnowing.

Both sides are cut into words; of every window of ``w`` word k-grams the one with
the least hash is kept. Two texts that share a run of ``w + k - 1`` words share a
kept k-gram, so joining the kept k-grams finds every such run; each hit is then
extended, word by word, to the whole shared run. Items are indexed in classes by
the run that counts as a leak: ``k`` and ``w`` of a class follow from its shortest
run, so none is missed, and a few short items don't change how others are looked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.wordgrams import chunks, grams, words
from loomstone.session import cut

SHORT_ITEM = 8
"""Items with fewer words must occur whole; of longer ones half, and at least so many words."""
BLOCK_BYTES = 32 << 20
"""Test items are taken in blocks of about so many bytes of text; the corpus is read once for each block, whose fingerprints are sent to all workers."""
HITS = 2_000_000
"""Hits extended at once; bounds the worker's memory, not the result."""
GRAM = 4


def run_needed(n_words: np.ndarray) -> np.ndarray:
    """Words of an item that must occur in one run."""
    return np.where(n_words < SHORT_ITEM, n_words, np.maximum(SHORT_ITEM, (n_words + 1) // 2))


def winnow(hashes: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: the rightmost least hash of each window. Windows at a text's ends are cut, which only adds positions."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(valid, hashes, most)
    padded = np.concatenate([np.full(window - 1, most), h, np.full(window - 1, most)])
    count = len(padded) - window + 1
    best, at = padded[:count].copy(), np.zeros(count, dtype=np.int64)
    for d in range(1, window):
        later = padded[d : d + count]
        take = later <= best
        best = np.where(take, later, best)
        at[take] = d
    keep = np.unique(at + np.arange(count) - (window - 1))
    keep = keep[(keep >= 0) & (keep < len(h))]
    return keep[valid[keep]]


@dataclass
class Prints:
    """The sorted k-grams of one class of items, and the window that texts are winnowed by for it."""

    gram: int
    window: int
    keys: np.ndarray
    at: np.ndarray


@dataclass
class Items:
    """The test items as flat arrays, with their fingerprints by class."""

    ids: list[str]
    hashes: np.ndarray
    starts: np.ndarray
    need: np.ndarray
    classes: list[Prints]


def shapes(need: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """Classes of items: which they are, k, and the w at which every run that counts holds a full window."""
    found = []
    for low, high in [*((n, n) for n in range(1, GRAM)), (GRAM, SHORT_ITEM - 1), (SHORT_ITEM, None)]:
        own = (need >= low) & (need <= high) if high else need >= low
        if own.any():
            gram = min(GRAM, low)
            found.append((own, gram, int(need[own].min()) - gram + 1))
    return found


def index_items(ids: list[str], texts: list[str | None]) -> Items:
    hashes, text_of = words(texts, folded=True)
    lengths = np.bincount(text_of, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    need = run_needed(lengths)
    classes = []
    for own, gram, window in shapes(need):
        g, valid = grams(hashes, text_of, gram)
        # All k-grams of the (few) items are kept: joined with winnowed texts this
        # finds the same runs and also those whose window differs at an item's end.
        at = np.flatnonzero(valid & own[text_of[: len(valid)]])
        order = np.argsort(g[at], kind="stable")
        classes.append(Prints(gram, window, g[at][order], at[order]))
    return Items(ids, hashes, starts, need, classes)


def leaks(texts: list[str | None], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(text index, item index) of every leak in ``texts``."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    if items.classes:
        hashes, text_of = words(texts, folded=True)
        hashed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for own in items.classes:
            if own.gram not in hashed:
                hashed[own.gram] = grams(hashes, text_of, own.gram)
            g, valid = hashed[own.gram]
            kept = winnow(g, valid, own.window)
            low, high = np.searchsorted(own.keys, g[kept], "left"), np.searchsorted(own.keys, g[kept], "right")
            hit = high > low
            kept, low, many = kept[hit], low[hit], (high - low)[hit]
            part = np.cumsum(many) // HITS
            for p in np.unique(part):
                found.append(_confirmed(hashes, text_of, kept[part == p], low[part == p], many[part == p], own, items))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def _confirmed(hashes: np.ndarray, text_of: np.ndarray, kept: np.ndarray, low: np.ndarray, many: np.ndarray, own: Prints, items: Items) -> np.ndarray:
    """Pairs of text and item whose shared run, from each hit to both sides, is long enough."""
    here = np.repeat(kept, many)
    there = own.at[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
    item = np.searchsorted(items.starts, there, side="right") - 1
    left, right = _extend(hashes, text_of, here, there, items, item)
    enough = left + right >= items.need[item]
    return np.unique(np.stack([text_of[here][enough], item[enough]]), axis=1)


def _extend(hashes: np.ndarray, text_of: np.ndarray, here: np.ndarray, there: np.ndarray, items: Items, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words shared to the left of each hit and from it on."""
    reach = []
    for step in (-1, 1):
        shared = np.zeros(len(here), dtype=np.int64)
        going = np.arange(len(here))
        d = 0 if step > 0 else 1
        while len(going):
            a, b = here[going] + step * d, there[going] + step * d
            ok = (a >= 0) & (a < len(hashes)) & (b >= items.starts[item[going]]) & (b < items.starts[item[going] + 1])
            going, a, b = going[ok], a[ok], b[ok]
            ok = (hashes[a] == items.hashes[b]) & (text_of[a] == text_of[here[going]])
            going = going[ok]
            shared[going] += 1
            d += 1
        reach.append(shared)
    return reach[0], reach[1]


def find_leaks(corpus: DataFrame, tests: DataFrame, key: str = "rec_id", text: str = "text", item_key: str = "id", item_text: str = "prompt") -> DataFrame:
    """Every (document, test item) such that the document holds the item's wording.

    Returns ``key`` and ``prompt_id``, each pair once. Null and blank texts and
    items without a word leak nothing; a repeated item id stands for all its
    wordings; repeated documents are reported under each id; other columns are
    ignored, whatever their names. An empty side gives no rows. Null ids are kept
    as null. The items are the query set: however many there are, they are held
    against all documents block by block, by the same code.
    """
    docs = corpus.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    items = tests.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    kind = dict(corpus.dtypes)[key]
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    if blocks == 1:
        found = _search(docs, items, kind)[0]
    else:
        items = cut(items)
        found = None
        for block in range(blocks):
            own, index = _search(docs, items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block), kind)
            own = cut(own)
            index.destroy()
            found = own if found is None else found.unionByName(own)
    return found.select(F.col("doc").alias(key), F.col("id").alias("prompt_id")).distinct()


def _search(docs: DataFrame, items: DataFrame, kind: str):
    """Leaks of one block of items, and its index as it was sent to the workers."""
    rows = items.collect()  # about BLOCK_BYTES
    index = docs.sparkSession.sparkContext.broadcast(index_items([r.id for r in rows], [r.text for r in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        names = np.array(own.ids, dtype=object)
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc")
            for begin, part in chunks(texts):
                at, item = leaks(part, own)
                if len(at):
                    pairs = list(dict.fromkeys(zip((at + begin).tolist(), names[item].tolist(), strict=True)))
                    yield pa.RecordBatch.from_arrays([doc.take(pa.array([a for a, _ in pairs])), pa.array([i for _, i in pairs], pa.string())], ["doc", "id"])

    return docs.where("text is not null").mapInArrow(search, f"doc {kind}, id string"), index
