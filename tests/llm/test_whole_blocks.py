"""Blocks too large for one piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import neardup


def test_the_rest_of_a_cut_block_is_met_in_the_second_round():
    n = 50_100
    key = np.concatenate([[1], np.full(n + 5, 7), [9, 9]])
    ids = np.arange(len(key))
    bits = np.zeros(len(key), dtype=np.int64)
    cuts = [0, 1 + n, 1 + n + 5 + 2]  # n rows of the block, then 5 more and another key
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in (key, ids, bits)], ["key", "id", "bits"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    # a batch without rows stands between them: the block is cut there
    batches.insert(1, batches[0].slice(0, 0))
    edges = set()
    for out in neardup._meet(iter(batches)):
        edges |= {b for a, b, k in zip(*(out.column(c).to_pylist() for c in ("a", "b", "key")), strict=True) if a is None and k == 7}
    assert edges == set(range(1, n + 6))


@pytest.mark.parametrize(("likeness", "least"), [(0.6, 0.94), (0.65, 0.98), (0.75, 0.995)])
def test_pairs_meet_as_often_as_is_stated(likeness, least):
    """Share of pairs of a likeness that agree in a block and stay under the Hamming limit."""
    n, pairs = 60, 1500
    shared = round(2 * n * likeness / (1 + likeness))
    each = 2 * n - shared
    own = np.arange(pairs * each, dtype=np.uint64).reshape(pairs, each)
    sets = np.stack([own[:, :n], own[:, n - shared :]], axis=1).reshape(2 * pairs, n)
    g, owner = neardup.mix(sets.reshape(-1) + np.uint64(1)), np.repeat(np.arange(2 * pairs), n)
    _, _, keys, bits = neardup.fingerprints_of(g, owner)
    met = (keys[0::2] == keys[1::2]).any(axis=1) & (np.bitwise_count(bits[0::2] ^ bits[1::2]) <= neardup.MOST_BITS)
    assert met.mean() >= least
