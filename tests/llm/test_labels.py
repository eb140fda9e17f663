"""The label model against labelled pairs: cutoffs from the first half, figures on the second."""

from __future__ import annotations

from collections import Counter

import pytest
from labelled import pairs as labelled

from loomstone.llm import pairs


@pytest.fixture(scope="module")
def judged(spark):
    """For each defect the posteriors and vote sums of both halves, under a model of the votes of a whole table and of the labelled pairs, whose labels it isn't told."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/download_instruct.parquet").select("text").collect()]
    counts = {name: Counter() for name in pairs.DEFECTS}
    halves = [[(pairs.vote(q, a)[0], want) for q, a, want in labelled(700, seed)] for seed in (1, 2)]
    for votes in [pairs.vote(q, a)[0] for t in texts if t for q, a in pairs.split_pairs(t)] + [v for half in halves for v, _ in half]:
        for name in pairs.DEFECTS:
            counts[name][votes[name]] += 1
    models = {name: pairs.fit(dict(counts[name]), pairs.LABELLERS[name]) for name in pairs.DEFECTS}
    return models, [{name: [(models[name][v[name]], sum(v[name]), name in want) for v, want in half] for name in pairs.DEFECTS} for half in halves]


def f1(kept, wanted):
    return 2 * sum(k and w for k, w in zip(kept, wanted, strict=True)) / max(1, sum(kept) + sum(wanted))


@pytest.mark.parametrize("name", pairs.DEFECTS)
def test_cutoffs_are_those_that_do_best_on_the_first_half(judged, name):
    first = judged[1][0][name]
    wanted = [w for *_, w in first]
    best = pairs.best_cutoff([(p, w) for p, _, w in first])
    assert f1([p > pairs.CUTOFFS[name] for p, *_ in first], wanted) == f1([p > best for p, *_ in first], wanted)


@pytest.mark.parametrize("name", pairs.DEFECTS)
def test_labels_on_the_second_half(judged, name):
    second = judged[1][1][name]
    wanted = [w for *_, w in second]
    kept = [p > pairs.CUTOFFS[name] for p, *_ in second]
    hits = sum(k and w for k, w in zip(kept, wanted, strict=True))
    assert sum(wanted) >= 20 and hits / sum(wanted) >= 0.95 and hits / sum(kept) >= 0.95
    assert f1(kept, wanted) >= f1([s > 0 for _, s, _ in second], wanted)


def test_the_model_does_better_than_a_vote_sum(judged):
    second = judged[1][1]
    kept = [p > pairs.CUTOFFS[name] for name in pairs.DEFECTS for p, *_ in second[name]]
    summed = [s > 0 for name in pairs.DEFECTS for _, s, _ in second[name]]
    wanted = [w for name in pairs.DEFECTS for *_, w in second[name]]
    assert f1(kept, wanted) > f1(summed, wanted)


def test_some_posteriors_are_undecided(judged):
    assert sum(0.1 < p < 0.9 for model in judged[0].values() for p in model.values()) >= 4


def test_source_habits_vote(spark):
    """Where a source seldom ends with a mark, the lack of one says less."""
    body = "The mill was sold because the owner of the land had left for the coast"
    strict = [(i, f"User: Why was it sold?\nAssistant: {body}, number {i} of them all.", "strict") for i in range(40)]
    loose = [(100 + i, f"User: Why was it sold?\nAssistant: {body}, number {i} of them all as people say" + ("." if i % 4 == 0 else ""), "loose") for i in range(40)]
    records = strict + loose + [(1000, f"User: Why was it sold?\nAssistant: {body} as people say", "strict"), (1001, f"User: Why was it sold?\nAssistant: {body} as people say", "loose")]
    df = spark.createDataFrame(records, "rec_id long, text string, source string")
    rows = {r.rec_id: r.posterior for r in pairs.label(df).where("defect = 'truncated'").collect()}
    assert rows[1000] > 0.35 and rows.get(1001, 0.0) < rows[1000]
