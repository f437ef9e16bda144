"""The near-dedup stage on planted near copies, against brute force."""

import itertools
import random

import pytest

import corpus_pipeline as pipeline
from tallyspark.llm import simhash

from . import brute
from .test_operators import SF, frame, prose


def jaccard_components(rows):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return brute.components(list(sets), links), links


def planted(seed=1):
    """Texts with copies that differ in a few words, some just under the limit, and a dense group of such copies."""
    rng, rows = random.Random(seed), []
    for k in range(80):
        words = prose(rng, rng.choice([3, 60, 100, 300])).split()
        rows.append(" ".join(words))
        for n in (1, 2, 4, 6):
            other = list(words)
            for at in rng.sample(range(len(words)), min(n, len(words))):
                other[at] = f"changed{n}"
            rows.append("  ".join(other).upper() if k % 2 else " ".join(other))
    base = prose(rng, 120).split()
    for k in range(100):
        other = list(base)
        other[rng.randrange(120)] = other[rng.randrange(120)] = f"x{k}"
        rows.append(" ".join(other))
    return [(i * 2, t) for i, t in enumerate([*rows, "", None, rows[0]])]


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_planted_near_copies_against_brute_force(spark, block):
    """Nothing is joined that brute force does not join, and of its groups all but pairs just at the limit are found."""
    rows = planted()
    want, links = jaccard_components(rows)
    assert len(links) > 500
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows), block=block).collect()}
    assert set(got) == set(want) and all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == c for i, c in want.items()) >= 0.98 * len(want)
    dense = [got[i] for i in got if want[i] == want[800]]
    assert len(dense) > 50 and max(map(dense.count, dense)) >= 0.98 * len(dense)  # brute force joins 56 of the 100 copies


def test_stage_keeps_one_of_each_group(spark):
    rows = planted(2)
    want, _ = jaccard_components(rows)
    left = {r.doc_id for r in pipeline.near_dedup(spark, frame(spark, rows), SF).collect()}
    assert left >= set(want.values()) and len(left) <= 1.02 * len(set(want.values()))
