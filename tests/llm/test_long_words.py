"""Toxic phrases behind long runs of text without white space."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import toxicity

from .test_operators import VOCAB, toxic_rows


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_pieces_hold_every_run_of_six_characters(text):
    for word in text.lower().split():
        pieces = toxicity.split(word)
        assert all(len(p.encode("utf-8", "surrogatepass")) <= toxicity.PIECE for p in pieces)
        assert all(any(word[k : k + 6] in p for p in pieces) for k in range(max(1, len(word) - 5)))


def test_a_toxic_phrase_behind_an_unspaced_run():
    rows = toxic_rows(600, 3)
    scorer = toxicity.Scorer(toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows]))
    rng = random.Random(4)
    for clean in ("_".join(rng.choice(VOCAB) for _ in range(100)), "今日は天気がいいから散歩しましょう" * 20):
        low, high = scorer.scores([clean, f"{clean}_badword_vileword_nastyterm"])
        assert low < toxicity.LIMIT <= high
