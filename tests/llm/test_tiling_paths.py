"""Both forms of op2 find the same on punctuated short items and repeated item ids."""

import random

import pytest

from tallyspark.llm import tiling

from . import brute
from .test_operators import VOCAB, frame


def test_broadcast_and_shuffle_agree_on_odd_items(spark):
    items = [(1, "What is 2 + 2 ?"), (2, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(10, "they ask what is 2 + 2 ? and go"), (11, "so alpha beta gamma delta epsilon zeta so"), (12, "so one two three four five six seven so"), (13, "x")])
    want = {(10, 1), (11, 2), (12, 2)}
    for limit in (tiling.BROADCAST_BYTES, 0):
        assert {(r.doc_id, r.item_id) for r in tiling.matches(docs, bench, broadcast_bytes=limit).collect()} == want


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_matches_equal_brute_force(spark, held):
    """All pairs tiled as first described: items with common beginnings, moved parts, repeated rows and ids."""
    rng = random.Random(3)
    head = "what is the answer to this question about".split()
    items = [(i % 25, " ".join(head * (i % 2) + rng.choices(VOCAB[:60], k=rng.choice([2, 4, 9, 14, 22])))) for i in range(30)] + [(99, "! ! ! just three words"), (98, "a a a a a a a a a"), (7, None)]
    rows = []
    for k in range(60):
        words = rng.choices(VOCAB[:60], k=30)
        item = rng.choice(items[:-1])[1].split()
        cut = rng.randrange(len(item))
        words[k % 20 : k % 20] = item[cut:] + ["gap"] * (k % 3) + item[: cut // (1 + k % 2)]
        rows.append((k // 2 if k < 20 else k, " ".join(words)))
    rows += [rows[0], rows[5], (70, "say just three words"), (71, "a a a a a a"), (72, None), (73, ""), (None, items[0][1])]
    want = []
    for d, text in rows:
        for i, item in dict.fromkeys(items):
            a, b = tiling.tokens(item), tiling.tokens(text)
            if d is not None and a and (n := sum(x for _, _, x in brute.tiles(a, b, min(5, len(a))))) >= 0.5 * len(a):
                want.append((d, i, round(n / len(a), 6)))
    docs = frame(spark, rows).withColumnsRenamed({"lang": "seed", "source": "items", "n_chars": "row"})
    got = tiling.matches(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=held).collect()
    assert len(want) > 20 and sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in got) == sorted(want)
