import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import divergence


def brute(rows, least, top):
    """rows of (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = text.translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        mine, q = shares(counts[lang, source]), shares(whole)
        pairs = [(sum(abs(mine[t] - p) for t, p in shares(counts[g]).items()), g[1]) for g in groups if g[0] == lang and g[1] != source]
        for i, (value, item) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
            out.add((lang, source, "pair", item, value, i))
        over = [(mine[t] - q[t], t) for t in kept if counts[lang, source][t] and mine[t] > q[t]]
        for i, (value, item) in enumerate(sorted(over, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
            out.add((lang, source, "term", item, value, i))
    return out


def rows_of(df):
    found = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


SCHEMA = "lang string, source string, text string, term string, n int, p int, value string"


@pytest.mark.parametrize(("loose", "top"), [(0, 7), (3, 5), (256, 50)])
def test_equals_brute_force_with_many_ties(spark, loose, top):
    rng = random.Random(top)
    made = ["".join(rng.choice("abé你") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["abcdefgh" + c for c in "ijkl"]
    rows = [(rng.choice(["en", "de", None]), f"s{rng.randint(0, 6)}", " ".join(rng.choice(made) for _ in range(rng.randint(0, 20)))) for _ in range(300)]
    rows += [("fr", "lonely", "Un deux"), ("it", "a", None), ("it", "b", ""), ("en", "empty", "1 2 3"), ("de", None, "AB ab Ab"), ("en", "s1", "ab " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows + rows[:20]], SCHEMA)
    assert rows_of(divergence.audit(df, 3, top, loose)) == brute(rows + rows[:20], 3, top)


def test_blocks_of_sources_and_slices_of_terms(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "SLICE", 10)
    monkeypatch.setattr(divergence, "ROWS", 4)
    rows = [("en", f"s{rng.randint(0, 10)}", " ".join(f"{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 5))}" for _ in range(15))) for _ in range(120)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    assert rows_of(divergence.audit(df, 2, 5, 1)) == brute(rows, 2, 5)


def test_hot_source_and_empty_table(spark):
    rng = random.Random(6)
    rows = [("en", "hot" if i % 3 else f"s{i % 7}", " ".join(rng.choice(("alpha", "beta", "gamma", "Delta")) for _ in range(9))) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    assert rows_of(divergence.audit(df)) == brute(rows, 30, 50)
    assert rows_of(divergence.audit(df.limit(0))) == set()
