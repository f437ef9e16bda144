import random
import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=3, length=5, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    letters, shorter = sorted({c for w in kept for c in w}), {}
    out = {}
    for w in kept:
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        found = [x for x in edits if x in kept and x != w]
        best = min(found, key=lambda x: (-kept[x], x), default=None)
        ok = best is not None and kept[best] >= 2 * kept[w]
        out[w] = (best if ok else None, kept[w], len(found), kept[best] if ok else None)
        shorter[w] = best if ok else None
    def root(w):
        while shorter[w]:
            w = shorter[w]
        return w
    return {w: (form, root(w), n, k, fn) for w, (form, n, k, fn) in out.items()}


def rows_of(df):
    found = df.collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def test_query_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    assert len(want) > 1000 and any(w[0] for w in want.values())
    assert rows_of(queries.op13_spelling_variants(spark, SF)) == want


@pytest.mark.parametrize(("shard", "at_once"), [(40, 1), (200, 4000), (1 << 20, 1 << 25)])
def test_many_shards_and_rounds_give_the_same(spark, shard, at_once):
    rng = random.Random(shard)
    rows = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(40))) for i in range(30)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least=2, length=2, every=5, shard=shard, at_once=at_once))
    assert got == brute(rows, 2, 2, 5)


def test_odd_texts(spark):
    long = "b" * 70_000
    rows = [
        (1, None), (2, ""), (None, "Straße Straße straße strasse"), (3, "cafés École école École cafés cafés cafes cafes cafes cafes cafes cafes"), (3, "×÷abc ×÷abc ×÷abc"),
        (4, f"{long} {long} {long} {long}c {long}c {long}c"), (5, "你hello你hello€hello \U0001f600jelly jelly jelly 12hello"), (5, "hello " * 20_000),
    ]
    docs = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, word string, n int, best int")
    got = rows_of(spelling.variants(docs))
    want = {w: x for w, x in brute([r for r in rows if r[0] != 4]).items()}
    assert {w: x for w, x in got.items() if len(w) < 1000} == want
    assert {(len(w), x[3]) for w, x in got.items() if len(w) > 1000} <= {(70_000, 1), (70_001, 1)}
    assert rows_of(spelling.variants(docs.where("doc_id = 99"))) == {}


def test_checksums_follow_from_parts():
    import numpy as np

    words = [b"abc", "été".encode(), b"x", b"hello" * 30]
    prefixes = [b"5:", b":", b"123456789012:"]
    row, code = np.arange(400) % 3, (np.arange(400) * 7 // 3) % 4
    got = spelling._checksums(prefixes, row, code, words)
    assert got.tolist() == [zlib.crc32(prefixes[r] + words[c]) for r, c in zip(row, code, strict=True)]
