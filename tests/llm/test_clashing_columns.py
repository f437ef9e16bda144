"""Tables whose further columns are named like the operators' own, and texts of 20,000 words, give what plain tables give."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import divergence, pivots, shards, simhash, spelling, substrings, tiling
from tests.llm import brute

NAMES = "key rep anchor mark k1 bucket block n fp salt a b far part home p q lo hi own size slot shard kept item_id seed hash word term form root count found _own _part component_id n_links text_crc32 value rank"


def clashing(df):
    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES.split()) if n not in df.columns))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    some = [f"w{draw.randint(0, 3000)}" for _ in range(20_000)]
    passage = " ".join(some[500:530])
    return [" ".join(some), " ".join(some[:-1]), "", None, passage, passage, f"before {passage} after", *(" ".join(draw.choices(some, k=40)) for _ in range(25))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def both(run, df, names):
    plain, more = (sorted((tuple(r[n] for n in names) for r in run(d).collect()), key=repr) for d in (df, clashing(df)))
    assert plain == more
    return plain


def test_simhash(docs, texts):
    got = both(simhash.near_duplicates, docs, ["doc_id", "fp", "component_id"])
    want = brute.simhash(list(enumerate(texts)))
    assert {(i, f"{fp & (2**64 - 1):016x}", c) for i, fp, c in got} == {(i, *v) for i, v in want.items()}


def test_similar_documents(docs):
    got = dict(both(simhash.similar_documents, docs, ["doc_id", "component_id"]))
    assert got[1] == got[0] == 0 and got[3] == got[2] == 2 and got[5] == got[4] == 4


def test_repeats(docs, texts):
    got = both(substrings.remove_repeats, docs, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert {i: tuple(rest) for i, *rest in got} == brute.repeats(list(enumerate(texts)))


def test_shards(docs, texts):
    got = both(lambda d: shards.assign(d, shards=4), docs, ["doc_id", "size", "shard", "slot"])
    counts = [sum(r[2] == s for r in got) for s in range(4)]
    assert len(got) == len(texts) and max(counts) - min(counts) <= 1


def test_tiling(spark, docs, texts):
    bench = spark.createDataFrame([(7, texts[4]), (8, None), (9, " ".join(texts[0].split()[9_000:9_040]))], "item_id long, text string")
    for run in (lambda d: tiling.matches(d, bench), lambda d: tiling.matches(d, clashing(bench)), lambda d: tiling.matches(d, clashing(bench), broadcast_bytes=0)):
        got = both(run, docs, ["doc_id", "item_id"])
        assert {(0, 7), (1, 7), (4, 7), (5, 7), (6, 7), (0, 9), (1, 9)} <= set(got) and not {d for d, _ in got} & {2, 3}


def test_pivots(spark):
    draw = random.Random(2)
    base = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base + [[x * 1.01 for x in v] for v in base[:10]])] + [(50, None), (51, [0.0] * 16)]
    got = both(pivots.near_duplicates, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ["vec_id", "n_links", "component_id"])
    assert [r for r in got if r[0] in (0, 40, 50, 51)] == [(0, 1, 0), (40, 1, 0), (50, 0, 50), (51, 0, 51)]


def test_divergence_and_spelling(docs):
    assert both(lambda d: divergence.audit(d, least_docs=2, top=5), docs, ["lang", "source", "part", "item", "value", "rank"])
    both(lambda d: spelling.variants(d, least=1, length=1), docs, ["word", "form", "root", "n", "n_near", "form_n"])
