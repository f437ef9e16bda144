"""The pipeline's stages, each against what it may and must do to its own input."""

import random

import corpus_pipeline as pipeline
from tallyspark.llm import bpe, simhash, tiling
from tallyspark.llm.common import materialize, table

from .test_operators import DOCS, PATH, frame, prose, toxic_rows

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, SF, "documents")
    seen = [docs.count()]
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(found.values())
        if name == "decontamination":
            hit = {r.doc_id for r in tiling.matches(docs, table(spark, SF, "benchmark")).collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - hit
        if name == "secrets":
            assert out.count() == docs.count()
        seen.append(out.count())
        last, docs = docs, out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, bpe.encode_documents(last, PATH).collect()))


def test_toxic_documents_go(spark, tmp_path):
    rows = toxic_rows(600, 3)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    wrong = [i for i, _, y in rows if (i in left) == bool(y)]
    assert len(wrong) <= 0.05 * len(rows)


def test_extra_columns_and_empty_tables(spark):
    docs = frame(spark, [(1, prose(random.Random(1), 30)), (None, None)]).withColumnsRenamed({"lang": "component_id", "source": "fp"})
    assert pipeline.near_dedup(spark, docs, SF).columns == docs.columns
    empty = spark.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
