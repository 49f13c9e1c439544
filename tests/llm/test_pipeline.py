"""The stages of the pipeline against brute force, each on its own input."""

import numpy as np

import corpus_pipeline
from draftlake.llm import quality_model
from draftlake.llm.queries import table
from tests.llm import frames
from tests.llm.test_duplicates import brute_exact, brute_near

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == table(spark, SMALL, "documents").columns
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    before, after = seen["quality"]
    good = {r.doc_id for r in after}
    assert np.mean([(r.doc_id in good) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]) > 0.95
    assert good == {r.doc_id for r in quality_model.classify(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect() if r.quality.predicted == 1}
    before, after = seen["exact_dedup"]
    groups, norm = brute_exact(before)
    assert sorted(r.doc_id for r in after) == sorted(k for k, _ in groups.values())
    before, after = seen["near_dedup"]
    comp = brute_near([(r.doc_id, r.text) for r in before], 80)[1]
    assert sorted(r.doc_id for r in after) == sorted({k for k, v in comp.items() if k == v})
    before, after = seen["mixing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) <= 2 * len(before)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    rerun = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rerun.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in after)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing columns, no rows."""
    rows = frames.awkward(spark)
    labels = [(1, 1), (2, 1), (3, 0), (4, 0), (8, 1), (8, 0), (9, None), (None, 1), (6, 1), (6, 1)]
    spark.createDataFrame(labels, "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    want = {"exact_dedup": {1, 3, 6, 7, 8, 9, 5}, "near_dedup": {1, 3, 4, 5, 6, 8, 9, None}}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, str(tmp_path))
        none = stage(spark, rows.where("false"), str(tmp_path))
        assert none.columns == got.columns and none.count() == 0
        found = got.collect()
        assert found and (name == "packing" or got.columns == rows.columns)
        if name in want:
            assert {r.doc_id for r in found} == want[name], (name, sorted(r.doc_id or -1 for r in found))
        if name in ("mixing", "packing"):
            assert {r.doc_id for r in found} == {r.doc_id for r in rows.collect()}
    kept = corpus_pipeline.quality(spark, rows, str(tmp_path)).collect()
    assert 1 in {r.doc_id for r in kept}
