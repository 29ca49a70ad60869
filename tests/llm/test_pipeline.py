"""The pipeline: each stage against its own operator on its own input."""

import corpus_pipeline
from rowsentry.llm.jaccard_join import jaccard_groups
from rowsentry.llm.quality_fm import score_quality


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        if name == "n-gram Jaccard join":
            groups = jaccard_groups(before)
            ids = {r.doc_id for r in after.collect()}
            assert ids == {r.component_id for r in groups.collect()} and after.count() == len(ids)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words, "en", "s", 1), (1, words, "en", "s", 1), (None, words, None, None, None), (2, None, "x", "y", None), (3, "", None, None, 0), (4, words + " more", "en", "s", 1)], schema)
    kept = corpus_pipeline.near_copies_stage(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1, 2, 3]
    # unlike texts under one id are documents of their own; columns may have any name
    other = " ".join(f"v{i}" for i in range(40))
    mixed = docs.union(spark.createDataFrame([(1, other, "en", "s", 1), (5, other + " z", "en", "s", 1), (1, None, "en", "s", 1)], schema))
    mixed = mixed.withColumnRenamed("source", "of_changes").withColumnRenamed("lang", "key")
    kept = corpus_pipeline.near_copies_stage(spark, mixed, "/root/testdata/sf0.001")
    assert kept.columns == mixed.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:2]) for r in kept.collect()) == [(-1, "w0"), (1, ""), (1, "v0"), (1, "w0"), (2, ""), (3, "")]
    assert corpus_pipeline.passages_stage(spark, mixed, "/root/testdata/sf0.001").columns == mixed.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_classifier_stage_is_fitted_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    poor = {r.doc_id for r in score_quality(docs, labels).where("predicted = 0").select("doc_id").collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    # what the rules leave: no labelled poor document, poor ones without a label among the rest
    left = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.classifier_stage(spark, left, sf_dir).select("doc_id").collect()}
    assert ids & poor and kept == ids - poor
    assert any(i not in quality for i in ids - kept)
