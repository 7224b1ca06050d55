import corpus_pipeline
from lodestone.llm import decontamination, near_dedup, suffix_dedup, toxicity


def test_stages_are_the_operators_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    (_, a), (_, b), (_, c), (_, d), (_, e) = corpus_pipeline.STAGES
    one = a(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - rejected
    two = b(spark, one, sf)
    firsts = {r.class_id for r in near_dedup.classes(one).collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == firsts
    three = c(spark, two, sf)
    cut = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(two).collect()}
    assert three.columns == docs.columns and all(cut[r.doc_id] - 8 <= len(r.text.encode()) <= cut[r.doc_id] for r in three.collect())
    four = d(spark, three, sf)
    leaks = {r.doc_id for r in decontamination.contamination(three, items).collect()}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == firsts - leaks
    assert {r.doc_id for r in e(spark, four, sf).collect()} == firsts - leaks
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == firsts - leaks
