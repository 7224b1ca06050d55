import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import diagnostics, protocols, store
from lodestone.sources import exports
from lodestone.sources.records import ArtifactError
from lodestone.streaming import events as streaming


def test_from_source_to_answers(spark, tmp_path, capsys):
    rows = [{"_id": "q0", "question": "What is the capital of Estonia?", "answer": "Tallinn", "type": "bridge", "level": "hard", "supporting_facts": [{"title": "Tallinn", "idx": 0}], "context": [{"title": "Tallinn", "sentences": ["Tallinn is the capital of Estonia."]}, {"title": "Moon", "sentences": ["The Moon is far."]}]}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    at = lambda name: f"{tmp_path}/{name}"
    assert cli.main(["prepare", at("s.json"), at("corpus"), at("data"), "--level", "hard", "--count", "1"]) == 0
    assert cli.main(["index", at("corpus"), at("index")]) == 0
    assert cli.main(["retrieve", at("index"), at("data/questions"), at("hits")]) == 0
    assert cli.main(["answer", at("corpus"), at("index"), at("data/questions"), at("answers")]) == 0
    printed = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert printed[0]["chunks"] == 2 and printed[2] == {"hits": 2} and printed[3] == {"sufficient_hop1": 1}
    assert spark.read.parquet(at("answers")).first().answer == "Tallinn"


def test_tokens_by_a_file(spark):
    path = "/opt/tokenizers/word_bpe_49k.json"
    got = spark.createDataFrame([("one two",), (None,)], "t string").select(protocols.file_token_counter(path)(F.col("t"))).collect()
    assert got[0][0] >= 2 and got[1][0] == 0


def test_evaluation_stops_at_the_first_failure(spark):
    planned = spark.createDataFrame([(k, k) for k in range(4)], "question_id bigint, position int")
    ran = spark.createDataFrame([(0, 10.0, 4.0, None), (1, 5.0, None, "E"), (2, 3.0, None, None)], "question_id bigint, latency_ms double, embedding_ms double, error_type string")
    hits = spark.createDataFrame([(0, "a", 1, 1.0), (2, "a", 1, 1.0)], "question_id bigint, chunk_id string, rank int, score double")
    gold = spark.createDataFrame([(k, "a") for k in range(4)], "question_id bigint, chunk_id string")
    rows = diagnostics.evaluate_retrieval(hits, gold, planned, 10, ran)
    got = {r.question_id: (r.status, r.mrr, r.core_latency_ms) for r in rows.collect()}
    assert got == {0: ("completed", 1.0, 6.0), 1: ("failed", 0.0, 5.0), 2: ("not_attempted", None, 3.0), 3: ("not_attempted", None, None)}
    s = diagnostics.run_summary(rows, 2.0).first()
    assert (s.planned, s.completed, s.failed, s.not_attempted, s.mean_mrr, s.throughput, s.retrieval_throughput) == (4, 1, 1, 2, 0.5, 0.5, 100.0)


def test_paired_checks(spark):
    hits = spark.createDataFrame([("fixed", 5, 1, 1, "a"), ("evidence", 5, 1, 1, "a"), ("fixed", 5, 2, 1, "a"), ("evidence", 5, 2, 1, "b")], "system string, top_k int, question_id int, rank int, chunk_id string")
    assert [(r.question_id, r.top_k) for r in diagnostics.unequal_first_hops(hits).collect()] == [(2, 5)]
    units = spark.createDataFrame([(1, "x::s0"), (1, "x::s1")], "question_id int, evidence_unit_id string")
    gold = spark.createDataFrame([(1, "x::s0"), (1, "y::s0"), (2, "z::s0")], "question_id int, evidence_unit_id string")
    cover = diagnostics.gold_coverage(units, gold)
    assert {(r.question_id, r.n_found, tuple(r.missing_ids)) for r in cover.collect()} == {(1, 1, ("y::s0",)), (2, 0, ("z::s0",))}
    assert tuple(diagnostics.coverage_totals(cover).first()) == (2, 3, 1, 0)
    calls = spark.createDataFrame([(1, [(3, 2, None), (4, 1, 1)]), (2, None)], "question_id int, calls array<struct<input_tokens:int,output_tokens:int,cached_tokens:int>>")
    assert {tuple(r) for r in diagnostics.usage(calls).collect()} == {(1, 7, 3, 1, 2), (2, 0, 0, 0, 0)}
    assert "| a |" in diagnostics.markdown("t", spark.createDataFrame([("x",)], "a string"))


def test_exports_are_checked(spark, tmp_path):
    events = spark.createDataFrame([("e1", "r", None, store.STARTED, "{}", 1), ("e2", "r", "q0", store.ANSWERED, "{}", 2)], "event_id string, run_id string, question_id string, event_type string, payload string, sequence bigint")
    planned = spark.createDataFrame([("r", "q0", 0)], "run_id string, question_id string, position int")
    exports.write_export(spark, f"{tmp_path}/run", {"events": events, "questions": planned}, {"run": "r"}, diagnostics.markdown("run", planned))
    assert exports.load_run(spark, f"{tmp_path}/run")[1].count() == 2
    with pytest.raises(ArtifactError):
        exports.write_export(spark, f"{tmp_path}/run", {"events": events}, {})
    exports.write_export(spark, f"{tmp_path}/odd", {"events": events.filter("sequence = 2"), "questions": planned}, {})
    with pytest.raises(ArtifactError, match="before the start"):
        exports.load_run(spark, f"{tmp_path}/odd")
    traces = spark.createDataFrame([("q0", 0), ("q0", 1)], "question_id string, condition int")
    exports.write_export(spark, f"{tmp_path}/sys", {"traces": traces}, {"questions": 1, "conditions": 2})
    assert exports.load_system_export(spark, f"{tmp_path}/sys")[1].count() == 2
    part = sorted((tmp_path / "sys" / "traces").glob("part-*.txt"))[0]
    part.write_text(part.read_text() + "{}\n")
    with pytest.raises(Exception):
        exports.load_system_export(spark, f"{tmp_path}/sys")


def test_a_stream_fills_a_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    run = spark.createDataFrame([("r", "dev", "d", "c", "f")], "run_id string, role string, dataset_version string, corpus_version string, config_fingerprint string")
    s.register(run, spark.createDataFrame([("q0", 0)], "question_id string, position int"))
    rows = [("e1", "r", "t", None, store.STARTED), ("e2", "r", "t", "q0", store.ANSWERED)]
    df = spark.createDataFrame(rows, "event_id string, run_id string, trace_id string, question_id string, event_type string")
    df = df.withColumn("occurred_at", F.to_timestamp(F.concat(F.lit("2024-01-01 00:00:0"), F.substring("event_id", 2, 1)))).withColumn("source", F.lit("s")).withColumn("source_version", F.lit("1")).withColumn("payload", F.lit("{}"))
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        streaming.ingest(streaming.read(spark, f"{tmp_path}/in", df.schema), s, f"{tmp_path}/cp").awaitTermination()
    assert s.events().count() == 2 and s.get_run("r")["completed"] == 1
