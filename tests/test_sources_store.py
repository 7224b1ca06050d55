import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, retrieval, store, systems
from lodestone.sources import indexes, records
from lodestone.sources.records import ArtifactError

RECORDS = [
    {"_id": f"q{k}", "question": f" Which {k}? ", "answer": "x", "type": "bridge", "level": "hard" if k else "easy", "supporting_facts": [["Alpha", 0], ["Beta", 1]], "context": [["Alpha", [f"Alpha {k}."]], ["Beta", ["One. ", "Two."]], ["Noise", ["No."]]]}
    for k in range(3)
]


@pytest.fixture()
def source(spark, tmp_path):
    as_json = [{**r, "supporting_facts": [{"title": t, "idx": i} for t, i in r["supporting_facts"]], "context": [{"title": t, "sentences": s} for t, s in r["context"]]} for r in RECORDS]
    path = tmp_path / "source.json"
    path.write_text(json.dumps(as_json))
    return records.read_source(spark, str(path))


def test_source_to_benchmark(spark, source, tmp_path):
    chosen, counts, rest = records.select_source(source, "hard", "seed", 2)
    assert {r.question_id for r in chosen.collect()} == {"q1", "q2"} and counts == {"source": 3, "invalid": 0, "eligible": 2} and rest.count() == 0
    manifest = records.prepare_benchmark(source, f"{tmp_path}/corpus", f"{tmp_path}/data", "v1")
    assert (manifest["candidates"], manifest["chunks"], manifest["duplicates"]) == (9, 5, 4)
    assert records.load_corpus(spark, f"{tmp_path}/corpus").count() == 5
    questions, gold = records.load_benchmark(spark, f"{tmp_path}/data", f"{tmp_path}/corpus")
    assert questions.columns == ["question_id", "text"] and gold.count() == 6 and gold.filter("evidence_unit_id not like 'chunk:%::s%'").count() == 0
    with pytest.raises(ArtifactError):
        records.prepare_benchmark(source, f"{tmp_path}/corpus", f"{tmp_path}/data2", "v1")
    spark.read.parquet(f"{tmp_path}/corpus/chunks").limit(1).write.mode("append").parquet(f"{tmp_path}/corpus/chunks")
    with pytest.raises(ArtifactError):
        records.load_corpus(spark, f"{tmp_path}/corpus")


def test_strict_json(spark, tmp_path):
    cases = [('{"a": 1}', None), ('{"a": 1, "a": 2}', "repeated key"), ('{"a": NaN}', "number is not finite"), ("[1]", "not an object"), ("{", "not JSON")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r[0] for r in rows.select(records.json_error(F.col("t"))).collect()] == [c[1] for c in cases]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="object"):
        records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    got = spark.sql("SELECT named_struct('b', 1, 'a', map('z', 1, 'y', 2)) AS s").select(records.canonical(F.col("s"))).first()[0]
    assert got == '{"a":{"y":2,"z":1},"b":1}'


def test_jsonl_is_exclusive_and_checked(spark, tmp_path):
    rows, uri = spark.range(3), f"{tmp_path}/out"
    described = records.write_jsonl(rows, uri)
    assert described["rows"] == 3
    records.validate(spark, uri, described)
    with pytest.raises(ArtifactError):
        records.write_jsonl(rows, uri)
    with pytest.raises(ArtifactError):
        records.validate(spark, uri, {**described, "files": []})


def test_published_postings_rank_like_texts(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "Alpha Red apple fruit."), (2, "Beta Blue ocean water."), (3, "Gamma Apple pie dessert."), (4, "")], "chunk_id bigint, text string")
    asked = spark.createDataFrame([(1, "red apple"), (2, "zzz"), (3, "apple apple")], "question_id int, text string")
    manifest = indexes.build_lexical(chunks, f"{tmp_path}/lex")
    index = indexes.load(spark, f"{tmp_path}/lex", "lexical", manifest["config"], chunks)
    rank = lambda df: sorted(tuple(r) for r in df.select("question_id", "chunk_id", "rank", "score").collect())
    assert rank(retrieval.bm25_indexed(index, asked)) == rank(retrieval.bm25(chunks, asked)) != []
    with pytest.raises(ArtifactError):
        indexes.build_lexical(chunks, f"{tmp_path}/lex")
    with pytest.raises(ArtifactError):
        indexes.load(spark, f"{tmp_path}/lex", "lexical", {"k1": 9}, chunks)
    with pytest.raises(ArtifactError):
        indexes.load(spark, f"{tmp_path}/lex", "lexical", None, chunks.filter("chunk_id > 1"))
    assert indexes.lexical_problems({"postings": index["postings"].unionByName(index["postings"]), "docs": index["docs"]})


def test_vectors_and_cache(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "chunk_id bigint, vector array<double>")
    manifest = indexes.build_dense(vectors, f"{tmp_path}/dense", 2)
    got = {r.chunk_id: r.vector for r in indexes.load(spark, f"{tmp_path}/dense", "dense", manifest["config"])["vectors"].collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 1.0]}
    with pytest.raises(Exception):
        indexes.build_dense(spark.createDataFrame([(1, [0.0, 0.0])], "chunk_id bigint, vector array<double>"), f"{tmp_path}/bad", 2)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "question_id int, text string")
    provider = lambda texts: texts.select("text", F.array(F.length("text").cast("float"), F.lit(0.5).cast("float")).alias("vector"))
    cache = indexes.QueryCache(spark, f"{tmp_path}/cache", "v1", "m", 2)
    assert {(r.question_id, r.cached) for r in cache.embed(asked.filter("question_id = 1"), provider).collect()} == {(1, False)}
    read = indexes.QueryCache(spark, f"{tmp_path}/cache", "v1", "m", 2, "read_only")
    assert {(r.question_id, r.cached) for r in read.embed(asked.filter("text = 'a'")).collect()} == {(1, True), (3, True)}
    with pytest.raises(ArtifactError):
        read.embed(asked)


def event(k, kind, question=None, payload="{}", at=None):
    return (f"e{k}", f"2024-01-01 00:00:{at if at is not None else k:02d}", "r", "t", question, kind, "s", "1", payload)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, occurred_at string, run_id string, trace_id string, question_id string, event_type string, source string, source_version string, payload string")
    return df.withColumn("occurred_at", F.to_timestamp("occurred_at"))


def test_the_life_of_a_run(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    run = spark.createDataFrame([("r", "dev", "d1", "c1", "f" * 64)], "run_id string, role string, dataset_version string, corpus_version string, config_fingerprint string")
    planned = spark.createDataFrame([("q0", 0), ("q1", 1)], "question_id string, position int")
    assert s.register(run, planned) and not s.register(run, planned)
    with pytest.raises(store.ConflictError):
        s.register(run.withColumn("role", F.lit("test")), planned)
    first = [event(1, store.STARTED), event(2, store.ANSWERED, "q0", '{"latency_ms": 4, "metrics": {"mrr": 0.5}}')]
    assert s.ingest(frame(spark, first)) == 2 and s.ingest(frame(spark, first)) == 0
    with pytest.raises(store.ConflictError):
        s.ingest(frame(spark, [event(2, store.ANSWERED, "q0", '{"latency_ms": 5}')]))
    for bad, why in [(event(3, store.ANSWERED, "q9"), "not planned"), (event(3, store.ANSWERED, "q0"), "out of order"), (event(3, store.FINISHED, None, '{"completed": 2}'), "summary"), (event(3, store.STARTED), "starts twice")]:
        with pytest.raises(store.StorageError, match=why):
            s.ingest(frame(spark, [bad]))
    path = tmp_path / "e.jsonl"
    lines = [dict(zip(("event_id", "occurred_at", "run_id", "trace_id", "question_id", "event_type", "source", "source_version", "payload"), e, strict=True)) for e in (event(3, store.ANSWERED, "q1"), event(4, store.FINISHED, None, '{"completed": 2}'))]
    path.write_text("\n".join(json.dumps({**x, "occurred_at": x["occurred_at"].replace(" ", "T")}) for x in lines))
    assert s.import_export(str(path)) == 2 and s.import_export(str(path)) == 0
    with pytest.raises(store.StorageError, match="behind the end"):
        s.ingest(frame(spark, [event(9, store.ANSWERED, "q1")]))
    got = s.get_run("r")
    assert (got["state"], got["completed"], got["failed"], got["pending"], got["n_events"]) == ("completed", 2, 0, 0, 4)
    page, cursor = s.list_questions("r", 1)
    assert page[0]["question_id"] == "q0" and [x["question_id"] for x in s.list_questions("r", 1, cursor)[0]] == ["q1"] and s.list_questions("r", 5, failures=True)[0] == []
    assert s.list_runs(1)[0][0]["run_id"] == "r" and s.list_runs(1)[1] is None and [r.sequence for r in s.trace("r", "q0").collect()] == [2]
    assert s.compare("r", "r", ("mrr",)).first().delta == 0.0 and s.health()["status"] == "ok"
    for wrong in ("!!", store.encode_cursor(-1)):
        with pytest.raises(store.StorageError):
            s.list_questions("r", 1, wrong)


def test_holders_of_items(spark):
    chunks = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three  four five six"), (3, "seven eight"), (4, None)], "chunk_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "eight"), (3, ""), (4, None), (5, "wo three four five six y")], "question_id bigint, text string")
    assert sorted(tuple(r) for r in corpus.holders(chunks, items).collect()) == [(1, 1), (2, 3), (5, 1)]
    assert corpus.holders(chunks, items.filter("question_id > 9")).count() == 0


def test_intervals_and_neighbours(spark):
    points = spark.createDataFrame([(k, float(v)) for k, v in enumerate((0, 1, 5, 9.5, -3))], "k int, v double")
    spans = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.5, 9.5), ("c", -10.0, 100.0), ("d", 3.0, 3.0)], "name string, lo double, hi double")
    got = {(r.k, r.name) for r in systems.contained(points, "v", spans, "lo", "hi").collect()}
    assert got == {(k, n) for k, v in enumerate((0, 1, 5, 9.5, -3)) for n, lo, hi in (("a", 0, 1), ("b", 0.5, 9.5), ("c", -10, 100), ("d", 3, 3)) if lo <= v < hi}
    left = spark.createDataFrame([(1, 100), (1, 500)], "s int, at int")
    right = spark.createDataFrame([(1, 90), (1, 100), (1, 130), (2, 101)], "s int, at int")
    assert {(r.at, r.before, r.behind) for r in systems.nearest(left, right, "s", "at", 120).collect()} == {(100, 90, 130), (500, None, None)}
