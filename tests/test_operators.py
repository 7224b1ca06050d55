import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, evaluation, events, evidence, retrieval


def hits(spark, rows):
    return spark.createDataFrame([(1, c, r, s) for c, r, s in rows], "question_id bigint, chunk_id string, rank int, score double")


def test_fusion_of_two_branches(spark):
    a, b = hits(spark, [("a", 1, 2.0), ("b", 2, 1.0)]), hits(spark, [("b", 1, 0.9), ("c", 2, 0.8)])
    got = retrieval.fuse({"bm25": a, "dense": b}).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert got[0].score == round(1 / 62 + 1 / 61, 6) and got[0].source_ranks == {"bm25": 2, "dense": 1}
    with pytest.raises(ValueError):
        retrieval.fuse({"bm25": a}, weights={"dense": 1.0})


def test_bm25_finds_only_chunks_with_a_token(spark):
    chunks = spark.createDataFrame([("a", "Alpha Red apple fruit."), ("b", "Beta Blue ocean water."), ("c", "Gamma Apple pie dessert.")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "red apple"), (2, "zzz"), (3, "apple apple")], "question_id int, text string")
    got = retrieval.bm25(chunks, asked).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id) for r in got] == [(1, "a"), (1, "c"), (3, "a"), (3, "c")]
    idf = math.log(1 + 1.5 / 2.5)
    assert got[2].score == round(2 * idf, 6)


def test_dense_ties_go_to_the_lesser_chunk(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 9)], "chunk_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "question_id bigint, vector array<double>")
    assert [r.chunk_id for r in retrieval.dense(v, q, 2).orderBy("rank").collect()] == [3, 5]
    assert retrieval.dense(v, q.filter("question_id > 1")).count() == 0


def test_hop_merge_keeps_first_scores(spark):
    got = retrieval.merge_hops(hits(spark, [("a", 1, 0.9), ("b", 2, 0.8)]), hits(spark, [("b", 1, 0.95), ("c", 2, 0.5)])).orderBy("merged_rank").collect()
    assert [(r.chunk_id, r.first_seen_hop) for r in got] == [("a", 1), ("b", 1), ("c", 2)]
    assert got[1].score == 0.8 and [(o.hop, o.rank) for o in got[1].occurrences] == [(1, 2), (2, 1)]
    assert retrieval.violations(hits(spark, [("a", 1, 1.0), ("a", 3, 2.0)]), 5).count() == 1


def test_ranking_metrics_by_hand(spark):
    got = evaluation.ranking_metrics(hits(spark, [("noise", 1, 4.0), ("a", 2, 3.0), ("other", 3, 2.0), ("b", 4, 1.0), ("a", 5, 0.5)]), spark.createDataFrame([(1, "a"), (1, "b")], "question_id bigint, chunk_id string"), 10).first()
    assert got.ndcg == round((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), 6)
    assert (got.recall, got.mrr, got.both_found, got.top1, got.any_missing) == (1.0, 0.5, 1.0, 0.0, 0.0)


def test_percentile_is_linear(spark):
    rows = spark.createDataFrame([("x", float(v)) for v in (40, 10, 30, 20)], "g string, v double")
    assert evaluation.percentiles(rows, ["g"], "v").first().p95 == 38.5


def test_answer_f1_is_a_multiset_overlap(spark):
    rows = spark.createDataFrame([(1, "London, England", "London"), (2, "", "the"), (3, "a b", "c"), (4, "x x", "x")], "k int, a string, g string")
    got = {r.k: (r.exact, r.f1) for r in evaluation.token_f1(rows, "k", "a", "g").collect()}
    assert got == {1: (0, 0.666667), 2: (1, 1.0), 3: (0, 0.0), 4: (0, 0.666667)}


def test_pages_have_one_row_more(spark):
    rows = spark.range(10).select(F.lit(1).alias("d"), "id")
    assert [r.id for r in evaluation.keyset_page(rows, "d", "id", (1, 3), 2).collect()] == [4, 5, 6]


QUESTION = "question_id int, normalized_question string, question_type string, expected_answer_type string, seeds array<string>, required array<string>"
UNIT = "question_id int, evidence_unit_id string, chunk_id string, doc_title string, sentence_id int, sentence_text string, resolved_text string, entities array<string>, relation_hints array<string>, answer_types array<string>, entity_overlap array<string>, retrieval_rank int, retrieval_score double"


@pytest.fixture(scope="module")
def film(spark):
    q = spark.createDataFrame([(1, "where was the director of glass harbour born?", "BRIDGE", "LOCATION", ["Glass Harbour"], ["directed", "born"])], QUESTION)
    u = spark.createDataFrame(
        [
            (1, "c1::s0", "c1", "Glass Harbour", 0, "Glass Harbour was directed by Marta Okonjo.", "Glass Harbour was directed by Marta Okonjo.", ["Glass Harbour", "Marta Okonjo"], ["directed"], ["PERSON"], ["Glass Harbour"], 1, None),
            (1, "c2::s0", "c2", "Marta Okonjo", 0, "Marta Okonjo was born in Lagos.", "Marta Okonjo was born in Lagos.", ["Marta Okonjo", "Lagos"], ["born"], ["LOCATION"], [], 2, None),
        ],
        UNIT,
    )
    return q, evidence.score_units(u, q)


def test_two_sentences_give_all_edge_kinds_and_the_bridge(spark, film):
    q, scored = film
    edges = evidence.graph_edges(scored, q)
    assert edges.select("edge_type").distinct().count() == 11
    assert edges.count() == edges.select("question_id", "edge_id").distinct().count()
    r = evidence.bridge_triples(edges).first()
    assert (r.seed, r.bridge, r.answer) == ("entity::glass_harbour", "entity::marta_okonjo", "entity::lagos")
    assert evidence.factoid_pairs(edges).count() == 1 and evidence.yes_no_pairs(edges).count() == 0
    best = evidence.search_paths(scored, edges, q.withColumn("targets", F.array().cast("array<string>"))).collect()
    assert [(r.path_rank, r.path_kind, r.answer_candidate, r.bridge_entity, r.evidence_unit_ids) for r in best] == [(1, "bridge_candidate", "Lagos", "Marta Okonjo", ["c1::s0", "c2::s0"])]
    u1, u2 = (r.final_score for r in scored.orderBy("chunk_id").collect())
    assert best[0].score == round((u1 + u2) / 2 + 0.25 + 0.20 + 0.10 + 0.20 + 0.15 + 0.05, 6)


def test_features_by_hand(film):
    r = film[1].filter("chunk_id = 'c1'").first()
    assert (r.entity_match, r.relation_match, r.answer_type_match, r.title_match, r.retrieval, r.bridge_entity) == (1.0, 0.5, 0.0, 1.0, 1.0, 1.0)
    assert r.noise_penalty == 0.0


def test_neighbours_stop_at_the_cap(spark):
    u = spark.createDataFrame([(1, f"c::s{k}", "c", "T", k, f"s{k}", f"s{k}", [], [], [], [], 1, None) for k in range(8)], UNIT)
    want = u.filter("sentence_id in (1, 3, 5)")
    got = evidence.band_neighbours(u, want)
    assert got.count() == 6 and {1, 3, 5} <= {r.sentence_id for r in got.collect()}
    text = evidence.render_context(u.filter("sentence_id < 2")).first()
    assert text.context_text == "[Title: T | Chunk: c | Sentence: 0]\ns0\n\n[Title: T | Chunk: c | Sentence: 1]\ns1"
    assert text.estimated_tokens == math.ceil(len(text.context_text) / 4)


def test_conflicting_deliveries_are_told_apart(spark):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "event_id int, event_type string")
    once, conflicts = events.deduplicate(events.content_hash(log, ["event_id", "event_type"]))
    assert [(r.event_id, r.deliveries) for r in once.collect()] == [(1, 2)] and [r.event_id for r in conflicts.collect()] == [2]


def test_life_cycle_states(spark):
    rows = [("a", 1, "start"), ("a", 2, "q"), ("a", 3, "finish"), ("b", 1, "start"), ("b", 2, "fail"), ("b", 3, "q"), ("c", 1, "q"), ("d", 1, "start")]
    got = {r.run: (r.state, r.out_of_order) for r in events.lifecycle(spark.createDataFrame(rows, "run string, sequence int, event_type string"), "run", "start", "finish", "fail").collect()}
    assert got == {"a": ("completed", False), "b": ("failed", True), "c": ("unregistered", False), "d": ("running", False)}


def test_source_records_are_judged(spark):
    schema = "question_id string, supporting_facts array<struct<title:string,idx:int>>, context array<struct<title:string,sentences:array<string>>>"
    rows = [("q0", [("A", 0)], [("A", ["x"]), ("B", ["y"])]), ("q1", [("A", 1)], [("A", ["x"])]), ("q2", [], [("A", ["x"]), ("A", ["y"])]), ("bad id", [], [("A", ["x"])]), ("q3", [], [("A", [])])]
    got = {r.question_id: r.is_valid for r in corpus.valid_source(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"q0": True, "q1": False, "q2": False, "bad id": False, "q3": False}
