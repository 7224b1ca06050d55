"""The evidence pipeline over small worlds whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks, diagnostics, evidence, next_hop, pipelines, units
from lodestone.operators import questions as Q

CHUNKS = [
    ("chunk:g", "Glass Harbour", "Glass Harbour was directed by Marta Okonjo."),
    ("chunk:m", "Marta Okonjo", "Marta Okonjo was born in Lagos."),
    ("chunk:t", "Tallinn", "Tallinn is the capital of Estonia."),
    ("chunk:x", "Moon", "The Moon is far away from here."),
]
ASKED = [
    (1, "What is the capital of Estonia?", ["chunk:t"], []),
    (2, "Where was the director of Glass Harbour born?", ["chunk:g"], ["chunk:m", "chunk:g"]),
    (3, "Is it?", [], []),
    (4, "Where was the director of Glass Harbour born?", ["chunk:g"], ["chunk:x"]),
]


@pytest.fixture(scope="module")
def world(spark):
    rows = spark.createDataFrame(CHUNKS, "chunk_id string, doc_title string, paragraph_text string").withColumn("sentences", F.lit(None).cast("array<struct<index:int,text:string>>"))
    asked = spark.createDataFrame([(i, t) for i, t, _, _ in ASKED], "question_id bigint, text string")
    return rows, asked


def retriever(spark):
    """First the hits of hop 1, for any other text of a question those of hop 2."""
    one = [(i, t, c, k + 1, 1.0 / (k + 1)) for i, t, first, _ in ASKED for k, c in enumerate(first)]
    two = [(i, c, k + 1, 1.0 / (k + 1)) for i, _, _, second in ASKED for k, c in enumerate(second)]
    first = spark.createDataFrame(one, "question_id bigint, text string, chunk_id string, rank int, score double")
    second = spark.createDataFrame(two, "question_id bigint, chunk_id string, rank int, score double")
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in ASKED], "question_id bigint, text string")

    def retrieve(q):
        other = q.join(texts, ["question_id", "text"], "left_anti").select("question_id")
        return q.join(first, ["question_id", "text"]).drop("text").unionByName(second.join(other, "question_id"))

    return retrieve


def test_one_hop_two_hops_and_none(spark, world):
    rows, asked = world
    got = {r.question_id: r for r in pipelines.evidence_run(asked, retriever(spark), rows).collect()}
    assert {k: r.state for k, r in got.items()} == {1: "sufficient_hop1", 2: "sufficient_hop2", 3: "insufficient_no_query", 4: "insufficient_after_hop2"}
    assert {k: r.n_retrievals for k, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert got[1].context_text == "[Title: Tallinn | Chunk: chunk:t | Sentence: 0]\nTallinn is the capital of Estonia." and got[1].query is None
    assert got[2].query.startswith("Glass Harbour") and got[2].answer == "Lagos" and got[2].selected_ids == ["chunk:g::s0", "chunk:m::s0"]
    assert got[3].context_text == "" and "away" not in got[4].context_text.replace("far away", "") and got[4].answer == ""


def test_baselines(spark, world):
    rows, asked = world
    fixed = {r.question_id: r for r in pipelines.baseline_run(asked, retriever(spark), rows).collect()}
    assert fixed[1].context_text == "[Document 1]\nTitle: Tallinn\nText: Tallinn is the capital of Estonia." and fixed[3].context_text == ""
    control = lambda seen: seen.select("question_id", F.when(F.col("question_id") == 2, F.lit("Marta Okonjo")).alias("query"))
    adaptive = {r.question_id: r for r in pipelines.adaptive_run(asked, retriever(spark), rows, control).collect()}
    assert adaptive[2].n_retrievals == 2 and adaptive[2].context_text.count("[Document") == 2 and adaptive[1].n_retrievals == 1


def test_unknown_chunks_are_errors(spark, world):
    rows, _ = world
    hits = spark.createDataFrame([(1, "chunk:none", 1, 1.0)], "question_id bigint, chunk_id string, rank int, score double")
    with pytest.raises(Exception, match="unknown chunk"):
        pipelines.resolved(hits, rows).collect()


@pytest.fixture(scope="module")
def found(spark, world, tmp_path_factory):
    rows, asked = world
    analysis = Q.analyze(asked)
    hits = spark.createDataFrame([(2, "chunk:g", 1, 1.0), (2, "chunk:m", 2, 0.5)], "question_id bigint, chunk_id string, rank int, score double")
    folder = str(tmp_path_factory.mktemp("tables"))

    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    analysis = keep(analysis.filter("question_id = 2"), "analysis")
    retrieved = keep(pipelines.resolved(hits, rows), "retrieved")
    return retrieved, analysis, pipelines.run_pass(retrieved, analysis, keep)


def test_paragraphs_ground_relations_and_bridges(found):
    retrieved, analysis, _ = found
    got = {r.chunk_id: r for r in chunks.analyze(retrieved, analysis).collect()}
    g = got["chunk:g"]
    assert [e.text for e in g.entities] == ["Glass Harbour", "Marta Okonjo"] and g.is_title_match and g.question_entity_overlap == ["Glass Harbour"]
    assert [(h.relation, h.subject_entity, h.object_entity, h.grounding_type) for h in g.relation_hints] == [("directed", "Marta Okonjo", "Glass Harbour", "entity_pair")]
    assert g.potential_bridges == ["Marta Okonjo"]
    (d,) = [x for x in g.bridge_decisions if x.accepted]
    assert (d.relation, d.relation_basis, d.linked_chunk_ids, d.link_basis, d.matches_question_relation) == ("directed", "entity_pair", ["chunk:m"], "title", True)
    assert {x.reason for x in got["chunk:m"].bridge_decisions} == {"document_title", "not_seed_side"}
    assert chunks.broken_spans(chunks.analyze(retrieved, analysis)).count() == 0
    assert chunks.pairing_failures(chunks.analyze(retrieved, analysis), retrieved).count() == 0
    alone = chunks.analyze(retrieved, analysis, linked=False).filter("chunk_id = 'chunk:g'").first()
    assert [x.reason for x in alone.bridge_decisions] == ["document_title", "no_context"]


def test_a_pass_is_sufficient_and_explains_itself(found):
    p = found[2]
    d = p.decisions.first()
    assert d.sufficient and d.reason_code == "sufficient_bridge" and d.answer_candidate == "Lagos" and d.missing_evidence is None
    assert [t.rule_code for t in d.rule_trace][:3] == ["path_available", "seed_connection", "evidence_units"] and all(t.passed for t in d.rule_trace)
    assert p.queries().first().query is None
    assert p.edges.select("edge_type").distinct().count() == 11
    nodes = {r.node_id: r for r in evidence.graph_nodes(p.edges).collect()}
    assert nodes["entity::glass_harbour"].is_seed and nodes["entity::lagos"].label == "Lagos"
    none = next_hop.propose_plain(p.decisions, pipelines.asked(p.analysis), p.paths).first()
    assert none.query is None and none.reason_code == "sufficient_decision"
    open_ = next_hop.propose_plain(p.decisions.withColumn("sufficient", F.lit(False)), pipelines.asked(p.analysis), p.paths).first()
    assert (open_.query, open_.query_type, open_.confidence) == ("Marta Okonjo directed", "bridge_entity_relation", 0.65)
    counts = {(r.name, r.value): r.n for r in diagnostics.decision_diagnostics(p.decisions).collect()}
    assert counts[("reason", "sufficient_bridge")] == 1


def test_sentences_and_pronouns(spark):
    text = 'Dr. Abe met J. Roe. "It rained." She left... Then they went! ok'
    row = spark.createDataFrame([(text,)], "t string").select(chunks.segmented(F.col("t")).alias("s")).first().s
    assert [x.text for x in row] == ["Dr. Abe met J. Roe.", '"It rained."', "She left... Then they went! ok"]
    assert all(text[x.start : x.end] == x.text for x in row)
    cases = [
        ("It is tall.", "Tower", None, "Tower is tall.", "title_pronoun"),
        ("Its roof fell.", "Tower", "Paul came.", "Its roof fell.", "ambiguous_context"),
        ("Its roof fell.", "Tower", "The Tower was old and Paul came.", "Tower's roof fell.", "title_pronoun"),
        ("Later, she won.", "Ana Lim", "nothing here", "Later, Ana Lim won.", "title_pronoun"),
        ("Rain fell.", "Tower", None, "Rain fell.", "unchanged"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "s string, t string, p string")
    got = [r.r for r in rows.select(units.resolve_v2(F.col("s"), F.col("t"), F.col("p")).alias("r")).collect()]
    assert [(r.text, r.method) for r in got] == [c[3:] for c in cases]


def test_literal_names(spark):
    cases = [("He saw York Minster there.", "York Minster", True), ("In New York City it rained.", "York City", False), ("President Ana Lim spoke", "Ana Lim", True), ("Old Ana Lim spoke", "Ana Lim", False), ("York", "York", False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "s string, n string")
    assert [r[0] for r in rows.select(units.names_seed(F.col("s"), F.col("n"))).collect()] == [c[2] for c in cases]


def test_pruning_keeps_order_and_cap(spark):
    rows = [(1, f"c::s{k}", "c", "T", k, f"s{k}", f"s{k}", 1) for k in range(8)]
    scored = spark.createDataFrame(rows, "question_id int, evidence_unit_id string, chunk_id string, doc_title string, sentence_id int, sentence_text string, resolved_text string, retrieval_rank int")
    picks = [(1, "BRIDGE", True, ["c::s1", "c::s3", "c::s5"])]
    got = evidence.prune(scored, spark.createDataFrame(picks, "question_id int, question_type string, sufficient boolean, selected_ids array<string>")).first()
    assert got.selected_ids == [f"c::s{k}" for k in range(6)] and got.removed_ids == ["c::s6", "c::s7"] and got.strategy == "sufficient_bridge_neighbor_sentence_pruning"
    empty = evidence.prune(scored, spark.createDataFrame([(2, "FACTOID", False, ["x"])], "question_id int, question_type string, sufficient boolean, selected_ids array<string>")).first()
    assert (empty.context_text, empty.estimated_tokens, empty.strategy, empty.missing_ids) == ("", 0, "empty_evidence_pruning", ["x"])


def test_first_version_rules(spark, world):
    rows, asked = world
    r = pipelines.resolved(spark.createDataFrame([(1, "chunk:t", 1, 1.0)], "question_id bigint, chunk_id string, rank int, score double"), rows)
    q = Q.analyze(asked)
    got = chunks.analyze_v1(r, q).first()
    assert got.is_title_match is False and got.question_entity_overlap == ["Estonia"] and [d.reason for d in got.bridge_decisions] == ["document_title", "question_entity"]
    unit = units.extract_v1(r, q).first()
    assert unit.entities == ["Tallinn", "Estonia"] and unit.relation_hints == ["capital"] and unit.answer_types == ["LOCATION", "ENTITY"] and unit.sentence_source == "paragraph_fallback"


def test_any_shape_of_retrieved_row(spark):
    rows = spark.sql("SELECT 1 AS question_id, named_struct('id', 'a', 'title', 'T', 'text', 'x y', 'sentences', array('x ', 'y')) AS chunk, 3 AS rank, 0.5D AS score")
    got = chunks.adapt(rows).first()
    assert (got.chunk_id, got.doc_title, got.paragraph_text, got.retrieval_rank) == ("a", "T", "x y", 3) and [s.text for s in got.sentences] == ["x ", "y"]
    assert chunks.broken_chunks(chunks.adapt(rows)).count() == 0
