"""Queries of the evidence pipeline over the driver's tables: items ask, documents answer.

SQL can't express their rules; tests compare them with fixtures worked out by
hand and check their contracts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunks, diagnostics, evidence, next_hop, pipelines, retrieval, sufficiency, units
from lodestone.operators import questions as analysis
from lodestone.plans import register
from lodestone.plans.register import query, table
from lodestone.sources import records
from lodestone.sources.tables import Scratch

#: Paragraphs that a question retrieves here.
DEPTH = 5


def _chunks(spark, sf_dir):
    """Documents as paragraphs whose title is their first word of three letters or more with a capital, if they begin with one."""
    title = F.regexp_extract("text", r"^\s*([A-Z][a-z]{2,})", 1)
    none = F.lit(None).cast("array<struct<index:int,text:string>>")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), title.alias("doc_title"), F.col("text").alias("paragraph_text"), none.alias("sentences"))


def _retrieve(spark, sf_dir, depth=DEPTH):
    texts = register.paragraphs(spark, sf_dir)
    return lambda asked: retrieval.bm25(texts, asked, depth)


#: Passes that this application has run, by its id and the tables; each is written once and read by all queries.
_PASSES: dict = {}


def _once(spark, sf_dir, name, make):
    """Result of ``make(keep)``, made again only if its tables are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    found = _PASSES.get(key)
    if found is None or not all(records.exists(spark, p) for p in found[0].paths):
        scratch = Scratch(spark)
        found = _PASSES[key] = (scratch, make(scratch.keep))
    return found[1]


def _retrieved(spark, sf_dir):
    def make(keep):
        asked = keep(analysis.analyze(register.questions(spark, sf_dir)), "analysis")
        hits = _retrieve(spark, sf_dir)(register.questions(spark, sf_dir))
        return keep(pipelines.resolved(hits, _chunks(spark, sf_dir)), "retrieved"), asked

    return _once(spark, sf_dir, "retrieved", make)


def _pass(spark, sf_dir):
    return _once(spark, sf_dir, "pass", lambda keep: pipelines.run_pass(*_retrieved(spark, sf_dir), keep))


@query()
def question_analysis(spark, sf_dir):
    return analysis.analyze(register.questions(spark, sf_dir))


@query()
def comparison_targets(spark, sf_dir):
    """Pairs of neighbouring words of each item, asked as a comparison."""
    words = F.split("text", " ")
    text = F.concat(F.lit("Which is older, "), F.initcap(F.get(words, F.lit(0))), F.lit(" or "), F.initcap(F.get(words, F.lit(1))), F.lit("?"))
    asked = analysis.analyze(register.questions(spark, sf_dir).select("question_id", text.alias("text")))
    return asked.select("question_id", "question_type", F.col("comparison_targets.text").alias("targets"))


@query()
def chunk_analysis(spark, sf_dir):
    rows = chunks.analyze(*_retrieved(spark, sf_dir))
    return rows.select("question_id", "chunk_id", F.size("entities").alias("n_entities"), F.size("relation_hints").alias("n_relations"), F.size("answers").alias("n_answers"), "potential_bridges", "question_entity_overlap", "question_token_overlap_score", "is_title_match")


@query()
def chunk_analysis_v1(spark, sf_dir):
    rows = chunks.analyze_v1(*_retrieved(spark, sf_dir))
    return rows.select("question_id", "chunk_id", F.size("entities").alias("n_entities"), F.size("relation_hints").alias("n_relations"), F.size("answers").alias("n_answers"), "question_entity_overlap", "question_token_overlap_score", "is_title_match")


@query()
def sentence_units(spark, sf_dir):
    return _pass(spark, sf_dir).units


@query()
def sentence_units_v1(spark, sf_dir):
    return units.extract_v1(*_retrieved(spark, sf_dir))


@query()
def evidence_graph(spark, sf_dir):
    return _pass(spark, sf_dir).edges.select("question_id", "edge_id", "source_id", "target_id", "edge_type", "weight", "evidence_unit_id", "relation")


@query()
def graph_nodes(spark, sf_dir):
    return evidence.graph_nodes(_pass(spark, sf_dir).edges)


@query()
def ranked_paths(spark, sf_dir):
    return _pass(spark, sf_dir).paths.select("question_id", "path_id", "path_kind", "answer_candidate", "bridge_entity", "score", "path_rank")


@query()
def sufficiency_decisions(spark, sf_dir):
    rows = _pass(spark, sf_dir).decisions
    return rows.select("question_id", "question_type", "sufficient", "confidence", "best_path_id", "answer_candidate", "missing_evidence", "reason_code", "n_paths")


@query()
def prune_context(spark, sf_dir):
    return _pass(spark, sf_dir).contexts.select("question_id", "context_text", "estimated_tokens", "strategy", "n_neighbours")


@query()
def next_hop_query(spark, sf_dir):
    return _pass(spark, sf_dir).queries()


@query()
def next_hop_plain(spark, sf_dir):
    p = _pass(spark, sf_dir)
    return next_hop.propose_plain(p.decisions, pipelines.asked(p.analysis), p.paths)


@query()
def evidence_run(spark, sf_dir):
    rows = pipelines.evidence_run(register.questions(spark, sf_dir), _retrieve(spark, sf_dir), _chunks(spark, sf_dir))
    return rows.select("question_id", "state", "n_retrievals", "query", "estimated_tokens", "answer", "reason_code", "confidence")


@query()
def baseline_run(spark, sf_dir):
    rows = pipelines.baseline_run(register.questions(spark, sf_dir), _retrieve(spark, sf_dir), _chunks(spark, sf_dir), DEPTH)
    return rows.select("question_id", "estimated_tokens", "n_retrievals", F.sha2("context_text", 256).alias("context_sha256"))


@query()
def component_diagnostics(spark, sf_dir):
    p = _pass(spark, sf_dir)
    parts = [diagnostics.question_diagnostics(p.analysis), diagnostics.unit_diagnostics(p.units), diagnostics.score_diagnostics(p.scored), diagnostics.graph_diagnostics(p.edges), diagnostics.path_diagnostics(p.paths), diagnostics.decision_diagnostics(p.decisions), diagnostics.pruning_diagnostics(p.contexts), diagnostics.next_hop_diagnostics(p.queries())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query()
def broken_contracts(spark, sf_dir):
    """Rows that break the contract of their component; there should be none."""
    retrieved, asked = _retrieved(spark, sf_dir)
    spans = chunks.broken_spans(chunks.analyze(retrieved, asked)).select(F.lit("span").alias("kind"), "question_id")
    guards = sufficiency.judged(_pass(spark, sf_dir).paths, pipelines.asked(asked)).filter("size(evidence_unit_ids) = 0").select(F.lit("path").alias("kind"), "question_id")
    return spans.unionByName(guards)
