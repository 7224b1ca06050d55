"""Question answering end to end, for all questions at once: fixed, adaptive and evidence-driven.

A retriever is a function from ``(question_id, text)`` rows to ranked hits
``(question_id, chunk_id, rank, score)``; chunks are ``(chunk_id, doc_title,
paragraph_text, sentences)``.  The second hop is the same plan over the
questions that need it.  Answers come from a function of contexts; without
one, the answer is the best path's candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks as C
from lodestone.operators import evidence, next_hop, retrieval, sufficiency, systems, units
from lodestone.operators import questions as Q
from lodestone.sources.tables import Keep, Scratch

Retriever = Callable[[DataFrame], DataFrame]
Answerer = Callable[[DataFrame], DataFrame]


def asked(analysis: DataFrame) -> DataFrame:
    """Questions as the evidence operators want them: texts of seeds and targets, names of relations."""
    return analysis.select(
        "question_id", "raw_question", "normalized_question", "question_type", "expected_answer_type",
        F.col("seed_entities.text").alias("seeds"), F.col("relation_hints.relation").alias("required"), F.col("comparison_targets.text").alias("targets"),
    )


def resolved(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the paragraphs they name; a hit whose paragraph does not exist is an error."""
    rows = hits.join(chunks.withColumn("_known", F.lit(True)), "chunk_id", "left")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id").cast("string")))).otherwise(F.col("rank"))
    return rows.select("question_id", "chunk_id", "doc_title", "paragraph_text", "sentences", known.cast("int").alias("retrieval_rank"), F.col("score").alias("retrieval_score"))


@dataclass
class Pass:
    """What one pass of the evidence components found, table by table."""

    retrieved: DataFrame
    analysis: DataFrame
    units: DataFrame
    scored: DataFrame
    edges: DataFrame
    paths: DataFrame
    decisions: DataFrame
    contexts: DataFrame

    def queries(self) -> DataFrame:
        """The follow-up query that each insufficient question proposes."""
        rows = self.decisions.join(asked(self.analysis).select("question_id", "expected_answer_type", "seeds", "required", "targets"), "question_id")
        return next_hop.propose(rows.withColumn("has_path", F.col("best_path_id").isNotNull()))


def run_pass(retrieved: DataFrame, analysis: DataFrame, keep: Keep, version: int = 2) -> Pass:
    """Units, scores, graph, paths, decisions and contexts of the retrieved paragraphs.

    Units, edges and paths are written once, as several later steps read
    them.  Questions without retrieved paragraphs get a decision and an empty
    context too.
    """
    q = asked(analysis)
    extract = units.extract if version == 2 else units.extract_v1
    scored = keep(evidence.score_units(extract(retrieved, analysis), q), "units")
    edges = keep(evidence.graph_edges(scored, q), "edges")
    paths = keep(evidence.search_paths(scored, edges, q), "paths")
    decisions = keep(sufficiency.decide(paths, q), "decisions")
    return Pass(retrieved, analysis, scored.select(*units.UNIT), scored, edges, paths, decisions, evidence.prune(scored, decisions))


def candidate_answers(contexts: DataFrame) -> DataFrame:
    """Offline answers: the candidate of the best path, or nothing."""
    return contexts.select("question_id", F.coalesce("answer_candidate", F.lit("")).alias("answer"))


def evidence_run(questions: DataFrame, retrieve: Retriever, chunks: DataFrame, answer: Answerer = candidate_answers, keep: Keep | None = None) -> DataFrame:
    """One row per question: state, hops, the follow-up query, the pruned context and the answer.

    Hop 1 and a pass for all; for those that are insufficient and propose a
    query, hop 2, the merged paragraphs and a second pass with the original
    question.  The pruned context of the last pass is kept even where it does
    not suffice.
    """
    keep = keep or Scratch(questions.sparkSession).keep
    analysis = keep(Q.analyze(questions), "analysis")
    first_hits = keep(retrieve(questions.select("question_id", "text")).select("question_id", "chunk_id", "rank", "score"), "hop1")
    one = run_pass(keep(resolved(first_hits, chunks), "retrieved"), analysis, keep)
    queries = keep(one.queries().filter("query is not null"), "queries")
    second_hits = retrieve(queries.select("question_id", F.col("query").alias("text"))).select("question_id", "chunk_id", "rank", "score")
    again = queries.select("question_id")
    merged = retrieval.merge_hops(first_hits.join(again, "question_id", "left_semi"), second_hits)
    merged = merged.select("question_id", "chunk_id", F.col("merged_rank").alias("rank"), "score", "first_seen_hop")
    merged = keep(merged, "merged")
    two = run_pass(keep(resolved(merged, chunks), "retrieved2"), analysis.join(again, "question_id", "left_semi"), keep)
    side = lambda p, n: p.decisions.select("question_id", F.col("sufficient").alias(f"sufficient{n}"), F.col("answer_candidate").alias(f"candidate{n}"), F.col("reason_code").alias(f"reason{n}"), F.col("confidence").alias(f"confidence{n}")).join(
        p.contexts.select("question_id", F.col("context_text").alias(f"context{n}"), F.col("estimated_tokens").alias(f"tokens{n}"), F.col("selected_ids").alias(f"ids{n}")), "question_id"
    )
    rows = questions.select("question_id").join(side(one, 1), "question_id").join(side(two, 2), "question_id", "left").join(queries.select("question_id", "query"), "question_id", "left")
    hop2 = F.col("sufficient2").isNotNull()
    last = lambda c: F.when(hop2, F.col(c + "2")).otherwise(F.col(c + "1"))
    state = systems.terminal_state(F.col("sufficient1"), F.coalesce("sufficient2", F.lit(False)), F.col("query").isNotNull())
    rows = rows.select(
        "question_id", state.alias("state"), F.when(hop2, 2).otherwise(1).alias("n_retrievals"), "query", last("context").alias("context_text"), last("tokens").cast("bigint").alias("estimated_tokens"),
        last("ids").alias("selected_ids"), last("candidate").alias("answer_candidate"), last("reason").alias("reason_code"), last("confidence").alias("confidence"),
    )
    return rows.join(answer(rows), "question_id", "left")


def baseline_run(questions: DataFrame, retrieve: Retriever, chunks: DataFrame, depth: int = 10, answer: Answerer | None = None) -> DataFrame:
    """The fixed baseline: whole paragraphs of one retrieval as context; questions without hits get an empty one."""
    hits = retrieve(questions.select("question_id", "text"))
    return _with_context(questions, hits, chunks, depth, answer).withColumn("n_retrievals", F.lit(1))


def adaptive_run(questions: DataFrame, retrieve: Retriever, chunks: DataFrame, controller: Callable[[DataFrame], DataFrame], depth: int = 10, answer: Answerer | None = None, keep: Keep | None = None) -> DataFrame:
    """The adaptive baseline: a controller sees question and context and may ask for one more retrieval.

    ``controller``: ``(question_id, text, context_text)`` to ``(question_id,
    query)``; a null or blank query ends the run.
    """
    keep = keep or Scratch(questions.sparkSession).keep
    first = keep(retrieve(questions.select("question_id", "text")).select("question_id", "chunk_id", "rank", "score"), "hop1")
    seen = _with_context(questions, first, chunks, depth, None).join(questions.select("question_id", "text"), "question_id")
    wanted = keep(controller(seen.select("question_id", "text", "context_text")).filter(F.trim(F.coalesce("query", F.lit(""))) != ""), "controls")
    second = retrieve(wanted.select("question_id", F.col("query").alias("text"))).select("question_id", "chunk_id", "rank", "score")
    merged = retrieval.merge_hops(first, second).select("question_id", "chunk_id", F.col("merged_rank").alias("rank"), "score")
    rows = _with_context(questions, merged, chunks, None, answer).join(wanted.select("question_id", F.col("query").alias("hop2_query")), "question_id", "left")
    return rows.withColumn("n_retrievals", F.when(F.col("hop2_query").isNull(), 1).otherwise(2))


def _with_context(questions: DataFrame, hits: DataFrame, chunks: DataFrame, depth: int | None, answer: Answerer | None) -> DataFrame:
    whole = chunks.select("chunk_id", F.col("doc_title").alias("title"), F.col("paragraph_text").alias("text"))
    context = systems.full_context(hits, whole, depth if depth is not None else 1_000_000)
    rows = questions.select("question_id").join(context, "question_id", "left").select("question_id", F.coalesce("context_text", F.lit("")).alias("context_text"), F.coalesce("estimated_tokens", F.lit(0)).cast("bigint").alias("estimated_tokens"))
    return rows.join(answer(rows), "question_id", "left") if answer else rows


def prompt(question, context):
    """What an answering model is shown."""
    return F.concat(F.lit("Original question:\n"), question, F.lit("\n\nRetrieved context:\n"), context)


def describe_evidence(retrieved: DataFrame, analysis: DataFrame) -> DataFrame:
    """Paragraph-level evidence (names, grounded relations, bridges) of the retrieved paragraphs."""
    return C.analyze(retrieved, analysis)


def search_text(chunks: DataFrame) -> DataFrame:
    """Chunks as the lexical index wants them: title and paragraph in one text."""
    return chunks.select("chunk_id", T.search_text(F.col("doc_title"), F.col("paragraph_text")).alias("text"))
