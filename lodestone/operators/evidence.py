"""Evidence units: scoring, graph, path search and context pruning as relational plans.

``questions``: question_id, normalized_question, question_type,
expected_answer_type, seeds[], required[], targets[].  ``units``:
question_id, evidence_unit_id, chunk_id, doc_title, sentence_id,
sentence_text, resolved_text, entities[], relation_hints[],
answer_types[], entity_overlap[], retrieval_rank, retrieval_score.
Every plan is keyed by question; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Words that carry no content.
STOPWORDS = (
    "a an and are as at be by did do does for from had has have how in into is it its of on or "
    "that the their then there this to was were what when where which who whom whose why with"
).split()
#: Weights of the features, penalties and their cap.
FEATURE_WEIGHTS = {
    "entity_match": 0.25,
    "relation_match": 0.20,
    "answer_type_match": 0.15,
    "token_overlap": 0.15,
    "title_match": 0.10,
    "retrieval": 0.05,
    "bridge_entity": 0.10,
}
SHORT, LONG, BARE, CAP = 0.20, 0.10, 0.15, 0.35
#: Labels that name an answer type.
GENERIC = ("person", "location", "date", "number", "boolean", "entity", "organization", "title or work", "unknown")
ANCHOR_WEIGHT, MAX_PATHS, CONTEXT_CAP = 0.1, 10, 6


def _set(values: Column, case=T.fold) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(case(x))), lambda x: x != ""))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(T.fold(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def _rounded(value: Column) -> Column:
    """To six places; a half is told by the value times a million, as SQL engines do, not by its shortest decimals."""
    return F.round(value * 1e6) / 1e6


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(F.lit(0.0))


def score_units(units: DataFrame, questions: DataFrame, case=T.fold) -> DataFrame:
    """Units with eight features and ``final_score``; one equi-join by question, then columns only.

    ``case`` brings names, titles and the texts they are looked for in to one
    case; words are always folded.
    """
    rows = units.join(questions.select("question_id", "normalized_question", "expected_answer_type", "seeds", "required"), "question_id")
    rows = rows.select(
        "*",
        _set(F.col("seeds"), case).alias("_seeds"), _set(F.col("entities"), case).alias("_own"), _set(F.col("required")).alias("_need"), _set(F.col("relation_hints")).alias("_has"),
        content_words(F.col("resolved_text")).alias("_words"), content_words(F.col("normalized_question")).alias("_asked"), F.trim(case(F.col("doc_title"))).alias("_title"), case(F.col("resolved_text")).alias("_text"),
    )
    matched = F.size(F.filter("_seeds", lambda s: F.array_contains(F.col("_own"), s) | F.contains(F.col("_text"), s)))
    expected, types = F.col("expected_answer_type"), F.col("answer_types")
    answer = F.when(expected == "UNKNOWN", 0.0).when(F.array_contains(types, expected), 1.0).when((expected == "ENTITY") & (F.size(types) > 0), 0.6).otherwise(0.0)
    named = F.col("_title") != ""
    title = F.when(named & F.array_contains("_seeds", F.col("_title")), 1.0).when(named & F.contains(case(F.col("normalized_question")), F.col("_title")), 0.8).otherwise(0.0)
    retrieval = F.when(F.col("retrieval_rank").isNotNull(), F.least(F.lit(1.0), 1 / F.col("retrieval_rank"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("retrieval_score", F.lit(0.0)))))
    others = F.size(F.array_except(F.array_except("_own", "_seeds"), F.array("_title")))
    bridge = F.when((others > 0) & (F.size("_has") > 0), 1.0).when(others > 0, 0.5).otherwise(0.0)
    penalty = F.when(F.size("_words") < 4, SHORT).otherwise(0.0) + F.when(F.size("_words") > 60, LONG).otherwise(0.0) + F.when((F.size("_own") == 0) & (F.size("_has") == 0), BARE).otherwise(0.0)
    features = {
        "entity_match": _share(matched, F.size("seeds")),
        "relation_match": _share(F.size(F.array_intersect("_need", "_has")), F.size("_need")),
        "answer_type_match": answer,
        "token_overlap": _share(F.size(F.array_intersect("_asked", "_words")), F.size("_asked")),
        "title_match": title,
        "retrieval": retrieval,
        "bridge_entity": bridge,
    }
    scored = rows.select(*units.columns, *[_rounded(c).alias(name) for name, c in features.items()], _rounded(F.least(F.lit(CAP), penalty)).alias("noise_penalty"))
    total = sum((F.lit(w) * F.col(name) for name, w in FEATURE_WEIGHTS.items()), F.lit(0.0)) - F.col("noise_penalty")
    return scored.withColumn("final_score", _rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))))


def _first_by_key(values: Column) -> Column:
    """Values in order, without those whose graph key came before."""
    keys = F.transform(values, T.graph_key)
    return F.filter(values, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def _related(value: Column, others: Column, key) -> Column:
    """Whether a label equals, holds or is held by one of others, by ``key``."""
    return F.exists(others, lambda o: F.contains(key(o), key(value)) | F.contains(key(value), key(o)))


EDGE = "array<struct<edge_type:string,source_id:string,target_id:string,source_label:string,target_label:string,weight:double,relation:string>>"


def graph_edges(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """All edges of each question's graph: ``question_id, edge_id, source_id, target_id, edge_type, weight, evidence_unit_id, relation`` and labels.

    Each unit gives an array of all its edges of the eleven kinds, so units
    are read and scored once.  One edge id keeps its greatest weight; of equal
    weights the relation that sorts first.
    """
    spaced = lambda c: F.replace(T.graph_key(c), F.lit("_"), F.lit(" "))
    ent = lambda c: T.node_id("entity", c)
    q = questions.select("question_id", "expected_answer_type", _first_by_key(F.col("seeds")).alias("seeds"))
    u = scored.join(q, "question_id").select(
        "question_id", "evidence_unit_id", "chunk_id", F.coalesce("doc_title", F.lit("")).alias("doc_title"), "final_score", "expected_answer_type", "entity_overlap", "resolved_text", "retrieval_rank", "sentence_id",
        T.sentence_node(F.col("evidence_unit_id")).alias("sid"), F.greatest("final_score", F.lit(ANCHOR_WEIGHT)).alias("anchor"), "seeds", F.transform("seeds", T.graph_key).alias("seed_keys"),
        F.transform(_first_by_key(F.col("entities")), lambda e: F.struct(e.alias("label"), T.graph_key(e).alias("key"), ent(e).alias("node"))).alias("ents"), _first_by_key(F.col("relation_hints")).alias("rels"), _first_by_key(F.col("answer_types")).alias("types"),
    )
    text = F.concat(F.lit(" "), spaced(F.col("resolved_text")), F.lit(" "))
    own_keys = F.concat(F.col("ents.key"), F.transform(F.concat("entity_overlap", F.array("doc_title")), T.graph_key))
    u = u.withColumn("own_keys", own_keys).withColumn("spaced", text)
    hit = F.filter("seeds", lambda s: F.array_contains("own_keys", T.graph_key(s)) | F.contains(F.col("spaced"), F.concat(F.lit(" "), spaced(s), F.lit(" "))))
    u = u.withColumn("hit", F.transform(hit, lambda s: F.struct(s.alias("label"), ent(s).alias("node"))))
    none = F.lit(None).cast("string")
    sid, sentence = F.col("sid"), F.col("evidence_unit_id")

    def edge(kind: str, source: Column, target: Column, a: Column, b: Column, weight: str, relation: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("edge_type"), source.alias("source_id"), target.alias("target_id"), a.alias("source_label"), b.alias("target_label"), F.col(weight).alias("weight"), relation.alias("relation"))

    title = F.col("doc_title")
    titled = F.array(
        edge("title_to_entity", T.node_id("title", title), ent(title), title, title, "anchor"),
        edge("sentence_in_document_about_entity", sid, ent(title), sentence, title, "anchor"),
    )
    plain = F.array(
        edge("chunk_to_sentence", T.node_id("chunk", F.col("chunk_id").cast("string")), sid, F.col("chunk_id").cast("string"), sentence, "final_score"),
        edge("title_to_sentence", T.node_id("title", title), sid, title, sentence, "final_score"),
    )
    expected = F.exists("types", lambda t: T.graph_key(t) == T.graph_key(F.col("expected_answer_type")))
    pairs = F.flatten(F.transform("ents", lambda e: F.transform(F.filter("ents", lambda f: e["node"] < f["node"]), lambda f: edge("entity_cooccurs_with_entity", e["node"], f["node"], e["label"], f["label"], "final_score"))))
    bridges = F.flatten(F.transform("hit", lambda s: F.transform(F.filter("ents", lambda e: e["node"] != s["node"]), lambda e: edge("possible_bridge", s["node"], e["node"], s["label"], e["label"], "final_score"))))
    answers = F.when(expected, F.filter("ents", lambda e: ~F.array_contains("seed_keys", e["key"]))).otherwise(F.filter("ents", lambda e: F.lit(False)))
    parts = [
        plain,
        F.when(title != "", titled).otherwise(F.array()),
        F.transform("ents", lambda e: edge("sentence_mentions_entity", sid, e["node"], sentence, e["label"], "final_score")),
        F.transform("rels", lambda r: edge("sentence_has_relation", sid, T.node_id("relation", r), sentence, r, "final_score", r)),
        F.transform("types", lambda t: edge("sentence_has_answer_type", sid, T.node_id("answer_type", t), sentence, t, "final_score")),
        pairs,
        F.transform("hit", lambda s: edge("seed_entity_to_sentence", s["node"], sid, s["label"], sentence, "anchor")),
        bridges,
        F.transform(answers, lambda e: edge("possible_answer_candidate", sid, e["node"], sentence, e["label"], "final_score")),
    ]
    every = u.select("question_id", "evidence_unit_id", F.coalesce("retrieval_rank", F.lit(1_000_000_000)).alias("rank"), "sentence_id", F.explode(F.concat(*[x.cast(EDGE) for x in parts])).alias("x"))
    every = every.select("question_id", "evidence_unit_id", "rank", "sentence_id", "x.*")
    named = every.withColumn("edge_id", T.edge_id(F.col("edge_type"), F.col("source_id"), F.col("target_id"), F.col("evidence_unit_id"), F.col("relation")))
    kept = F.max_by(F.struct("source_id", "target_id", "edge_type", "weight", "evidence_unit_id", "relation", "source_label", "target_label", "rank", "sentence_id"), F.struct("weight", -F.col("rank"), F.reverse(F.coalesce("relation", F.lit("")))))
    return named.groupBy("question_id", "edge_id").agg(kept.alias("x")).select("question_id", "edge_id", "x.*")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """``question_id, node_id, node_type, label, labels, is_seed``; the label that came first by retrieval rank and sentence counts."""
    where = F.struct("rank", "evidence_unit_id", "sentence_id", "edge_type")
    ends = [edges.select("question_id", F.col(f"{x}_id").alias("node_id"), F.col(f"{x}_label").alias("label"), where.alias("where"), (F.lit(x == "source") & (F.col("edge_type") == "seed_entity_to_sentence")).alias("seed")) for x in ("source", "target")]
    rows = ends[0].unionByName(ends[1]).groupBy("question_id", "node_id").agg(F.min_by("label", F.struct("where", "label")).alias("label"), F.array_sort(F.collect_set("label")).alias("labels"), F.bool_or("seed").alias("is_seed"))
    return rows.select("question_id", "node_id", F.substring_index("node_id", "::", 1).alias("node_type"), "label", "labels", "is_seed")


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_type = 'seed_entity_to_sentence'").select("question_id", F.col("source_id").alias("seed"), F.col("target_id").alias("s1"), F.col("edge_id").alias("seed_edge"))


def _mentions(edges: DataFrame, s: str, e: str, edge: str) -> DataFrame:
    return edges.filter("edge_type = 'sentence_mentions_entity'").select("question_id", F.col("source_id").alias(s), F.col("target_id").alias(e), F.col("edge_id").alias(edge))


def _free(edges: DataFrame, s: str, e: str, edge: str) -> DataFrame:
    """Mentions of entities that are no seeds."""
    known = _seeds(edges).select("question_id", F.col("seed").alias(e)).distinct()
    return _mentions(edges, s, e, edge).join(known, ["question_id", e], "left_anti")


def _bridges(edges: DataFrame) -> DataFrame:
    first = _seeds(edges).join(_free(edges, "s1", "bridge", "e1"), ["question_id", "s1"])
    second = first.join(_free(edges, "s2", "bridge", "e2"), ["question_id", "bridge"]).filter("s1 <> s2")
    return second.join(_free(edges, "s2", "answer", "e3"), ["question_id", "s2"]).filter("answer <> bridge")


def bridge_triples(edges: DataFrame) -> DataFrame:
    """seed → sentence → bridge → other sentence → answer, by equi-joins of mention edges per question.

    The bridge is no seed, the answer is neither seed nor bridge.
    """
    return _bridges(edges).select("question_id", "seed", "s1", "bridge", "s2", "answer")


def _factoids(edges: DataFrame) -> DataFrame:
    return _seeds(edges).join(_free(edges, "s1", "answer", "e1"), ["question_id", "s1"])


def factoid_pairs(edges: DataFrame) -> DataFrame:
    """seed → sentence → answer that is no seed."""
    return _factoids(edges).select("question_id", "seed", "s1", "answer")


def _yes_no(edges: DataFrame) -> DataFrame:
    seeds = _seeds(edges).select("question_id", F.col("seed").alias("left")).distinct()
    left = _mentions(edges, "s1", "left", "e1").join(seeds, ["question_id", "left"])
    return left.join(left.select("question_id", "s1", F.col("left").alias("right"), F.col("e1").alias("e2")), ["question_id", "s1"]).filter("left < right")


def yes_no_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of seeds that one sentence mentions."""
    return _yes_no(edges).select("question_id", "left", "s1", "right")


def _specific(label: Column) -> Column:
    return ~T.spaced_key(label).isin(*GENERIC) & label.rlike(r"[\p{L}\p{N}]")


PATH = (
    "question_id", "question_type", "path_kind", "path_id", "node_ids", "edge_ids", "evidence_unit_ids", "entity_chain", "relation_chain", "answer_candidate",
    "answer_type", "bridge_entity", "comparison_target", "score", "titles", "chunks", "texts", "last_entities", "sentence_types",
)


def _ranked_answers(rows: DataFrame, edges: DataFrame, units: DataFrame, nodes: DataFrame, sentence: str) -> DataFrame:
    """Rows with ``answer_rank``: possible answers first, then where the sentence has the type, specific names, names that sort first."""
    possible = edges.filter("edge_type = 'possible_answer_candidate'").select("question_id", F.col("source_id").alias(sentence), F.col("target_id").alias("answer"), F.lit(True).alias("possible"))
    label = nodes.select("question_id", F.col("node_id").alias("answer"), F.col("label").alias("answer_label"))
    typed = units.select("question_id", F.col("sid").alias(sentence), "answer_types", "expected_answer_type")
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    out = rows.join(possible, ["question_id", sentence, "answer"], "left").join(label, ["question_id", "answer"]).join(typed, ["question_id", sentence])
    generic = T.graph_key(F.col("answer_label")) == T.graph_key(F.col("expected_answer_type"))
    worth = flag(F.coalesce("possible", F.lit(False)), 0.40) + flag(F.array_contains("answer_types", F.col("expected_answer_type")), 0.25) + flag(_specific(F.col("answer_label")), 0.10) - flag(generic, 0.20)
    return out.withColumn("worth", worth).withColumn("answer_key", T.fold(F.col("answer_label"))).drop("possible", "answer_types", "expected_answer_type")


def search_paths(scored: DataFrame, edges: DataFrame, questions: DataFrame, k: int = MAX_PATHS) -> DataFrame:
    """Ranked paths of each question by its type; see ``PATH``, with ``path_rank``.

    Bridge questions join two sentences by an entity that is no seed; factoid
    ones read the answer in a seed's sentence; comparisons take the best
    answer in each sentence of a target (of the seeds if no target is in the
    graph); yes/no questions pair two seeds in a sentence, or with fewer than
    two seeds are factoids.  Score: mean unit score, answer type, share of
    required relations, length, bridge and answer specificity and the best
    retrieval rank; a yes/no path has its unit score and a bonus.  Of paths
    with the same units, chain and answer the best is kept; all ties go to
    the lesser path id.
    """
    q = questions.select("question_id", "question_type", "expected_answer_type", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    nodes = graph_nodes(edges)
    u = scored.join(q, "question_id").select(
        "question_id", T.sentence_node(F.col("evidence_unit_id")).alias("sid"), "evidence_unit_id", F.col("chunk_id").cast("string").alias("chunk_id"), "doc_title", "resolved_text", "entities", "final_score", "answer_types", F.array_distinct("relation_hints").alias("rels"),
        F.coalesce("retrieval_rank", F.lit(None).cast("int")).alias("rank"), "expected_answer_type",
    )
    types = q.select("question_id", "question_type")
    seeds = _seeds(edges).groupBy("question_id").agg(F.count_distinct("seed").alias("n_seeds"))
    kinds = types.join(seeds, "question_id", "left").withColumn("kind", F.when((F.col("question_type") == "YES_NO") & (F.coalesce("n_seeds", F.lit(0)) < 2), "FACTOID").otherwise(F.col("question_type"))).select("question_id", "kind")
    of = lambda kind: edges.join(kinds.filter(F.col("kind") == kind).select("question_id"), "question_id", "left_semi")
    none = F.lit(None).cast("string")
    shape = lambda rows, kind, prefix, nodes_, edges_, sentences, entities, answer, bridge, target: rows.select(
        "question_id", F.lit(kind).alias("path_kind"), F.lit(prefix).alias("prefix"), F.array(*nodes_).alias("node_ids"), F.array_distinct(F.array(*edges_)).alias("edge_ids"), F.array(*sentences).alias("sentences"),
        F.array(*entities).alias("entity_ids"), answer.alias("answer_id"), bridge.alias("bridge_id"), target.alias("target_id"),
    )
    e = of("BRIDGE")
    bridges = shape(_bridges(e), "bridge_candidate", "bridge", ["seed", "s1", "bridge", "s2", "answer"], ["seed_edge", "e1", "e2", "e3"], ["s1", "s2"], ["seed", "bridge", "answer"], F.col("answer"), F.col("bridge"), none)
    factoids = shape(_factoids(of("FACTOID")), "factoid_candidate", "factoid", ["seed", "s1", "answer"], ["seed_edge", "e1"], ["s1"], ["seed", "answer"], F.col("answer"), none, none)
    yes_no = shape(_yes_no(of("YES_NO")), "yes_no_evidence_connection", "yes_no", ["left", "s1", "right"], ["e1", "e2"], ["s1"], ["left", "right"], none, none, none)
    c = of("COMPARISON")
    named = q.select("question_id", F.explode("targets").alias("t")).select("question_id", T.node_id("entity", F.col("t")).alias("target"))
    held = named.join(_mentions(c, "s1", "target", "e1").select("question_id", "target").distinct(), ["question_id", "target"], "left_semi").distinct()
    other = _seeds(c).select("question_id", F.col("seed").alias("target")).distinct().join(held.select("question_id").distinct(), "question_id", "left_anti")
    both = held.unionByName(other).join(_mentions(c, "s1", "target", "e1"), ["question_id", "target"]).join(_mentions(c, "s1", "answer", "e2"), ["question_id", "s1"]).filter("answer <> target")
    first = Window.partitionBy("question_id", "target", "s1").orderBy(F.desc("worth"), "answer_key", "answer")
    best = _ranked_answers(both, c, u, nodes, "s1").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    partial = shape(best, "comparison_target_partial", "comparison_partial", ["target", "s1", "answer"], ["e1", "e2"], ["s1"], ["target", "answer"], F.col("answer"), none, F.col("target"))
    rows = bridges.unionByName(factoids).unionByName(yes_no).unionByName(partial)
    # what the sentences and nodes of a path say, gathered by question: bounded by what was retrieved for it
    said = u.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("sid", F.struct("evidence_unit_id", "chunk_id", "doc_title", "resolved_text", "entities", "final_score", "answer_types", "rels", "rank")))).alias("units"))
    labels = nodes.filter("node_type = 'entity'").groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "label"))).alias("labels"))
    rows = rows.join(said, "question_id").join(labels, "question_id").join(q, "question_id")
    us = F.transform("sentences", lambda s: F.try_element_at("units", s))
    rows = rows.withColumn("us", us).drop("units").withColumn("chain", F.transform("entity_ids", lambda n: F.try_element_at("labels", n)))
    label = lambda c: F.try_element_at("labels", F.col(c))
    rows = rows.withColumn("answer_candidate", label("answer_id")).withColumn("bridge_entity", label("bridge_id")).withColumn("comparison_target", label("target_id")).drop("labels")
    relations = F.array_distinct(F.flatten(F.col("us.rels")))
    mean = F.aggregate("us", F.lit(0.0), lambda acc, x: acc + x["final_score"]) / F.size("us")
    last = F.element_at("us", -1)
    matched = F.size(F.filter(relations, lambda r: _related(r, F.col("required"), T.spaced_key)))
    rank = F.array_min(F.col("us.rank"))
    flag = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    full = (
        mean + 0.25 * flag(F.array_contains(last["answer_types"], F.col("expected_answer_type")), 1.0) + 0.20 * F.least(F.lit(1.0), matched / F.greatest(F.lit(1), F.size("required"))) + 0.10
        + F.when(F.col("bridge_id").isNull(), 0.0).when(_specific(F.col("bridge_entity")), 0.20).otherwise(0.05) + flag(_specific(F.col("answer_candidate")), 0.15) + 0.05 * F.coalesce(1 / rank, F.lit(0.0))
    )
    score = F.when(F.col("prefix") == "yes_no", mean + 0.15).otherwise(full)
    paths = rows.select(
        "question_id", "question_type", "path_kind", T.path_id(F.col("prefix"), F.concat_ws("|", "node_ids"), F.concat_ws("|", "edge_ids")).alias("path_id"), "node_ids", "edge_ids", F.col("us.evidence_unit_id").alias("evidence_unit_ids"),
        F.col("chain").alias("entity_chain"), relations.alias("relation_chain"), "answer_candidate", F.when(F.col("prefix") == "yes_no", "BOOLEAN").otherwise(F.col("expected_answer_type")).alias("answer_type"), "bridge_entity", "comparison_target",
        F.round(score, 6).alias("score"), F.col("us.doc_title").alias("titles"), F.col("us.chunk_id").alias("chunks"), F.col("us.resolved_text").alias("texts"), last["entities"].alias("last_entities"), F.array_distinct(F.flatten(F.col("us.answer_types"))).alias("sentence_types"),
    )
    same = Window.partitionBy("question_id", "evidence_unit_ids", "entity_chain", "answer_candidate").orderBy(F.desc("score"), "path_id")
    best = paths.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.size("evidence_unit_ids"), F.coalesce("answer_candidate", F.lit("")), "path_id")
    return best.withColumn("path_rank", F.row_number().over(order)).filter(F.col("path_rank") <= k).select(*PATH, "path_rank")


def band_neighbours(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units of the wanted units' chunks at most one sentence away, wanted ones included, at most ``CONTEXT_CAP`` per question.

    A band join on (question, chunk); wanted units come first, then
    neighbours in the order of the wanted unit and then of the input.
    """
    u = units.select("question_id", "chunk_id", "sentence_id", "evidence_unit_id", "retrieval_rank")
    w = wanted.select("question_id", "evidence_unit_id").distinct().join(u, ["question_id", "evidence_unit_id"]).select("question_id", "chunk_id", F.col("sentence_id").alias("w_sid"))
    near = w.join(u, ["question_id", "chunk_id"]).filter(F.abs(F.col("w_sid") - F.col("sentence_id")) <= 1)
    once = near.groupBy("question_id", "evidence_unit_id", "chunk_id", "sentence_id", "retrieval_rank").agg(F.min(F.abs(F.col("w_sid") - F.col("sentence_id"))).alias("gap"))
    order = Window.partitionBy("question_id").orderBy("gap", F.coalesce("retrieval_rank", F.lit(1_000_000_000)), "chunk_id", "sentence_id")
    return once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CONTEXT_CAP).drop("nth", "gap")


def render_context(units: DataFrame) -> DataFrame:
    """``question_id, context_text, estimated_tokens, n_units``: units in context order under their headers."""
    row = F.struct(
        F.coalesce("retrieval_rank", F.lit(1_000_000_000)).alias("rank"), "chunk_id", "sentence_id",
        F.concat(F.lit("[Title: "), "doc_title", F.lit(" | Chunk: "), F.col("chunk_id").cast("string"), F.lit(" | Sentence: "), F.col("sentence_id").cast("string"), F.lit("]\n"), "sentence_text").alias("text"),
    )
    got = units.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    text = F.array_join(F.col("rows.text"), "\n\n")
    return got.select("question_id", text.alias("context_text"), T.estimated_tokens(text).alias("estimated_tokens"), F.size("rows").alias("n_units"))


def prune(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """The context of each decision: the selected units, for sufficient bridges with their neighbours, in context order.

    ``decisions``: ``question_id, question_type, sufficient, selected_ids``.
    Neighbours are units of the same paragraph one sentence away; they are
    taken in input order (retrieval rank, paragraph, sentence) until the
    context holds ``CONTEXT_CAP`` units, and the cap is looked at behind each
    unit of a selected paragraph, so one more may come in when the selection
    alone is over it.  Questions without units get an empty context.
    """
    order = F.struct(F.coalesce("retrieval_rank", F.lit(1_000_000_000)).alias("rank"), F.col("chunk_id").cast("string").alias("chunk"), F.col("sentence_id").alias("sentence"), F.col("evidence_unit_id").alias("unit"))
    text = F.when(F.coalesce("resolved_text", F.lit("")) != "", F.col("resolved_text")).otherwise(F.col("sentence_text"))
    block = F.concat(F.lit("[Title: "), F.coalesce("doc_title", F.lit("")), F.lit(" | Chunk: "), F.col("chunk_id").cast("string"), F.lit(" | Sentence: "), F.col("sentence_id").cast("string"), F.lit("]\n"), text)
    units = scored.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("block"), text.alias("text")))).alias("units"))
    rows = decisions.join(units, "question_id", "left")
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = rows.withColumn("requested", F.array_distinct(held(F.col("selected_ids")))).withColumn("all_ids", held(F.col("units.o.unit")))
    rows = rows.withColumn("mandatory", F.array_intersect("requested", "all_ids")).withColumn("kept", F.filter("units", lambda u: F.array_contains("mandatory", u["o"]["unit"])))
    widen = F.col("sufficient") & (F.col("question_type") == "BRIDGE")
    near = lambda u: F.exists("kept", lambda m: (m["o"]["chunk"] == u["o"]["chunk"]) & (F.abs(m["o"]["sentence"] - u["o"]["sentence"]) <= 1))

    def take(acc: Column, u: Column) -> Column:
        here = F.exists("kept", lambda m: m["o"]["chunk"] == u["o"]["chunk"])
        ids = F.when(~acc["done"] & here & near(u), F.array_union(acc["ids"], F.array(u["o"]["unit"]))).otherwise(acc["ids"])
        return F.struct(ids.alias("ids"), (acc["done"] | (here & (F.size(ids) >= CONTEXT_CAP))).alias("done"))

    wide = F.aggregate("units", F.struct(F.col("mandatory").alias("ids"), F.lit(False).alias("done")), take, lambda acc: acc["ids"])
    rows = rows.withColumn("ids", F.when(widen, held(wide)).otherwise(F.col("mandatory"))).withColumn("chosen", F.filter("units", lambda u: F.array_contains("ids", u["o"]["unit"])))
    context = F.coalesce(F.array_join(F.col("chosen.block"), "\n\n"), F.lit(""))
    ids = held(F.col("chosen.o.unit"))
    strategy = (
        F.when(F.size(ids) == 0, "empty_evidence_pruning").when(widen & (F.size(ids) > F.size("requested")), "sufficient_bridge_neighbor_sentence_pruning")
        .when(F.col("sufficient"), "sufficient_path_sentence_pruning").otherwise("partial_evidence_sentence_pruning")
    )
    return rows.select(
        "question_id", ids.alias("selected_ids"), F.array_distinct(held(F.col("chosen.o.chunk"))).alias("selected_chunks"), context.alias("context_text"), T.estimated_tokens(context).alias("estimated_tokens"), strategy.alias("strategy"),
        F.array_except("all_ids", ids).alias("removed_ids"), F.array_except("requested", "all_ids").alias("missing_ids"), F.size(F.array_except(ids, F.col("mandatory"))).alias("n_neighbours"),
    )
