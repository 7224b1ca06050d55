"""Exact lexical and dense retrieval, rank fusion and hop merging, for all questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: BM25 and fusion parameters.
K1, B = 1.5, 0.75
RRF, WEIGHTS = 60, {"bm25": 0.3, "dense": 0.7}
DEPTH, RESULT = 100, 10
#: Question vectors that one pass compares.
BLOCK = 4096


def ranked(scored: DataFrame, k: int, *ties: Column) -> DataFrame:
    """Ranks 1 to ``k`` of each question by falling score; ties by ``ties``, then chunk."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), *ties, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def document_tokens(chunks: DataFrame) -> DataFrame:
    """``chunk_id, tokens, dl`` from ``chunk_id, text``."""
    return chunks.select("chunk_id", T.tokenize("text").alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(chunks: DataFrame) -> DataFrame:
    """``token, chunk_id, tf, dl`` of the whole corpus; texts are cut once and counted map-side."""
    return document_tokens(chunks).select("chunk_id", "dl", F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "dl").agg(F.count("*").alias("tf"))


#: Distinct words of the questions that one pass looks for; they are broadcast, so their number is checked.
VOCABULARY = 200_000


def _question_tokens(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(T.tokenize("text")).alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("times"))


def _scored(asked: DataFrame, hits: DataFrame, size: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """Scores from ``token, chunk_id, tf, dl, df``; what is shown has six places, ranks look at nine."""
    weight = hits.join(F.broadcast(size)).select(
        "token", "chunk_id",
        (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("part"),
    )
    # sums differ in the last places by the order of their parts: ties are those to so many places
    scored = asked.join(weight, "token").groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col("times")), 9).alias("score"))
    return ranked(scored, k).withColumn("score", F.round("score", 6))


def bm25(chunks: DataFrame, questions: DataFrame, k: int = DEPTH, k1: float = K1, b: float = B) -> DataFrame:
    """``question_id, chunk_id, score, rank`` straight from texts; repeated question tokens count each time.

    Each text is cut once: an empty word stands for each document, so one
    shuffle of (document, question word) counts gives frequencies, lengths and
    their mean, and the plan reuses it.  The questions' vocabulary is
    broadcast while it is small.
    """
    asked = _question_tokens(questions)
    words = asked.select("token").unionByName(questions.sparkSession.createDataFrame([("",)], "token string")).distinct()
    if words.limit(VOCABULARY + 1).count() <= VOCABULARY:
        words = F.broadcast(words)
    rows = document_tokens(chunks).select("chunk_id", "dl", F.explode(F.array_append("tokens", F.lit(""))).alias("token")).join(words, "token")
    hits = rows.groupBy("chunk_id", "dl", "token").agg(F.count("*").alias("tf"))
    size = hits.filter("token = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = hits.filter("token <> ''")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    return _scored(asked, hits.join(df, "token"), size, k, k1, b)


def bm25_indexed(index: dict[str, DataFrame], questions: DataFrame, k: int = DEPTH, k1: float = K1, b: float = B) -> DataFrame:
    """The same from published postings: only the files that hold the questions' tokens are read."""
    asked = _question_tokens(questions)
    size = index["docs"].agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = index["postings"].join(asked.select("token").distinct(), "token")
    return _scored(asked, hits, size, k, k1, b)


def dense(vectors: DataFrame, questions: DataFrame, k: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``question_id, chunk_id, score, rank`` by exact cosine of ``vector`` columns.

    The question set is taken in blocks; each pass multiplies a block with the
    vectors where they are and keeps the best ``k`` of each partition (ties by
    chunk), so the shuffle does not carry all pairs.  A block is at most
    ``BLOCK`` vectors.
    """
    out = None
    for some in _blocks(questions, block):
        part = vectors.select("chunk_id", "vector").mapInArrow(_nearest(some, k), "question_id bigint, chunk_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "question_id bigint, chunk_id bigint, score double, rank int")
    # sums of products differ in the last places by how rows were batched: ties are those to so many places
    return ranked(out.withColumn("score", F.round("score", 12)), k).withColumn("score", F.round("score", 6))


def _blocks(questions: DataFrame, size: int) -> Iterator[list]:
    some = []
    for r in questions.select("question_id", "vector").orderBy("question_id").toLocalIterator():
        some.append((r[0], r[1]))
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    if not np.isfinite(n).all() or (n == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return x / n


def _flat(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as one matrix, from its values without Python objects."""
    values = column.flatten()
    n = len(column)
    if column.null_count or values.null_count or (n and len(values) % n):
        raise ValueError("vectors must be there and of one size")
    return np.asarray(values, np.float64).reshape(n, -1)


def _nearest(asked: list, k: int):
    ids = np.array([q for q, _ in asked])
    q = _unit(np.array([v for _, v in asked], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best of all rows so far; never more than k of a question
        best_score, best_chunk = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                chunk = np.broadcast_to(np.asarray(part.column(0)), (len(ids), part.num_rows))
                score = np.concatenate([best_score, q @ _unit(_flat(part.column(1))).T], 1)
                chunk = np.concatenate([best_chunk, chunk], 1)
                order = np.lexsort((chunk, -np.round(score, 12)), axis=1)[:, :k]
                best_score, best_chunk = np.take_along_axis(score, order, 1), np.take_along_axis(chunk, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_chunk.shape[1])), pa.array(best_chunk.ravel()), pa.array(best_score.ravel())], ["question_id", "chunk_id", "score"])

    return run


def fuse(branches: dict[str, DataFrame], k: int = RESULT, weights: dict[str, float] | None = None, constant: int = RRF) -> DataFrame:
    """Weighted reciprocal-rank fusion: ``question_id, chunk_id, score, best_rank, sources, ranks, rank``.

    One shuffle: branches are stacked and summed by question and chunk.  Ties
    go to the better source rank, then the chunk.
    """
    weights = weights or {name: 1.0 for name in branches}
    if set(weights) != set(branches):
        raise ValueError("each branch needs a weight")
    stacked = None
    for name, hits in branches.items():
        part = hits.select("question_id", "chunk_id", F.lit(name).alias("source"), "rank", F.col("score").alias("source_score"), (F.lit(weights[name]) / (F.lit(constant) + F.col("rank"))).alias("part"))
        stacked = part if stacked is None else stacked.unionByName(part)
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", c))))
    scored = stacked.groupBy("question_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("rank").alias("best_rank"), entry("source_score").alias("source_scores"), entry("rank").alias("source_ranks"))
    # two sources give two parts at most, whose sum does not depend on their order
    return ranked(scored, k, F.col("best_rank")).withColumn("score", F.round("score", 6))


def broken_branches(branches: dict[str, DataFrame]) -> list[str]:
    """Sources whose hits break the contract of fusion: a chunk twice for a question, or ranks that are not 1 to n."""
    out = []
    for name, hits in branches.items():
        rows = hits.groupBy("question_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"))
        if not rows.filter("n <> top or n <> chunks or n <> ranks or low <> 1").isEmpty():
            out.append(name)
    return out


#: Profiles of fusion; a profile's name stands for its constant and weights.
PROFILES = {"hybrid-v1": (60, {"bm25": 1.0, "dense": 1.0}), "hybrid-v2": (60, {"bm25": 0.3, "dense": 0.7})}


def profile(name: str, constant: int | None = None, weights: dict[str, float] | None = None) -> tuple[int, dict[str, float]]:
    """Constant and weights of a profile; others under its name are an error."""
    own = PROFILES[name]
    if (constant, weights) not in ((None, None), own):
        raise ValueError(f"profile {name} has constant and weights of its own")
    return own


def merge_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """First hop in order, then chunks only the second has: ``merged_rank``, first hop, where it occurred."""
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    once = both.groupBy("question_id", "chunk_id").agg(
        F.min(F.struct("hop", "rank", "score")).alias("first"), F.sort_array(F.collect_list(F.struct("hop", "rank"))).alias("occurrences")
    )
    order = Window.partitionBy("question_id").orderBy("first.hop", "first.rank", "chunk_id")
    return once.select("question_id", "chunk_id", F.col("first.hop").alias("first_seen_hop"), F.col("first.score").alias("score"), "occurrences", F.row_number().over(order).alias("merged_rank"))


def violations(hits: DataFrame, k: int) -> DataFrame:
    """Questions whose ranking breaks its contract: ranks not 1..n, a chunk twice, too many, scores rising."""
    order = Window.partitionBy("question_id").orderBy("rank")
    seen = hits.withColumn("before", F.lag("score").over(order))
    return seen.groupBy("question_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("chunk_id").alias("chunks"), F.count_if(F.col("score") > F.col("before")).alias("rising")
    ).filter((F.col("n") != F.col("top")) | (F.col("n") != F.col("chunks")) | (F.col("n") > k) | (F.col("rising") > 0))
