"""Corpus preparation: validity, hash-rank selection, content ids, exact dedup, link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import spans as S
from lodestone.functions import text as T

#: Fixed value: what an identifier looks like.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER) & (F.length(c) <= 255), F.lit(False))


def valid_source(rows: DataFrame) -> DataFrame:
    """Source records with ``is_valid``: known id, titles unique, sentences in each paragraph, facts that resolve."""
    titles = F.col("context.title")
    full = F.forall("context", lambda p: F.size(p["sentences"]) > 0)
    resolves = F.forall("supporting_facts", lambda f: F.exists("context", lambda p: (p["title"] == f["title"]) & (f["idx"] >= 0) & (f["idx"] < F.size(p["sentences"]))))
    ok = valid_identifier(F.col("question_id")) & (F.size("context") > 0) & full & (F.size(F.array_distinct(titles)) == F.size(titles)) & resolves
    return rows.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def hash_rank(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the least digest of seed and key, with their position."""
    ranked = rows.withColumn("digest", T.stable_digest(F.lit(seed), F.col(key))).orderBy("digest", key).limit(n)
    from pyspark.sql import Window

    return ranked.withColumn("position", F.row_number().over(Window.orderBy("digest", key)))


def chunks(rows: DataFrame, title: Column, sentences: Column) -> DataFrame:
    """Rows with ``chunk_id``, a digest of title and sentences."""
    return rows.withColumn("chunk_id", T.chunk_id(title, sentences))


def dedup(candidates: DataFrame) -> DataFrame:
    """One row per chunk id with how many candidates it had; counted map-side before the shuffle."""
    return candidates.groupBy("chunk_id").agg(F.count("*").alias("copies"), F.min("source_id").alias("first_source"))


def unresolved(links: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Links whose target does not exist."""
    return links.join(targets.select(*keys).distinct(), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


#: Words of the piece by which an item is looked for, and items that one pass takes.
PIECE, ITEMS = 4, 20_000


def holders(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """``question_id, chunk_id`` of the chunks (``chunk_id, text``) that hold an item's whole text, character for character.

    Each item gives a run of ``PIECE`` words from its inside; runs of a chunk
    are intersected with those of a block of items where the chunk is, and
    only chunks that share one are compared with the items that gave it.
    Items too short for such a run are compared with every chunk; they are
    taken in blocks like all others.  Empty items and nulls match nothing.
    """
    spark = chunks.sparkSession
    rows = items.select("question_id", "text").filter("text <> ''")
    words = F.split("text", " ")
    rows = rows.withColumn("piece", F.when(F.size(words) >= PIECE + 2, F.array_join(F.slice(words, 2, PIECE), " ")))
    out, block = None, []

    def found(block: list) -> DataFrame:
        table = spark.createDataFrame(block, "question_id bigint, item string, piece string")
        pieces = sorted({p for _, _, p in block if p is not None})
        at = lambda cut: F.when(F.size(cut) >= PIECE, F.sequence(F.lit(0), F.size(cut) - PIECE)).otherwise(F.array().cast("array<int>"))
        joined = lambda cut, k: F.concat_ws(" ", *[F.get(cut, k + j) for j in range(PIECE)])
        runs = S.let(F.split("text", " "), lambda cut: F.transform(at(cut), lambda k: joined(cut, k)))
        known = F.lit(pieces) if pieces else F.array().cast("array<string>")
        near = chunks.select("chunk_id", "text", F.explode(F.array_intersect(runs, known)).alias("piece")).join(F.broadcast(table), "piece")
        near = near.filter(F.contains("text", "item")).select("question_id", "chunk_id")
        short = [r for r in block if r[2] is None]
        if short:
            few = F.array(*[F.struct(F.lit(i).cast("bigint").alias("question_id"), F.lit(t).alias("item")) for i, t, _ in short])
            hits = chunks.select("chunk_id", F.explode(F.filter(few, lambda x: F.contains(F.col("text"), x["item"]))).alias("x")).select("x.question_id", "chunk_id")
            near = near.unionByName(hits)
        return near

    for r in rows.orderBy("question_id").toLocalIterator():
        block.append((r["question_id"], r["text"], r["piece"]))
        if len(block) == ITEMS:
            out = found(block) if out is None else out.unionByName(found(block))
            block = []
    if block or out is None:
        last = found(block) if block else chunks.select(F.lit(None).cast("bigint").alias("question_id"), "chunk_id").filter("false")
        out = last if out is None else out.unionByName(last)
    return out.distinct()
