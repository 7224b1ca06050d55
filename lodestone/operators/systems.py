"""System runs: contexts, the condition grid, summaries, terminal states and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: The systems and depths of a full grid.
SYSTEMS, DEPTHS = ("fixed", "adaptive", "evidence"), (5, 10, 20, 30)


def full_context(hits: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
    """``question_id, context_text, estimated_tokens``: whole paragraphs in rank order under numbered headers."""
    rows = hits.filter(F.col("rank") <= depth).join(chunks, "chunk_id")
    block = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\nTitle: "), "title", F.lit("\nText: "), "text")
    got = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    text = F.array_join(F.col("blocks.block"), "\n\n")
    return got.select("question_id", text.alias("context_text"), T.estimated_tokens(text).alias("estimated_tokens"))


def grid(questions: DataFrame, systems: tuple[str, ...] = SYSTEMS, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Each question under each condition, depth by depth and in each depth system by system."""
    conditions = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(s).alias("system"), F.lit(d).alias("top_k")) for n, (d, s) in enumerate((d, s) for d in depths for s in systems)])
    return questions.select("question_id", F.explode(conditions).alias("c")).select("question_id", "c.*")


def condition_summary(rows: DataFrame, metrics: list[str], latency: str) -> DataFrame:
    """Macro means and latency percentiles of each (system, top_k); failed rows count as failed only."""
    done = F.col("status") == "completed"
    means = [F.round(F.avg(F.when(done, F.col(m))), 6).alias(f"mean_{m}") for m in metrics]
    shares = [F.round(F.coalesce(F.percentile(F.when(done, F.col(latency)), p), F.lit(0.0)), 6).alias(f"p{round(p * 100)}_{latency}") for p in (0.5, 0.95)]
    return rows.groupBy("system", "top_k").agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), *means, *shares)


def terminal_state(first: Column, second: Column, has_query: Column) -> Column:
    """Where a two-pass run ended, from whether each pass was sufficient (null: no second pass)."""
    return F.when(first, "sufficient_hop1").when(second, "sufficient_hop2").when(~has_query, "insufficient_no_query").otherwise("insufficient_after_hop2")


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """How many scores are zero, one, or between."""
    bucket = F.when(F.col(score) == 0, "zero").when(F.col(score) == 1, "one").otherwise("interior")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node: seed flags joined by or, labels distinct in the order of ``pos``, the first one first."""
    grouped = nodes.groupBy("question_id", "node_id").agg(F.bool_or("is_seed").alias("is_seed"), F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("seen"))
    return grouped.select("question_id", "node_id", "is_seed", F.array_distinct(F.col("seen.label")).alias("labels")).withColumn("label", F.get("labels", F.lit(0)))


def broken_spans(rows: DataFrame, text: str, span: str, start: str, end: str) -> DataFrame:
    """Rows whose span is not what stands in the text from ``start`` to ``end`` (from 0, end left out)."""
    inside = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
    return rows.filter((F.col(end) <= F.col(start)) | (inside != F.col(span)))


def broken_postings(postings: DataFrame) -> DataFrame:
    """Tokens whose postings break the index contract: a chunk twice, or a count below one."""
    seen = postings.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"), F.min("tf").alias("least"))
    return seen.filter((F.col("n") != F.col("chunks")) | (F.col("least") < 1))


def contained(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Points joined to the half-open intervals that hold them, of any widths and overlapping or not.

    Cells of the intervals' mean width make it a join by equality: an interval
    stands in each cell it touches, a point in its own.
    """
    width = intervals.agg(F.greatest(F.avg(F.col(high) - F.col(low)), F.lit(1e-9))).first()[0]
    if width is None:
        return points.crossJoin(intervals.limit(0))
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    spread = intervals.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    rows = points.withColumn("_cell", cell(F.col(value))).join(spread, "_cell")
    return rows.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, reach: int | None = None) -> DataFrame:
    """For each row of ``left`` the places of the nearest rows of ``right`` before and behind it, within ``reach``.

    Both sides are stacked and two running frames look back and ahead, so it
    is one shuffle by the key.  Rows at the same place are neither.
    """
    from pyspark.sql import Window

    rows = left.withColumn("_side", F.lit(0)).unionByName(right.select(key, at).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 1, F.col(at))
    w = Window.partitionBy(key).orderBy(at)
    found = rows.withColumn("before", F.max(mark).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("behind", F.min(mark).over(w.rangeBetween(1, Window.unboundedFollowing)))
    found = found.filter("_side = 0").drop("_side")
    if reach is not None:
        found = found.withColumn("before", F.when(F.col(at) - F.col("before") <= reach, F.col("before"))).withColumn("behind", F.when(F.col("behind") - F.col(at) <= reach, F.col("behind")))
    return found
