"""Ranking and answer metrics, macro means, percentiles, paired comparison and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

METRICS = ("recall", "mrr", "ndcg", "missing_rate", "any_missing", "both_found", "top1")


def relevance(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits with ``rel``; a repeated chunk keeps its rank but earns nothing."""
    first = Window.partitionBy("question_id", "chunk_id").orderBy("rank")
    marked = hits.withColumn("nth", F.row_number().over(first)).join(gold.select("question_id", "chunk_id", F.lit(1).alias("gold")), ["question_id", "chunk_id"], "left")
    return marked.select("question_id", "chunk_id", "rank", F.when((F.col("nth") == 1) & (F.col("gold") == 1), 1).otherwise(0).alias("rel"))


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row per question with gold: recall, MRR, nDCG, missing rate and flags at ``k``."""
    want = gold.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    got = relevance(hits, gold).filter((F.col("rel") == 1) & (F.col("rank") <= k)).groupBy("question_id").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    found = F.coalesce("found", F.lit(0))
    r = F.round
    return want.join(got, "question_id", "left").select(
        "question_id",
        r(found / F.col("n_gold"), 6).alias("recall"),
        r(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        r(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
        r(1 - found / F.col("n_gold"), 6).alias("missing_rate"),
        F.when(found < F.col("n_gold"), 1.0).otherwise(0.0).alias("any_missing"),
        F.when(F.col("n_gold") == 2, F.when(found == 2, 1.0).otherwise(0.0)).alias("both_found"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("top1"),
    )


def macro_means(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean of each metric over the rows that have it, and how many those are."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("denominator"))


def percentiles(rows: DataFrame, group: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Linear percentiles at (n - 1) times the share; null where there are no values."""
    return rows.groupBy(*group).agg(*[F.round(F.percentile(value, s), 6).alias(f"p{round(s * 100)}") for s in shares], F.count(value).alias("n"))


def missing(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Gold chunks outside the top ``k``."""
    return gold.join(hits.filter(F.col("rank") <= k), ["question_id", "chunk_id"], "left_anti")


def exact_match(answer: Column, gold: Column) -> Column:
    return (T.answer_key(answer) == T.answer_key(gold)).cast("int")


def token_f1(rows: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """``key, exact, f1``: multiset overlap of answer words, summed by word after one shuffle."""
    words = lambda c: F.filter(F.split(T.answer_key(F.col(c)), " "), lambda w: w != "")
    cut = rows.select(key, exact_match(F.col(answer), F.col(gold)).alias("exact"), words(answer).alias("a"), words(gold).alias("g"))
    stacked = cut.select(key, F.explode("a").alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(cut.select(key, F.explode("g").alias("w"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    common = stacked.groupBy(key, "w").agg(F.least(F.sum("x"), F.sum("y")).alias("c")).groupBy(key).agg(F.sum("c").alias("common"))
    p, r = F.col("common") / F.size("a"), F.col("common") / F.size("g")
    both_empty = (F.size("a") == 0) & (F.size("g") == 0)
    f1 = F.when(both_empty, 1.0).when(F.coalesce("common", F.lit(0)) == 0, 0.0).otherwise(2 * p * r / (p + r))
    return cut.join(common, key, "left").select(key, "exact", F.round(f1, 6).alias("f1"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, lower_is_better: bool = False) -> DataFrame:
    """Paired rows of two runs: delta and whether the second improved."""
    left, right = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 6)
    sign = F.signum(delta) * (-1 if lower_is_better else 1)
    return left.join(right, key).select(key, "before", "after", delta.alias("delta"), F.when(sign > 0, "improved").when(sign < 0, "regressed").otherwise("unchanged").alias("change"))


def metric_deltas(runs: DataFrame, baseline: str, candidate: str, metrics: list[str]) -> DataFrame:
    """``metric, baseline, candidate, delta`` from one row per run."""
    long = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("run_id", "x.*")
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("value")))
    return long.groupBy("metric").agg(F.round(pick(baseline), 6).alias("baseline"), F.round(pick(candidate), 6).alias("candidate"), F.round(pick(candidate) - pick(baseline), 6).alias("delta"))


def context_reduction(rows: DataFrame, pair: list[str], system: str, baseline: str, candidate: str, size: str) -> DataFrame:
    """Mean percentage by which the candidate's context is smaller than the baseline's, per depth."""
    base = rows.filter(F.col(system) == baseline).select(*pair, F.col(size).alias("base"))
    cand = rows.filter(F.col(system) == candidate).select(*pair, F.col(size).alias("cand"))
    share = F.try_divide((F.col("base") - F.col("cand")) * 100.0, F.col("base"))
    return base.join(cand, pair).groupBy(pair[-1]).agg(F.round(F.avg(share), 6).alias("reduction_pct"), F.count(share).alias("pairs"))


def keyset_page(rows: DataFrame, falling: str, rising: str, after: tuple | None, size: int) -> DataFrame:
    """A page in (``falling`` desc, ``rising`` asc) order behind the cursor, and one row more if there is a next page."""
    if after is not None:
        rows = rows.filter((F.col(falling) < F.lit(after[0])) | ((F.col(falling) == F.lit(after[0])) & (F.col(rising) > F.lit(after[1]))))
    return rows.orderBy(F.desc(falling), rising).limit(size + 1)


def cursor(*values: Column) -> Column:
    """Opaque cursor: base64url of a JSON array, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(F.array(*[v.cast("string") for v in values])), "UTF-8")), "+/", "-_"), F.lit("="))
