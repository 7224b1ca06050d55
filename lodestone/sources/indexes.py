"""Published retrieval indexes: postings and vectors as versioned tables with a manifest, and a cache of query vectors."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval
from lodestone.sources import records
from lodestone.sources.records import ArtifactError

#: Fixed value: what a cache key begins with.
CACHE_NAMESPACE = "query-embedding-cache-key-v1"


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def order_digest(ids: DataFrame) -> str:
    """Digest of the chunk ids in order, from the digests of ranges of them, so no task sees all."""
    digest = records.content_digest(ids.select(F.col("chunk_id").cast("string").alias("chunk_id")))
    return digest["sha256"]


def _manifest(kind: str, chunks: DataFrame, config: dict, parts: dict[str, DataFrame]) -> dict:
    spark = chunks.sparkSession
    return {
        "kind": kind, "config": config, "config_fingerprint": fingerprint(config), "chunks": chunks.count(), "order_digest": order_digest(chunks), "corpus": records.content_digest(chunks),
        "parts": {name: records.content_digest(df) for name, df in parts.items()}, "spark": spark.version,
    }


def _publish(spark: SparkSession, folder: str, kind: str, chunks: DataFrame, config: dict, tables: dict[str, DataFrame], problems) -> dict:
    """Write to a stage, read back, check, and publish under a name that must be new."""
    records.require_new(spark, folder)
    stage = folder + ".stage"
    records.remove(spark, stage)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
        again = {name: spark.read.parquet(f"{stage}/{name}") for name in tables}
        found = problems(again)
        if found:
            raise ArtifactError("; ".join(found))
        manifest = _manifest(kind, chunks, config, again)
        records.write_json(spark, stage + "/manifest.json", manifest)
        records.rename(spark, stage, folder)
        return manifest
    finally:
        records.remove(spark, stage)


def lexical_problems(parts: dict[str, DataFrame]) -> list[str]:
    """What is wrong with postings: none, a chunk twice, a count below one, lengths that don't add up."""
    postings, docs = parts["postings"], parts["docs"]
    out = []
    if docs.isEmpty():
        out.append("index is empty")
    if not docs.groupBy("chunk_id").count().filter("count > 1").isEmpty():
        out.append("a chunk is there twice")
    if not postings.groupBy("token", "chunk_id").agg(F.count("*").alias("n"), F.min("tf").alias("least")).filter("n > 1 or least < 1").isEmpty():
        out.append("postings repeat or have no count")
    sums = postings.groupBy("chunk_id").agg(F.sum("tf").alias("total"))
    if not docs.filter("dl > 0").join(sums, "chunk_id", "left").filter("not (dl <=> total)").isEmpty():
        out.append("lengths do not add up")
    return out


def dense_problems(parts: dict[str, DataFrame], dimensions: int) -> list[str]:
    vectors = parts["vectors"]
    out = []
    if vectors.isEmpty():
        out.append("index is empty")
    if not vectors.groupBy("chunk_id").count().filter("count > 1").isEmpty():
        out.append("a chunk is there twice")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    if not vectors.filter((F.size("vector") != dimensions) | F.exists("vector", lambda x: F.isnan(x) | x.isNull()) | (F.abs(norm - 1) > 1e-6)).isEmpty():
        out.append("a vector has the wrong size or is not of unit length")
    return out


def build_lexical(chunks: DataFrame, folder: str, k1: float = retrieval.K1, b: float = retrieval.B) -> dict:
    """Publish postings of ``chunks`` (``chunk_id, text``).

    Postings carry document frequency and length and are ranged by token and
    chunk, so readers skip files without their tokens, and one very frequent
    token is spread over many files.
    """
    spark = chunks.sparkSession
    docs = retrieval.document_tokens(chunks).select("chunk_id", "dl")
    rows = retrieval.postings(chunks)
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    rows = rows.join(df, "token").repartitionByRange("token", "chunk_id").sortWithinPartitions("token", "chunk_id")
    return _publish(spark, folder, "lexical", chunks, {"k1": k1, "b": b, "tokenizer": T.WORD}, {"postings": rows, "docs": docs}, lexical_problems)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors of unit length; a zero or non-finite one is an error."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), norm).otherwise(F.raise_error(F.lit("vectors must be finite and not zero")))
    return vectors.withColumn("n", ok).select("chunk_id", F.transform("vector", lambda x: x.cast("double") / F.col("n")).alias("vector"))


def build_dense(vectors: DataFrame, folder: str, dimensions: int) -> dict:
    """Publish ``chunk_id, vector`` as unit vectors."""
    spark = vectors.sparkSession
    rows = unit_vectors(vectors).sortWithinPartitions("chunk_id")
    return _publish(spark, folder, "dense", vectors.select("chunk_id"), {"dimensions": dimensions, "metric": "inner_product"}, {"vectors": rows}, lambda parts: dense_problems(parts, dimensions))


def load(spark: SparkSession, folder: str, kind: str, config: dict | None = None, chunks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a published index, if they are what its manifest says and, where given, made of these chunks by this configuration."""
    manifest = records.read_json(spark, folder + "/manifest.json")
    if manifest["kind"] != kind:
        raise ArtifactError(f"{folder} is no {kind} index")
    if config is not None and manifest["config_fingerprint"] != fingerprint(config):
        raise ArtifactError(f"{folder} was made by another configuration")
    if manifest["config_fingerprint"] != fingerprint(manifest["config"]):
        raise ArtifactError("configuration and fingerprint differ")
    if chunks is not None and (manifest["chunks"] != chunks.count() or manifest["order_digest"] != order_digest(chunks)):
        raise ArtifactError(f"{folder} was made of other chunks")
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["parts"]}
    for name, df in parts.items():
        if records.content_digest(df) != manifest["parts"][name]:
            raise ArtifactError(f"{folder}/{name} is not what its manifest says")
    return parts


# --- cache of query vectors ------------------------------------------------------------------


def cache_key(text: Column, version: str, model: str, dimensions: int) -> Column:
    return T.stable_digest(F.lit(CACHE_NAMESPACE), F.lit(version), F.lit(model), F.lit(str(dimensions)), text)


class QueryCache:
    """Vectors of query texts by content-addressed key, in shards by the key's first two digits.

    ``mode``: ``disabled`` asks the provider for everything, ``read_only``
    fails on a text that is not there, ``read_write`` asks for those and keeps
    them.  A provider maps ``(text)`` rows to ``(text, vector)``.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, model: str, dimensions: int, mode: str = "read_write"):
        if mode not in ("disabled", "read_only", "read_write"):
            raise ValueError(mode)
        self.spark, self.folder, self.version, self.model, self.dimensions, self.mode = spark, folder.rstrip("/"), version, model, dimensions, mode

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cache_key", cache_key(F.col("text"), self.version, self.model, self.dimensions))

    def entries(self) -> DataFrame | None:
        """Stored rows whose key, size and digest agree with their text and vector; any other is an error."""
        if not records.exists(self.spark, self.folder):
            return None
        rows = self.spark.read.parquet(self.folder)
        digest = F.sha2(F.array_join(F.transform("vector", lambda x: F.hex(F.encode(x.cast("string"), "UTF-8"))), ","), 256)
        ok = (F.col("cache_key") == cache_key(F.col("text"), self.version, self.model, self.dimensions)) & (F.size("vector") == self.dimensions) & (F.col("vector_sha256") == digest)
        return rows.withColumn("vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("broken cache entry "), "cache_key"))))

    def store(self, vectors: DataFrame) -> None:
        """Append ``text, vector`` rows that are not there yet."""
        digest = F.sha2(F.array_join(F.transform("vector", lambda x: F.hex(F.encode(x.cast("string"), "UTF-8"))), ","), 256)
        rows = self._keyed(vectors.select("text", F.col("vector").cast("array<float>").alias("vector"))).dropDuplicates(["cache_key"]).withColumn("vector_sha256", digest).withColumn("shard", F.substring("cache_key", 1, 2))
        have = self.entries()
        if have is not None:
            rows = rows.join(have.select("cache_key"), "cache_key", "left_anti")
        rows.write.mode("append").partitionBy("shard").parquet(self.folder)

    def embed(self, questions: DataFrame, provider=None) -> DataFrame:
        """``question_id, vector, cached`` of ``question_id, text``."""
        texts = self._keyed(questions.select("text").distinct())
        have = self.entries() if self.mode != "disabled" else None
        known = texts.join(have.select("cache_key", "vector"), "cache_key").select("text", "vector", F.lit(True).alias("cached")) if have is not None else None
        left = texts.join(have.select("cache_key"), "cache_key", "left_anti").select("text") if have is not None else texts.select("text")
        if self.mode == "read_only":
            if not left.isEmpty():
                raise ArtifactError("a query is not in the cache")
            every = known
        else:
            fresh = provider(left).select("text", F.col("vector").cast("array<float>").alias("vector"), F.lit(False).alias("cached"))
            every = fresh if known is None else known.unionByName(fresh)
            if self.mode == "read_write":
                self.store(fresh.select("text", "vector"))
        return questions.select("question_id", "text").join(every, "text").select("question_id", "vector", "cached")
