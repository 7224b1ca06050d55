"""Exports of runs: tables as canonical JSON lines in a new folder, with a manifest that says what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import store
from lodestone.sources import records
from lodestone.sources.records import ArtifactError


def write_export(spark: SparkSession, uri: str, tables: dict[str, DataFrame], meta: dict, report: str | None = None) -> dict:
    """Write all tables and a manifest to a stage and publish them together under a name that must be new."""
    records.require_new(spark, uri)
    stage = uri + ".stage"
    records.remove(spark, stage)
    try:
        parts = {name: records.write_jsonl(df, f"{stage}/{name}") | {"schema": df.schema.jsonValue()} for name, df in tables.items()}
        manifest = {"meta": meta, "parts": parts, "report": report}
        records.write_json(spark, stage + "/manifest.json", manifest)
        records.rename(spark, stage, uri)
        return manifest
    finally:
        records.remove(spark, stage)


def load_export(spark: SparkSession, uri: str) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables of an export whose files are, byte for byte, what the manifest says."""
    manifest = records.read_json(spark, uri + "/manifest.json")
    out = {}
    for name, part in manifest["parts"].items():
        records.validate(spark, f"{uri}/{name}", part)
        out[name] = spark.read.schema(StructType.fromJson(part["schema"])).option("mode", "FAILFAST").json(f"{uri}/{name}")
        if spark.read.text(f"{uri}/{name}").count() != part["rows"]:
            raise ArtifactError(f"{uri}/{name} does not hold {part['rows']} rows")
    return manifest, out


def load_run(spark: SparkSession, uri: str) -> tuple[dict, DataFrame]:
    """Events of an exported run, whose life must be in order and whose questions must be those planned."""
    manifest, tables = load_export(spark, uri)
    events = tables["events"].withColumn("sequence", F.col("sequence").cast("bigint"))
    found = store.violations(events, tables["questions"]).limit(1).collect()
    if found:
        raise ArtifactError(found[0]["problem"])
    return manifest, events


def load_system_export(spark: SparkSession, uri: str) -> tuple[dict, DataFrame]:
    """Traces of a system run: one for each question and condition, each once."""
    manifest, tables = load_export(spark, uri)
    traces = tables["traces"]
    expected = manifest["meta"]["questions"] * manifest["meta"]["conditions"]
    n = traces.agg(F.count("*").alias("n"), F.count_distinct("question_id", "condition").alias("d")).first()
    if n["n"] != expected or n["d"] != expected:
        raise ArtifactError(f"{expected} traces are expected")
    return manifest, traces
