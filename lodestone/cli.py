"""Command line: prepare a benchmark, build indexes, retrieve, answer, and keep and read the experiment store.

``python -m lodestone.cli COMMAND ...`` under ``spark-submit`` or plain Python.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import diagnostics, pipelines, retrieval
from lodestone.operators.store import EVENT, Store
from lodestone.sources import indexes, records


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *needed: str, **optional):
        p = commands.add_parser(name)
        for n in needed:
            p.add_argument(n)
        for n, default in optional.items():
            p.add_argument("--" + n.replace("_", "-"), default=default, type=type(default) if default is not None else str)
        return p

    add("prepare", "source", "corpus", "dataset", level=None, seed="frozen-v1", count=1000, version="v1")
    add("index", "corpus", "folder")
    add("retrieve", "folder", "questions", "out", k=10)
    add("answer", "corpus", "folder", "questions", "out", k=10)
    add("import", "store", "export")
    add("list", "store", limit=20, cursor=None, role=None)
    add("inspect", "store", "run")
    add("compare", "store", "baseline", "candidate", metrics="mrr")
    add("provenance", folder=".")
    return top


def _chunks(spark: SparkSession, corpus: str) -> DataFrame:
    return records.load_corpus(spark, corpus)


def _retriever(spark: SparkSession, folder: str, k: int):
    index = indexes.load(spark, folder, "lexical")
    return lambda questions: retrieval.bm25_indexed(index, questions, k)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "prepare":
        chosen, counts, _ = records.select_source(records.read_source(spark, args.source), args.level, args.seed, args.count)
        out = counts | records.prepare_benchmark(chosen, args.corpus, args.dataset, args.version)
    elif args.command == "index":
        out = indexes.build_lexical(pipelines.search_text(_chunks(spark, args.corpus)), args.folder)
    elif args.command == "retrieve":
        hits = _retriever(spark, args.folder, args.k)(spark.read.parquet(args.questions))
        hits.write.parquet(args.out)
        out = {"hits": spark.read.parquet(args.out).count()}
    elif args.command == "answer":
        rows = pipelines.evidence_run(spark.read.parquet(args.questions), _retriever(spark, args.folder, args.k), _chunks(spark, args.corpus))
        rows.write.parquet(args.out)
        out = {r["state"]: r["count"] for r in spark.read.parquet(args.out).groupBy("state").count().collect()}
    elif args.command == "import":
        out = {"events": Store(spark, args.store).import_export(args.export), "schema": EVENT}
    elif args.command == "list":
        page, cursor = Store(spark, args.store).list_runs(args.limit, args.cursor, args.role)
        out = {"runs": page, "next": cursor}
    elif args.command == "inspect":
        out = Store(spark, args.store).get_run(args.run)
    elif args.command == "compare":
        out = {r["metric"]: r["delta"] for r in Store(spark, args.store).compare(args.baseline, args.candidate, tuple(args.metrics.split(","))).collect()}
    else:
        out = diagnostics.provenance(args.folder)
    print(json.dumps(out, default=str, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
