"""The experiment store: runs, planned questions and events as tables of a folder, and what may be read from them.

One writer appends; a batch of events is checked against what is stored and
written whole or not at all.  Readers get DataFrames.
"""

from __future__ import annotations

import base64
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import events as E
from lodestone.operators import corpus, evaluation
from lodestone.sources import records

#: Kinds of events in the life of a run.
STARTED, ANSWERED, FAILED, FINISHED = "run.started", "question.completed", "question.failed", "run.finished"
RUN = "run_id string, role string, dataset_version string, corpus_version string, config_fingerprint string, registered_at timestamp"
QUESTION = "run_id string, question_id string, position int"
EVENT = "event_id string, occurred_at timestamp, run_id string, trace_id string, question_id string, event_type string, source string, source_version string, payload string"


class StorageError(ValueError):
    """The store refuses what it was given."""


class ConflictError(StorageError):
    """The same identity came with different contents."""


def decode_cursor(cursor: str) -> list:
    """Values of a cursor; anything but a list in base64url JSON is an error."""
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise StorageError("invalid cursor") from e
    if not isinstance(value, list):
        raise StorageError("invalid cursor")
    return value


def encode_cursor(*values) -> str:
    return base64.urlsafe_b64encode(json.dumps([v if isinstance(v, int) else str(v) for v in values]).encode()).decode().rstrip("=")


class Store:
    """A folder with ``runs``, ``run_questions`` and ``trace_events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        uri = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(uri) if records.exists(self.spark, uri) else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", RUN)

    def run_questions(self) -> DataFrame:
        return self._read("run_questions", QUESTION)

    def events(self) -> DataFrame:
        return self._read("trace_events", EVENT + ", sequence bigint, content_hash string")

    # --- writing ---

    def register(self, run: DataFrame, questions: DataFrame) -> bool:
        """Insert a run and its planned questions, or verify that they are there as given; whether they were inserted."""
        keys = [c.split()[0] for c in RUN.split(", ")][:-1]
        ids = [r[0] for r in run.select("run_id").distinct().limit(2).collect()]
        if len(ids) != 1 or not corpus.repeated(questions, ["question_id"]).isEmpty():
            raise StorageError("one run at a time, and each question once")
        have = self.runs().filter(F.col("run_id") == ids[0])
        planned = questions.select(F.lit(ids[0]).alias("run_id"), "question_id", F.col("position").cast("int").alias("position"))
        if not have.isEmpty():
            same = have.select(*keys).exceptAll(run.select(*keys)).isEmpty() and records.content_digest(self.run_questions().filter(F.col("run_id") == ids[0])) == records.content_digest(planned)
            if not same:
                raise ConflictError(f"run {ids[0]} is registered with other contents")
            return False
        planned.write.mode("append").parquet(f"{self.folder}/run_questions")
        run.select(*keys, F.current_timestamp().alias("registered_at")).write.mode("append").parquet(f"{self.folder}/runs")
        return True

    def ingest(self, batch: DataFrame) -> int:
        """Append the events of a batch that are new, in order; how many there were.

        An event that is stored already with the same contents is left out;
        with other contents it is a conflict.  The life cycle is checked over
        stored and new events together (``violations``), and a batch with any
        violation is refused whole.
        """
        names = [c.split()[0] for c in EVENT.split(", ")]
        rows = E.content_hash(batch.select(*names), names)
        once, twice = E.deduplicate(rows)
        have = self.events()
        known = have.select("event_id", F.col("content_hash").alias("stored"))
        both = once.join(known, "event_id", "left")
        if not twice.isEmpty() or not both.filter("stored is not null and stored <> content_hash").isEmpty():
            raise ConflictError("an event id came with different contents")
        fresh = both.filter("stored is null").select(*names, "content_hash")
        last = have.groupBy("run_id").agg(F.max("sequence").alias("last"))
        order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
        fresh = fresh.withColumn("n", F.row_number().over(order)).join(last, "run_id", "left").withColumn("sequence", F.col("n") + F.coalesce("last", F.lit(0))).drop("n", "last")
        stage = f"{self.folder}/.stage-{uuid.uuid4().hex}"
        try:
            fresh.select(*names, "sequence", "content_hash").write.parquet(stage)
            fresh = self.spark.read.parquet(stage)
            n = fresh.count()
            found = violations(have.unionByName(fresh), self.run_questions()).limit(1).collect()
            if found:
                raise StorageError(f"run {found[0]['run_id']}: {found[0]['problem']}")
            if n:
                fresh.write.mode("append").parquet(f"{self.folder}/trace_events")
        finally:
            records.remove(self.spark, stage)
        return n

    def import_export(self, path: str) -> int:
        """Ingest a file of JSON lines whole; a line that is no strict object refuses all.  Importing again changes nothing."""
        lines = self.spark.read.text(path).filter(F.trim("value") != "").withColumn("error", records.json_error(F.col("value")))
        bad = lines.filter("error is not null").limit(1).collect()
        if bad:
            raise StorageError(f"invalid line: {bad[0]['error']}")
        return self.ingest(lines.select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.*"))

    # --- reading ---

    def list_runs(self, limit: int, cursor: str | None = None, role: str | None = None) -> tuple[list[dict], str | None]:
        """A page of runs, newest first, and the cursor of the next one."""
        rows = self.runs() if role is None else self.runs().filter(F.col("role") == role)
        after = None
        if cursor is not None:
            at, run = decode_cursor(cursor)
            after = (F.to_timestamp(F.lit(at)), run)
            rows = rows.filter((F.col("registered_at") < after[0]) | ((F.col("registered_at") == after[0]) & (F.col("run_id") > run)))
        page = [r.asDict() for r in rows.orderBy(F.desc("registered_at"), "run_id").limit(limit + 1).collect()]
        more = page[limit - 1] if len(page) > limit else None
        return page[:limit], encode_cursor(more["registered_at"].isoformat(), more["run_id"]) if more else None

    def get_run(self, run_id: str) -> dict:
        """A run with its state and counters, recomputed from its events."""
        found = self.runs().filter(F.col("run_id") == run_id).collect()
        if not found:
            raise StorageError(f"no run {run_id}")
        state = project(self.events().filter(F.col("run_id") == run_id), self.run_questions().filter(F.col("run_id") == run_id)).collect()
        return found[0].asDict() | (state[0].asDict() if state else {})

    def list_questions(self, run_id: str, limit: int, cursor: str | None = None, failures: bool = False) -> tuple[list[dict], str | None]:
        """A page of a run's questions by position, with their status."""
        rows = question_states(self.events().filter(F.col("run_id") == run_id), self.run_questions().filter(F.col("run_id") == run_id))
        if failures:
            rows = rows.filter("status = 'failed'")
        if cursor is not None:
            (at,) = decode_cursor(cursor)
            if not isinstance(at, int) or at < 0:
                raise StorageError("invalid cursor")
            rows = rows.filter(F.col("position") > at)
        page = [r.asDict() for r in rows.orderBy("position").limit(limit + 1).collect()]
        return page[:limit], encode_cursor(page[limit - 1]["position"]) if len(page) > limit else None

    def trace(self, run_id: str, question_id: str) -> DataFrame:
        """All events of a question in their order."""
        return self.events().filter((F.col("run_id") == run_id) & (F.col("question_id") == question_id)).orderBy("sequence")

    def compare(self, baseline: str, candidate: str, metrics: tuple[str, ...]) -> DataFrame:
        """Metric means of two compatible runs and their difference."""
        runs = {r["run_id"]: r for r in self.runs().filter(F.col("run_id").isin(baseline, candidate)).collect()}
        if len(runs) < len({baseline, candidate}):
            raise StorageError("no such run")
        differ = [c for c in ("role", "dataset_version", "corpus_version") if runs[baseline][c] != runs[candidate][c]]
        if differ:
            raise StorageError(f"runs differ in {', '.join(differ)}")
        value = lambda m: F.get_json_object("payload", f"$.metrics.{m}").cast("double")
        means = self.events().filter((F.col("event_type") == ANSWERED) & F.col("run_id").isin(baseline, candidate)).groupBy("run_id").agg(*[F.avg(value(m)).alias(m) for m in metrics])
        return evaluation.metric_deltas(means, baseline, candidate, list(metrics))

    def health(self) -> dict:
        """Whether the tables can be read."""
        try:
            return {"status": "ok", "runs": self.runs().count()}
        except Exception as e:  # noqa: BLE001 - whatever the storage says is the answer
            return {"status": "unavailable", "error": type(e).__name__}


def violations(events: DataFrame, planned: DataFrame) -> DataFrame:
    """``run_id, problem``: events that break the life of their run.

    A run starts once and first; its questions come in planned order, none
    behind a failed one; it finishes once, with a summary that counts its
    questions, and nothing comes behind that.  ``events`` has ``sequence``.
    """
    order = Window.partitionBy("run_id").orderBy("sequence")
    is_question = F.col("event_type").isin(ANSWERED, FAILED)
    rows = events.join(planned.select("run_id", "question_id", "position"), ["run_id", "question_id"], "left")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.sum(is_question.cast("int")).over(before)).withColumn("last", F.max(F.when(is_question, F.col("position"))).over(before)).withColumn("broken", F.max((F.col("event_type") == FAILED).cast("int")).over(before)).withColumn("over", F.max((F.col("event_type") == FINISHED).cast("int")).over(before)).withColumn("begun", F.max((F.col("event_type") == STARTED).cast("int")).over(before))
    counted = F.get_json_object("payload", "$.completed").cast("int") + F.coalesce(F.get_json_object("payload", "$.failed").cast("int"), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    problem = (
        F.when(zero("over") == 1, "an event comes behind the end")
        .when((F.col("event_type") == STARTED) & (zero("begun") == 1), "the run starts twice")
        .when((F.col("event_type") != STARTED) & (zero("begun") == 0), "an event comes before the start")
        .when(is_question & F.col("position").isNull(), "a question is not planned")
        .when(is_question & (zero("broken") == 1), "a question comes behind a failure")
        .when(is_question & (F.col("position") != F.coalesce(F.col("last") + 1, F.lit(0))), "a question is out of order")
        .when((F.col("event_type") == FINISHED) & ~F.coalesce(counted == zero("seen"), F.lit(False)), "the summary does not count the questions")
    )
    return rows.withColumn("problem", problem).filter("problem is not null").select("run_id", "sequence", "problem").orderBy("run_id", "sequence")


def question_states(events: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned questions with ``status`` and ``latency_ms`` from their events."""
    done = events.filter(F.col("event_type").isin(ANSWERED, FAILED)).select("run_id", "question_id", F.when(F.col("event_type") == ANSWERED, "completed").otherwise("failed").alias("status"), F.get_json_object("payload", "$.latency_ms").cast("double").alias("latency_ms"))
    return planned.join(done, ["run_id", "question_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def project(events: DataFrame, planned: DataFrame) -> DataFrame:
    """``run_id, state, completed, failed, pending, n_events`` of each run."""
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    life = events.groupBy("run_id").agg(has(STARTED).alias("s"), has(FINISHED).alias("f"), has(FAILED).alias("x"), F.count("*").alias("n_events"))
    counts = question_states(events, planned).groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")])
    state = F.when(F.coalesce("x", F.lit(0)) == 1, "failed").when(F.coalesce("f", F.lit(0)) == 1, "completed").when(F.coalesce("s", F.lit(0)) == 1, "running").otherwise("registered")
    return counts.join(life, "run_id", "left").select("run_id", state.alias("state"), F.col("completed"), F.col("failed"), F.col("pending"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def observations(results: DataFrame, observed: DataFrame) -> DataFrame:
    """Hand each result the embedding that was observed for its text, first in first out; a result without one gets null.

    ``results``: ``query_hash, position``; ``observed``: ``query_hash,
    recorded, embedding_ms``.
    """
    mine = Window.partitionBy("query_hash").orderBy("position")
    theirs = Window.partitionBy("query_hash").orderBy("recorded")
    return results.withColumn("nth", F.row_number().over(mine)).join(observed.withColumn("nth", F.row_number().over(theirs)).select("query_hash", "nth", "embedding_ms"), ["query_hash", "nth"], "left").drop("nth")


def trace_start(questions: DataFrame, run_id: str) -> DataFrame:
    """Each question with a trace of its own in the run; the same run and question give the same trace."""
    return questions.withColumn("run_id", F.lit(run_id)).withColumn("trace_id", F.sha2(F.concat_ws("\u0001", F.lit(run_id), F.col("question_id").cast("string")), 256))


def component_events(rows: DataFrame, component: str, version: str, payload: Column, error: Column | None = None) -> DataFrame:
    """One completed or failed event of a component for each row of a trace."""
    failed = error.isNotNull() if error is not None else F.lit(False)
    kind = F.concat(F.lit(f"{component}."), F.when(failed, "failed").otherwise("completed"))
    body = F.when(failed, F.to_json(F.struct((error if error is not None else F.lit(None).cast("string")).alias("error_type")))).otherwise(F.to_json(payload))
    event_id = F.sha2(F.concat_ws("\u0001", "trace_id", kind, F.lit(version)), 256)
    return rows.select(event_id.alias("event_id"), F.current_timestamp().alias("occurred_at"), "run_id", "trace_id", F.col("question_id").cast("string").alias("question_id"), kind.alias("event_type"), F.lit(component).alias("source"), F.lit(version).alias("source_version"), body.alias("payload"))
