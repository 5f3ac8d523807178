"""Review logs, rate limits, sessions and queues, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def current_reviews(log: DataFrame, run: str, question: str, event: str) -> DataFrame:
    """L1: the active review of each question: the last of an append-only log, with its predecessor."""
    by = Window.partitionBy(run, question).orderBy(event)
    marked = log.withColumn("previous", F.lag(event).over(by)).withColumn("__last", F.lead(event).over(by).isNull())
    return marked.filter("__last").drop("__last")


def one_decision(log: DataFrame, run: str, decision: Column, event: str) -> DataFrame:
    """The one decision in force for each run and its revision number, whoever wrote at the same time.

    The log is append-only and its events are ordered, so what a row lock would
    serialise is an aggregation by run: the last event decides.
    """
    return log.groupBy(run).agg(F.max_by(decision, event).alias("decision"), F.max(event).alias(event), F.count("*").alias("revision"))


ACTIONS = "run string, question string, event long, action string, verdict string, expected long"
OUTCOME = "run string, question string, event long, outcome string, active long"


def fold(stack: list[tuple[int, str]], event: int, action: str, verdict: str | None, expected: int | None) -> str:
    """Apply one action to a question's stack of active reviews; the outcome's name.

    A review with a stale ``expected`` id is a conflict, the verdict that is
    already active a replay. A rollback takes the active review off, so its
    predecessor is active again; of an empty stack it is a replay.
    """
    active = stack[-1] if stack else None
    if action == "rollback":
        if active is None:
            return "replay"
        if expected is not None and expected != active[0]:
            return "conflict"
        stack.pop()
        return "rolled_back"
    if active is not None and active[1] == verdict:
        return "replay"
    if expected is not None and expected != (active[0] if active else 0):
        return "conflict"
    stack.append((event, verdict or ""))
    return "accepted"


def in_order(df: DataFrame, keys: list[str], order: list[str | Column], schema: str, start: Callable[[tuple], Any], step: Callable[[Any, tuple], tuple]) -> DataFrame:
    """Rows of each key (the first columns) in order through ``step(state, row)``, which gives a row of ``schema``.

    Keys are hashed to tasks and rows sorted there, so a task holds one batch
    and the state of one key, however many rows the key has. A null is a key.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    key, state = row[:n], start(row[:n])
                rows.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    fields = StructType.fromDDL(schema)
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def replay(log: DataFrame) -> DataFrame:
    """L1, L2: the outcome of every action of a log, in event order within each question.

    The state is one stack of active reviews for each (run, question), however
    many actions it has; questions run in parallel.
    """

    def step(stack: list, row: tuple) -> tuple:
        run, question, event, action, verdict, expected = row
        outcome = fold(stack, event, action, verdict, expected)
        return run, question, event, outcome, stack[-1][0] if stack else None

    shaped = log.select("run", "question", "event", "action", "verdict", "expected")
    return in_order(shaped, ["run", "question"], ["event"], OUTCOME, lambda _: [], step)


def promote(reviews: DataFrame, review: str, verdict: str, case: Column, existing: DataFrame | None = None) -> DataFrame:
    """L3: reviews as new evaluation cases, one for each (review, case type): approvals give golden cases, others negative ones."""
    cases = reviews.filter(F.col(verdict).isin("approve", "reject", "needs_edit")).select(F.col(review).alias("source_review_id"), case.alias("case_type"))
    kept = cases.filter(((F.col("case_type") == "golden")) | (F.col("case_type") == "negative")).distinct()
    return kept if existing is None else kept.join(existing.select("source_review_id", "case_type"), ["source_review_id", "case_type"], "left_anti")


def request_counts(events: DataFrame, client: str, bucket: str, at: Column, seconds: int = 60) -> DataFrame:
    """L4 without admission: requests of the client and bucket in the last ``seconds``, itself included."""
    by = Window.partitionBy(client, bucket).orderBy("__at").rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return events.withColumn("__at", at).withColumn("recent", F.count("*").over(by)).drop("__at")


def admitted(events: DataFrame, client: str, bucket: str, at: Column, event: str, limits: dict[str, int], default: int = 120, seconds: int = 60) -> DataFrame:
    """L4: sliding-log rate limit; rejected requests do not enter the window, and one without a time is rejected.

    The state of a client and bucket is its window, so at most ``limit`` times.
    """
    shaped = events.select(F.col(client).cast("string").alias("client"), F.col(bucket).cast("string").alias("bucket"), at.cast("long").alias("at"), F.col(event).cast("long").alias("event"))

    def step(window: deque, row: tuple) -> tuple:
        who, where, t, number = row
        while window and t is not None and window[0] <= t - seconds * 1_000_000:
            window.popleft()
        ok = t is not None and len(window) < limits.get(where, default)
        if ok:
            window.append(t)
        return who, where, number, ok

    return in_order(shaped, ["client", "bucket"], ["at", "event"], "client string, bucket string, event long, admitted boolean", lambda _: deque(), step)


def live_sessions(sessions: DataFrame, created: Column, now: Column, seconds: float = 1800) -> DataFrame:
    """Sessions no older than their time to live."""
    return sessions.filter(now - created <= seconds)


def queue_outcome(tasks: DataFrame, fails: Column, retries: str, most: int = 3) -> DataFrame:
    """Processed, retried or dead after one pass over a queue; a retry counts up."""
    state = F.when(~fails, "processed").when(F.col(retries) < most, "retry").otherwise("dead_letter")
    return tasks.withColumn("outcome", state).withColumn(retries, F.when(F.col("outcome") == "retry", F.col(retries) + 1).otherwise(F.col(retries)))


def queue_stats(outcomes: DataFrame) -> DataFrame:
    """Counters; every failure counts, retried or dead."""
    n = lambda s: F.count_if(F.col("outcome").isin(*s))
    return outcomes.agg(n(["retry"]).alias("queued"), n(["processed"]).alias("processed"), n(["retry", "dead_letter"]).alias("failed"), n(["dead_letter"]).alias("dead_letter"))


def route_queue(tasks: DataFrame, path: str, checkpoint: str, fails: Column, retries: str, most: int = 3):
    """L6 as a stream: each batch of tasks goes to the folders of its outcomes, once for each batch number.

    A batch that is run again after a failure overwrites its own folder, so no
    task is routed twice.
    """

    def route(batch: DataFrame, number: int) -> None:
        queue_outcome(batch, fails, retries, most).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    return tasks.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(tasks: DataFrame, fails_at: Column, retries: str, most: int = 3) -> DataFrame:
    """L6 until the queue is empty: a task that fails its first ``fails_at`` tries (null: always) ends processed or dead."""
    always = fails_at.isNull()
    tries = F.lit(most) - F.col(retries) + 1
    dead = always | (fails_at >= tries)
    return tasks.withColumn("attempts", F.when(dead, tries).otherwise(fails_at + 1)).withColumn("outcome", F.when(dead, "dead_letter").otherwise("processed"))
