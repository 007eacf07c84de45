"""Receipts, attempts, the outbox and dead letters as tables: operator views, claims, leases, replays, reviews, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(table: DataFrame, **wanted) -> DataFrame:
    """Rows that equal all given values; values that are null ask for nothing, lists ask for any of theirs."""
    for name, value in wanted.items():
        if value is not None:
            table = table.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return table


def listing(table: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """(a page of rows in order, how many there are in all)."""
    return table.orderBy(*order).offset(offset).limit(limit), table.count()


def receipts(receipt: DataFrame, events: DataFrame, attempts: DataFrame, dead: DataFrame) -> DataFrame:
    """Receipts with how many events, attempts, open attempts and dead letters each has: each side is counted before it is joined."""
    out = receipt
    sides = {"events": events.groupBy("receipt_id").agg(F.count("*").alias("events")), "attempts": attempts.groupBy("receipt_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "queued").alias("queued")), "dead": dead.groupBy("receipt_id").agg(F.count("*").alias("dead_letters"))}
    for side in sides.values():
        out = out.join(side, "receipt_id", "left")
    return out.na.fill(0, ["events", "attempts", "queued", "dead_letters"])


def attempts_view(attempts: DataFrame, outbox: DataFrame, dead: DataFrame) -> DataFrame:
    """Attempts with their message, and their dead letter where there is one."""
    return attempts.join(outbox, "message_id").join(dead.select("attempt_id", "reason"), "attempt_id", "left")


def claimable(outbox: DataFrame, circuits: DataFrame, now: str, limit: int) -> DataFrame:
    """Pending messages that are due and whose endpoint has no open circuit, oldest first. A micro-batch is the only writer, so rows need no locks."""
    at = F.lit(now).cast("timestamp")
    ready = outbox.where((F.col("status") == "pending") & (F.coalesce("scheduled_at", at) <= at))
    return ready.join(circuits.where("mode = 'open'").select("endpoint"), "endpoint", "left_anti").orderBy("created_at", "message_id").limit(limit)


def expired_leases(attempts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(attempts with overdue leases put back to pending, an audit row for each of them)."""
    overdue = (F.col("status") == "leased") & (F.col("lease_until") < F.lit(now).cast("timestamp"))
    back = attempts.withColumns({"status": F.when(overdue, "pending").otherwise(F.col("status")), "lease_until": F.when(~overdue, F.col("lease_until"))})
    return back, attempts.where(overdue).select("attempt_id", F.lit("lease_expired").alias("action"), F.lit(now).cast("timestamp").alias("at"))


def resubmitted(dead: DataFrame, attempts: DataFrame, outbox: DataFrame) -> DataFrame:
    """Messages of active dead letters, ready to be sent once more."""
    return dead.where("status = 'active'").join(attempts.select("attempt_id", "message_id"), "attempt_id").join(outbox, "message_id").select("message_id", "endpoint", "payload", F.lit(0).cast("long").alias("attempts"), F.lit("pending").alias("status"))


def reviewed(pending: DataFrame, decisions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(pending rows with their new status, mappings of those approved): the last decision on an id holds; expired and decided rows stay as they are."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"))
    open_ = (F.col("status") == "pending") & (F.col("expires_at") >= F.lit(now).cast("timestamp"))
    status = F.when(open_ & F.col("decision").isin("approved", "rejected"), F.col("decision")).when((F.col("status") == "pending") & ~open_, "expired").otherwise(F.col("status"))
    out = pending.join(last, "id", "left").withColumn("new_status", status)
    approved = out.where("new_status = 'approved' AND status = 'pending'").select("id", "code", "target")
    return out.drop("status", "decision").withColumnRenamed("new_status", "status"), approved


def patient_search(patients: DataFrame, text: str | None = None, birth_date: str | None = None) -> DataFrame:
    """Patients whose number or names hold the text in any case, born on a day if one is given."""
    out = patients
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "mrn", "family", "given")), F.lit(text.lower())))
    return out.where(F.to_date("birth_date") == F.lit(birth_date).cast("date")) if birth_date else out


def compacted(log: DataFrame, candidates: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots of the candidate streams, the log without their events): a snapshot keeps counts, sums and the last state."""
    own = log.join(candidates.select("stream_id"), "stream_id", "left_semi")
    snapshot = own.groupBy("stream_id").agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"), F.max_by("event_type", "position").alias("last_type"), F.max("position").alias("position"))
    return snapshot, log.join(candidates.select("stream_id"), "stream_id", "left_anti")


def snapshots_due(streams: DataFrame, snapshots: DataFrame, events: int, seconds: int, now: Column) -> DataFrame:
    """Streams with so many events and so many seconds since their last snapshot."""
    state = streams.join(snapshots.select("stream_id", F.col("version").alias("kept"), F.col("at").alias("kept_at")), "stream_id", "left")
    grown = F.col("version") - F.coalesce("kept", F.lit(-1)) >= events
    old = F.col("kept_at").isNull() | (F.unix_micros(now) - F.unix_micros("kept_at") >= seconds * 1_000_000)
    return state.where(grown & old).select("stream_id", "version")


def saga(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of each saga from its steps (saga, n, name) and step results (saga, n, ok): completed, running, or compensated with the steps to undo, last first."""
    both = steps.join(results, ["saga", "n"], "left")
    first_bad = F.min(F.when(~F.col("ok"), F.col("n")))
    done = F.collect_list(F.when(F.col("ok"), F.struct("n", "name")))
    out = both.groupBy("saga").agg(first_bad.alias("failed_at"), F.count("*").alias("steps"), F.count_if(F.coalesce("ok", F.lit(False))).alias("done"), F.array_sort(done).alias("good"))
    undo = F.transform(F.reverse(F.filter("good", lambda x: x["n"] < F.col("failed_at"))), lambda x: x["name"])
    status = F.when(F.col("failed_at").isNotNull(), "compensated").when(F.col("done") == F.col("steps"), "completed").otherwise("running")
    return out.select("saga", status.alias("status"), F.when(F.col("failed_at").isNotNull(), undo).otherwise(F.array().cast("array<string>")).alias("undo"))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Sequence numbers from 1 within each key, for session logs."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
