"""Where events go: files, logs, databases, queues, the event log, dead letters. Network targets are writers that a caller hands in."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cel, workflow


def safe_path(base: str, path: str) -> str:
    """path under base; a path that would leave it is refused."""
    full = posixpath.normpath(posixpath.join(base, path.lstrip("/")))
    if not (full + "/").startswith(posixpath.normpath(base) + "/"):
        raise ValueError(f"{path} leaves {base}")
    return full


def to_files(events: DataFrame, base: str, path: str = "events", by: list[str] | None = None, form: str = "json") -> None:
    """Lines of JSON, CSV or Parquet in folders by columns; Spark's committer makes each write all or nothing."""
    writer = events.write.mode("append").partitionBy(*(by or []))
    getattr(writer, form)(safe_path(base, path))


def log_lines(events: DataFrame, template: str, payload: str = "data") -> DataFrame:
    """(position, line) of a log action."""
    return events.select("position", workflow.template(template, events.columns, payload).alias("line"))


def projected(events: DataFrame, mapping: dict[str, str], payload: str = "data") -> DataFrame:
    """Columns by paths of the event, for a database action."""
    scope = cel.event_scope(events.columns, payload)
    return events.select(*[scope(["event", *path.removeprefix("event.").split(".")]).alias(name) for name, path in mapping.items()])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after rows: the last row of each key by order replaces or adds; rows in the table that aren't named stay."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in table.columns if c not in keys]), order).alias("last_of_upsert")).select(*keys, "last_of_upsert.*").select(*table.columns)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def queue_rows(events: DataFrame, topic: str, key: str, headers: dict[str, str] | None = None, payload: str = "data") -> DataFrame:
    """topic, key, value and headers as the queue writers take them."""
    scope = cel.event_scope(events.columns, payload)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in (headers or {}).items()]) if headers else F.array().cast("array<struct<key:string,value:binary>>")
    return events.select(F.lit(topic).alias("topic"), scope(["event", *key.removeprefix("event.").split(".")]).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), pairs.alias("headers"))


def to_kafka(rows: DataFrame, servers: str) -> None:
    """Needs the Kafka package on the cluster's class path."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", True).save()


def to_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def delivered(rows: DataFrame, key: str, send: Callable[[pd.DataFrame], list[str | None]]) -> DataFrame:
    """(key, error) of handing batches to send on the executors; a call that raises is the error of its whole batch."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                errors = send(b)
            except Exception as e:  # a failed delivery is a result: it goes to the dead letters
                errors = [f"{type(e).__name__}: {e}"] * len(b)
            yield pd.DataFrame({key: b[key], "error": errors})

    return rows.mapInPandas(run, f"{key} {kind}, error string")


def dead_letters(failed: DataFrame, folder: str) -> None:
    failed.withColumn("error_class", workflow.error_class(F.col("error"))).write.mode("append").parquet(folder)


def retryable(error: Column) -> Column:
    """Whether another attempt may help: timeouts, connections and server errors."""
    return workflow.error_class(error).isin("timeout", "connection", "server_error")
