"""Streaming queries over the events table, run to the end of what there is; their oracles are batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..streaming import folds
from .events import LOG
from .register import query


def _folders(spark) -> tuple[str, str]:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='carelake-')}"
    run = f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/checkpoint"


def _stream(spark, sf_dir):
    """The log as a stream: the events file's folder, that file alone."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.col("user_id") % 4
    source = F.when(k == 0, "epic").when(k == 1, "cerner").when(k == 2, "lab").otherwise("")
    return raw.select(F.col("event_id").alias("position"), F.concat(F.lit("user:"), "user_id").alias("stream_id"), "event_type", source.alias("source"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts"))


def _collected(spark, rows, mode: str):
    out, checkpoint = _folders(spark)
    folds.each_batch(rows, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint, mode).awaitTermination()
    return spark.read.schema(rows.schema.add("batch", IntegerType())).parquet(out)


@query(f"WITH {LOG} SELECT event_type, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS events FROM log GROUP BY 1, 2")
def stream_statistics(spark, sf_dir):
    """Each batch writes the counts that changed; the last one of a key holds."""
    rows = _collected(spark, folds.statistics(_stream(spark, sf_dir)), "update")
    return rows.groupBy("event_type", "source").agg(F.max_by("events", "batch").alias("events"))


@query(f"""WITH {LOG}, ends AS (SELECT stream_id, arg_max(event_type, (ts, position)) AS kind FROM log WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1) SELECT stream_id FROM ends WHERE kind = 'signup'""")
def stream_last_state(spark, sf_dir):
    """Keyed state in RocksDB, which transformWithState asks for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _collected(spark, folds.active(_stream(spark, sf_dir), ["signup"], ["click"], ["purchase", "error"], "data"), "update")
    finally:  # the session's other queries keep their own
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return rows.groupBy("stream_id").agg(F.max_by("active", "batch").alias("active")).where("active").select("stream_id")
