"""Daily ingestion as a stream: turnstile files arriving in a folder become
daily sums by line.

``readStream`` over the folder -> event time from the day-first date ->
watermark -> one-day tumbling window by line, in update mode -> ``foreachBatch``
that writes each micro-batch's changed sums into folders of its own, by day and
``batch_id`` (a retried batch rewrites them, never appends a second copy), and
logs the run; :func:`read_daily` gives the newest sums of every day, open days
included. A batch reads its own sums and what was written for the same days
before, which the watermark bounds, whatever the stream has written in all.
The query
state and progress live in a checkpoint folder under the shared
``spark.checkpoint.dir``, so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.coerce import day_first_text, py_number, py_strip
from ..operators.ingest import INGESTION_SCHEMA, append_log
from ..session import shared_path
from ..sources.files import path_exists

TURNSTILE_STREAM_SCHEMA = T.StructType([
    T.StructField("fecha", T.StringType()),
    T.StructField("linea", T.StringType()),
    T.StructField("estacion", T.StringType()),
    T.StructField("pax_total", T.StringType()),
])


def daily_sums(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming daily sums by line with a watermark on the event day."""
    ts = day_first_text(py_strip(F.col("fecha")))
    value = F.coalesce(py_number(F.col("pax_total")), F.lit(0.0))
    rows = stream.select(ts.alias("ts"), py_strip(F.col("linea")).alias("linea"), value.alias("pax_total"))
    return (
        rows.where(F.col("ts").isNotNull() & F.col("linea").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "linea")
        .agg(F.sum("pax_total").alias("pax_total"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").cast("date").alias("date"), "linea", "pax_total", "rows")
    )


OUT_SCHEMA = "date date, linea string, pax_total double, rows long, batch_id long"


def read_daily(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest sums of every day and line."""
    if not path_exists(spark, out_dir):
        return spark.createDataFrame([], OUT_SCHEMA).drop("batch_id")
    return _newest(spark.read.schema(OUT_SCHEMA).parquet(out_dir))


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("date", "linea").agg(F.max_by(F.struct("pax_total", "rows"), "batch_id").alias("r"))
    return newest.select("date", "linea", "r.pax_total", "r.rows")


def _new_rows(spark: SparkSession, out_dir: str, batch_id: int, days: list[dt.date]) -> int:
    """How many rows the batch has added to the sums of its days, from what is
    written in these days' folders (not by running the stateful plan again)."""
    paths = [f"{out_dir}/date={d.isoformat()}" for d in days]
    if not paths:
        return 0
    rows = spark.read.schema(OUT_SCHEMA).option("basePath", out_dir).parquet(*paths)
    now = F.sum(F.when(F.col("batch_id") == batch_id, F.col("rows")))
    changed = rows.where(F.col("batch_id") <= batch_id).groupBy("date", "linea").agg(
        now.alias("now"), F.max(F.col("batch_id") == batch_id).alias("changed"),
        F.max(F.when(F.col("batch_id") < batch_id, F.struct("batch_id", "rows"))).alias("b"))
    return changed.where("changed").agg(F.coalesce(F.sum(F.col("now") - F.coalesce("b.rows", F.lit(0))), F.lit(0))).first()[0]


def start_daily_ingest(spark: SparkSession, source_dir: str, out_dir: str, log_dir: str | None = None,
                       checkpoint: str | None = None, fmt: str = "csv", sep: str = ";",
                       schema: T.StructType = TURNSTILE_STREAM_SCHEMA, model_tag: str = "stream",
                       available_now: bool = True, name: str = "daily") -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and
    stops. ``name`` and a digest of the checkpoint folder (the stream's state)
    make the run ids of its batches its own."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("sep", sep).option("escape", '"')
    daily = daily_sums(reader.load(source_dir))
    checkpoint = checkpoint or shared_path(spark, "streams", f"{name}_{hashlib.sha1(source_dir.encode()).hexdigest()[:12]}")
    stream_id = f"{name}_{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        seen = Observation()
        batch = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).observe(seen, F.collect_set("date").alias("days"))
        # one file a day; only the day folders of this batch are replaced
        batch.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(out_dir)
        if log_dir:
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            n = _new_rows(s, out_dir, batch_id, sorted(seen.get["days"] or []))
            run = f"stream_{stream_id}_{batch_id}"
            append_log(s.createDataFrame([(run, now.date(), source_dir, n, now, model_tag)], INGESTION_SCHEMA), log_dir, "ingestion_runs", run)

    writer = daily.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
