"""Daily ingestion with a run log, exact-size repeatable sampling, log tables.

A log table is a Parquet folder with one subfolder per append (its batch id):
a retried append rewrites its own subfolder, an append never touches another
one's rows, and reading keeps the newest row of each key. Every few appends the
subfolders are compacted (:mod:`railyard.sources.folders`), so reading opens a
bounded number of them.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import light_names
from ..sources.files import path_exists
from ..sources.folders import Folders

INGESTION_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_date", T.DateType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("rows_loaded", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("model_tag", T.StringType()),
])

INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("reported_at", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("target_team", T.StringType()),
    T.StructField("raw_llm_output", T.StringType()),
])

TIME_OF = {"ingestion_runs": "created_at", "incidents": "reported_at"}
LOG_TABLES = {"ingestion_runs": (INGESTION_SCHEMA, "run_id"), "incidents": (INCIDENT_SCHEMA, "incident_id")}

@dataclass(frozen=True)
class PipelineConfig:
    run_date: str
    limit_rows: int | None = None  # sampling only where a caller asks for it
    key: str | None = None  # unique column that sampling orders by
    model_tag: str = "phase3-week9"  # fixed value


SAMPLE_BUCKETS = 4  # hex digits of the hash that make a bucket


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones for the same data and seed:
    those whose ``md5(key:seed)`` is smallest. ``key`` is a unique column, so
    copies of a value are drawn independently; the call refuses to run without.

    Two scans: one counts the rows of each bucket (the hash's first four digits),
    the other keeps whole buckets before the n-th row and the first rows of the
    bucket that holds it. What is kept is ordered bucket by bucket, so no task
    merges n rows."""
    if key not in df.columns:
        raise ValueError(f"sampling needs a unique key column; {key!r} is none of {df.columns}")
    h = F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{seed}")).cast("binary"))
    hashed = df.withColumn("_h", F.coalesce(h, F.lit("")))
    bucket = F.substring("_h", 1, SAMPLE_BUCKETS)
    counts = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))  # at most 65,537 rows
    upto = counts.withColumn("s", F.sum("c").over(Window.orderBy("b")))
    edge = upto.where((F.col("s") >= n) & (F.col("s") - F.col("c") < n)).select("b", (F.col("s") - F.col("c")).alias("before")).first()
    if edge is None:  # fewer than n rows
        return df
    kept = hashed.withColumn("_b", bucket).where(F.col("_b") <= edge.b)
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", f"`{key}`"))
    return kept.withColumn("_i", place).where((F.col("_b") < edge.b) | (F.col("_i") <= n - edge.before)).drop("_h", "_b", "_i")


def run_id(run_date: str, run_ts: dt.datetime) -> str:
    return f"run_{run_date}_{run_ts.strftime('%Y%m%dT%H%M%SZ')}"


def init_log_tables(spark: SparkSession, log_dir: str) -> None:
    """Create the empty log tables when absent."""
    for name, (schema, _) in LOG_TABLES.items():
        path = f"{log_dir}/{name}"
        if not path_exists(spark, path):
            stored = stored_schema(schema)
            spark.createDataFrame([], stored).drop("_batch").write.mode("overwrite").parquet(f"{path}/_batch=created")


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_appended", T.TimestampNTZType()), T.StructField("_batch", T.StringType())])


def append_log(df: DataFrame, log_dir: str, table: str, batch_id: str, appended_at: dt.datetime | None = None) -> None:
    """Append rows to a log table. ``batch_id`` names the append: a retry with
    the same id rewrites its own folder, so it leaves one copy; no other
    append's rows are changed. ``appended_at`` (default: now, UTC) decides
    between rows of one key and time."""
    schema, _ = LOG_TABLES[table]
    path = f"{log_dir}/{table}"
    write_batch(df, path, schema, batch_id, appended_at)
    Folders(df.sparkSession, path, stored_schema(schema)).compact()


def write_batch(df: DataFrame, path: str, schema: T.StructType, batch_id: str, appended_at: dt.datetime | None = None) -> None:
    """The folder of one append."""
    if not re.fullmatch(r"[A-Za-z0-9_.:-]+", batch_id):
        raise ValueError(f"a batch id has letters, digits and ._:- only: {batch_id!r}")
    at = appended_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], F.lit(at).cast("timestamp_ntz").alias("_appended"))
    out.write.mode("overwrite").parquet(f"{path}/_batch={batch_id.replace(':', '%3A')}")


def read_log(spark: SparkSession, log_dir: str, table: str) -> DataFrame:
    """:func:`newest` of all appends. An absent table is empty."""
    schema, _ = LOG_TABLES[table]
    path = f"{log_dir}/{table}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return newest(Folders(spark, path, stored_schema(schema)).rows(), table)


#: Bytes of rows that a task orders at most, those of a row beside its texts, and groups of keys they are added up for.
TASK_BYTES, ROW_BYTES, KEY_GROUPS = 128 << 20, 300, 4096


def newest(rows: DataFrame, table: str) -> DataFrame:
    """The newest row of each key (by its own time, then by append, then by
    batch id and value); rows without a key are all kept.

    One scan adds up the bytes of the rows, so that each task orders
    ``TASK_BYTES`` of them, however large the files are. Keys with more rows
    than that are first spread over all tasks."""
    schema, key = LOG_TABLES[table]
    names = schema.fieldNames()
    order = F.struct(F.coalesce(F.col(TIME_OF[table]), F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz")), "_appended", "_batch", F.xxhash64(*names))
    keyed = rows.where(F.col(key).isNotNull())
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))
    width = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in rows.dtypes if kind == "string"), F.lit(ROW_BYTES)).cast("long")
    sizes = keyed.groupBy(group.alias("g")).agg(F.sum(width).alias("n")).collect()  # at most KEY_GROUPS rows
    parts = max(1, -(-sum(r.n for r in sizes) // TASK_BYTES))
    large = [r.g for r in sizes if r.n > TASK_BYTES]
    if large:
        spread = keyed.where(group.isin(large)).withColumn("_part", F.floor(F.rand(42) * parts)).repartition(parts, key, "_part")
        best = spread.groupBy(key, "_part").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        keyed = keyed.where(~group.isin(large)).unionByName(best)
    best = keyed.repartition(parts, key).groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")
    return best.unionByName(rows.where(F.col(key).isNull()).select(*names))


def ingest_daily_batch(source: DataFrame, cfg: PipelineConfig, log_dir: str, source_file: str,
                       run_ts: dt.datetime) -> DataFrame:
    """Load (names stripped and lower-cased; sampled only if the caller set a
    limit and a key), count, and log the run. Returns the run record."""
    spark = source.sparkSession
    df = light_names(source)
    if cfg.limit_rows is not None:
        if cfg.key is None:
            raise ValueError("sampling needs PipelineConfig.key, a unique column")
        df = sample_rows(df, cfg.limit_rows, cfg.key)
    n = df.count()
    run = run_id(cfg.run_date, run_ts)
    record = spark.createDataFrame(
        [(run, dt.date.fromisoformat(cfg.run_date), source_file, n, run_ts, cfg.model_tag)],
        INGESTION_SCHEMA,
    )
    init_log_tables(spark, log_dir)
    append_log(record, log_dir, "ingestion_runs", run)
    return record


def example_incidents(spark: SparkSession, run_date: str, reported_at: dt.datetime) -> DataFrame:
    """The two example incidents used to check the incident log."""
    # The example incident records.
    rows = [
        (f"INC-{run_date}-0001", reported_at, "n8n_demo",
         "15-minute delay on Line B at Carlos Pellegrini due to a mechanical issue.",
         "infrastructure", "medium", "B", "Carlos Pellegrini", "infrastructure_maintenance", None),
        (f"INC-{run_date}-0002", reported_at, "n8n_demo",
         "Overcrowding reported on Line D at 9 de Julio during peak hour.",
         "overcrowding", "medium", "D", "9 de Julio", "operations_control", None),
    ]
    return spark.createDataFrame(rows, INCIDENT_SCHEMA)


def latest_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    """The k most recent runs (a top-k, not a sort of the whole log)."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(k)
