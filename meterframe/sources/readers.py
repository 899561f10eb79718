"""Raw event readers: JSON batches and file streams with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.timecalc import from_instant
from meterframe.schema import RAW_EVENT

# On disk `metadata` is a JSON object; reading it as a string keeps its text.
_JSON_SCHEMA = RAW_EVENT.replace("`timestamp` timestamp_ntz", "`timestamp` string")


def rfc3339_to_ntz(text: Column) -> Column:
    """RFC 3339 text with any offset as a UTC value; NULL when absent or malformed."""
    return from_instant(F.try_to_timestamp(F.nullif(F.trim(text), F.lit(""))))


def typed_raw(rows: DataFrame) -> DataFrame:
    """Typed times; `bad_timestamp` marks text that is not a time, which validation rejects."""
    given = F.nullif(F.trim("timestamp"), F.lit(""))
    parsed = rfc3339_to_ntz(F.col("timestamp"))
    return rows.withColumn("bad_timestamp", given.isNotNull() & parsed.isNull()).withColumn("timestamp", parsed)


def read_raw_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw events from JSON: one object per line, or whole arrays with `multi_line`.

    One object per line splits within a file, so prefer it for large inputs.
    """
    reader = spark.read.schema(_JSON_SCHEMA).option("multiLine", multi_line)
    return typed_raw(reader.json(path))


def stream_raw_json(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw events from a folder that JSON files arrive in."""
    reader = spark.readStream.schema(_JSON_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return typed_raw(reader.json(path))


def stream_parquet(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream over a parquet folder, a file, or a glob of either."""
    head, _, name = path.rstrip("/").rpartition("/")
    if not any(mark in name for mark in "*[?{"):
        # As a glob the last part may be a folder or a single file.
        name = f"[{name[0]}]{name[1:]}"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{head}/{name}")
