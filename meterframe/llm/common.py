"""Helpers that several of the text operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"
# Texts can be long: a batch that goes to Python is bounded by bytes, not by rows alone.
BATCH_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Spark serves the archive to the executors; only the driver reads the local file.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="meterframe-code-"), "meterframe_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`mapInArrow` with the package shipped to the workers and batches of bounded size."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_row(df: DataFrame) -> DataFrame:
    """Adds a row number that is unique even where ids are null or repeated.

    It is a function of the scan's partition and position, so a recomputed task gives its
    rows the same numbers.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [value or "" for value in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def range_index(value: Column, cuts: list) -> Column:
    """How many of the sorted `cuts` are at most `value`: a two-level search over literals."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.lit([g[0] for g in groups]), lambda c: c <= value))
    fine = F.element_at(F.array(*[F.lit(g) for g in groups]), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda c: c <= value)))


def sampled_cuts(keys: DataFrame, parts: int, per_part: int = 64) -> tuple[list, list[int]]:
    """Cut points of one column into about `parts` ranges, and a number of salts per range.

    Cuts only balance the work: any cuts give the same result. A range that holds one heavy
    key cannot be cut further and gets salts instead. At most about `parts * per_part` values
    reach the driver.
    """
    column = keys.columns[0]
    total = keys.count()
    wanted = parts * per_part
    sample = keys if total <= wanted else keys.sample(wanted / total, seed=7)
    values = sorted(r[0] for r in sample.filter(F.col(column).isNotNull()).collect())
    cuts = sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []
    counts = [0] * (len(cuts) + 1)
    at = 0
    for value in values:
        while at < len(cuts) and cuts[at] <= value:
            at += 1
        counts[at] += 1
    share = max(1, len(values) / parts)
    return cuts, [max(1, round(c / share)) for c in counts]
