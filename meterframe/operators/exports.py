"""Batches of CSV exports and their status rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.predicates import from_dict, to_column
from meterframe.plans.spec import QuerySpec, check_shared, definitions, named_groups, run_together
from meterframe.session import materialize
from meterframe.sources.sinks import write_bucket_csv

# Fixed names of the export states.
ACTIVE = ("queued", "running")
COMPLETED = ("completed",)
NEEDS_ACTION = ("failed", "canceled")


def run_exports(
    spark: SparkSession, specs: list[tuple[str, str]], events: DataFrame, meters: DataFrame, folder: str
) -> DataFrame:
    """Run each `(id, spec JSON)` into `folder/id`; returns status rows.

    All bucket specs share one scan of the events, whose result is written once. One
    failing export does not stop the others, and a repeated id overwrites its own output,
    so the batch can be run again.
    """
    parsed: list[tuple[str, QuerySpec]] = []
    failed: dict[str, str] = {}
    for key, text in specs:
        try:
            parsed.append((key, QuerySpec.from_json(text)))
        except Exception as error:  # any failure becomes this export's status
            failed[key] = _first_line(error)
    known = definitions([spec for _, spec in parsed], meters)
    sound = []
    for key, spec in parsed:
        try:
            check_shared(spec, known)
            to_column(from_dict(spec.filter), events.columns)
            sound.append((key, spec))
        except Exception as error:
            failed[key] = _first_line(error)
    shared = materialize(run_together(sound, events, meters), "export-rows")
    done: dict[str, str] = {}
    for key, spec in sound:
        meter, path = known[(spec.workspace, spec.meter)], f"{folder}/{key}"
        try:
            write_bucket_csv(
                named_groups(shared.filter(F.col("spec") == key), spec),
                path,
                spec.meter,
                spec.bucket_size,
                meter["aggregation"],
                meter["unit"],
                list(spec.group_by),
                single_file=spec.limit is not None,
            )
            done[key] = path
        except Exception as error:
            failed[key] = _first_line(error)
    statuses = [
        (key, "completed" if key in done else "failed", done.get(key), failed.get(key)) for key, _ in specs
    ]
    return spark.createDataFrame(statuses, "id string, status string, path string, error string")


def _first_line(error: Exception) -> str:
    return str(error).splitlines()[0]


def export_status(jobs: DataFrame) -> DataFrame:
    """Active, completed and needs-action counts."""
    status = F.col("status")
    return jobs.agg(
        F.count_if(status.isin(*ACTIVE)).alias("active"),
        F.count_if(status.isin(*COMPLETED)).alias("completed"),
        F.count_if(status.isin(*NEEDS_ACTION)).alias("needs_action"),
    )
