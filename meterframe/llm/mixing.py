"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks. Its i-th block (from 0) may not start before slot
floor(i / w) and must be placed before slot ceil((i + 1) / w), for a target weight w; among
the released blocks the one with the earliest deadline takes the slot. With weights that add up
to one this places every block in its window, so after any number of slots each source is
less than one block away from its share.

Weights are exact fractions: a given weight counts as the number that its double stands for,
over the exact sum. So the schedule never drifts from the targets, however long it runs. It is
computed once over block numbers, of which there are at most `MAX_BLOCKS` and one per source
(blocks grow beyond that); totals and block numbers are all that passes through the driver, and
documents are placed where they are.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import parallelism

BLOCK_CHARS = 1 << 16
MAX_BLOCKS = 1 << 20
TEMPER = 0.5
NULL_SOURCE = "\u0000"


def exact_shares(weights: dict[str, float]) -> dict[str, Fraction]:
    """Each source's share of the slots; the shares add up to one without rounding."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive")
    exact = {name: Fraction(w) for name, w in weights.items()}
    total = sum(exact.values())
    return {name: w / total for name, w in exact.items()}


def window(block: int, share: Fraction) -> tuple[int, int]:
    """Release slot (inclusive) and deadline (exclusive) of a source's block."""
    part, whole = share.numerator, share.denominator
    return block * whole // part, -(-(block + 1) * whole // part)


def schedule(shares: dict[str, Fraction], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """For each source the slot, release and deadline of its blocks, by earliest deadline first.

    `blocks` are the sources' numbers of blocks. Slots in which no block is released stay empty.
    """
    waiting = [(0, name, 0) for name in sorted(shares) if blocks.get(name, 0) > 0]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []  # (deadline, source, block, release)
    placed: dict[str, list[tuple[int, int, int]]] = {name: [] for name in shares}
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (window(block, shares[name])[1], name, block, release))
        deadline, name, block, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError(f"block {block} of {name!r} missed its deadline")
        placed[name].append((slot, release, deadline))
        if block + 1 < blocks[name]:
            heapq.heappush(waiting, (window(block + 1, shares[name])[0], name, block + 1))
        slot += 1
    return placed


def tempered(totals: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    """Target weights by the power of each source's size, which lifts small sources."""
    raw = {name: float(max(1, size)) ** power for name, size in totals.items()}
    whole = sum(raw.values())
    return {name: value / whole for name, value in raw.items()}


def mix(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of `documents` and the struct `mix`: block, slot, release, deadline, offset.

    A source's documents stand in the order of a hash; `offset` is the number of characters
    before a document, `block` the block of `block_chars` characters (or of 1 / `MAX_BLOCKS` of all
    characters, if that is more) in which it starts. Slots
    order the blocks of all sources. The target weights default to the sources' sizes to the
    power 0.5. Nothing is dropped or repeated: when a source has no blocks left, its slots stay
    empty and the rest goes on in its order.

    A null source is a source of its own (key None in `weights`); sources that `weights` leaves
    out come after all slots (slot null). A null text has no characters. Repeated rows are
    placed each. A column that is already called `mix` is replaced.
    """
    spark = documents.sparkSession
    rows = documents.drop("mix")
    kept = rows.columns
    name = F.coalesce(F.col("source"), F.lit(NULL_SOURCE))
    order = F.xxhash64("doc_id", "text")
    bits = max(1, (4 * parallelism(spark) - 1).bit_length())
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    rows = rows.select(F.struct(*kept).alias("__doc"), name.alias("__source"), order.alias("__order"), chars.alias("__chars"))
    rows = rows.withColumn("__part", F.shiftright("__order", 64 - bits))

    # Characters before each (source, hash range): two-level running sums, so that no source
    # is summed in one task.
    parts = rows.groupBy("__source", "__part").agg(F.sum("__chars").alias("part_chars"))
    earlier = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("__source").alias("start_source"),
        F.col("__part").alias("start_part"),
        F.coalesce(F.sum("part_chars").over(earlier), F.lit(0)).alias("start"),
    )
    totals = {r["__source"]: r["chars"] for r in parts.groupBy("__source").agg(F.sum("part_chars").alias("chars")).collect()}
    if weights is None:
        targets = tempered(totals)
    else:
        targets = {NULL_SOURCE if k is None else k: v for k, v in weights.items()}
    block_chars = max(block_chars, -(-sum(totals.values()) // MAX_BLOCKS))
    # A document without characters may start where its source ends.
    blocks = {n: chars // block_chars + 1 for n, chars in totals.items()}
    placed = schedule(exact_shares(targets), blocks)
    if any(own and own[-1][2] >= 1 << 63 for own in placed.values()):
        raise ValueError("a target weight is too small for the size of its source")
    table = spark.createDataFrame(
        [(n, *([list(column) for column in zip(*own)] or [[], [], []])) for n, own in sorted(placed.items())],
        "plan_source string, slots array<bigint>, releases array<bigint>, deadlines array<bigint>",
    )

    within = Window.partitionBy("__source", "__part").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__before", F.coalesce(F.sum("__chars").over(within), F.lit(0)))
    same = (F.col("__source") == F.col("start_source")) & (F.col("__part") == F.col("start_part"))
    offset = F.col("start") + F.col("__before")
    at = (F.col("__block") + 1).cast("int")
    result = (
        local.join(starts, same)
        .withColumn("__offset", offset)
        .withColumn("__block", _div(offset, F.lit(block_chars)))
        .join(F.broadcast(table), F.col("__source") == F.col("plan_source"), "left")
        .withColumn(
            "mix",
            F.struct(
                F.col("__block").alias("block"),
                F.element_at("slots", at).alias("slot"),
                F.element_at("releases", at).alias("release"),
                F.element_at("deadlines", at).alias("deadline"),
                F.col("__offset").alias("offset"),
            ),
        )
    )
    return result.select(*[F.col("__doc")[c].alias(c) for c in kept], "mix")


def _div(value: Column, by: Column) -> Column:
    """Whole-number division of non-negative numbers."""
    return ((value - value % by) / by).cast("bigint")


def in_order(mixed: DataFrame) -> DataFrame:
    """The documents in ranges of slots, sorted by slot, as training reads them; without `mix`."""
    kept = [c for c in mixed.columns if c != "mix"]
    keys = [F.col("mix.slot").asc_nulls_last(), F.col("mix.offset").asc()]
    return mixed.repartitionByRange(parallelism(mixed.sparkSession), *keys).sortWithinPartitions(*keys).select(*kept)


def with_position(ordered: DataFrame, name: str) -> DataFrame:
    """Adds each row's position (from 0, without gaps) in the order in which its files were written.

    For tables that `in_order` made and Spark wrote and read again: a scan deals files to tasks
    by size, so the order is taken from the files' part numbers and the rows' places in them.
    Only the files' names and row counts pass through the driver.
    """
    rows = ordered.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = rows.groupBy("__file").agg(F.count("*").alias("n")).collect()
    starts, start = [], 0
    for file in sorted(files, key=lambda f: _part_number(f["__file"])):
        starts.append((file["__file"], start))
        start += file["n"]
    table = ordered.sparkSession.createDataFrame(starts, "start_file string, start bigint")
    placed = rows.join(F.broadcast(table), F.col("__file") == F.col("start_file"))
    return placed.select(*ordered.columns, (F.col("start") + F.col("__at")).alias(name))


def _part_number(file: str) -> tuple[int, str]:
    """Spark names files part-<task>-...-c<file of the task>; the number outgrows its zeros at 100,000."""
    found = re.match(r"part-(\d+)", file)
    return (int(found[1]) if found else -1), file
