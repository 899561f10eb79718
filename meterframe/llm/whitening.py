"""Embedding whitening over weighted multiplicities.

Vectors become whole numbers, and equal ones are one row with a count. Sums and the covariance are
taken over those rows with their counts as weights: every task multiplies its centred rows into one
small matrix (a GEMM per batch), and the matrices are added up on the executors. The eigenvectors of
that matrix, whose size is the dimension's alone, whiten each distinct vector once; the result is
joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import map_batches, parallelism
from meterframe.session import materialize

# The scale and the offset of the whole numbers.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
# Beyond this a scaled entry is no exact whole number in double precision.
EXACT = float(1 << 53)
LONG_MAX = (1 << 63) - 1
# A vector with more than this share of an even partition's rows is joined in salted parts.
HOT_SHARE = 0.25
SALTS = 64


def whole_vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`vec_id`, `x`: the vectors that take part, as arrays of whole numbers."""
    vector = F.col("v")
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < EXACT))
    rows = embeddings.select(
        embeddings[id_column].alias("vec_id"), embeddings[vector_column].cast("array<double>").alias("v")
    )
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(sound)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy().reshape(len(values), -1)


def _summed_arrays(parts: DataFrame) -> dict[int, list]:
    """Adds up rows of (index, array) by index and place; index and place follow from the dimension."""
    spread = parts.select("index", F.posexplode("value").alias("place", "part"))
    sums = spread.groupBy("index", "place").agg(F.sum("part").alias("part"))
    lists = sums.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("all"))
    return {r["index"]: list(r["value"]) for r in lists.select("index", F.col("all.part").alias("value")).collect()}


def totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch, 0), batch.column(1).to_numpy()
                part = (x * w[:, None]).sum(axis=0)
                count += int(w.sum())
                sums = part if sums is None else sums + part
        if sums is not None:
            row = pa.array([[count, *sums.tolist()]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), row], ["index", "value"])

    found = _summed_arrays(map_batches(distinct.select("x", "weight"), add, "index int, value array<long>"))
    if not found:
        return 0, []
    return found[0][0], found[0][1:]


def products(rows: DataFrame, column: str, matrix_of) -> np.ndarray:
    """The sum over all rows of weight * outer(row, row), for rows made by `matrix_of` from a column."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = matrix_of(_matrix(batch, 0))
                part = made.T @ (made * batch.column(1).to_numpy()[:, None].astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            index = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([index, pa.array(total.tolist(), pa.list_(pa.float64()))], ["index", "value"])

    found = _summed_arrays(map_batches(rows.select(column, "weight"), multiply, "index int, value array<double>"))
    return np.array([found[i] for i in range(len(found))])


def _deviations(x: np.ndarray, count: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S)^2; null where a sum does not fit into a long."""
    most = max(count * max(abs(int(x.min())), abs(int(x.max()))), int(np.abs(sums).max()))
    if most < 1 << 62:
        apart = x * np.int64(count) - sums
        if x.shape[1] * int(np.abs(apart).max()) ** 2 <= LONG_MAX:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((count * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [d if d <= LONG_MAX else None for d in exact]


def whiten(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    use_counts: bool = True,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes floor(64 c) + 1,000,000. The fit list is all vectors (`use_counts`) or all
    distinct ones; n is its length, `deviation` the exact sum of (n x - S)^2 over the dimensions
    (null if it does not fit into a long). Components are numbered by falling eigenvalue.

    Left out are vectors that are null, empty, hold a null or non-finite entry, hold an entry of
    2^47 or more (no exact whole number), or have another dimension than most (on a tie the
    smaller one counts): no covariance holds two dimensions. A component whose eigenvalue is zero
    to double precision cannot be scaled and is left out, so vectors that are all equal give no
    rows. Null and repeated ids are passed on, one set of rows per input row; other columns are
    not read.
    """
    spark = embeddings.sparkSession
    rows = materialize(whole_vectors(embeddings, id_column, vector_column), "whole-vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == common["size"])
    # The weights in the groups are counts also where the fit list holds each vector once.
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("weight", F.col("copies") if use_counts else F.lit(1).cast("bigint"))
    distinct = materialize(distinct, "distinct-vectors")
    count, sums = totals(distinct)
    whole = np.array(sums, dtype=np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return _centred(x, count, whole)

    covariance = products(distinct, "x", centred) / count
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    trace = float(np.trace(covariance))
    order = [i for i in order if values[i] > trace * len(sums) * np.finfo(float).eps]
    if not order:
        return spark.createDataFrame([], schema)
    turn = vectors[:, order] / np.sqrt(values[order])
    shares = (values[order] / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 0)
                flat = (_centred(x, count, whole) @ turn).ravel()
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(order))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(_deviations(x, count, whole), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    ["x", "weight", "copies", "deviation", "white"],
                )

    made = map_batches(
        distinct.select("x", "weight", "copies"), project, "x array<long>, weight long, copies long, deviation long, white array<double>"
    )
    made = materialize(made, "whitened-vectors")
    spread = products(made, "white", lambda white: white) / count
    error = float(np.abs(spread - np.eye(len(order))).max())

    joined = _joined_back(rows, made)
    explained = F.element_at(F.lit(shares), F.col("component"))
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(count).cast("bigint").alias("n"), "deviation", "whitened"
    ).withColumns({"explained": explained, "identity_error": F.lit(error)})


def _centred(x: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding: the numerator n x - S is exact as long as it fits."""
    if count * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62:
        return (x * np.int64(count) - sums) / count
    return x - (sums.astype(np.longdouble) / count).astype(np.float64)


def _joined_back(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Each row with its vector's result.

    Vectors whose copies outweigh a part of an even partition are at most partitions /
    HOT_SHARE; their rows are dealt over salts, and their results are repeated for each salt.
    """
    spark = rows.sparkSession
    total = made.agg(F.sum("copies")).first()[0]
    heavy = F.col("copies") > HOT_SHARE * total / parallelism(spark)
    key = F.xxhash64("x")
    hot = made.filter(heavy & (F.col("copies") > SALTS)).select(F.xxhash64("x").alias("hot_key")).distinct()
    marked = rows.withColumn("key", key).join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    salted = marked.withColumn("salt", F.when(F.col("hot_key").isNotNull(), salt).otherwise(0)).drop("hot_key")
    every = F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    results = made.select(F.xxhash64("x").alias("made_key"), F.col("x").alias("made_x"), "deviation", "white")
    results = results.join(F.broadcast(hot), F.col("made_key") == F.col("hot_key"), "left")
    results = results.withColumn("made_salt", F.explode(every))
    same = (F.col("key") == F.col("made_key")) & (F.col("salt") == F.col("made_salt")) & (F.col("x") == F.col("made_x"))
    return salted.join(results, same).select("vec_id", "deviation", "white")
