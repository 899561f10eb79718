"""Near-duplicate texts by a Jaccard join on word shingles with Bayesian candidate pruning.

A text is the set of its runs of five lower-case words. Equal sets form a class, and only one
text per class is compared. Texts that agree in one of 32 bands of four MinHash values become
candidates. Their 128 values are compared a few at a time; a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold, given the matches so far and a
uniform prior, is below the tolerance. What is left is verified on the full shingle sets.

A band's bucket is a group of rows. Large buckets are split into blocks, one group per pair of
blocks; a pair that shares several bands is handled in the first one only. Groups give back
counts of links and a spanning tree, never the pairs, so a large group of near copies stays linear.

A pair at the threshold misses all bands with probability (1 - 0.8^4)^32 = 5e-8, and is
pruned wrongly with about the tolerance per step; more similar pairs are safer still.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm import graph
from meterframe.llm.bpe import Memo
from meterframe.llm.common import map_batches
from meterframe.session import materialize

SHINGLE = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that the last test is in whole numbers
HASHES, BAND_ROWS = 128, 4
BANDS = HASHES // BAND_ROWS
STEP = 32
TOLERANCE = 1e-8
BLOCK = 512
BROADCAST_ROWS = 500_000  # of two longs each
MEMO = 100_000
# Multipliers of the shingle hash and its finalizer.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8"))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles. A text of fewer words is one shingle."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.hashes = Memo(_word_hash, MEMO, 64)

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        count = len(words) - size + 1
        total = codes[:count].copy()
        for i in range(1, size):
            total = total * np.uint64(BASE) + codes[i : i + count]
        total = (total ^ (total >> np.uint64(33))) * np.uint64(MIX[0])
        total = (total ^ (total >> np.uint64(29))) * np.uint64(MIX[1])
        return np.unique(total ^ (total >> np.uint64(32)))


def _family() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    odd = random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


FACTORS, OFFSETS = _family()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of the MinHash values."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[None, start : start + 2048] * FACTORS[:, None] + OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return ((least * np.uint64(MIX[0])) >> np.uint64(48)).astype(np.uint16)


def least_matches(compared: int, threshold: float = 0.8, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of `compared` values with which a pair is not yet dropped.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the
    probability that it reaches t is that of at most m successes in n + 1 trials at t.
    """
    below = 0.0
    for matches in range(compared + 1):
        below += comb(compared + 1, matches) * threshold**matches * (1 - threshold) ** (compared + 1 - matches)
        if below >= tolerance:
            return matches
    return compared


LEAST = [least_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Mask of the pairs (rows of `a`, rows of `b`) that pass all steps and meet first in `band`."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for step, least in enumerate(LEAST):
        part = slice(step * STEP, (step + 1) * STEP)
        matches[alive] += np.count_nonzero(a[left[alive], part] == b[right[alive], part], axis=1)
        alive = alive[matches[alive] >= least]
    if len(alive):
        equal = (a[left[alive]] == b[right[alive]]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
        alive = alive[equal.argmax(axis=1) == band]
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mask of the pairs of shingle sets whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    if len(left) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)])
    else:  # many pairs among few texts: one product of membership matrices, column block by block
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(codes[-1]) + 1, 4096):
            low, high = np.searchsorted(codes, (first, first + 4096))
            member = np.zeros((len(sets), 4096), np.float32)
            member[owner[low:high], codes[low:high] - first] = 1.0
            total += member @ member.T
        common = total[left, right].astype(np.int64)
    either = sizes[left] + sizes[right] - common
    return common * THRESHOLD[1] >= either * THRESHOLD[0]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of consecutive rows that agree in the first `keys` columns."""
    at, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys]))
        start = 0
        for n in range(1, len(marks) + 1):
            if n < len(marks) and marks[n] == marks[start]:
                continue
            part = [c[start:n] for c in columns]
            if marks[start] == at:
                for have, more in zip(held, part):
                    have.extend(more)
            else:
                if held is not None:
                    yield held
                at, held = marks[start], part
            start = n
    if held is not None:
        yield held


def _describe(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_key, signature) per row; the last two are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, marks = [], []
            for text in batch.column(2).to_pylist():
                shingles = shingler(text or "")
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                marks.append(signature(shingles).tobytes() if len(shingles) else None)
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set_key", "signature"])

    schema = "doc_id bigint, text_hash bigint, set_key binary, signature binary"
    return map_batches(documents.select("doc_id", _text_hash(), "text"), run, schema)


def _text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def _candidates(classes: DataFrame) -> DataFrame:
    """Groups of classes with their pairs that survive the pruning.

    (band, bucket, i, j, position, class, partners): `partners` is a bit set over the
    positions of the group. Classes without a surviving pair are left out.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BAND_ROWS)
            keys = np.zeros(marks.shape[:2], np.int64)
            for i in range(BAND_ROWS):
                keys = (keys << 16) | marks[:, :, i]
            numbers = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            columns = [pa.array(band), pa.array(keys.ravel()), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["band", "bucket", "class"])

    rows = map_batches(classes.select("class", "signature"), bands, "band int, bucket bigint, class bigint")
    shared = rows.groupBy("band", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = shared.select("band", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = materialize(rows.join(shared, ["band", "bucket"]), "bucket-members")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select(
        "band",
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"),
        "class",
    ).join(classes.select("class", "signature"), "class")
    keys = ["band", "bucket", "i", "j"]
    placed = placed.select(*keys, "second", "class", "signature").repartition(*keys)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]
        for band, bucket, i, j, second, numbers, marks in groups(batches, 4):
            if len(numbers) < 2:
                continue
            table = np.frombuffer(b"".join(marks), np.uint16).reshape(-1, HASHES)
            later = np.array(second)
            near = np.zeros((len(numbers), len(numbers)), bool)
            for n in range(len(numbers) - 1):
                others = np.arange(n + 1, len(numbers))
                if i[0] != j[0]:
                    others = others[later[others] != later[n]]
                if len(others):
                    mask = surviving(table, table, np.full(len(others), n), others, band[0])
                    near[n, others[mask]] = True
            near |= near.T
            bits = np.packbits(near, axis=1)
            for n in np.flatnonzero(near.any(axis=1)).tolist():
                row = (band[0], bucket[0], i[0], j[0], n, numbers[n], bits[n].tobytes())
                for column, value in zip(out, row):
                    column.append(value)
            if len(out[0]) >= 5_000:
                yield batch_of(out)
                out = [[] for _ in range(7)]
        yield batch_of(out)

    names = [*keys, "position", "class", "partners"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "band int, bucket bigint, i int, j int, position int, class bigint, partners binary"
    return map_batches(placed.sortWithinPartitions(*keys, "second", "class"), prune, schema)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table of narrow rows has at most `rows` rows."""
    return df.count() <= rows


def _verified(documents: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(class, links, root) per group and class with at least one verified link."""
    known = classes.select("class", "size", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    needed = materialize(candidates.select("class").distinct().join(known, "class"), "compared-classes")
    small = F.broadcast(needed) if fits(needed) else needed
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    found = documents.select("doc_id", _text_hash(), "text").join(small, is_rep)
    found = found.select("class", "size", "text").dropDuplicates(["class"])  # a repeated row comes once
    keys = ["band", "bucket", "i", "j"]
    rows = candidates.join(found, "class").select(*keys, "position", "class", "size", "partners", "text")
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "position")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for _, _, _, _, positions, numbers, sizes, partners, bodies in groups(batches, 4):
            near = np.unpackbits(np.frombuffer(b"".join(partners), np.uint8).reshape(len(numbers), -1), axis=1)
            left, right = np.nonzero(np.triu(near[:, positions], 1))
            if not len(left):
                continue
            sets = [shingler(body or "") for body in bodies]
            true = similar(sets, left, right)
            left, right = left[true], right[true]
            weight = np.array(sizes, np.int64)
            links = np.zeros(len(numbers), np.int64)
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
            parent = np.arange(len(numbers))
            graph.unite(parent, left, right)
            roots = graph.find(parent, parent)
            own = np.array(numbers, np.int64)
            hit = np.flatnonzero(links)
            if len(hit):
                columns = [pa.array(own[hit]), pa.array(links[hit]), pa.array(own[roots[hit]])]
                yield pa.RecordBatch.from_arrays(columns, ["class", "links", "root"])

    return map_batches(placed, verify, "class bigint, links bigint, root bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, class_id, n_links, group_id and kept.

    `class_id` is the smallest doc_id with the same shingle set, `n_links` the number of other
    rows of similarity 0.8 or more (those of its class included), `group_id` the smallest
    doc_id reachable over links, `kept` true for the row that represents its group (rows that
    repeat id and text are all marked; `deduplicated` leaves one).

    A null or wordless text has no shingles: it links with nothing and is kept. A row without id
    takes part; its class and group have the smallest id that is not null, if there is one, and a
    group of such rows only is represented by the smallest text hash. Only doc_id and text are read.
    """
    rows = documents.select("doc_id", "text")
    described = materialize(_describe(rows), "shingle-sets")
    identity = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    grouped = described.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min(identity).alias("rep"), F.count("*").alias("size"), F.first("signature").alias("signature")
    )
    classes = materialize(grouped.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")
    candidates = materialize(_candidates(classes), "candidates")
    linked = materialize(_verified(rows, classes, candidates), "links")

    roots = graph.components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    totals = linked.groupBy(F.col("class").alias("linked")).agg(F.sum("links").alias("links"))
    known = classes.drop("signature").join(totals, F.col("class") == F.col("linked"), "left")
    known = known.join(roots, F.col("class") == F.col("node"), "left")
    known = known.select("set_key", "rep", "size", "links", F.coalesce("root", "class").alias("root"))
    known = materialize(known, "known-classes")
    heads = known.groupBy("root").agg(F.min("rep").alias("head"))
    found = known.join(heads, "root").select(
        "set_key", "rep", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("others")
    )
    result = described.drop("signature").join(found, "set_key", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    alone = F.col("head").isNull()
    return result.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.coalesce("others", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        F.when(alone, True).otherwise(is_head).alias("kept"),
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, with one row left of each group of near duplicates."""
    marked = materialize(near_duplicates(documents), "marked").select("doc_id", "text_hash", "n_links", "kept")
    key = ["doc_id", "text_hash"]

    def named(rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.select(*[F.col(k).alias(f"{name}_{k}") for k in key]), name)

    dropped = named(marked.filter(~F.col("kept")).distinct(), "dropped")
    again = marked.filter(F.col("kept") & (F.col("n_links") > 0)).groupBy(*key).agg(F.count("*").alias("times"))
    repeated = named(again.filter("times > 1"), "repeated")

    def same(name: str) -> Column:
        mine = F.xxhash64("text")
        return F.col("doc_id").eqNullSafe(F.col(f"{name}_doc_id")) & (mine == F.col(f"{name}_text_hash"))

    kept = documents.join(F.broadcast(dropped) if fits(dropped) else dropped, same("dropped"), "left_anti")
    if repeated.isEmpty():
        return kept
    few = F.broadcast(repeated) if fits(repeated) else repeated
    once = kept.join(few, same("repeated"), "left_semi").withColumn("__hash", F.xxhash64("text"))
    once = once.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return kept.join(few, same("repeated"), "left_anti").unionByName(once)
