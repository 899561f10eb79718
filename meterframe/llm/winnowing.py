"""Document fingerprints by winnowing.

Every k-gram of code points is hashed; of each window of `WINDOW` consecutive k-grams the
smallest hash is chosen, the rightmost one on ties, and kept with its position. Any passage
of at least `GRAM + WINDOW - 1` code points that two texts share therefore yields a common
fingerprint, and a chosen k-gram's position says where the match is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import map_batches, parallelism, range_index

GRAM = 16
WINDOW = 32
# An odd multiplier of the rolling hash and those of the 64-bit finalizer.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
# A window key is the upper 32 bits of the hash, then the position counted from the end, so
# that the smallest key is the smallest hash and, of equal ones, the rightmost.
PART = 1 << 31


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all `gram`-grams, by doubling: hash(xy) = hash(x) * BASE^|y| + hash(y)."""
    if len(points) < gram:
        return np.zeros(0, np.uint64)
    total, width = None, 0
    block, size = points.astype(np.uint64) + np.uint64(1), 1
    left = gram
    while True:
        if left & 1:
            if total is None:
                total, width = block, size
            else:
                count = min(len(total) - size, len(block))
                total = block[:count] * np.uint64(pow(BASE, width, 1 << 64)) + total[size : size + count]
                width += size
        left >>= 1
        if not left:
            break
        block = block[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + block[size:]
        size *= 2
    h = total[: len(points) - gram + 1]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[1])
    return h >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint in text order.

    A text shorter than one k-gram is hashed whole at position 0; the empty text has none. A
    text with fewer than `window` k-grams is one window.
    """
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = gram_hashes(points, min(gram, len(points)))
    count = len(hashes)
    key = (hashes << np.uint64(32)) | (np.uint64(PART - 1) - np.arange(count, dtype=np.uint64))
    span, left, size = key, min(window, count), 1
    best = None
    shift = 0
    while True:  # sliding minimum of `left` keys, by doubling
        if left & 1:
            if best is None:
                best, shift = span, size
            else:
                end = min(len(best), len(span) - shift)
                best = np.minimum(best[:end], span[shift : shift + end])
                shift += size
        left >>= 1
        if not left:
            break
        span = np.minimum(span[:-size], span[size:])
        size *= 2
    chosen = best[: count - min(window, count) + 1]
    positions = np.uint64(PART - 1) - (chosen & np.uint64((1 << 32) - 1))
    keep = np.ones(len(chosen), bool)
    keep[1:] = positions[1:] != positions[:-1]
    return (chosen[keep] >> np.uint64(32)).astype(np.uint32), positions[keep].astype(np.uint32)


def as_text(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Sixteen hex digits per chosen k-gram: hash, then position."""
    hashes, positions = fingerprint
    both = np.empty((len(hashes), 2), ">u4")
    both[:, 0], both[:, 1] = hashes, positions
    return both.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two distinct sorted hash sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def edited(text: str, follower: str) -> str:
    """The last half of the code points replaced by as many from the start of `follower`."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and its fingerprint as (hash, position) pairs in text order.

    A null text is the empty text, whose fingerprint is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                hashes, positions = winnow(text or "")
                rows.append([{"hash": int(h), "position": int(p)} for h, p in zip(hashes, positions)])
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "grams"])

    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, grams array<struct<hash: long, position: long>>")


def ranges_with_followers(documents: DataFrame) -> DataFrame:
    """(doc_id, text) dealt into ranges of descending doc_id, each closed by the next range's head.

    Only ids are read to find the cuts and the heads (one per partition each, so what reaches
    the driver is bounded by the number of partitions); the texts move once. `closing` marks
    the copies of a following range's head; the last range closes with the very first row.
    Rows without an id come last, in the order of their text's hash, and are cut by that hash.
    Rows that repeat an id follow each other in the order of that hash.
    """
    spark = documents.sparkSession
    ids = documents.select("doc_id")
    parts = max(2, 2 * parallelism(spark))
    found = ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)
    cuts = sorted({int(c) for c in found})
    tie = F.xxhash64("text")
    if ids.filter(F.col("doc_id").isNull()).isEmpty():
        without_id, base = F.lit(0), ids
    else:
        without_id = F.shiftright(tie, 58) + (len(cuts) + 33)
        base = documents
    above = len(cuts) - range_index(F.col("doc_id"), cuts)
    slot = F.when(F.col("doc_id").isNull(), without_id).otherwise(above).cast("int")
    least = F.min(F.when(F.col("doc_id").isNull(), tie)) if base is documents else F.lit(None).cast("bigint")
    heads = base.groupBy(slot.alias("slot")).agg(F.max("doc_id").alias("head"), least.alias("head_tie")).collect()
    heads.sort(key=lambda r: r["slot"])
    to = [(r["slot"], r["head"], r["head_tie"], heads[i - 1]["slot"]) for i, r in enumerate(heads)]
    copies = spark.createDataFrame(to, "slot int, head bigint, head_tie bigint, to int")
    placed = documents.withColumn("slot", slot).join(F.broadcast(copies), "slot")
    is_head = F.coalesce(
        F.when(F.col("doc_id").isNull(), tie == F.col("head_tie")).otherwise(F.col("doc_id") == F.col("head")),
        F.lit(False),
    )
    own = F.struct(F.col("slot").alias("at"), F.lit(False).alias("closing"))
    copy = F.struct(F.col("to").alias("at"), F.lit(True).alias("closing"))
    rows = placed.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("p"))
    rows = rows.select("doc_id", "text", "p.at", "p.closing")
    count = max([r["slot"] for r in heads], default=0) + 1
    return rows.repartitionById(count, F.col("at")).sortWithinPartitions(
        "at", "closing", F.desc_nulls_last("doc_id"), F.xxhash64("text")
    )


SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses, one row per input row.

    The edited form replaces the last half of the code points by the start of the next text in
    descending doc_id (after the last: the first; a table of one row follows itself). A null
    text is empty; two empty fingerprints are alike (1.0), one empty one is not (0.0). Equal
    texts have equal fingerprints. Columns other than the two named are not read.
    """
    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its follower
        closed = False
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, closing in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if closed:
                    continue
                text = text or ""
                print_ = winnow(text)
                own = np.unique(print_[0])
                if last is not None:
                    number, before, marks, before_set = last
                    changed = edited(before, text)
                    changed_print = winnow(changed)
                    values = (
                        number,
                        len(before),
                        hashlib.sha256(changed.encode("utf-8")).hexdigest(),
                        as_text(marks),
                        as_text(changed_print),
                        likeness(before_set, np.unique(changed_print[0])),
                        likeness(before_set, own),
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                last, closed = (doc_id, text, print_, own), closing
            kinds = [batch.column(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            names = ["doc_id", *[part.split()[0] for part in SCHEMA.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return map_batches(ranges_with_followers(rows), run, f"doc_id bigint, {SCHEMA}")
