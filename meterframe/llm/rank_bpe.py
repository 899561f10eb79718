"""Byte-level BPE by ranks: a fold of Spark higher-order functions over the bytes of distinct words.

A word is one match of the split pattern. The fold turns it into an array of one-byte pieces and
joins the neighbours of lowest rank, leftmost first, until no neighbours are in the literal rank
map. It runs once for each distinct frequent word of the corpus (a dictionary of bounded bytes)
and, in the same expression, for each distinct other word of a document. Documents are then put
together from the ids of their words, where they are: only words and counts are shuffled. Decoding
concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import map_batches
from meterframe.session import materialize

BUCKETS = 1 << 14
# A word of more bytes (plus the lookahead) is folded in windows.
WINDOW = 256
# Bytes of the dictionary of frequent words, which every Python worker holds.
DICTIONARY_BYTES = 24 << 20
# Steps of the count scale per doubling.
SCALE = 4
# Words that a task holds before it adds up their counts.
COUNTED_WORDS = 1 << 21
UNICODE_END = 0x110000
OTHER, LETTER, NUMBER, SPACE = range(4)
# The endings that the split pattern takes together with an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


class Ranks:
    """The rank file: `pieces[i]` is the byte string of id i."""

    def __init__(self, text: str):
        pairs = [line.split() for line in text.splitlines() if line.strip()]
        self.rank = {base64.b64decode(piece): int(number) for piece, number in pairs}
        size = max(self.rank.values(), default=-1) + 1
        self.pieces = [b""] * size
        for piece, number in self.rank.items():
            self.pieces[number] = piece

    def buckets(self) -> str:
        """The rank map as JSON: maps from hex text to rank, one for each crc32 remainder."""
        table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, number in self.rank.items():
            table[binascii.crc32(piece) % BUCKETS][piece.hex().upper()] = number
        return json.dumps(table, separators=(",", ":"))

    def lookahead(self) -> int:
        """Bytes after which the tokens of a prefix can no longer change.

        Two texts with a common prefix have equal tokens up to a frontier that starts at the
        prefix's end. It moves left over a piece p only when a join (p, q) takes p; the next
        such join has a higher rank and a right part that begins with p. The longest way of
        joins of rising rank is found in one pass, with every split of a piece into two pieces.
        """
        reach: dict[bytes, int] = {}
        longest = 0
        for piece in sorted(self.rank, key=self.rank.__getitem__):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in self.rank and right in self.rank:
                    way = cut + max((reach.get(right[:end], 0) for end in range(1, len(right) + 1)), default=0)
                    reach[left] = max(reach.get(left, 0), way)
                    longest = max(longest, way)
        return longest


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Ranks:
    with open(path, encoding="ascii") as source:
        return Ranks(source.read())


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point: letter, number, white space, or other, as the split pattern sees it."""
    every = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else "\0" for c in range(UNICODE_END))
    table = np.zeros(UNICODE_END, dtype=np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (SPACE, "White_Space")):
        for found in regex.finditer(rf"\p{{{name}}}+", every):
            table[found.start() : found.end()] = kind
    return table


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the matches of the split pattern start, for all code points of many texts.

    The pattern's matches cover a text. A match is a run of letters, of numbers or of other
    characters, with one space before it if there is one; the rest of a run of white space,
    less its last character if something follows; or an apostrophe with one of seven endings
    where a match can start at it. `text_starts` are the first points of the texts that have some.
    """
    size = len(points)
    if not size:
        return np.empty(0, dtype=np.int64)
    kind = kinds()[points]
    first = np.zeros(size + 1, dtype=bool)
    first[text_starts] = True
    first[size] = True
    start = np.empty(size + 1, dtype=bool)
    start[0] = start[size] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:size])
    start |= first
    # A run after white space: the last white space starts a match, and joins the run if it is a space.
    after = np.flatnonzero(start[1:size] & ~first[1:size] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == ord(" ")]] = False
    # Apostrophes at which a match starts.
    mark = np.flatnonzero((points == ord("'")) & start[:size])
    padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
    ends = np.concatenate([first, np.ones(2, dtype=bool)])
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in SHORT_ENDINGS]) & ~ends[mark + 1]
    long = np.zeros(len(mark), dtype=bool)
    for ending in LONG_ENDINGS:
        long |= (one == ord(ending[0])) & (two == ord(ending[1]))
    long &= ~ends[mark + 1] & ~ends[mark + 2]
    taken = short | long
    start[mark[taken] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    return np.flatnonzero(start[:size])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For a column of texts: the first word of each (and the end), and all words, not copied."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    count = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + count + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = memoryview(data)[bounds[0] : bounds[-1]] if data is not None else memoryview(b"")
    bounds = bounds - bounds[0]
    flat = np.frombuffer(raw, dtype=np.uint8)
    if len(flat) and flat.max() >= 0x80:
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((flat & 0xC0) != 0x80)  # the first byte of each code point
    else:
        points, at = flat.astype(np.uint32), np.arange(len(flat))
    edges = np.concatenate([at, [len(flat)]])
    begins = np.searchsorted(at, bounds[:-1][bounds[:-1] < bounds[1:]])
    starts = edges[word_starts(points, begins)]
    offsets = np.concatenate([starts, [len(flat)]]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw))
    return np.searchsorted(starts, bounds), words


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once: a lambda over an array of one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Fold:
    """The expressions of the fold; `table` holds the ranks by bucket, `keep` is the lookahead."""

    def __init__(self, table: Column, keep: int):
        self.table, self.keep = table, keep

    def rank(self, piece: Column) -> Column:
        """The rank of a binary piece, null if it is none."""
        bucket = F.element_at(self.table, (F.crc32(piece) % BUCKETS + 1).cast("int"))
        return F.element_at(bucket, F.hex(piece))

    def joined(self, pieces: Column) -> Column:
        """The pieces after all joins: each step joins the leftmost pair of lowest rank.

        The ranks of all pairs are kept; a step changes those on both sides of the join only.
        """
        def pair(left, right):
            return self.rank(F.concat(left, right))

        def step(state, _):
            parts, ranks = state["parts"], state["ranks"]

            def apply(at):  # the pair of pieces at and at + 1, counted from 1
                new = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
                fewer = F.filter(parts, lambda p, i: i != at)
                others = F.filter(ranks, lambda r, i: i != at - 1)

                def state_of(piece):
                    before = pair(F.get(parts, at - 2), piece)
                    after = pair(piece, F.get(parts, at + 1))
                    return F.struct(
                        F.transform(fewer, lambda p, i: F.when(i == at - 1, piece).otherwise(p)).alias("parts"),
                        F.transform(
                            others, lambda r, i: F.when(i == at - 2, before).when(i == at - 1, after).otherwise(r)
                        ).alias("ranks"),
                    )

                return let(new, state_of)

            found = F.array_position(ranks, F.array_min(ranks)).cast("int")
            return let(found, lambda at: F.when(at > 0, apply(at)).otherwise(state))

        def whole(parts):
            # The last piece has no pair: its rank is that of nothing.
            ranks = F.transform(parts, lambda p, i: pair(p, F.get(parts, i + 1)))
            start = F.struct(parts.alias("parts"), ranks.alias("ranks"))
            return F.aggregate(parts, start, step, lambda s: s["parts"])

        return let(pieces, whole)

    def split(self, word: Column) -> Column:
        """The bytes of a binary word as pieces."""
        return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def ids_of_pieces(self, pieces: Column) -> Column:
        return F.transform(pieces, self.rank)

    def windows(self, word: Column) -> Column:
        """The ids of a long word: each window gives the tokens that its lookahead makes final."""
        size = F.octet_length(word)
        last = F.ceil(size / WINDOW).cast("int")

        def step(state, _):
            start = state["start"]
            window = F.substring(word, start, F.lit(WINDOW + self.keep))
            final = start + WINDOW + self.keep > size

            def taken(pieces):
                ends = F.aggregate(
                    pieces,
                    F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"), F.lit(0).alias("stop")),
                    lambda s, p: let(
                        s["end"] + F.octet_length(p),
                        lambda end: F.when(
                            (end <= WINDOW) | final,
                            F.struct(end.alias("end"), (s["n"] + 1).alias("n"), end.alias("stop")),
                        ).otherwise(F.struct(end.alias("end"), s["n"].alias("n"), s["stop"].alias("stop"))),
                    ),
                )
                return let(
                    ends,
                    lambda e: F.struct(
                        (start + e["stop"]).alias("start"),
                        F.concat(state["ids"], self.ids_of_pieces(F.slice(pieces, F.lit(1), e["n"]))).alias("ids"),
                    ),
                )

            return F.when(start > size, state).otherwise(let(self.joined(self.split(window)), taken))

        # A window gives at least one token, and all of its first WINDOW bytes but the last token's.
        begin = F.struct(F.lit(1).alias("start"), F.expr("cast(array() as array<int>)").alias("ids"))
        return F.aggregate(F.sequence(F.lit(1), 2 * last + 1), begin, step, lambda s: s["ids"])

    def ids(self, word: Column) -> Column:
        """The ids of a binary word as an array: its own rank, or those of the folded pieces."""
        def of(raw):
            direct = F.array(self.rank(raw))
            short = self.ids_of_pieces(self.joined(self.split(raw)))
            return (
                F.when(F.octet_length(raw) == 0, F.expr("cast(array() as array<int>)"))
                .when(self.rank(raw).isNotNull(), direct)
                .when(F.octet_length(raw) <= WINDOW + self.keep, short)
                .otherwise(self.windows(raw))
            )

        return let(word, of)


def with_ranks(ranks: Ranks, use) -> Column:
    """`use(fold)` over the literal rank map, which stands in the plan once.

    `from_json` of a literal becomes a literal when the plan is optimized.
    """
    table = F.from_json(F.lit(ranks.buckets()), "array<map<string,int>>")
    keep = ranks.lookahead()
    return let(table, lambda held: use(Fold(held, keep)))


def word_counts(documents: DataFrame) -> DataFrame:
    """`word`, `n`: how often each word occurs. Tasks send sums, not occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            found = pc.value_counts(split_words(batch.column(0))[1])
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            if sum(t.num_rows for t in held) >= COUNTED_WORDS:
                held = [_summed(held)]
                if held[0].num_rows >= COUNTED_WORDS // 2:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _summed(held).to_batches(1 << 16)

    return map_batches(documents.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": summed["word"], "n": summed["n_sum"].cast(pa.int64())})


def dictionary(documents: DataFrame, ranks: Ranks, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """`word`, `ids` of the words that occur most often, as many as fit into `limit` bytes.

    The least count is read off a logarithmic count scale of all words, so that no list of
    words is sorted. A word that stays out costs a fold in each document that holds it.
    """
    counts = word_counts(documents).filter("n > 1")
    step = F.floor(F.log2("n") * SCALE).cast("int")
    size = 2 * F.octet_length("word").cast("bigint") + 16
    counted = materialize(counts.select("word", step.alias("step"), size.alias("size")), "word-counts")
    sizes = sorted(counted.groupBy("step").agg(F.sum("size")).collect(), reverse=True)  # at most 64 * SCALE rows
    least, total = math.inf, 0
    for at, part in sizes:
        total += part
        if total > limit:
            break
        least = at
    chosen = counted.filter(F.col("step") >= (least if least < math.inf else 1 << 30)).select("word")
    return chosen.select("word", with_ranks(ranks, lambda fold: fold.ids(F.encode("word", "UTF-8"))).alias("ids"))


class Dictionary:
    """The frequent words of a worker, and the binary pieces of all ids."""

    def __init__(self, table: bytes, pieces: list[bytes]):
        rows = pa.ipc.open_stream(table).read_all().combine_chunks()
        empty = not rows.num_rows
        self.words = pa.array([], pa.string()) if empty else rows.column("word").chunk(0)
        offsets, ids = _flat(pa.array([], pa.list_(pa.int32())) if empty else rows.column("ids").chunk(0))
        self.sizes = np.diff(offsets)
        self.ids = ids
        self.offsets = offsets
        self.pieces = pa.array(pieces, pa.binary())
        self.said = pa.array([b"%d " % i for i in range(len(pieces))], pa.binary())
        self.word_pieces = _joined(self.pieces, ids, offsets)
        self.word_said = _joined(self.said, ids, offsets)

    def find(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text the entries of its words, and its distinct words outside the dictionary.

        Instead of an entry, -k - 1 stands for the k-th such word of the text.
        """
        bounds, words = split_words(texts)
        entry = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        missing = np.flatnonzero(entry < 0)
        coded = words.take(pa.array(missing)).dictionary_encode()
        row = np.searchsorted(bounds, missing, side="right") - 1
        key = row << 32 | coded.indices.to_numpy().astype(np.int64)
        distinct, which = np.unique(key, return_inverse=True)
        first = np.searchsorted(distinct >> 32, np.arange(len(texts) + 1))
        entry[missing] = first[row] - which - 1
        rare = coded.dictionary.take(pa.array(distinct & 0xFFFFFFFF))
        return _lists(bounds, pa.array(entry)), _lists(first, rare)

    def put_together(self, entries: pa.Array, rare: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Bounds of the texts' words, the index of each word among the dictionary's and then the
        batch's other words, and offsets and ids of the latter."""
        bounds, flat = _flat(entries)
        index = flat.to_numpy().astype(np.int64)
        first, lists = _flat(rare)
        offsets, ids = _flat(lists)
        hole = np.flatnonzero(index < 0)
        row = np.searchsorted(bounds, hole, side="right") - 1
        index[hole] = len(self.words) + first[row] - index[hole] - 1
        return bounds, index, offsets, ids

    def digests(self, entries: pa.Array, rare: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """For each text the number of ids and the digests of the ids as text and of the decoded bytes."""
        bounds, index, offsets, ids = self.put_together(entries, rare)
        sizes = np.concatenate([self.sizes, np.diff(offsets)])[index]
        counts = np.concatenate([[0], np.cumsum(sizes)])
        said = pa.concat_arrays([self.word_said, _joined(self.said, ids, offsets)])
        pieces = pa.concat_arrays([self.word_pieces, _joined(self.pieces, ids, offsets)])
        names = [hashlib.sha256(t[: max(0, len(t) - 1)]).hexdigest() for t in _concatenated(said, index, bounds)]
        decoded = [hashlib.sha256(t).hexdigest() for t in _concatenated(pieces, index, bounds)]
        return np.diff(counts[bounds]), names, decoded


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and flat values of a list column without nulls."""
    if not len(column):  # such a column may come without an offset
        return np.zeros(1, dtype=np.int64), pa.array([], column.type.value_type)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _joined(pieces: pa.Array, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
    """For each word, whose ids lie between two offsets, the concatenated pieces."""
    taken = pieces.take(ids)
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[offsets])), taken.buffers()[2]]
    )


def _concatenated(words: pa.Array, index: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
    """For each text the concatenated bytes of its words."""
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        data = words.take(pa.array(index[begin:end])).buffers()[2]
        yield memoryview(data) if data is not None else memoryview(b"")


_DICTIONARY: dict[int, Dictionary] = {}


def _worker(packed: tuple[bytes, list[bytes]]) -> Dictionary:
    key = hash(packed[0])
    if key not in _DICTIONARY:
        _DICTIONARY.clear()
        _DICTIONARY[key] = Dictionary(*packed)
    return _DICTIONARY[key]


def _found(documents: DataFrame, rank_path: str, id_column: str, text_column: str, limit: int):
    """Rows of id, entries and rare words' ids, and the shared dictionary."""
    spark = documents.sparkSession
    ranks = read_ranks(rank_path)
    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].cast("string").alias("text"))
    table = materialize(dictionary(rows, ranks, limit), "word-ids").toArrow()  # at most `limit` bytes
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared = spark.sparkContext.broadcast((sink.getvalue(), ranks.pieces))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *known.find(batch.column(1))], ["doc_id", "entries", "rare"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = map_batches(rows, find, f"doc_id {kind}, entries array<int>, rare array<string>")
    of_rare = with_ranks(ranks, lambda fold: F.transform("rare", lambda w: fold.ids(F.encode(w, "UTF-8"))))
    return found.withColumn("rare", of_rare), shared, kind


def encode_ids(
    documents: DataFrame, rank_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = DICTIONARY_BYTES
) -> DataFrame:
    """Per row: id and the token ids as an array. A null text has no tokens."""
    rows, shared, kind = _found(documents, rank_path, id_column, text_column, limit)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker(shared.value)
        for batch in batches:
            bounds, index, offsets, ids = known.put_together(batch.column(1), batch.column(2))
            lists = pa.concat_arrays([_lists(known.offsets, known.ids), _lists(offsets, ids)]).take(pa.array(index))
            ends, flat = _flat(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ends[bounds], flat)], ["doc_id", "ids"])

    return map_batches(rows, join, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, rank_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: id and the bytes of the ids. A null array gives no bytes, null ids are skipped."""
    rows = encoded.select(encoded[id_column].alias("doc_id"), encoded[ids_column].alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(rank_path).pieces)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [b"".join([pieces[i] for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return map_batches(rows, decode, f"doc_id {kind}, bytes binary")


def encode_documents(
    documents: DataFrame, rank_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = DICTIONARY_BYTES
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256.

    A null text is the empty text: no tokens, both digests those of nothing. Null and repeated
    ids are passed on, one result row per input row; other columns are not read. A word of any
    length is folded whole or in windows with the same result, and the size of the dictionary
    changes no result. Memory of a task is the dictionary, a batch, and the ids of one text.
    """
    rows, shared, kind = _found(documents, rank_path, id_column, text_column, limit)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker(shared.value)
        for batch in batches:
            counts, names, decoded = known.digests(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(names, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(rows, digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
