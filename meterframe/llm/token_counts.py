"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is merged by the merge list; those that end as their own
single token are proven whole. A pre-token that is a proven string counts one without any
merging; only the rest is merged, and short results are kept in a bounded memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from meterframe.llm import bpe
from meterframe.llm.common import map_batches, texts

# Fixed value: the pre-token pattern of byte-level vocabularies.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
MEMO = 200_000
MEMO_CHARS = 64


def whole_tokens(vocabulary: bpe.Vocabulary) -> list[str]:
    """The vocabulary strings proven to encode alone as one token, as text."""
    back = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    proven = []
    for string, number in vocabulary.ids.items():
        raw = bytes(back[c] for c in string if c in back)
        if len(raw) != len(string) or vocabulary.merge(vocabulary.symbols(raw)) != [number]:
            continue
        try:
            proven.append(raw.decode("utf-8"))
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
    return proven


class PreTokenCounts(bpe.Memo):
    """Tokens per pre-token: one for a proven string, else the length of its merge."""

    def __init__(self, vocabulary: bpe.Vocabulary, proven: list[str]):
        super().__init__(self.count, MEMO, MEMO_CHARS)
        self.vocabulary = vocabulary
        self.proven = frozenset(proven)

    def count(self, word: str) -> int:
        if word in self.proven:
            return 1
        return len(self.vocabulary.merge(self.vocabulary.symbols(word.encode("utf-8"))))


def count_tokens(text: str, counts: PreTokenCounts, pattern: regex.Pattern) -> int:
    total = 0
    for piece, special in bpe.split_special(text, counts.vocabulary.special):
        total += 1 if special is not None else sum(map(counts.__getitem__, pattern.findall(piece)))
    return total


_COUNTS: dict[int, PreTokenCounts] = {}


def token_counts(
    documents: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens as the tokenizer file gives them, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are passed on, one
    result row per input row. Special strings of the file inside a text are one token each.
    Other columns are not read, so clashing names do no harm. Memory per task is the
    vocabulary, the memo and one batch.
    """
    source = bpe.read_file(tokenizer_path)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((source, whole_tokens(bpe.vocabulary(source))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, proven = shared.value
        key = hash(text)
        if key not in _COUNTS:
            _COUNTS[key] = PreTokenCounts(bpe.vocabulary(text), proven)
        counts = _COUNTS[key]
        pattern = regex.compile(BYTE_LEVEL)
        for batch in batches:
            numbers = pa.array([count_tokens(t, counts, pattern) for t in texts(batch, "text")], pa.int64())
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            over = pc.greater(numbers, pa.scalar(limit, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, numbers, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
