"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

The transducer reads a word's symbols in pieces of any size and emits tokens once they are
stable: `Vocabulary.lookahead` symbols, a number computed from the merge list, suffice to fix
everything before them. It keeps at most one chunk and the lookahead, however long the word.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meterframe.llm import bpe
from meterframe.llm.common import map_batches, texts

# Fixed value: the word pattern of the vocabulary with word ends; white space is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK = 256  # bytes that wait at most, next to the lookahead, before stable tokens leave
TEXT_CHUNK = 1 << 16
MEMO = 120_000
MEMO_CHARS = 48


class Transducer:
    """Encodes one word from pieces of its bytes."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.vocabulary = vocabulary
        self.keep = vocabulary.lookahead
        self.pending: list[int] = []
        self.held: int | None = None  # the newest byte, as it may be the word's last

    def push(self, piece: bytes) -> list[int]:
        """Tokens that became stable with this piece."""
        if not piece:
            return []
        inner = self.vocabulary.inner
        if self.held is not None:
            self.pending.append(inner[self.held])
        self.pending.extend(inner[b] for b in piece[:-1])
        self.held = piece[-1]
        if len(self.pending) < CHUNK + self.keep:
            return []
        tokens = self.vocabulary.merge(self.pending)
        widths, stable, end = self.vocabulary.widths, 0, 0
        for token in tokens:
            if end + widths[token] > len(self.pending) - self.keep:
                break
            end += widths[token]
            stable += 1
        del self.pending[:end]
        return tokens[:stable]

    def finish(self) -> list[int]:
        """The remaining tokens; the last symbol carries the end of the word."""
        if self.held is None:
            return []
        tokens = self.vocabulary.merge([*self.pending, self.vocabulary.last[self.held]])
        self.pending, self.held = [], None
        return tokens


def encode_word(vocabulary: bpe.Vocabulary, word: bytes) -> Iterator[list[int]]:
    """The word's tokens in the order and the portions in which they become stable."""
    machine = Transducer(vocabulary)
    for start in range(0, len(word), CHUNK):
        tokens = machine.push(word[start : start + CHUNK])
        if tokens:
            yield tokens
    yield machine.finish()


class TextMachine:
    """Turns ids into text step by step; its state is the unfinished part of a character.

    Without a decoder in the file, the strings of the tokens are joined by spaces, and the
    state is whether a token was seen. With the byte-level decoder, bytes become text as soon
    as a character is complete.
    """

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.strings = vocabulary.strings
        self.back = vocabulary.bytes_of
        self.joined = vocabulary.decoder is None
        self.seen = False
        self.utf8 = None if self.joined else codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        strings = [self.strings[t] for t in tokens]
        if self.joined:
            text = " ".join(strings)
            if strings and self.seen:
                text = " " + text
            self.seen = self.seen or bool(strings)
            return text
        out = []
        for string in strings:
            if all(c in self.back for c in string):
                out.append(self.utf8.decode(bytes(self.back[c] for c in string)))
            else:
                out.append(string)
        return "".join(out)

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", final=True)


def normal(text: str) -> str:
    """The file's normalizer: NFC, then lower case letter by letter (no final sigma rule).

    Its white-space rule is left out: the word pattern drops white space anyway.
    """
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def portions(text: str) -> Iterator[str]:
    """The text in pieces of about `TEXT_CHUNK`, cut after a space or line end only."""
    at, size = 0, len(text)
    while at < size:
        end = at + TEXT_CHUNK
        if end >= size:
            yield text[at:]
            return
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        while cut < 0 and end < size:
            start, end = end, end + TEXT_CHUNK
            hits = [p for p in (text.find(" ", start, end), text.find("\n", start, end)) if p >= 0]
            cut = min(hits) if hits else -1
        if cut < 0:
            cut = size - 1
        yield text[at : cut + 1]
        at = cut + 1


class Words(bpe.Memo):
    """Per word: token count, ids as little-endian 32-bit integers, decoded text with a leading join."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        super().__init__(self.encoded, MEMO, MEMO_CHARS)
        self.vocabulary = vocabulary

    def encoded(self, word: str) -> tuple[int, bytes, str]:
        return pack(self.vocabulary, [t for part in encode_word(self.vocabulary, word.encode("utf-8")) for t in part])


def pack(vocabulary: bpe.Vocabulary, tokens: list[int]) -> tuple[int, bytes, str]:
    machine = TextMachine(vocabulary)
    machine.seen = True  # the piece follows others; the very first join is removed at the end
    return len(tokens), struct.pack(f"<{len(tokens)}I", *tokens), machine.feed(tokens) + machine.finish()


def stream(words: Words, found: list[str]) -> Iterator[list[tuple[int, bytes, str]]]:
    """The entries of words in order: runs of memoised ones, and long words token portion by portion."""
    at = 0
    for place, word in enumerate(found):
        if len(word) <= MEMO_CHARS:
            continue
        yield [words[w] for w in found[at:place]]
        at = place + 1
        for tokens in encode_word(words.vocabulary, word.encode("utf-8")):
            yield [pack(words.vocabulary, tokens)]
    yield [words[w] for w in found[at:]]


def encode(text: str, vocabulary: bpe.Vocabulary, words: Words, pattern: regex.Pattern) -> tuple[int, str, str]:
    """Token count and SHA-256 of the ids and of the decoded text, in one pass over the text."""
    ids, decoded = hashlib.sha256(), hashlib.sha256()
    total = 0
    for piece, special in bpe.split_special(text, vocabulary.special):
        if special is not None:
            parts: Iterable[list[tuple[int, bytes, str]]] = [[pack(vocabulary, [special])]]
        else:
            parts = (entries for p in portions(piece) for entries in stream(words, pattern.findall(normal(p))))
        for entries in parts:
            if not entries:
                continue
            ids.update(b"".join([e[1] for e in entries]))
            said = "".join([e[2] for e in entries])
            decoded.update((said if total else said[1:]).encode("utf-8"))
            total += sum([e[0] for e in entries])
    return total, ids.hexdigest(), decoded.hexdigest()


_WORDS: dict[int, Words] = {}


def encode_documents(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded text, and the columns of `keep`.

    For a vocabulary with word ends and no decoder (tokens joined by spaces). A null text is
    the empty text: no tokens, both hashes those of nothing. Null and repeated ids are passed
    on, one result row per input row; other columns are not read. `encode_ids` gives the ids
    themselves and `decode_ids` their text.
    """
    def run(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
        vocabulary, words, pattern = _worker(source)
        for batch in batches:
            done = [encode(t, vocabulary, words, pattern) for t in texts(batch)]
            columns = [
                batch.column(0),
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.string()),
                pa.array([d[2] for d in done], pa.string()),
                *batch.columns[2:],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    kinds = dict(documents.select(*keep).dtypes)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return _mapped(documents, tokenizer_path, id_column, text_column, run, schema, keep)


def encode_ids(
    documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: id and the token ids as an array. A null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
        vocabulary, words, pattern = _worker(source)
        for batch in batches:
            rows = [ids_of(t, vocabulary, words, pattern) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(documents, tokenizer_path, id_column, text_column, run, "ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: id and the text of the ids. A null array gives the empty text, null ids are skipped."""

    def run(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(source)
        for batch in batches:
            said = []
            for ids in batch.column(1).to_pylist():
                machine = TextMachine(vocabulary)
                said.append(machine.feed(i for i in ids or [] if i is not None) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "text"])

    return _mapped(encoded, tokenizer_path, id_column, ids_column, run, "text string")


def ids_of(text: str, vocabulary: bpe.Vocabulary, words: Words, pattern: regex.Pattern) -> list[int]:
    out: list[int] = []
    for piece, special in bpe.split_special(text, vocabulary.special):
        if special is not None:
            out.append(special)
            continue
        for part in portions(piece):
            for word in pattern.findall(normal(part)):
                count, packed, _ = words[word]
                out.extend(struct.unpack(f"<{count}I", packed))
    return out


def _worker(source: str) -> tuple[bpe.Vocabulary, Words, regex.Pattern]:
    vocabulary = bpe.vocabulary(source)
    key = hash(source)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(vocabulary)
    return vocabulary, _WORDS[key], regex.compile(WORDS)


def _mapped(documents, tokenizer_path, id_column, value_column, run, schema, keep=()) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(bpe.read_file(tokenizer_path))
    rows = documents.select(documents[id_column].alias("doc_id"), documents[value_column].alias("text"), *keep)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, lambda batches: run(batches, shared.value), f"doc_id {kind}, {schema}")
