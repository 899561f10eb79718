import hashlib
import struct

import public_tokenizers
import pytest
import regex
from helpers import LONG, no_documents, odd_documents, sf_documents
from tokenizers import Tokenizer

from meterframe.llm import bpe, token_counts, transducer

COUNT_FILE = public_tokenizers.path("byte_bpe_50k.json")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "",
    " ",
    "it's <|endoftext|>x<|startoftext|> y",
    "Σας ΟΔΟΣ İstanbul é ẞ",
    "x" * 9_000,
    "ab" * 7_000,
    "thethethe" * 1_500,
    "\x1c\x1f \x85  a  b\n\n c\t",
    "0x12 1234567 ½²",
    "日本語のテキスト 😀👍🏽",
    " ́abc  ̈ ABC!!! ***",
    LONG,
]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def words(source):
    vocabulary = bpe.Vocabulary(bpe.read_file(source))
    return vocabulary, transducer.Words(vocabulary), regex.compile(transducer.WORDS)


@pytest.mark.parametrize("text", HARD)
def test_counts_and_ids_equal_the_library(text):
    vocabulary = bpe.Vocabulary(bpe.read_file(COUNT_FILE))
    counts = token_counts.PreTokenCounts(vocabulary, token_counts.whole_tokens(vocabulary))
    expected = Tokenizer.from_file(COUNT_FILE).encode(text, add_special_tokens=False)
    assert token_counts.count_tokens(text, counts, regex.compile(token_counts.BYTE_LEVEL)) == len(expected.ids)
    library = Tokenizer.from_file(WORD_FILE)
    ids = library.encode(text, add_special_tokens=False).ids
    assert transducer.ids_of(text, *words(WORD_FILE)) == ids
    said = library.decode(ids, skip_special_tokens=False)
    digests = [hashlib.sha256(x).hexdigest() for x in (struct.pack(f"<{len(ids)}I", *ids), said.encode())]
    assert transducer.encode(text, *words(WORD_FILE)) == (len(ids), *digests)


def test_transducer_in_any_pieces_equals_one_merge():
    vocabulary = bpe.Vocabulary(bpe.read_file(WORD_FILE))
    word = ("there" * 3_000 + "e" * 9_001).encode()
    whole = vocabulary.merge(vocabulary.symbols(word))
    for size in (1, 700, 5_000):
        machine = transducer.Transducer(vocabulary)
        tokens, most = [], 0
        for start in range(0, len(word), size):
            tokens += machine.push(word[start : start + size])
            most = max(most, len(machine.pending))
        assert tokens + machine.finish() == whole
        assert most <= transducer.CHUNK + vocabulary.lookahead + size  # constant memory


def test_heap_and_list_merges_agree():
    vocabulary = bpe.Vocabulary(bpe.read_file(COUNT_FILE))
    for text in ("strengthening", "aaaaaaaaaaaaaaa", "hellohellohello", "=========="):
        symbols = vocabulary.symbols(text.encode())
        assert vocabulary.merge(symbols) == vocabulary._merge_heap(symbols)


def test_byte_state_machine_round_trip():
    vocabulary = bpe.Vocabulary(bpe.read_file(COUNT_FILE))
    text = "日本語 😀 é plain"
    machine = transducer.TextMachine(vocabulary)
    tokens = vocabulary.merge(vocabulary.symbols(text.encode()))
    assert "".join(machine.feed([t]) for t in tokens) + machine.finish() == text


def test_encode_then_decode_frames(spark):
    docs = odd_documents(spark)
    said = transducer.decode_ids(transducer.encode_ids(docs, WORD_FILE), WORD_FILE)
    library = Tokenizer.from_file(WORD_FILE)
    for row in said.collect():
        if row["doc_id"] == 1:
            text = "Hello there, this is a plain text of some ten words"
            assert row["text"] == library.decode(library.encode(text, add_special_tokens=False).ids)


def test_queries_on_documents(spark):
    for docs in (odd_documents(spark), sf_documents(spark), no_documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        counted = sorted(map(str, token_counts.token_counts(docs, COUNT_FILE).collect()))
        library = Tokenizer.from_file(COUNT_FILE)
        expected = []
        for row in rows:
            text = row["text"] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            expected.append(f"Row(doc_id={row['doc_id']}, n_bytes={len(text.encode())}, n_tokens={n}, over_limit={n > 512})")
        assert counted == sorted(expected)
        library, expected = Tokenizer.from_file(WORD_FILE), []
        for row in rows:
            ids = library.encode(row["text"] or "", add_special_tokens=False).ids
            said = library.decode(ids, skip_special_tokens=False)
            expected.append((str(row["doc_id"]), len(ids), *map(digest, (struct.pack(f"<{len(ids)}I", *ids), said.encode()))))
        found = transducer.encode_documents(docs, WORD_FILE).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)
