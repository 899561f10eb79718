import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import no_documents, odd_documents, sf_documents

from meterframe.llm import rank_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = random.Random(3)
HARD = [
    "",
    None,
    " ",
    "it's <|endoftext|>x 's't're'll''s \n'd",
    "Σας ΟΔΟΣ İstanbul é ẞ",
    "x" * 5_000,
    "ab" * 3_000,
    "thethethe" * 900,
    "\x1c\x1f \x85  a  b\n\n c\t",
    "0x12 1234567 ½²",
    "日本語のテキスト 😀👍🏽",
    " " * 700 + "x",
    "-" * 1_500 + "=#" * 400,
    "".join(LETTERS.choice("etaoinshr") for _ in range(3_000)),
    "same words same words",
    "".join(chr(c) for c in range(0x20, 0x1800)),
]


def library():
    ranks = rank_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def expected(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    said = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


def test_words_are_the_matches_of_the_pattern():
    pattern, dice = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    signs = ["'", "'", "s", "t", "re", "ll", "d", "a", " ", " ", "\n", "　", "1", "½", "!", "é", "日", "😀", "\x85"]
    for _ in range(500):
        texts = ["".join(dice.choice(signs) for _ in range(dice.randint(0, 14))) or None for _ in range(6)]
        bounds, words = rank_bpe.split_words(pa.array(texts, pa.string()))
        words = words.to_pylist()
        assert [words[bounds[i] : bounds[i + 1]] for i in range(6)] == [pattern.findall(t or "") for t in texts]


@pytest.mark.parametrize("limit", [rank_bpe.DICTIONARY_BYTES, 0])
def test_digests_equal_the_library_with_and_without_the_dictionary(spark, limit):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in rank_bpe.encode_documents(rows, PATH, limit=limit).collect()}
    encoding = library()
    assert found == {i: expected(t, encoding) for i, t in enumerate(HARD)}


def test_table_rows_equal_the_library(spark):
    documents = sf_documents(spark)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    encoding = library()
    found = rank_bpe.encode_documents(documents, PATH).collect()
    assert len(found) == len(texts)
    assert all(tuple(r)[1:] == expected(texts[r["doc_id"]], encoding) for r in found)


def test_ids_and_their_bytes(spark):
    rows = spark.createDataFrame([(1, "it's a test, it's"), (2, None), (None, "日本")], "doc_id long, text string")
    encoding = library()
    ids = rank_bpe.encode_ids(rows, PATH)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {
        1: encoding.encode_ordinary("it's a test, it's"), 2: [], None: encoding.encode_ordinary("日本")
    }
    assert {bytes(r["bytes"]) for r in rank_bpe.decode_ids(ids, PATH).collect()} == {
        b"it's a test, it's", b"", "日本".encode()
    }


def test_odd_rows_and_empty_tables(spark):
    odd = odd_documents(spark)
    encoding = library()
    want = sorted((str(r["doc_id"]), *expected(r["text"], encoding)) for r in odd.collect())
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in rank_bpe.encode_documents(odd, PATH).collect()) == want
    assert rank_bpe.encode_documents(no_documents(spark), PATH).collect() == []
