import hashlib
import struct

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from meterframe.llm import jaccard_join, mixing, personal_data, quality
from meterframe.llm.queries import QUERIES
from meterframe.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_names_and_stages():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_good", "keep_one_of_each_group", "mask_personal_data", "mix_sources", "encode",
    ]


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] >= quality.THRESHOLD]
    sets = {n: set(jaccard_join.Shingler()(t).tolist()) for n, t in kept}
    group = {n: n for n, _ in kept}
    for _ in range(3):
        for a, _ in kept:
            for b, _ in kept:
                common = len(sets[a] & sets[b])
                if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    kept = [(n, t) for n, t in kept if group[n] == n]
    network = personal_data.Network(
        personal_data.fit(spark.createDataFrame(kept, "doc_id bigint, text string"))
    )
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for number, text in kept:
        clean = personal_data.mask(text, personal_data.find([text], network)[0][1])
        ids = library.encode(clean, add_special_tokens=False).ids
        expected.append((number, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in found) == sorted(expected)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_positions_follow_the_schedule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs, block_chars=4096)
    plan = {r["doc_id"]: r for r in mixed.select("doc_id", "source", "mix.*").collect()}
    written = materialize(mixing.in_order(mixed), "mixed")
    assert len(written.inputFiles()) > 1
    found = sorted(corpus_pipeline.encode(spark, written, FOLDER).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(plan)))
    order = [plan[r["doc_id"]] for r in found]
    assert [(r["slot"], r["offset"]) for r in order] == sorted((r["slot"], r["offset"]) for r in order)
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"])
    shares = mixing.exact_shares(mixing.tempered(sizes))
    for row in order:  # before a block, its source has had less than one block more or less than its share
        assert abs(row["block"] - row["slot"] * shares[row["source"]]) < 1
