import hashlib
import zlib

import pytest
from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from meterframe.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    size = None if row["n_chars"] is None else row["n_chars"] + more
    return digest(*[value(v) for v in (row["doc_id"], row["source"], row["lang"], size, row["text"])])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, place):
    out = []
    for nodes in tree[:-1]:
        left = nodes[place - 1] if place % 2 else ""
        right = nodes[place + 1] if place % 2 == 0 and place + 1 < len(nodes) else ""
        out.append((left, right))
        place //= 2
    return out


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for number, name in enumerate(names):
        for place, row in enumerate(groups[name]):
            path = siblings(trees[name], place) + siblings(top, number)
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            own = leaf(row, int(tampered))
            for left, right in path:
                own = digest(left, own, right)
            proof = digest(*[a + b for a, b in path])
            yield row["doc_id"], leaf(row), trees[name][-1][0], top[-1][0], proof, own, own == top[-1][0]


def same(found, rows):
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain([r.asDict() for r in rows.collect()])))


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_equal_to_plain_trees(spark, bits):
    counts = spark.range(1, 38).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") > 4, "fr").alias("lang"),
        (F.col("id") % 9).alias("n_chars"), F.concat(F.lit("té "), "id").alias("text"),
    )
    same(merkle.verified(merkle.manifest(counts, bits=bits)), counts)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    same(merkle.verified(merkle.manifest(odd, bits=2)), odd)


def test_one_leaf_and_no_leaf(spark):
    one = odd_documents(spark).filter("doc_id = 1")
    found = merkle.verified(merkle.manifest(one)).collect()
    same(merkle.verified(merkle.manifest(one)), one)
    assert found[0]["leaf"] == found[0]["subroot"] == found[0]["root"]
    assert merkle.verified(merkle.manifest(no_documents(spark))).collect() == []


def test_a_changed_text_breaks_only_its_own_proof(spark):
    rows = odd_documents(spark).filter("doc_id in (1, 3, 6, 7)")
    proofs = merkle.manifest(rows, bits=2).select("doc_id", "leaf", "path", "root").collect()
    again = merkle.manifest(rows.withColumn("text", F.when(F.col("doc_id") == 3, "new").otherwise(F.col("text"))), bits=2)
    leaves = {r["doc_id"]: r["leaf"] for r in again.collect()}
    for row in proofs:
        own = leaves[row["doc_id"]]
        for step in row["path"]:
            own = digest(step["left"] or "", own, step["right"] or "")
        assert (own == row["root"]) == (row["doc_id"] != 3)
