import hashlib

import numpy as np
from helpers import no_documents, odd_documents, sf_documents

from meterframe.llm import winnowing as w


def brute(text, gram=w.GRAM, window=w.WINDOW):
    """Winnowing by its definition, window after window."""
    points = w.code_points(text)
    if not len(points):
        return []
    hashes = w.gram_hashes(points, min(gram, len(points))).tolist()
    chosen = []
    for start in range(max(1, len(hashes) - window + 1)):
        part = hashes[start : start + window]
        at = start + max(i for i, h in enumerate(part) if h == min(part))
        if not chosen or chosen[-1] != (hashes[at], at):
            chosen.append((hashes[at], at))
    return chosen


def test_matches_definition():
    random = np.random.default_rng(1)
    for size in (0, 1, 5, 15, 16, 17, 40, 47, 48, 300):
        for letters in ("a", "ab", "abcdefé😀"):
            text = "".join(random.choice(list(letters), size))
            assert list(zip(*(x.tolist() for x in w.winnow(text)))) == brute(text)


def test_shared_passage_shares_a_fingerprint():
    random = np.random.default_rng(2)
    letters = list("abcdefghij ")
    passage = "".join(random.choice(letters, w.GRAM + w.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(random.choice(letters, 100)) + passage + "".join(random.choice(letters, 80)) for _ in "ab")
        found_a, found_b = (dict(zip(*(x.tolist() for x in w.winnow(t)))) for t in (a, b))
        common = set(found_a) & set(found_b)
        assert any(100 <= found_a[h] < 180 for h in common)


def expected(rows):
    """Neighbours by descending id, null last, ties by Spark's hash order left out of the check."""
    out = {}
    for n, (number, text) in enumerate(rows):
        follower = rows[(n + 1) % len(rows)][1] or ""
        text = text or ""
        changed = w.edited(text, follower)
        own, other, after = (w.winnow(x) for x in (text, changed, follower))
        sets = [np.unique(x[0]) for x in (own, other, after)]
        out[number] = (
            len(text),
            hashlib.sha256(changed.encode()).hexdigest(),
            w.as_text(own),
            w.as_text(other),
            w.likeness(sets[0], sets[1]),
            w.likeness(sets[0], sets[2]),
        )
    return out


def test_followers_over_ranges(spark):
    docs = sf_documents(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    found = {r[0]: tuple(r)[1:] for r in w.fingerprint_edits(docs).collect()}
    assert found == expected(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = w.fingerprint_edits(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["n_chars"] == 0 and by_id[2]["fingerprint"] == ""
    assert by_id[1]["fingerprint"] == by_id[7]["fingerprint"]
    assert None in by_id
    one = docs.filter("doc_id = 1")
    row = w.fingerprint_edits(one).first()
    assert row["edited_sha256"] == expected([(1, one.first()["text"])])[1][1]
    assert w.fingerprint_edits(no_documents(spark)).count() == 0
    assert w.fingerprints(docs).filter("size(grams) > 0").count() == 7
