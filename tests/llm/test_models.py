import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
from helpers import LONG, no_documents, odd_documents, sf_documents

from meterframe.llm import context_mixing, mixing, personal_data, quality

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = personal_data.digits_of(match[0])
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in match[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and personal_data.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                spans.append((kind, *match.span()))
    return personal_data.in_order(spans)


def test_base_spans_against_the_patterns(spark):
    texts = [r["text"] for r in sf_documents(spark, "/root/testdata/sf0.01").collect()]
    texts += ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 (234) 567-8901-", "++12345678901"]
    texts += ["4111-1111 1111 1111  4111 1111 1111 1111 9", "@a.b", "a@.b", "é@ü.de x%@y-z.q.", "1 " * 40]
    assert [personal_data.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]


def test_network_gradient():
    network = personal_data.Network()
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    random = np.random.default_rng(0)
    inputs = random.integers(0, personal_data.CLASS_COUNT, (7, 3))
    gold = random.integers(0, personal_data.TAGS, (7, 3))
    _, gradient = network.gradient(inputs, gold)
    for name, at in (("left_in", (inputs[2, 1], 5)), ("right_step", (3, 20)), ("moves", (1, 2)), ("out", (4, 3))):
        values = []
        for step in (1e-2, -1e-2):
            network.w[name][at] += step
            values.append(network.gradient(inputs, gold)[0])
            network.w[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-2 - gradient[name][at]) < 2e-3


def test_network_finds_variants_and_leaves_the_rest(spark):
    docs = sf_documents(spark, "/root/testdata/sf0.01")
    weights = personal_data.fit(docs)
    network = personal_data.Network(weights)
    spans = [personal_data.find([t], network)[0][1] for t in ("call (743) 555-3824 now", "on 2024-01-12 v1.2.3.4000", "plain")]
    assert spans == [[("phone", 5, 19)], [], []]
    found = personal_data.personal_data(docs, weights).collect()
    assert sum(r["n_added"] for r in found) <= 5
    held = [t for t, _ in [(w, s) for w, s in personal_data.made_windows(170)]]
    truth = [s for _, s in personal_data.made_windows(170)]
    hits = sum(set(s) <= set(personal_data.find([t], network)[0][1]) for t, s in zip(held, truth) if s)
    assert hits >= 0.8 * sum(bool(s) for s in truth)


def test_personal_data_on_odd_rows(spark):
    weights = personal_data.Network().w
    docs = odd_documents(spark)
    assert personal_data.personal_data(docs, weights).count() == 9
    clean = personal_data.redacted(docs.unionByName(docs.limit(1).selectExpr(
        "doc_id", "'mail a.b@c.de now' text", "lang", "source", "17L n_chars", "score", "mix", "quality")), weights)
    assert clean.columns == docs.columns
    texts = {r["text"]: r["n_chars"] for r in clean.collect()}
    assert texts["mail <email> now"] == 16 and None in texts
    assert personal_data.personal_data(no_documents(spark)).count() == 0
    assert personal_data.mask("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a<ip>ef"


def test_base_score_against_brute_force(spark):
    docs = odd_documents(spark).unionByName(sf_documents(spark).selectExpr(
        "doc_id + 100 doc_id", "text", "lang", "source", "n_chars", "0D score", "'m' mix", "1 quality"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    fold = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}

    def tokens(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]

    counts = collections.Counter(t for d, text in rows if not fold[d] for t in tokens(text))
    total = sum(counts.values())
    expected = []
    for number, text in rows:
        mine = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in mine)
        expected.append((str(number), fold[number], len(mine), sum(counts[t] > 0 for t in mine), total, round(base, 6)))
    found = context_mixing.score_documents(docs).collect()
    mine = [(str(r[0]), r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in found]
    assert sorted(mine) == sorted(expected)
    for row in found:
        assert row["score"] < 0
    held = [r for r in found if r["held_out"] and r["n_bytes"] > 500]
    assert sum(r["bits_per_byte"] for r in held) / len(held) < 3.2  # far below the 4.2 of single letters
    assert context_mixing.score_documents(no_documents(spark)).count() == 0


def test_mixer_predicts_a_distribution():
    random = np.random.default_rng(0)
    seen = context_mixing.gram_keys(bytes(random.choice(list(b"abcdefg "), 5000).astype(np.uint8)))
    counts = [
        context_mixing.Counts(context_mixing.of_order(seen, order), random.integers(0, 9, len(seen)))
        for order in range(context_mixing.PREDICTORS)
    ]
    mixer = context_mixing.Mixer(counts, None, context_mixing.refinement(np.ones((2, 256 * context_mixing.BUCKETS))))
    context = context_mixing.gram_keys(b"abcdefg")[6] & ~np.uint64(0xFF)
    keys = context | np.arange(256, dtype=np.uint64)
    assert abs(float((10.0 ** mixer.cost(keys)).sum()) - 1.0) < 1e-4
    scorer = context_mixing.Scorer(mixer)
    texts = [b"", b"abc", LONG.encode(), b"abc"]
    scores = scorer.scores(texts)
    assert scores[1] == scores[3] == scorer.scores([b"abc"])[0]
    assert abs(scores[2] - float(mixer.cost(context_mixing.gram_keys(texts[2])).sum())) < 1e-6 * abs(scores[2])


def test_counts_over_two_hundred_million_keep_their_ratio():
    keys = context_mixing.gram_keys(b"abcdef")[5] & ~np.uint64(0xFF) | np.array([0, 255], np.uint64)
    exact = [
        context_mixing.Counts(context_mixing.of_order(keys, order), np.array([3 * 10**8, 3 * 10 ** (9 + order)]))
        for order in range(context_mixing.PREDICTORS)
    ]
    x, _, _ = next(context_mixing.Mixer(exact).inputs(keys, False))
    assert np.allclose(x[: context_mixing.PREDICTORS, 0], np.log(10.0) * np.arange(1, 7))


def test_word_contexts(monkeypatch):
    keys = context_mixing.gram_keys("xy Ecole École école\nécoles, anticipation Anticipation".encode())
    words = context_mixing.of_order(keys, context_mixing.PREDICTORS - 1)
    at = {w: "xy Ecole École école\nécoles, anticipation Anticipation".encode().index(w.encode()) for w in
          ("École", "école\n", "anticipation", "Anticipation")}
    for i in range(2, len("anticipation")):  # after two letters, whatever the case of the first
        assert words[at["anticipation"] + i] == words[at["Anticipation"] + i]
    assert keys[at["anticipation"] + 9] >> np.uint64(48) and not keys[at["anticipation"] + 3] >> np.uint64(48)
    for i in range(3, len("école".encode())):
        assert words[at["École"] + i] == words[at["école\n"] + i]
    assert len(context_mixing.gram_keys(b"")) == 1
    whole = context_mixing.gram_keys(LONG[:5000].upper().encode())
    for size in (1, 7, 4096):
        monkeypatch.setattr(context_mixing, "PASS", size)
        assert (context_mixing.gram_keys(LONG[:5000].upper().encode()) == whole).all()
    assert (context_mixing.gram_keys(b"no white space at all") < context_mixing.HELD).all()


def test_held_out_bits_a_byte(spark):
    """Far below the five-byte contexts alone (2.24), near the add-one unigram score, which gets case and white space free."""
    rows = context_mixing.score_documents(sf_documents(spark, "/root/testdata/sf0.01")).filter("held_out").collect()
    size = sum(r["n_bytes"] for r in rows)
    assert -sum(r["score"] for r in rows) * math.log2(10) / size < 2.17


def test_learning_does_not_depend_on_tasks(spark):
    docs = sf_documents(spark)
    results = []
    for tasks in (1, 7):
        rows = context_mixing.score_documents(docs.repartition(tasks)).collect()
        results.append(sorted((r["doc_id"], r["score"]) for r in rows))
    assert [r[0] for r in results[0]] == [r[0] for r in results[1]]
    assert np.allclose([r[1] for r in results[0]], [r[1] for r in results[1]], rtol=1e-9)


def test_counts_of_every_context_apart():
    random = np.random.default_rng(0)
    keys = np.unique(random.integers(0, 1 << 48, 300_000, dtype=np.uint64))
    counts = context_mixing.Counts(keys, np.ones(len(keys), np.int64))
    seen = sum(sum(zeros + ones) for zeros, ones in list(counts.branches(keys[:2000]))[:1])
    assert seen == 2000  # with hashed slots, contexts that share one would add up
    other = np.setdiff1d(random.integers(0, 1 << 48, 1000, dtype=np.uint64) >> np.uint64(8), keys >> np.uint64(8))
    assert not any((zeros + ones).any() for zeros, ones in counts.branches(other << np.uint64(8)))


def test_scores_do_not_depend_on_the_frequent_grams(spark, monkeypatch):
    docs = odd_documents(spark).unionByName(sf_documents(spark).selectExpr(
        "doc_id + 100 doc_id", "text", "lang", "source", "n_chars", "0D score", "'m' mix", "1 quality"))
    results = []
    for size in (context_mixing.HEAD_GRAMS, 500, 0):
        monkeypatch.setattr(context_mixing, "HEAD_GRAMS", size)
        rows = context_mixing.score_documents(docs).collect()
        results.append(sorted((str(r["doc_id"]), r["n_bytes"], r["score"]) for r in rows))
    for other in results[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in results[0]]
        assert np.allclose([r[2] for r in other], [r[2] for r in results[0]], rtol=1e-9)


def test_counts_travel_in_packs(spark):
    """One row per share and task instead of one per word or gram, with the same counts."""
    random = np.random.default_rng(0)
    texts = [bytes(random.choice(list(b"abcdefgh  E"), 600).astype(np.uint8)).decode() for _ in range(400)] + [None, "", "é" * 9]
    rows = spark.createDataFrame([(t, i % 7 == 2) for i, t in enumerate(texts)], "text string, held_out boolean").repartition(3)
    found = context_mixing.gather(rows).collect()
    assert len(found) <= 2 * context_mixing.SHARES
    learned, held, words = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in enumerate(texts):
        (held if i % 7 == 2 else learned).update(context_mixing.gram_keys((text or "").encode()).tolist())
        if i % 7 != 2:
            words.update([*(text or "").encode().lower().split(), b" "])
    grams = [r for r in found if r["kind"] == context_mixing.GRAM_KIND]
    for column, expected in (("learned", learned), ("held", held)):
        counts = collections.Counter()
        for r in grams:
            keys, times = context_mixing.unpacked_keys(r["keys"]), context_mixing.unpacked(r[column], np.int64)
            assert r["n"] == len(keys) == len(set(keys.tolist()))
            counts.update({k: n for k, n in zip(keys.tolist(), times.tolist()) if n})
        assert counts == expected
    mine = [r for r in found if r["kind"] == context_mixing.WORD_KIND]
    pairs = [p for r in mine for p in zip(
        context_mixing.unpacked_words(r["keys"]).to_pylist(), context_mixing.unpacked(r["learned"], np.int64).tolist())]
    assert len(pairs) == len(words) and dict(pairs) == dict(words)
    assert sum(r["n"] for r in mine) == len(words) and sum(r["times"] for r in mine) == sum(words.values())


def test_parts_are_those_of_sparks_hash(spark):
    keys = context_mixing.gram_keys("A wide Ärea, aßb 日本".encode())
    contexts = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF) | np.uint64(0x202020)
    rows = spark.createDataFrame([(int(c),) for c in contexts], "c bigint").selectExpr("hash(c) h").collect()
    assert context_mixing.spread(keys).tolist() == [r["h"] for r in rows]


def test_joined_texts_have_the_grams_of_each(monkeypatch):
    texts = [b"", "École a École".encode(), b"x" * 900, b"", b"a longer word than that one", LONG[:3000].encode()]
    expected = [context_mixing.gram_keys(t) for t in texts]
    for size in (64, 1000, 1 << 17):
        monkeypatch.setattr(context_mixing, "PASS", size)
        found = [[] for _ in texts]
        for keys, owners, starts in context_mixing.joined_grams(texts):
            for owner, some in zip(owners, np.split(keys, starts[1:])):
                found[owner].extend(some.tolist())
        assert found == [e.tolist() for e in expected]


def test_lookup_by_hash_and_in_slices(monkeypatch):
    random = np.random.default_rng(0)
    keys = np.unique(random.integers(0, 1 << 62, 5000, dtype=np.uint64))
    costs = random.random(len(keys))
    monkeypatch.setattr(context_mixing, "HEAD_BITS", 8)  # many share a place
    head = context_mixing.HeadCosts(keys[::2], costs[::2])
    assert np.array_equal(head.cost(keys[::2]), costs[::2]) and np.isnan(head.cost(keys[1::2])).all()
    counts = [context_mixing.Counts(context_mixing.of_order(keys, o), np.ones(len(keys), np.int64)) for o in range(6)]
    mixer = context_mixing.Mixer(counts)
    whole = mixer.cost(keys)
    monkeypatch.setattr(context_mixing, "LOOKED_UP", 700)
    assert np.allclose(mixer.cost(keys), whole, rtol=1e-12)


def test_rare_words_and_grams_are_looked_up(spark, monkeypatch):
    docs = sf_documents(spark)
    results = []
    for words, grams, rare in ((100_000, 1 << 21, 1_000_000), (10, 100, 50)):
        monkeypatch.setattr(context_mixing, "HEAD_WORDS", words)
        monkeypatch.setattr(context_mixing, "HEAD_GRAMS", grams)
        monkeypatch.setattr(context_mixing, "RARE", rare)
        monkeypatch.setattr(context_mixing, "PART_GRAMS", 3_000)  # more parts than shares
        monkeypatch.setattr(context_mixing, "SHARES", 1024 if rare > 50 else 3)
        rows = context_mixing.score_documents(docs).collect()
        results.append(sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows))
    assert [r[:3] for r in results[0]] == [r[:3] for r in results[1]]
    assert np.allclose([r[3:] for r in results[0]], [r[3:] for r in results[1]], rtol=1e-9)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.classify(sf_documents(spark, folder), labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored)
    assert right >= 0.93 * len(scored)
    assert sum(r["predicted"] for r in scored if r["quality"]) >= 0.97 * sum(r["quality"] for r in scored)


def test_quality_learns_a_repeated_id_once(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int")
    rows = [(1, "good text here"), (3, "bad words there")]
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    often = spark.createDataFrame(rows + [(1, "other text")] * 500 + rows[1:] * 300, "doc_id bigint, text string")
    assert (quality.fit(once, labels) == quality.fit(often, labels)).all()


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (7, 5, 1)], "doc_id bigint, quality int, toxic int")
    docs = odd_documents(spark)
    found = quality.classify(docs, labels).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_documents(spark), labels).count() == 0


def assert_less_than_one_off(weights, slots):
    """Against the true weights: before and after each block its source is less than one block off."""
    exact = {n: Fraction(w) for n, w in weights.items()}
    total = sum(exact.values())
    blocks = {n: math.ceil(w / total * slots) + 1 for n, w in exact.items()}
    placed = mixing.schedule(mixing.exact_shares(weights), blocks)
    assert {n: len(own) for n, own in placed.items()} == blocks
    used = sorted(slot for own in placed.values() for slot, _, _ in own if slot < slots)
    assert used == list(range(slots))
    for name, own in placed.items():
        for block, (slot, release, deadline) in enumerate(own):
            assert release <= slot < deadline
            assert abs(block * total - exact[name] * slot) < total
            assert abs((block + 1) * total - exact[name] * (slot + 1)) < total


def test_every_block_in_its_window_and_less_than_one_off():
    random = np.random.default_rng(1)
    for _ in range(20):
        assert_less_than_one_off({f"s{i}": float(random.random() ** 3 + 1e-4) for i in range(random.integers(1, 40))}, 500)


def test_schedule_does_not_drift_from_the_true_weights():
    random = np.random.default_rng(2)
    assert_less_than_one_off(mixing.tempered({f"s{i}": int(random.integers(1, 10**9)) for i in range(20)}), 120_000)


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 7)
    docs = sf_documents(spark)
    rows = mixing.mix(docs, block_chars=1).select("source", "mix.*").collect()
    sources = {r["source"] for r in rows}
    assert len(rows) == docs.count() and len({(r["source"], r["block"]) for r in rows}) <= 7 + len(sources)


def test_mix_places_all_documents(spark):
    docs = sf_documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mix(docs, block_chars=4096).select("doc_id", "source", "text", "mix.*").collect()
    assert len(rows) == 1000
    by_source = collections.defaultdict(list)
    owner = {}
    for row in rows:
        by_source[row["source"]].append((row["offset"], len(row["text"])))
        assert row["block"] == row["offset"] // 4096 and row["release"] <= row["slot"] < row["deadline"]
        assert owner.setdefault(row["slot"], row["source"]) == row["source"]
    for places in by_source.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0


def test_mix_on_odd_rows(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.count() == 9
    ordered = mixing.in_order(mixed)
    assert ordered.columns == [c for c in docs.columns if c != "mix"] and ordered.count() == 9
    some = mixing.mix(docs, weights={"a": 3.0, None: 1.0})
    assert {r["source"] for r in some.filter("mix.slot is null").collect()} == {"b"}
    assert mixing.mix(no_documents(spark)).count() == 0
