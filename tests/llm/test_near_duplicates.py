import collections
import math

import duckdb
import numpy as np
from helpers import no_documents, odd_documents

from meterframe.llm import cover_tree, graph, jaccard_join
from meterframe.llm.queries import ORACLES


def shingles(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows):
    """(links, group) per position by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = np.arange(len(rows))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 5 * common >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                graph.unite(parent, np.array([i]), np.array([j]))
    roots = graph.find(parent, parent)
    ids = collections.defaultdict(list)
    for (number, _), root in zip(rows, roots):
        if number is not None:
            ids[root].append(number)
    return [(n, links[i], min(ids[roots[i]], default=None)) for i, (n, _) in enumerate(rows)]


def copies(count=240):
    """Groups of exact and near copies of different closeness, and texts that share one passage."""
    random = np.random.default_rng(4)
    lexicon = [f"w{i}" for i in range(3000)]
    passage = list(random.choice(lexicon, 60))
    rows = []
    while len(rows) < count:
        base = list(random.choice(lexicon, random.integers(30, 200)))
        for changes in random.integers(0, 6, random.integers(1, 9)):
            words = list(base)
            for at in random.integers(0, len(words), changes):
                words[at] = str(random.choice(lexicon))
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*passage, *random.choice(lexicon, 90)])))
    return rows


def test_links_against_all_pairs(spark):
    rows = copies()
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_links"], r["group_id"]) for r in found) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in found)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = copies(100)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_links"], r["group_id"]) for r in found) == sorted(brute(rows))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = jaccard_join.near_duplicates(docs).collect()
    expected = [(n, k, n if not shingles(t) else g) for (n, t), (_, k, g) in zip(rows, brute(rows))]
    assert sorted(((r["doc_id"], r["n_links"], r["group_id"]) for r in found), key=str) == sorted(expected, key=str)
    left = jaccard_join.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 2, 3, 4, 5, 6, None]
    assert jaccard_join.deduplicated(no_documents(spark)).count() == 0


def test_pruning_keeps_similar_pairs():
    assert jaccard_join.LEAST == sorted(jaccard_join.LEAST)
    for compared, least in zip(range(32, 129, 32), jaccard_join.LEAST):
        tail = sum(math.comb(compared, m) * 0.8**m * 0.2 ** (compared - m) for m in range(least))
        assert tail < 1e-7  # a pair at the threshold is dropped less often than this


def vectors_table(spark):
    random = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        centres = random.normal(size=(12, 16))
        for n in range(120):
            vector = centres[n % 12] + random.normal(size=16) * (0.02 if n % 3 else 0.5)
            rows.append((len(rows), [float(np.float32(x)) for x in vector], label, "x"))
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8, [2.0] * 8]
    for vector in [*odd, rows[0][1], rows[0][1]]:
        rows.append((len(rows), vector, 0, "x"))
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n_links string"), rows


def expected_vectors(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        wide = np.array(v, np.float64)
        return wide / math.sqrt(wide @ wide)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    parent, links = np.arange(len(rows)), [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2] or a @ b < 0.93:
                continue
            links[i] += 1
            links[j] += 1
            graph.unite(parent, np.array([i]), np.array([j]))
    roots = graph.find(parent, parent)
    return [(r[0], links[i], rows[roots[i]][0]) for i, r in enumerate(rows)]


def test_cover_trees_against_all_pairs(spark):
    frame, rows = vectors_table(spark)
    for block in (4096, 20):
        found = cover_tree.near_duplicates(frame, block=block).collect()
        assert sorted((r[0], r[1], r[2]) for r in found) == expected_vectors(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert cover_tree.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_without_id_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)]
    found = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect()), key=str) == [(3, 1, 3, True)] * 2 + [(None, 1, None, False)] * 2


def test_tree_levels():
    points = cover_tree.unit(np.random.default_rng(0).normal(size=(500, 6)))
    tree = cover_tree.CoverTree(points)

    def below(node):
        if tree.members[node] is not None:
            return set(tree.members[node].tolist())
        parts = [below(c) for c in tree.children[node]]
        assert sum(map(len, parts)) == len(set().union(*parts))
        return set().union(*parts)

    assert below(tree.root) == set(range(500))
    for node in range(len(tree.centre)):
        away = np.linalg.norm(points[sorted(below(node))] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-9
        if tree.children[node] is not None:
            assert tree.centre[tree.children[node][0]] == tree.centre[node]


def test_embeddings_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = sorted(connection.execute(ORACLES["op8_cover_tree"]).fetchall())
    assert sorted(map(tuple, cover_tree.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet")).collect())) == expected


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, n) for n in range(101, 160)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 160), 100)}


def test_extreme_components_link(spark):
    rows = [
        (1, [1e-200, 0.0], 1), (2, [2e-200, 0.0], 1), (3, [1e200, 1.0], 2), (4, [1.1e200, 1.0], 2), (5, [0.0, 1e200], 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(frame).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
