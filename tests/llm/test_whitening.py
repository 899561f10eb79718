import numpy as np
import pytest

from meterframe.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int"


def plain(vectors, fit):
    x = np.floor(64 * np.array(vectors)) + 1_000_000
    base = np.floor(64 * np.array(fit)) + 1_000_000
    mean = base.mean(axis=0)
    values, turn = np.linalg.eigh((base - mean).T @ (base - mean) / len(base))
    values, turn = values[::-1], turn[:, ::-1]
    return len(base), ((len(base) * x - base.sum(axis=0)) ** 2).sum(axis=1), (x - mean) @ turn / np.sqrt(values), values / values.sum()


@pytest.mark.parametrize("use_counts", [True, False])
def test_equal_to_a_plain_eigenvalue_solution(spark, use_counts):
    dice = np.random.default_rng(5)
    vectors = (dice.normal(size=(300, 6)) * np.arange(1, 7)).tolist()
    vectors += [vectors[0]] * 200  # one vector holds two fifths of the rows
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA)
    found = whitening.whiten(frame, components=4, use_counts=use_counts).toArrow().to_pandas()
    found = found.sort_values(["vec_id", "component"])
    count, deviation, white, shares = plain(vectors, vectors if use_counts else vectors[:300])
    assert len(found) == 500 * 4 and set(found["n"]) == {count}
    assert (found["deviation"].to_numpy().reshape(-1, 4)[:, 0] == deviation.astype(np.int64)).all()
    assert np.allclose(np.abs(found["whitened"].to_numpy().reshape(-1, 4)), np.abs(white[:, :4]), atol=1e-8)
    assert np.allclose(found["explained"].to_numpy()[:4], shares[:4])
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [3.0, 1.0], 2), (2, None, 1), (3, [1.0, None], 1),
        (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1e300, 1.0], 1), (7, [], 1), (8, [1.0], 1),
        (9, [2.5, -2.0], None),
    ]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in found) == [
        ("1", 1), ("1", 1), ("1", 2), ("1", 2), ("9", 1), ("9", 2), ("None", 1), ("None", 2)
    ]
    assert {r["n"] for r in found} == {4}


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    for frame in (empty, same):
        found = whitening.whiten(frame)
        assert found.columns[:3] == ["vec_id", "component", "n"] and found.collect() == []


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 50, 0], [0, 0]])
    assert whitening._deviations(x, 2, x.sum(axis=0)) == [None, None]
    small = np.array([[3, 0], [1, 2]])
    assert whitening._deviations(small, 2, small.sum(axis=0)) == [8, 8]
