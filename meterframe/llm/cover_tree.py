"""Exact near-duplicate embeddings by cover trees that are walked in pairs.

A tree's levels have halving radii: a node's points are covered by children whose centres lie
more than the level's radius apart, the first being the node's own centre. Two nodes whose
centres are further apart than the link distance plus both covering radii hold no link, so the
pair is dropped whole; pairs of leaves are compared in full. On unit vectors a cosine of at
least c is a distance of at most sqrt(2 - 2c).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm import graph
from meterframe.llm.common import map_batches, parallelism
from meterframe.session import materialize

THRESHOLD = 0.93
BLOCK = 4_096  # vectors per tree; larger groups become several trees, compared pair by pair
LEAF = 24
FINEST = 1 / 64
SLACK = 1e-9


class CoverTree:
    """Nodes as parallel lists: centre (point index), covering radius, children, leaf points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.members: list[np.ndarray | None] = []
        everything = np.arange(len(points))
        self.root = self._build(0, everything, self._distance(0, everything), 1.0)
        self.centres = np.array(self.centre)
        self.radii = np.array(self.radius)

    def _distance(self, centre: int, among: np.ndarray) -> np.ndarray:
        cosine = self.points[among] @ self.points[centre]
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))

    def _build(self, centre: int, among: np.ndarray, away: np.ndarray, radius: float) -> int:
        """`away`: distances of `among` from the centre; `radius`: that of the children's level."""
        number = len(self.centre)
        reach = float(away.max()) if len(away) else 0.0
        self.centre.append(centre)
        self.radius.append(reach)
        self.children.append(None)
        self.members.append(among)
        if len(among) <= LEAF or reach <= FINEST:
            return number
        while radius >= reach:  # a level at which the node is its own only child
            radius /= 2
        balls = []
        rest, distance, ball = among, away, centre
        while True:
            near = distance <= radius
            balls.append((ball, rest[near], distance[near]))
            rest = rest[~near]
            if not len(rest):
                break
            ball = int(rest[0])
            distance = self._distance(ball, rest)
        self.members[number] = None
        self.children[number] = np.array([self._build(*ball, radius / 2) for ball in balls])
        return number


def linked_pairs(
    a: CoverTree, b: CoverTree, threshold: float, found: Callable[[np.ndarray, np.ndarray], None]
) -> None:
    """Calls `found` with point indices of `a` and `b` for all pairs at or over `threshold`.

    With `a is b` each unordered pair comes once, without the points themselves.
    """
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + SLACK
    same = a is b
    todo = [(a.root, b.root)]
    while todo:
        x, y = todo.pop()
        mine, other = a.members[x], b.members[y]
        if mine is not None and other is not None:
            hits = np.nonzero(a.points[mine] @ b.points[other].T >= threshold)
            left, right = mine[hits[0]], other[hits[1]]
            if same and x == y:
                once = left < right
                left, right = left[once], right[once]
            if len(left):
                found(left, right)
            continue
        xs = a.children[x] if mine is None else np.array([x])
        ys = b.children[y] if other is None else np.array([y])
        cosine = a.points[a.centres[xs]] @ b.points[b.centres[ys]].T
        distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))
        near = distance <= limit + a.radii[xs][:, None] + b.radii[ys][None, :]
        if same and x == y:
            near = np.triu(near)
        i, j = np.nonzero(near)
        single = [a.members[n] is not None for n in xs], [b.members[n] is not None for n in ys]
        leaves = np.array(single[0])[i] & np.array(single[1])[j]
        if leaves.any() and not (same and x == y):
            _compare_leaves(a, b, xs[i[leaves]], ys[j[leaves]], threshold, found, same)
            i, j = i[~leaves], j[~leaves]
        elif leaves.any():
            _compare_leaves(a, b, xs[i[leaves]], ys[j[leaves]], threshold, found, same)
            i, j = i[~leaves], j[~leaves]
        todo.extend(zip(xs[i].tolist(), ys[j].tolist()))


def _compare_leaves(a, b, xs, ys, threshold, found, same, chunk: int = 50_000) -> None:
    """All points of leaf pairs, flattened so that many small leaves cost one product."""
    sizes_x = np.array([len(a.members[n]) for n in xs])
    sizes_y = np.array([len(b.members[n]) for n in ys])
    ends = np.cumsum(sizes_x * sizes_y)
    start = 0
    while start < len(xs):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        left = np.concatenate([np.repeat(a.members[n], s) for n, s in zip(xs[start:stop], sizes_y[start:stop])])
        right = np.concatenate([np.tile(b.members[n], s) for n, s in zip(ys[start:stop], sizes_x[start:stop])])
        twin = np.repeat(xs[start:stop] == ys[start:stop], (sizes_x * sizes_y)[start:stop]) & same
        keep = ~twin | (left < right)
        left, right = left[keep], right[keep]
        hits = np.einsum("ij,ij->i", a.points[left], b.points[right]) >= threshold
        if hits.any():
            found(left[hits], right[hits])
        start = stop


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two brings each row near one first, so that no square over- or underflows."""
    wide = vectors.astype(np.float64)
    exponent = np.frexp(np.abs(wide).max(axis=1, initial=0.0))[1]
    wide = np.ldexp(wide, -exponent[:, None])
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def compare_blocks(
    first: np.ndarray, first_size: np.ndarray, second: np.ndarray | None, second_size: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) per class of the first block, then of the second (None: the first with itself).

    `links` counts vectors of linked classes, `root` is the smallest position reachable.
    """
    a = CoverTree(unit(first))
    b = a if second is None else CoverTree(unit(second))
    shift = 0 if second is None else len(first)
    sizes = first_size if second is None else np.concatenate((first_size, second_size))
    links = np.zeros(len(sizes), np.int64)
    parent = np.arange(len(sizes))

    def found(left: np.ndarray, right: np.ndarray) -> None:
        right = right + shift
        np.add.at(links, left, sizes[right])
        np.add.at(links, right, sizes[left])
        graph.unite(parent, left, right)

    linked_pairs(a, b, threshold, found)
    return links, graph.find(parent, parent)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of (vec_id, embedding, label): n_links, component_id and kept.

    Only vectors of one label (and one length) are compared, in double precision; a link is a
    cosine of at least `threshold`. Vectors that are null, zero or hold a null or non-finite
    component, and those without a label, have no links and are their own component. Equal
    vectors are one class: they are compared once and link with each other. Rows that repeat a
    vec_id are vectors of their own; a row without vec_id counts as a link of others, but names
    no component: if no id can be reached, component_id is null and kept is false. Other
    columns are not read.

    A label's classes are dealt into blocks of about `block` vectors and each pair of blocks is
    one group of rows, so a label with a third of all rows spreads over many tasks.
    """
    value = F.col("embedding")
    rows = embeddings.select("vec_id", "embedding", "label")
    spoiled = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("label").isNotNull() & value.isNotNull() & ~spoiled & F.exists(value, lambda x: x != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = ["label", "embedding"]
    grouped = marked.filter("sound").groupBy(*key).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = materialize(grouped.withColumn("class", F.monotonically_increasing_id()), "vector-classes")

    shape = [F.col("label"), F.size("embedding").alias("width")]
    counts = classes.groupBy(*shape).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.withColumn("width", F.size("embedding")).join(counts, ["label", "width"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["label", "width", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    pairs = dealt.select(*group, (F.col("own") > F.col("other")).alias("second"), "class", "size", "embedding")
    placed = pairs.repartition(4 * parallelism(embeddings.sparkSession), "label", "width", "i", "j")
    placed = placed.sortWithinPartitions("label", "width", "i", "j", "second", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key_, rows_ in _groups(batches):
            vectors = np.array([r[3] for r in rows_], np.float64)
            numbers = np.array([r[1] for r in rows_], np.int64)
            sizes = np.array([r[2] for r in rows_], np.int64)
            second = np.array([r[0] for r in rows_], bool)
            cut = int(np.count_nonzero(~second))
            if key_[2] == key_[3]:
                links, roots = compare_blocks(vectors, sizes, None, sizes, threshold)
            elif 0 < cut < len(rows_):
                links, roots = compare_blocks(vectors[:cut], sizes[:cut], vectors[cut:], sizes[cut:], threshold)
            else:
                continue
            hit = np.flatnonzero(links)
            if len(hit):
                columns = [pa.array(numbers[hit]), pa.array(links[hit]), pa.array(numbers[roots[hit]])]
                yield pa.RecordBatch.from_arrays(columns, ["class", "links", "root"])

    linked = materialize(map_batches(placed, compare, "class bigint, links bigint, root bigint"), "vector-links")
    roots = graph.components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    totals = linked.groupBy(F.col("class").alias("c")).agg(F.sum("links").alias("links"))
    known = classes.join(totals, F.col("class") == F.col("c"), "left").join(
        roots, F.col("class") == F.col("node"), "left"
    )
    known = known.withColumn("root", F.coalesce("root", "class")).select(*key, "first_id", "size", "links", "root")
    known = materialize(known, "vector-known")
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component"))
    found = known.join(smallest, "root").select(
        F.lit(True).alias("known"), *key, "component", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n")
    )
    result = marked.join(found.withColumnRenamed("known", "sound"), ["sound", *key], "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first four columns; a group is bounded by two blocks."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        columns.append([None] * batch.num_rows)
        vectors = batch.column(7)
        for n in range(batch.num_rows):
            at = tuple(columns[i][n] for i in range(4))
            if at != key:
                if rows:
                    yield key, rows
                key, rows = at, []
            rows.append((columns[4][n], columns[5][n], columns[6][n], vectors[n].values.to_numpy(zero_copy_only=False)))
    if rows:
        yield key, rows
