"""A Merkle manifest by nested-struct rollup.

Leaves are ranked inside their group and dealt to blocks of consecutive ranks. Inside a block the
binary digits of the rank are columns: each rollup step groups the last digit away and nests the
two children of a node in a struct of its parent, until one struct holds the block's tree. A
block's sorted rows serve all of its steps, so a round takes one shuffle. The roots of the blocks
are the leaves of the next round. At the end a chain of transforms walks from the top of each
struct to its leaves and collects their siblings, and an explode emits one proof per leaf.
Paths from above a block meet the block's struct in a grouped union, not in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import ROW, parallelism
from meterframe.session import materialize

#: Leaves of a block as a power of two. A block's struct is built in memory: about 250 bytes a leaf.
BLOCK_BITS = 8
# One tampered leaf in so many, by the checksum of its id.
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts; a null part is no text."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def encoded(value: Column) -> Column:
    """A value of a leaf: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    return digest(*[encoded(fields[name]) for name in FIELDS])


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds `rank` (from 0) in `order` inside each group, and `n`, the rows of the group.

    Rows are written in ranges of (group, order), so a row's rank is its place in its file
    plus the group's rows in earlier files: no group passes through one task. Rows that are
    equal in all of these are dealt by their number. The counts table has one row per file
    and group in it: at most files + groups rows, as groups follow one another.
    """
    spark = rows.sparkSession
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col(ROW)]
    numbered = rows.withColumn(ROW, F.monotonically_increasing_id())
    parts = max(1, parallelism(spark))
    written = materialize(numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(ROW), name)
    # A file's part number tells its place; row indexes count from 0 in each file.
    placed = written.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    part = F.regexp_extract("__file", r"part-(\d+)", 1).cast("bigint")
    placed = placed.withColumn("__file", part)
    counts = placed.groupBy(group, "__file").agg(F.count(F.lit(1)).alias("rows"), F.min("__at").alias("first"))
    counts = materialize(counts, f"{name}-counts")
    before = Window.partitionBy(group).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    starts = counts.select(
        F.col(group).alias("__group"),
        F.col("__file").alias("__start_file"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("__start"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__file") == F.col("__start_file"))
    return placed.join(starts, same).select(*rows.columns, (F.col("__at") + F.col("__start")).alias("rank"), "n")


def _levels(bits: int) -> list[str]:
    """The digit columns from the last (smallest) to the first."""
    return [f"digit{i}" for i in range(bits)]


def nested(rows: DataFrame, group: str, bits: int) -> DataFrame:
    """One row per block: group, `n`, `block` and `tree`, the struct of the block's tree.

    `rows` have group, rank, n and the struct `leaf` with its `hash`. The nodes of a level are
    hashed as long as the group has several of them; a group's single node moves up unchanged.
    """
    digits = _levels(bits)
    held = rows.select(
        group, "n", F.shiftright("rank", bits).alias("block"),
        *[F.shiftright("rank", i).bitwiseAND(1).cast("int").alias(d) for i, d in enumerate(digits)],
        F.col("leaf").alias("node"),
    )
    # One shuffle and one sort serve all steps: each grouping is a prefix of the order.
    held = held.repartition(group, "block").sortWithinPartitions(group, "n", "block", *reversed(digits))
    for level, digit in enumerate(digits):
        above = digits[level + 1 :]
        pair = held.groupBy(group, "n", "block", *reversed(above)).agg(
            F.first(F.when(F.col(digit) == 0, F.col("node")), ignorenulls=True).alias("left"),
            F.first(F.when(F.col(digit) == 1, F.col("node")), ignorenulls=True).alias("right"),
        )
        # Nodes of the group at this level: ceil(n / 2^level); a single one is the root already.
        several = F.col("n") > (1 << level)
        joined = F.when(several, digest(F.col("left.hash"), F.col("right.hash"))).otherwise(F.col("left.hash"))
        kids = F.when(F.col("right").isNull(), F.array("left")).otherwise(F.array("left", "right"))
        node = F.struct(joined.alias("hash"), kids.alias("kids"))
        held = pair.select(group, "n", "block", *reversed(above), node.alias("node"))
    return held.withColumnRenamed("node", "tree")


SIBLING = "struct<left:string,right:string>"


def unnested(tree: Column, bits: int, above: Column, count: Column) -> Column:
    """All leaves of a block's struct with their siblings from the leaf up, then those of `above`.

    An array of (leaf, path). Each transform goes one level down: it puts a node's sibling in
    front of the path of its children. Levels above a group's single node leave no siblings.
    """
    found = F.array(F.struct(tree.alias("node"), above.alias("path")))

    def step_down(several: Column):
        def children(entry):
            kids = entry["node"]["kids"]

            def child(kid, place):
                left = F.when(place == 1, F.get(kids, F.lit(0))["hash"])
                right = F.when(place == 0, F.get(kids, F.lit(1))["hash"])
                longer = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), entry["path"])
                return F.struct(kid.alias("node"), F.when(several, longer).otherwise(entry["path"]).alias("path"))

            return F.transform(kids, child)

        return children

    for level in reversed(range(bits)):
        found = F.flatten(F.transform(found, step_down(count > (1 << level))))
    return found


def paths(leaves: DataFrame, group: str, bits: int, name: str) -> DataFrame:
    """Per leaf: group, `leaf`, `path` (siblings from the leaf to its group's root) and `root`.

    `leaves` have group, rank, n and `leaf`. Rounds go on until no group has more than one
    block; how many follows from the largest n, the only number that reaches the driver.
    """
    blocks = materialize(nested(leaves, group, bits), name)
    most = blocks.agg(F.max("n")).first()[0] or 0
    single = F.array().cast(f"array<{SIBLING}>")
    if most <= 1 << bits:
        tops = blocks.withColumns({"path": single, "root": F.col("tree.hash")})
    else:
        upper = blocks.select(
            group,
            F.col("block").alias("rank"),
            F.ceil(F.col("n") / (1 << bits)).cast("bigint").alias("n"),
            F.struct(F.col("tree.hash").alias("hash"), F.col("block").alias("block")).alias("leaf"),
        )
        above = paths(upper, group, bits, name).select(
            group, F.col("leaf.block").alias("block"), F.struct("path", "root").alias("above"),
            F.lit(None).cast(blocks.schema["tree"].dataType).alias("tree"), F.lit(None).cast("bigint").alias("n"),
        )
        own = blocks.withColumn("above", F.lit(None).cast(above.schema["above"].dataType))
        both = own.select(group, "block", "above", "tree", "n").union(above.select(group, "block", "above", "tree", "n"))
        met = both.groupBy(group, "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("tree", "above", "n")]
        )
        tops = met.select(group, "n", "block", "tree", "above.path", "above.root")
    leaf = F.explode(unnested(F.col("tree"), bits, F.col("path"), F.col("n"))).alias("entry")
    return tops.select(group, "root", leaf).select(group, "root", F.col("entry.node").alias("leaf"), "entry.path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its siblings give."""
    return F.aggregate(path, start, lambda own, s: digest(s["left"], own, s["right"]))


def siblings(path: Column) -> Column:
    """The digest of a path's siblings, in its order."""
    names = F.transform(path, lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit(""))))
    return F.sha2(F.concat_ws("", names), 256)


def manifest(documents: DataFrame, group: str = "lang", bits: int = BLOCK_BITS) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, its siblings as `path`, and `tampered`.

    A document's leaf is the digest of its fields; `tampered` is that of the document with one
    more in n_chars where the checksum of its id asks for it, else null. Leaves stand in the
    order of doc_id inside their group (null first; rows of one id by their leaf), a run of two
    becomes one node and a single last one is hashed alone; a lone leaf is its group's subroot.
    Groups (null is one of its own) stand in bytewise order under the root. Repeated rows are
    leaves of their own. A null id is never tampered with. No rows give no rows. Columns other
    than the five fields and the group are not read.
    """
    fields = {name: F.col(name) for name in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    other = leaf_hash(fields | {"n_chars": F.col("n_chars") + 1})
    changed = F.when(chosen & F.col("n_chars").isNotNull(), other)
    # The texts are read and hashed once; after this only digests move.
    rows = documents.select(
        F.col(group).alias("group"), "doc_id", leaf_hash(fields).alias("hash"), changed.alias("tampered")
    )
    hashed = materialize(rows, "leaves")
    leaves = ranked(hashed, "group", ["doc_id", "hash"], "ranked-leaves")
    leaf = F.struct("hash", "doc_id", "tampered").alias("leaf")
    below = materialize(paths(leaves.select("group", "rank", "n", leaf), "group", bits, "blocks"), "leaf-paths")
    # The same rollup over the groups' subroots, as leaves of one group.
    tops = below.groupBy("group").agg(F.max("root").alias("hash")).withColumn("all", F.lit(0))
    upper = ranked(tops, "all", ["group"], "ranked-groups").select(
        "all", "rank", "n", F.struct("hash", F.col("group").alias("name")).alias("leaf")
    )
    above = paths(upper, "all", bits, "group-blocks").select(
        F.col("leaf.name").alias("top_group"), F.col("root").alias("top_root"), F.col("path").alias("top_path")
    )
    # One row per group: Spark broadcasts them when they are few.
    met = below.join(above, F.col("group").eqNullSafe(F.col("top_group")))
    return met.select(
        F.col("leaf.doc_id").alias("doc_id"), F.col("leaf.hash").alias("leaf"), F.col("root").alias("subroot"),
        F.col("top_root").alias("root"), F.concat("path", "top_path").alias("path"), F.col("leaf.tampered").alias("tampered"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """Per row of a manifest: the digest of its proof, the root its leaf folds to, and whether it holds."""
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
