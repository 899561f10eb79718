"""URL filter rules by a sort-merge range join, in DataFrame functions only.

A rule is a host (with all its subdomains) and a path prefix. Its canonical key is the host
with its labels reversed, then the path: the keys below it fill the interval that starts at the
key. A page stands in the sweep once per ancestor of its host, so that a rule on a parent
domain is one interval too. Keys are cut into ranges, a rule is copied to the ranges that its
interval meets, and in each range one sorted sweep keeps the last opened rule of every nesting
depth: the stack of rules that may be active. A page takes the deepest that is still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import ROW, parallelism, range_index, sampled_cuts, with_row

BETWEEN = "\u0000"  # sorts below every character of a host or path
CUT_CHARS = 200


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.contains(url, F.lit("://")), host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    path = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), path), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + F.lit(3), F.length(url))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(BETWEEN), path)


def cuts_inside(key: Column, cuts: list[str]) -> Column:
    """How many cuts lie behind the start of the interval of all keys that begin with `key`."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: F.startswith(c, key) & (c > key)))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict, rank, depth): one row per host and path, with its nesting depth.

    Rules without a host or verdict are left out, a null path is empty. Of several rules for
    one host and path, a blocking one counts. `depth` is the number of rules around it.
    """
    host, path = F.lower("host"), F.coalesce("path", F.lit(""))
    clean = rules.filter((F.col("host") != "") & F.col("verdict").isNotNull())
    clean = clean.select(host.alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")  # block sorts after allow
    )
    keyed = clean.select(
        key_of(reversed_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size")).alias("rank"),
        F.size(F.split("host", "\\.")).alias("labels"),
    )
    shorter = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.substr("key", F.lit(1), n))
    prefixes = keyed.select("key", F.explode(shorter).alias("outer_key"))
    outer = keyed.select(F.col("key").alias("outer_key"))
    depth = prefixes.join(outer, "outer_key").groupBy("key").agg(F.count("*").alias("depth"))
    return keyed.join(depth, "key", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """Per page row: id, host, path, the longest rule that fits (or null) and the verdict.

    `rules` has host, path, verdict. A page whose url is null or has no `://` has an empty host
    and path and fits no rule; pages without a rule get `default`. Null and repeated ids are
    passed on, one result row per page row. Only the id and the url are read. No rules at all,
    or no pages, is fine. Of rules of one length the one with the longer host wins.
    """
    spark = pages.sparkSession
    swept = prepared_rules(rules)
    shape = swept.agg(F.max("depth").alias("depth"), F.max("labels").alias("labels")).first()
    deepest, labels = shape["depth"] or 0, shape["labels"] or 1

    rows = with_row(pages.select(F.col(id_column).alias("page_id"), F.col("url").alias("__url")))
    rows = rows.select(ROW, "page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    upward = F.sequence(F.lit(1), F.least(F.size(reversed_labels(F.col("host"))), F.lit(labels)))
    keys = rows.withColumn("__level", F.explode(upward)).withColumn(
        "key", key_of(F.slice(reversed_labels(F.col("host")), F.lit(1), F.col("__level")), F.col("path"))
    )

    cuts, salts = sampled_cuts(keys.select(F.substring("key", 1, CUT_CHARS)), parallelism(spark))
    salt_count = F.element_at(F.lit(salts), F.col("cell") + 1)
    placed_pages = keys.withColumn("cell", range_index(F.col("key"), cuts)).select(
        "key",
        F.lit(1).alias("kind"),
        "cell",
        F.pmod(F.xxhash64(ROW, "key"), salt_count).cast("int").alias("salt"),
        F.struct(ROW, "page_id", "host", "path").alias("page"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("struct<size: int, host_size: int>").alias("rank"),
        F.lit(None).cast("int").alias("depth"),
    )
    first = range_index(F.col("key"), cuts)
    last = first + cuts_inside(F.col("key"), cuts)
    placed_rules = (
        swept.withColumn("cell", F.explode(F.sequence(first, last)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salt_count - 1)))
        .select(
            "key",
            F.lit(0).alias("kind"),
            "cell",
            "salt",
            F.lit(None).cast(placed_pages.schema["page"].dataType).alias("page"),
            "rule",
            "verdict",
            "rank",
            "depth",
        )
    )
    sweep = Window.partitionBy("cell", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind") == 0, F.struct("key", "rank", "rule", "verdict"))
    stack = [
        F.last(F.when(F.col("depth") == d, opened), ignorenulls=True).over(sweep).alias(f"open_{d}")
        for d in range(deepest + 1)
    ]
    active = [
        F.when(F.startswith(F.col("key"), F.col(f"open_{d}.key")), F.col(f"open_{d}"))
        for d in range(deepest, -1, -1)
    ]
    hits = (
        placed_pages.unionByName(placed_rules)
        .select("key", "kind", "page", *stack)
        .filter(F.col("kind") == 1)
        .select("page", F.coalesce(*active).alias("hit"))
    )
    best = F.max(F.struct(F.col("hit.rank"), F.col("hit.rule"), F.col("hit.verdict"))).alias("best")
    judged = hits.groupBy(F.col(f"page.{ROW}")).agg(F.first("page").alias("page"), best)
    return judged.select(
        "page.page_id",
        "page.host",
        "page.path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
