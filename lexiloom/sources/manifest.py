"""Manifests: digests of named things folded into a tree, so that what differs is found without comparing all.

A thing's name is hashed, and the hash's hexadecimal digits are its way down the tree; a node's digest is that
of its children's names and digests in order.  Two manifests are compared from the root down:
only children of nodes that differ are looked at, so a damaged file among millions costs a few rows a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Things below a lowest node, about; the depth follows from it.
LEAF_THINGS = 64


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest, bytes) of the files of a folder and those below it, named by their path within it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.col("path"), full, -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def row_digests(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(name, digest) of a table's rows by their values in some columns; nulls differ from empty texts."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return rows.select(F.col(name).cast("string").alias("name"), F.sha2(F.concat_ws("\x00", *values), 256).alias("digest"))


def depth_for(n: int) -> int:
    """Digits of the lowest nodes, so that they have about ``LEAF_THINGS`` things."""
    depth = 1
    while 16**depth * LEAF_THINGS < n:
        depth += 1
    return depth


def _folded(rows: DataFrame, key: Column) -> DataFrame:
    """Nodes (prefix, digest, things) over (name, digest, things)."""
    children = F.array_sort(F.collect_list(F.struct("name", "digest")))
    joined = F.array_join(F.transform(children, lambda c: F.concat(c["name"], F.lit(" "), c["digest"])), "\n")
    return rows.groupBy(key.alias("prefix")).agg(F.sha2(joined, 256).alias("digest"), F.sum("things").alias("things"))


def build(things: DataFrame, depth: int | None = None) -> DataFrame:
    """The tree's nodes (level, prefix, digest, things), the root being level 0 with an empty prefix; no things give no nodes.

    ``things`` are (name, digest); rows without a name are left out.
    """
    rows = things.where(F.col("name").isNotNull()).select("name", "digest", F.lit(1).cast("long").alias("things"))
    depth = depth_for(rows.count()) if depth is None else depth
    level = _folded(rows, F.substring(F.sha2("name", 256), 1, depth))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = _folded(level.withColumnRenamed("prefix", "name"), F.substring("name", 1, d))
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "prefix", "digest", "things")


def differing_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lowest nodes (prefix) in which two trees of one depth differ, found from the root down; both should be stored."""
    depth = a.agg(F.max("level")).first()[0]
    other = b.agg(F.max("level")).first()[0]
    if depth is None or other is None or depth != other:
        raise ValueError("trees of two depths, or without nodes")
    suspects = a.sparkSession.createDataFrame([("",)], "prefix string")
    for d in range(depth + 1):
        def children(t: DataFrame, d=d, suspects=suspects) -> DataFrame:
            own = t.where(F.col("level") == d)
            return own.join(suspects.withColumnRenamed("prefix", "parent"), F.substring("prefix", 1, max(0, d - 1)) == F.col("parent"), "left_semi").select("prefix", "digest")

        x, y = children(a), children(b).withColumnRenamed("digest", "other")
        suspects = x.join(y, "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix")
    return suspects


def differences(a: DataFrame, b: DataFrame, tree_a: DataFrame, tree_b: DataFrame) -> DataFrame:
    """(name, change): what ``b`` has lost, gained or changed against ``a``; only things below differing nodes are compared."""
    depth = tree_a.agg(F.max("level")).first()[0]
    suspects = differing_nodes(tree_a, tree_b)

    def below(things: DataFrame) -> DataFrame:
        named = things.where(F.col("name").isNotNull()).withColumn("prefix", F.substring(F.sha2("name", 256), 1, depth))
        return named.join(suspects, "prefix", "left_semi").select("name", "digest")

    both = below(a).join(below(b).withColumnRenamed("digest", "other"), "name", "full_outer")
    change = F.when(F.col("other").isNull(), "lost").when(F.col("digest").isNull(), "gained").when(F.col("digest") != F.col("other"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")
