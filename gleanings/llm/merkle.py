"""Merkle manifest of a dataset: a digest of every row, a tree over each group, a tree over the groups, and proofs of single rows.

A row's leaf is the SHA-256 of its fields, each with its length in front. The leaves of a group stand in the order of a column; every
``fanout`` consecutive nodes get one parent, until one node is left (the group's subroot); the subroots, in the order of the groups,
get parents likewise, up to the root. One level is one aggregation: conditional aggregates spread the children of a parent into
``fanout`` slot columns; all of them concatenated are what the parent hashes, and without a child's own slot they are its siblings.

Leaves are hashed once, where the rows are read; texts are never shuffled. A leaf's place is found without gathering a group: Spark
cuts the order of (group, order, leaf) into ranges and sorts each, the ranges are written out with running numbers, and only their counts
are summed. Parents are grouped by (group, place), so a group that holds a third of all rows is dealt out evenly. Every level is a
table in the shared folder, a sixteenth of the one below, so a lost executor repeats one level at most.

Defined results: a null field counts as ``-``; null and empty texts differ; a null group is a group of its own, before all others; null
orders come first; rows with the same order stand by their leaf, so equal rows are equal neighbours and proofs of repeated rows are
those of their own places; a group of one row has its leaf as subroot, and one group's subroot is the root; without siblings the proof
is the digest of nothing; no rows have no root and no proofs. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.llm.common import staged

#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Columns that name a group: whether it is null, and its text.
GROUP = ["g_some", "g"]
_IN_RANGE = (1 << 33) - 1  # monotonically_increasing_id() has the partition above 33 bits of row number


def digest(*parts: Column | str) -> Column:
    """SHA-256 in lowercase hex of all parts one after another; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its number of UTF-8 bytes, a colon and its text, or "-" where it is null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with place (from 0, in the order of ``order``, nulls first) in their group, and n, the group's number of rows.

    No group is gathered: ranges of the order are sorted and written out with running numbers; what is summed has one row for each
    range and group.
    """
    ranged = staged(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit(_IN_RANGE)))
    parts = ranged.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_range", "_first", before.alias("_before"), F.sum("_n").over(own).alias("n"))
    return ranged.join(parts, [*group, "_range"]).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_row", "_first", "_before")


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def spread(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of nodes (group, place, n, node) of groups with several: group, place, n, the slot columns c0, c1, ... and node, their digest."""
    slot = F.col("place") % fanout
    columns = [F.max(F.when(slot == k, F.col("node"))).alias(name) for k, name in enumerate(_slots(fanout))]
    up = nodes.filter("n > 1").groupBy(*GROUP, F.expr(f"place div {fanout}").alias("place")).agg(*columns, F.max(F.expr(f"(n + {fanout - 1}) div {fanout}")).alias("n"))
    return up.withColumn("node", digest(*_slots(fanout)))


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables of parents, level by level, until no group has two nodes."""
    out: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number: the size of the largest group
    while most > 1:
        nodes = staged(spread(nodes, fanout))
        out.append(nodes)
        most = -(-most // fanout)
    return out


@dataclass
class Manifest:
    """Tables of a tree. leaves: group, place, n, node and the columns kept with them; levels: parents within groups; tops: those above subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    fanout: int

    @property
    def root(self) -> DataFrame:
        """One row with the root; none if there are no rows."""
        return (self.tops[-1] if self.tops else self.subroots).select(F.col("node").alias("root"))


def build(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", fanout: int = 16, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of rows. keep: further columns that stay with the leaves."""
    name = F.col(group).cast("string")
    hashed = rows.select(name.isNotNull().alias(GROUP[0]), F.coalesce(name, F.lit("")).alias(GROUP[1]), F.col(order).alias("order"), leaf([F.col(f) for f in fields]).alias("node"), *[c.alias(k) for k, c in (keep or {}).items()])
    # the range partitioning reads its input twice, so digests are made and written before it
    leaves = staged(numbered(staged(hashed), GROUP, ["order", "node"]))
    levels = _levels(leaves, fanout)
    single = [t.filter("n = 1").select(*GROUP, "node") for t in (leaves, *levels)]
    subroots = single[0]
    for t in single[1:]:
        subroots = subroots.unionByName(t)
    one = subroots.withColumnsRenamed({GROUP[0]: "s_some", GROUP[1]: "s"}).withColumns({GROUP[0]: F.lit(True), GROUP[1]: F.lit("")})
    subroots = staged(numbered(one, GROUP, ["s_some", "s"]))
    return Manifest(leaves, levels, subroots, _levels(subroots, fanout), fanout)


_PATH = "array<struct<l:string,r:string>>"


def _under(children: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """children (group, place, ...) with the path of their parent (slot columns, path), and their own siblings in front of it."""
    slot = F.col("place") % fanout
    left = F.concat_ws("", *[F.when(slot > k, F.col(f"_{c}")) for k, c in enumerate(_slots(fanout))])
    right = F.concat_ws("", *[F.when(slot < k, F.col(f"_{c}")) for k, c in enumerate(_slots(fanout))])
    own = [F.col(c).alias(f"_{c}") for c in _slots(fanout)]
    up = parents.select(*GROUP, F.col("place").alias("_up"), *own, "path", *[c for c in ("subroot", "root") if c in parents.columns])
    joined = children.withColumn("_up", F.expr(f"place div {fanout}")).join(up, [*GROUP, "_up"])
    return joined.withColumn("path", F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), "path")).drop("_up", *[f"_{c}" for c in _slots(fanout)])


def _paths(base: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Rows of base (level 0 of groups) with the path to the root. tops: group, path and what is known of a group's last node."""
    known = [c for c in tops.columns if c not in GROUP]
    above = None  # nodes of the level above that have a path
    for level in (*reversed(levels), base):
        last = level.filter("n = 1").join(tops, GROUP)
        above = last if above is None else last.unionByName(_under(level.filter("n > 1"), above, fanout).select(*last.columns))
    return above.select(*base.columns, *known)


def proofs(manifest: Manifest) -> DataFrame:
    """All leaves with subroot, root and path: for each level from the leaf to the root the digests to the left and to the right of the node.

    A parent's path is joined to its children, whose own follow from it within the task: what is shuffled is one path for each ``fanout`` rows.
    """
    end = manifest.root.select(F.lit(True).alias(GROUP[0]), F.lit("").alias(GROUP[1]), F.expr(f"cast(array() as {_PATH})").alias("path"), "root")
    over = _paths(manifest.subroots, manifest.tops, end, manifest.fanout)
    groups = staged(over.select(F.col("s_some").alias(GROUP[0]), F.col("s").alias(GROUP[1]), F.col("node").alias("subroot"), "root", "path"))
    return _paths(manifest.leaves, manifest.levels, groups, manifest.fanout)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to; a level without siblings hashes the node alone, as the tree does."""
    return F.aggregate(path, node, lambda x, step: F.sha2(F.concat(step["l"], x, step["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), ""), 256)


def changed(before: Manifest, after: Manifest) -> DataFrame:
    """group (null where it is) of every group whose subroot differs or that only one manifest has: where two versions of a dataset differ."""
    a = before.subroots.select("s_some", "s", F.col("node").alias("a"))
    b = after.subroots.select("s_some", "s", F.col("node").alias("b"))
    return a.join(b, ["s_some", "s"], "full").filter("not (a <=> b)").select(F.when(F.col("s_some"), F.col("s")).alias("group"))


def save(manifest: Manifest, path: str) -> None:
    """The manifest's tables as Parquet in a folder."""
    manifest.leaves.write.parquet(f"{path}/leaves")
    manifest.subroots.write.parquet(f"{path}/subroots")
    for kind, levels in (("levels", manifest.levels), ("tops", manifest.tops)):
        for i, t in enumerate(levels):
            t.write.parquet(f"{path}/{kind}-{i}")
    sizes = [(len(manifest.levels), len(manifest.tops), manifest.fanout)]
    manifest.leaves.sparkSession.createDataFrame(sizes, "levels int, tops int, fanout int").coalesce(1).write.parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Manifest:
    """A manifest that save() wrote."""
    shape = spark.read.parquet(f"{path}/shape").first()
    read = lambda kind, n: [spark.read.parquet(f"{path}/{kind}-{i}") for i in range(n)]
    return Manifest(spark.read.parquet(f"{path}/leaves"), read("levels", shape.levels), spark.read.parquet(f"{path}/subroots"), read("tops", shape.tops), shape.fanout)
