"""A Merkle manifest of a table: one root for each group of rows, one over all.

Every row is a leaf, the SHA-256 of its fields, each written as ``-`` (null) or
as its number of UTF-8 bytes, ``:`` and its value. The leaves of a group stand
in the order of their keys; while a level has several nodes, every ``RUN``
neighbours (fewer at the end) become the hash of their concatenated hex digests.

1. Leaves are hashed where the rows lie; from then on only digests move.
2. A range shuffle by (group, key) and the counts of its partitions give each
   leaf its place in the group, so that a group of any size is spread over all
   tasks.
3. Each aligned block of ``RUN ** LEVELS`` nodes keeps a level as one string of
   hex digests. Substrings of ``RUN`` digests hash to the next level's string;
   what is left after ``LEVELS`` levels is one node, a row of the next round.
   The number of rounds is the logarithm of the largest group's size.
4. The groups' roots, in the order of the groups, pass the same rounds.
5. A leaf's proof is read from the strings of its own block and of the blocks
   above: at each level the substrings left and right of its node within the run.

Cases: null groups are a group of their own, which comes first; null keys come
first; rows that repeat a key are ordered by their leaves, and equal rows are
leaves of their own, in any order; a null text and an empty one have different
leaves; a group of one row has that leaf for its root; an empty table has no
root and an empty result; extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

RUN = 8
LEVELS = 3
BLOCK = RUN**LEVELS
DIGEST = 64  # hex digits


def field(value: Column) -> Column:
    """One field as a leaf has it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def ranked(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``idx``, a row's place in its group by ``order`` from 0 on,
    and ``total``, the rows of the group."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("at", 33)
    parts = placed.groupBy(part.alias("part"), F.col(group).alias("of")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "of", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("total"))
    both = placed.join(parts, (part == parts["part"]) & placed[group].eqNullSafe(parts["of"]))
    return both.select(*df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "total")


def _cut(level: Column, first: Column, count: Column) -> Column:
    """``count`` digests of a level's string, from number ``first`` on."""
    return F.substr(level, (first * DIGEST + 1).cast("int"), (F.greatest(count, F.lit(0)) * DIGEST).cast("int"))


def _parents(level: Column) -> Column:
    """The next level's string."""
    run = RUN * DIGEST
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run).cast("int"))
    hashed = F.transform(starts, lambda i: F.sha2(F.substr(level, i * run + 1, F.lit(run)), 256))
    return F.array_join(hashed, "").cast("binary")


def _height(total: Column) -> Column:
    """Levels from that many leaves to one node: the octal digits of total - 1."""
    return F.when(total > 1, F.length(F.conv((total - 1).cast("string"), 10, RUN))).otherwise(0)


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row a block: its members' ``carry`` columns, the strings of its levels
    (null above its top), ``steps``, the levels it rises, and its ``top``."""
    members = F.sort_array(F.collect_list(F.struct("idx", "node", *carry)))
    blocks = nodes.groupBy("group", F.expr(f"idx div {BLOCK}").alias("block")).agg(members.alias("m"), F.first("total").alias("total"), F.first("rise").alias("rise"))
    level = [F.array_join(F.col("m.node"), "").cast("binary")]
    blocks = blocks.withColumns({"l0": level[0], "steps": F.least(F.lit(LEVELS), F.col("rise"))})
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"l{k}", F.when(F.col("steps") >= k, _parents(F.col(f"l{k - 1}"))))
    top = F.coalesce(*(F.col(f"l{k}") for k in range(LEVELS, -1, -1))).cast("string")
    kept = F.transform("m", lambda x: F.struct(x["idx"].alias("idx"), *(x[c].alias(c) for c in carry)))
    return blocks.withColumns({"top": top, "m": kept}).drop(f"l{LEVELS}")


def _path(place: Column) -> Column:
    """Left and right siblings of the node above ``place`` at each level of its block."""
    steps = []
    for k in range(LEVELS):
        node = F.floor(place / RUN**k).cast("long")
        run = node - node % RUN
        level = F.col(f"l{k}")
        pair = F.struct(_cut(level, run, node - run).alias("left"), _cut(level, node + 1, run + RUN - 1 - node).alias("right"))
        steps.append(F.when(F.col("steps") > k, pair))
    return F.array_compact(F.array(*steps))


class Tree:
    """Rounds of blocks from the nodes of each group to the group's root.
    ``nodes``: group, idx, total, node and the ``carry`` columns."""

    def __init__(self, nodes: DataFrame, carry: Sequence[str] = ()) -> None:
        self.carry = list(carry)
        nodes = nodes.withColumn("rise", _height(F.col("total")))
        self.rounds = [stored(_blocks(nodes, self.carry), "blocks")]
        while (self.rounds[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
            below = self.rounds[-1]
            nodes = below.select("group", F.col("block").alias("idx"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"), F.greatest(F.col("rise") - LEVELS, F.lit(0)).alias("rise"))
            self.rounds.append(stored(_blocks(nodes, ()), "blocks"))

    def roots(self) -> DataFrame:
        """group, node: one row a group."""
        return self.rounds[-1].select("group", F.col("top").alias("node"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """One row a node: group, idx, the carried columns, ``node``, its ``path``
        to the last root, and what ``above`` (group, path, ...) says of its group."""
        said = [c for c in above.columns if c not in ("group", "path")]
        paths = above.withColumn("block", F.lit(0).cast("long"))
        for k, blocks in reversed(list(enumerate(self.rounds))):
            paths = paths.withColumnsRenamed({"group": "g", "block": "b"})
            rows = blocks.join(paths, blocks["group"].eqNullSafe(paths["g"]) & (blocks["block"] == paths["b"]))
            rows = rows.withColumn("x", F.explode("m"))
            place = F.col("x.idx") - F.col("block") * BLOCK
            out = [F.col("group"), F.concat(_path(place), F.col("path")).alias("path"), *said]
            if k:
                paths = rows.select(*out, F.col("x.idx").alias("block"))
            else:
                return rows.select(*out, F.col("x.idx").alias("idx"), _cut(F.col("l0"), place, F.lit(1)).cast("string").alias("node"), *(F.col(f"x.{c}").alias(c) for c in self.carry))
        raise AssertionError


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["left"], acc.cast("binary"), x["right"]), 256))


def digest_of(path: Column) -> Column:
    """The hash of all siblings on a path, from its beginning, left to right."""
    return F.sha2(F.aggregate(path, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["left"], x["right"])), 256)


class Manifest:
    """The Merkle tree over the rows of ``docs``. ``fields`` make a leaf,
    ``group`` and ``order`` place it; ``carry`` names columns, by expressions
    over ``docs``, that stay beside a leaf for whoever reads its proof."""

    def __init__(self, docs: DataFrame, fields: Sequence[str], group: str, order: str, carry: dict[str, Column] | None = None) -> None:
        carry = carry or {}
        self.spark: SparkSession = docs.sparkSession
        kept = [F.col(order).alias("key"), leaf_of(*(F.col(f) for f in fields)).alias("node"), *(c.alias(f"c_{n}") for n, c in carry.items())]
        # stored, since a range shuffle first looks at a sample of what it deals out
        leaves = stored(docs.select(F.col(group).cast("string").alias("group"), *kept).withColumn("row", F.monotonically_increasing_id()), "leaves")
        self.carry = list(carry)
        self.leaves = Tree(ranked(leaves, "group", ["key", "node", "row"]), ["key", *(f"c_{n}" for n in carry)])
        subroots = self.leaves.roots().select(F.lit(0).alias("group"), F.col("group").alias("name"), "node")
        self.groups = Tree(ranked(subroots, "group", ["name"]), ["name"])

    def root(self) -> DataFrame:
        """One row, the root; none for an empty table."""
        return self.groups.roots().select(F.col("node").alias("root"))

    def subroots(self) -> DataFrame:
        """group, subroot, path (to the root), root."""
        above = self.groups.roots().select("group", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.col("node").alias("root"))
        return self.groups.proofs(above).select(F.col("name").alias("group"), F.col("node").alias("subroot"), "path", "root")

    def proofs(self) -> DataFrame:
        """One row a leaf: group, key, leaf, subroot, root, path and the carried columns."""
        rows = self.leaves.proofs(stored(self.subroots(), "subroots"))
        return rows.select("group", "key", F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(f"c_{n}").alias(n) for n in self.carry))
