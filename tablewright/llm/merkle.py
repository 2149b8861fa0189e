"""Merkle manifest of a dataset, kept in checkpoints and recomputed in between.

Every row is a leaf; the leaves of a language, in order of id, form a tree of runs of eight, and the languages' roots
form one more. Only every third level of a tree is stored, as rows of up to 512 nodes that lie side by side: all that
one node three levels up depends on. To extract proofs, each such row regenerates the two levels that are not stored,
emits the siblings of its own nodes on all three, and forgets the levels again; the siblings further up are
the same for all of its nodes and come down from the stored level above. So no task ever holds more of a tree than
one of these rows, whatever the number of leaves, and the table of proofs needs no pass over the levels for each leaf.

All of it is DataFrame functions: the texts are read once, for the leaves, and only digests are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import column, written

#: Nodes that become one, and levels from one stored level to the next.
RUN, KEPT = 8, 3
#: Nodes of a stored level that lie in one row.
SPAN = RUN**KEPT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lowered(text: Column) -> Column:
    """The text with a-z for A-Z and nothing else changed."""
    return F.translate(text.cast("string"), UPPER, LOWER)


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def _raised(hashes: Column) -> Column:
    """The next level: one digest per run of eight."""
    runs = F.sequence(F.lit(0), ((F.size(hashes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(hashes, r * RUN + 1, RUN), "")))


def _with_levels(rows: DataFrame) -> DataFrame:
    """Columns l0 to l3 beside ``nodes``: the stored level and the three above it.

    A level with one node in the whole tree, whose stored level has ``m``, is the last one: from there on the same
    node is repeated.
    """
    rows = rows.withColumn("l0", F.transform("nodes", lambda x: x["h"]))
    for k in range(KEPT):
        below = F.col(f"l{k}")
        rows = rows.withColumn(f"l{k + 1}", F.when(F.col("m") > RUN**k, _raised(below)).otherwise(below))
    return rows


def _step(hashes: Column, place: Column) -> Column:
    """The siblings before and after a place in its run of eight, digests behind each other."""
    first = place - place % RUN
    return F.struct(
        F.array_join(F.slice(hashes, first + 1, place % RUN), "").alias("before"),
        F.array_join(F.slice(hashes, place + 2, F.lit(RUN - 1) - place % RUN), "").alias("after"),
    )


_PROOF = "array<struct<before: string, after: string>>"


def _placed(nodes: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``i``, the place in the node's tree by ``order`` (from 0), and ``m``, the tree's number of nodes.

    Ranges of the whole table are sorted and counted; a place is the count of all earlier ranges of the tree plus
    the place in the own one. So a tree that holds most rows is spread over many tasks.
    """
    spread = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    # The partition's number stands in the upper bits, the row's number in the lower ones.
    spread = written(spread.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    spread = spread.withColumn("part", F.shiftright("at", 33))
    counted = spread.groupBy(tree, "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    # One row per tree and range.
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        F.col(tree).alias("of"),
        F.col("part").alias("in"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("n").over(whole).alias("m"),
    )
    offsets = written(offsets, "merkle-ranges")
    joined = spread.join(offsets, (F.col(tree) == F.col("of")) & (F.col("part") == F.col("in")))
    return joined.withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "of", "in", "shift", "start")


def _stored(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(tree, s, m, nodes): 512 neighbours a row, each a struct of place, digest and ``extra``."""
    node = F.struct("i", "h", *extra)
    rows = nodes.groupBy("tree", F.expr(f"i div {SPAN}").alias("s")).agg(
        F.max("m").alias("m"), F.sort_array(F.collect_list(node)).alias("nodes")
    )
    return written(rows, "merkle-level")


@dataclass(frozen=True)
class Forest:
    """Trees in checkpoints: ``stored[j]`` is level 3j of every tree, ``tops`` one row (tree, h) per tree."""

    stored: list[DataFrame]
    tops: DataFrame


def plant(leaves: DataFrame, extra: Sequence[str] = ()) -> Forest:
    """The trees over ``leaves``, rows of (tree, i, m, h) and the columns ``extra``; trees have up to m leaves."""
    stored = [_stored(leaves, extra)]
    while True:
        level = stored[-1]
        higher = F.ceil(F.col("m") / SPAN).cast("bigint")
        top = F.col(f"l{KEPT}")[0]
        nodes = _with_levels(level).select("tree", F.col("s").alias("i"), higher.alias("m"), top.alias("h"))
        if not level.where(F.col("m") > SPAN).limit(1).count():
            return Forest(stored, written(nodes.select("tree", "h"), "merkle-tops"))
        stored.append(_stored(nodes))


def proofs(forest: Forest, above: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every leaf's (tree, i, h, ``extra``) with its proof: per level, the siblings before and after it.

    ``above`` has one row per tree: tree, proof (what follows above its top) and columns that all its leaves get.
    """
    carried = [c for c in above.columns if c not in ("tree", "proof")]
    upper = above.select("tree", F.lit(0).cast("bigint").alias("i"), "proof", *carried)
    for j, level in reversed(list(enumerate(forest.stored))):
        upper = written(upper, "merkle-proofs").toDF("of", "at", "rest", *carried)
        rows = level.join(upper, (F.col("tree") == F.col("of")) & (F.col("s") == F.col("at")))
        rows = _with_levels(rows).drop(f"l{KEPT}", "of", "at", "s")

        def own(place: Column) -> Column:
            """The steps of a stored node inside its row; levels that the tree does not have add none."""
            steps = [
                F.when(F.col("m") > RUN**k, F.array(_step(F.col(f"l{k}"), F.floor(place / RUN**k).cast("int"))))
                .otherwise(F.array().cast(_PROOF))
                for k in range(KEPT)
            ]
            return F.concat(*steps)

        each = F.transform("nodes", lambda x, k: F.struct(x.alias("node"), own(k).alias("own")))
        rows = rows.select("tree", "rest", *carried, F.inline(each))
        keep = ["node.i"] if j else ["node.i", "node.h", *[f"node.{e}" for e in extra]]
        upper = rows.select("tree", *keep, F.concat("own", "rest").alias("proof"), *carried)
    return upper


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass(frozen=True)
class Manifest:
    """The stored levels of the trees of all languages and of the tree above them."""

    documents: Forest
    languages: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """doc_id, leaf, the further leaf columns, subroot, root and proof of every document."""
        none = F.array().cast(_PROOF).alias("proof")
        above = proofs(self.languages, self.languages.tops.select("tree", none), ["lang"])
        above = above.select(F.col("lang").alias("tree"), "proof", F.col("h").alias("subroot"))
        node = self.documents.stored[0].schema["nodes"].dataType.elementType
        extra = [f.name for f in node.fields[2:]]
        found = proofs(self.documents, above, extra)
        return found.select(*extra, F.col("h").alias("leaf"), "subroot", F.lit(self.root).alias("root"), "proof")


def build_manifest(
    df: DataFrame,
    key: str = "doc_id",
    tree: str = "lang",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    **others: Column,
) -> Manifest:
    """The manifest of all rows: a leaf is the digest of ``fields``, a tree holds the rows with one value of ``tree``.

    ``others`` are further columns that are carried along with the leaves, computed from the row while its text is
    read. Rows of a tree are in order of ``key``, null first, then of their digests; null is a tree of its own, before
    all others, which are in order of their UTF-8 bytes. Repeated rows are leaves each. An empty table has no root.
    Columns beyond ``key``, ``tree`` and ``fields`` are not looked at.
    """
    extra = ["doc_id", *others]
    # '-' sorts before '=', so null comes first.
    name = F.when(column(tree).isNull(), "-").otherwise(F.concat(F.lit("="), column(tree).cast("string")))
    leaves = df.select(
        name.alias("tree"),
        column(key).alias("doc_id"),
        leaf_hash([column(f) for f in fields]).alias("h"),
        *[c.alias(n) for n, c in others.items()],
    )
    documents = plant(_placed(leaves, "tree", ["doc_id", "h"]), extra)
    roots = documents.tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "h")
    languages = plant(_placed(roots, "tree", ["lang"]), ["lang"])
    top = languages.tops.first()
    return Manifest(documents, languages, top["h"] if top else None)
