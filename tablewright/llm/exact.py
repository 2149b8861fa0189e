"""Exact deduplication by deterministic block naming.

A document without its white space is a row of fixed-size blocks. Distinct blocks, sorted, get integer names;
distinct pairs of adjacent names, sorted, get integer names in turn, until one name is left per document.
Equal texts have equal names and different ones different names: no hash decides.

Naming stops early for a document that its length and outer blocks already tell from all others; the rest
go through the rounds. Names are positions in a range-partitioned sort, so no task sees all names, and a block
that many documents share is one row before it is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column, maybe_broadcast, written

#: Characters of a block.
BLOCK = 2048
#: Characters of the outer blocks that are compared first.
OUTER = 64
#: Rows (of an id with two hashes) up to which the counted candidates are broadcast.
BROADCAST_ROWS = 1_000_000

_SPACE = "\t\n\x0b\x0c\r "


def _named(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Every distinct ``keys`` with an integer name, in sorted order."""
    ordered = values.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The partition's number, then the place inside it: ascends with the sort.
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def find_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if they are identical without the characters U+0009 to U+000D and U+0020. Of equal texts
    the one with the most code points stays, then the one with the smallest id (null is smallest).

    A null text counts as empty. Rows that repeat an id and an equal text share their fate: they count in
    group_size, and all of them are kept if their id is. An empty table gives an empty result. Other columns
    are not looked at.
    """
    plain = F.translate(F.coalesce(column(text).cast("string"), F.lit("")), _SPACE, "")
    rows = df.select(
        column(doc_id).alias("d"),
        F.length(F.coalesce(column(text).cast("string"), F.lit(""))).alias("size"),
        plain.alias("p"),
    )
    length = F.length("p")
    outer = F.xxhash64(F.substring("p", 1, OUTER), F.substring("p", -OUTER, OUTER)).alias("o")
    # The digest is part of a row's key and of the result; it never decides whether texts are equal.
    short = written(rows.select("d", "size", length.alias("n"), outer, F.sha2("p", 256).alias("sha")), "copy-rows")

    alike = short.groupBy("n", "o").count().where("count > 1").select("n", "o")
    alike = maybe_broadcast(written(alike, "copy-candidates"), BROADCAST_ROWS)
    texts = rows.select("d", "p", length.alias("n"), outer).join(alike, ["n", "o"], "left_semi")
    cut = F.regexp_extract_all("p", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(cut)
    blocks = texts.select("d", F.sha2("p", 256).alias("sha"), "n", F.posexplode(cut).alias("i", "b"))
    blocks = written(blocks, "copy-blocks")
    names = _named(blocks, ["b"], "copy-names")
    current = written(blocks.join(names, "b").select("d", "sha", "n", "i", "name").distinct(), "copy-level")
    longest = current.agg(F.max("i")).first()[0] or 0
    while longest > 0:
        left = current.where("i % 2 = 0").select("d", "sha", "n", F.expr("i div 2").alias("i"), F.col("name").alias("x"))
        right = current.where("i % 2 = 1").select(
            F.col("d").alias("e"), F.col("sha").alias("s"), F.expr("i div 2").alias("j"), F.col("name").alias("y")
        )
        same = F.col("d").eqNullSafe(F.col("e")) & (F.col("sha") == F.col("s")) & (F.col("i") == F.col("j"))
        pairs = left.join(right, same, "left").select(
            "d", "sha", "n", "i", "x", F.coalesce("y", F.lit(-1)).alias("y")
        )
        pairs = written(pairs, "copy-pairs")
        names = _named(pairs, ["x", "y"], "copy-names")
        current = written(pairs.join(names, ["x", "y"]).select("d", "sha", "n", "i", "name"), "copy-level")
        longest //= 2

    # The identity is name and length: a shorter document may take fewer real rounds, never another length.
    found = current.select(F.col("d").alias("e"), F.col("sha").alias("s"), F.col("name").alias("own"))
    same = F.col("d").eqNullSafe(F.col("e")) & (F.col("sha") == F.col("s"))
    known = written(short.join(found, same, "left").select("d", "size", "n", "sha", "own"), "copy-known")
    groups = (
        known.where("own IS NOT NULL")
        .groupBy("own", "n")
        .agg(F.min(F.struct((-F.col("size")).alias("size"), "d")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("own", "n", F.col("best.d").alias("best"), "group_size", F.lit(True).alias("grouped"))
    )
    joined = known.join(groups, ["own", "n"], "left")
    keep = F.when(F.col("grouped"), F.col("best")).otherwise(F.col("d"))
    return joined.select(
        F.col("d").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("d").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
