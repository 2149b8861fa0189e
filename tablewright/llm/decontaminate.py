"""Benchmark decontamination by winnowing over word k-grams.

The benchmark keeps, of every window of ``window`` words, the least k-gram hash. Any document passage that
equals a benchmark window holds that k-gram, so probing documents with the kept hashes misses nothing. Documents
that hold one are winnowed too: of each of their windows the least hash is taken and joined with the
benchmark's, and a hit is extended to the whole window, whose words are then compared. Windows that overlap
extend a hit to both sides.

Everything is DataFrame functions. Documents are read twice, their words once for all and once more for the
candidates; only candidates' windows and one short row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column, maybe_broadcast, written

#: Words of a k-gram.
K = 4
#: Least number of words that is certain to be found; shorter items count as one window of their own.
WINDOW = 10
#: Rows up to which a counted table is broadcast (hashes, or ids with a hash).
BROADCAST_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words of a text without capital ASCII letters; an empty one may come first and last."""
    return F.split(text, _BETWEEN, -1)


def _fold(text: Column | str) -> Column:
    """Lower case of all letters, whether a whole text or a single word is folded (sigma has two forms)."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _trimmed(parts: str) -> Column:
    size = F.size(parts)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", size - 1).otherwise(size)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _shift(values: Column | str, by: int) -> Column:
    return F.slice(values, by + 1, F.size(values))


def _tokenized(df: DataFrame, keep: list[str], exact: bool) -> DataFrame:
    """Words w of text t. Not exact: all letters are lower-cased, which keeps equal words equal and is faster."""
    lower = F.translate("t", _UPPER, _LOWER) if exact else _fold("t")
    return df.select(*keep, _words(lower).alias("w")).select(*keep, _trimmed("w").alias("w"))


def _grams(df: DataFrame, keep: list[str], k: int = K) -> DataFrame:
    """Adds g: the hashes of all k-grams of words w, k a power of two."""
    df = df.select(*keep, "w", F.col("w").alias("g"))
    step = 1
    while step < k:
        df = df.select(
            *keep, "w", F.zip_with("g", _shift("g", step), lambda a, b: F.xxhash64(a, b)).alias("g")
        )
        step *= 2
    return df.select(*keep, "w", F.slice("g", 1, F.greatest(F.size("w") - (k - 1), F.lit(0))).alias("g"))


def _passage(words: str, at: Column, size) -> Column:
    """The words from ``at`` on (from 0) as one text; words hold no blank."""
    return F.array_join(F.slice(words, at + 1, size), " ")


def _upto(last: Column) -> Column:
    """0, 1, ... last; empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _marks(words: str, size: int) -> Column:
    """Hash of every passage of ``size`` < K words, marked with the size."""
    return F.transform(
        _upto(F.size(words) - size), lambda at: F.xxhash64(F.lit(size), F.slice(words, at + 1, size))
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as text, sorted), contaminated.

    Words are runs of ASCII digits and letters, A-Z lower-cased, and of everything beyond ASCII. A document's
    word is hit if it lies in a passage equal to a window of ``window`` words of an item; an item with fewer
    words, but not none, is one window.

    Null and empty texts have no words, on either side. Rows that repeat both id and text give one row; rows
    that share only the id give one each. A null document id is an id like any other, a null item id is listed
    as an empty text. Empty tables give no rows, or no hits. Other columns are not looked at.
    """
    items = benchmark.select(
        F.coalesce(column(item_id).cast("string"), F.lit("")).alias("item"),
        F.coalesce(column(item_text).cast("string"), F.lit("")).alias("t"),
    ).distinct()
    # Windows of the benchmark, with all items that have them.
    exact = _tokenized(items, ["item"], exact=True).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    passages = exact.select(
        "item",
        length.alias("size"),
        F.explode(
            F.transform(_upto(F.size("w") - length), lambda at: _passage("w", at, length))
        ).alias("passage"),
    )
    passages = written(
        passages.groupBy("size", "passage").agg(F.sort_array(F.collect_set("item")).alias("items")), "leak-passages"
    )
    sizes = sorted(r[0] for r in passages.select("size").distinct().collect())

    # Fingerprints: the least k-gram of every window, or a passage's own hash below K words.
    parts = passages.select("size", F.split(_fold("passage"), " ").alias("w"))
    long = _grams(parts.where(F.col("size") >= K), ["size"]).select(F.array_min("g").alias("g"))
    short = parts.where(F.col("size") < K).select(F.xxhash64("size", "w").alias("g"))
    prints = maybe_broadcast(written(long.union(short).distinct(), "leak-prints"), BROADCAST_ROWS)

    rows = docs.select(
        column(doc_id).alias("d"), F.coalesce(column(text).cast("string"), F.lit("")).alias("t")
    ).withColumn("h", F.xxhash64("t"))
    key = ["d", "h"]
    probes = _grams(_tokenized(rows, key, exact=False), key)
    probes = probes.select(
        *key,
        F.size("w").cast("bigint").alias("n_words"),
        F.explode_outer(F.concat("g", *[_marks("w", s) for s in sizes if s < K])).alias("g"),
    )
    seen = probes.join(prints.withColumn("leak", F.lit(True)), "g", "left").groupBy(*key, "n_words").agg(
        F.coalesce(F.max("leak"), F.lit(False)).alias("maybe")
    )
    seen = written(seen, "leak-documents")
    wanted = maybe_broadcast(written(seen.where("maybe").select(*key), "leak-candidates"), BROADCAST_ROWS)

    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    chosen = rows.alias("a").join(wanted.alias("b"), same, "left_semi")
    full = _tokenized(chosen, key, exact=True)
    found = []
    for size in sizes:
        if size < window:
            at = F.transform(
                _upto(F.size("w") - size), lambda i: F.struct(i.alias("at"), _passage("w", i, size).alias("passage"))
            )
            found.append(full.select(*key, F.lit(size).alias("size"), F.inline(at)))
        else:
            # The least k-gram of each window is its fingerprint; lower-casing as in the benchmark's.
            folded = full.select(*key, "w", F.transform("w", _fold).alias("v"))
            grams = _grams(folded.withColumnRenamed("w", "x").withColumnRenamed("v", "w"), [*key, "x"])
            at = F.transform(
                _upto(F.size("x") - size),
                lambda i: F.struct(
                    i.alias("at"),
                    F.array_min(F.slice("g", i + 1, size - K + 1)).alias("g"),
                    _passage("x", i, size).alias("passage"),
                ),
            )
            winnowed = grams.select(*key, F.lit(size).alias("size"), F.inline(at))
            found.append(winnowed.join(prints, "g", "left_semi").select(*key, "size", "at", "passage"))
    if not found:  # no item has a word
        return seen.select(
            F.col("d").alias("doc_id"),
            "n_words",
            F.lit(0).cast("bigint").alias("n_hit"),
            F.lit(0).cast("bigint").alias("n_items"),
            F.array().cast("array<string>").alias("items"),
            F.lit(False).alias("contaminated"),
        )
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    hits = places.join(maybe_broadcast(passages, BROADCAST_ROWS // 10), ["size", "passage"])
    hits = hits.groupBy(*key).agg(
        F.collect_set(F.struct("at", "size")).alias("places"), F.collect_set("items").alias("items")
    )
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["size"] - 1)))
    hits = hits.select(
        *key,
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    return (
        seen.alias("a")
        .join(hits.alias("b"), same, "left")
        .select(
            F.col("a.d").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            "items",
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
