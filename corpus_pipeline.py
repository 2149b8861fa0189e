"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents (the last one: packed sequences). It works on all
that the stage before kept, and touches only doc_id, text, lang and n_chars; further columns pass through, whatever
they are called. Nulls, empty tables and repeated rows have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import column, maybe_broadcast, written
from tablewright.llm.decontaminate import find_contamination
from tablewright.llm.language import fit_languages, predict_language
from tablewright.llm.lines import drop_repeated_lines
from tablewright.llm.neardup import near_duplicates
from tablewright.llm.packing import pack

#: Ids up to which a counted table of them is broadcast.
BROADCAST_ROWS = 1_000_000
#: A repeat of one or two lines goes from so many words on.
REPEATED_WORDS = 50


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not in column doc_id of ``ids``."""
    gone = maybe_broadcast(written(ids.select(F.col("doc_id").alias("gone")).distinct(), "gone"), BROADCAST_ROWS)
    return docs.join(gone, column("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    The model learns from the documents' own ``lang``. Rejected are texts without letters (null and empty ones
    too) and texts that lie between two languages' codewords.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, lang = f"c{names.index('text')}", f"c{names.index('lang')}"
    found = predict_language(plain, fit_languages(plain, text, lang), text, keep=plain.columns)
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(plain.columns).toDF(*names)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, or long lines, that occur before; those of which nothing is left go.

    ``n_chars`` is brought up to date where lines went.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    found = drop_repeated_lines(plain, doc_id, text, words=REPEATED_WORDS)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        kind = found.schema[size].dataType
        found = found.withColumn(
            size, F.when(F.col("n_removed") > 0, F.length(text).cast(kind)).otherwise(F.col(size))
        )
    return found.select(plain.columns).toDF(*names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates (five words, 0.8)."""
    found = near_duplicates(docs, width=5, percent=80)
    return _without(docs, found.where(~F.col("kept")))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, find_contamination(docs, benchmark).where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' sequences in batches of optimal length buckets."""
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: SQL can state neither the language model nor the boundaries' dynamic programme.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
