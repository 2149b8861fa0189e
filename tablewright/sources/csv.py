"""CSV files as typed tables: header and row checks, missing markers, type inference."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import col
from tablewright.types import IngestError, kind

# Texts that mean "missing", as pandas reads them by default.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Spellings of the two truth values, and the number formats.
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
REAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"

# Spellings of one header (blanks around names) that are told apart before files count as different.
_SPELLINGS = 100

# Follows every line as one more field, to see how many fields came before it.
_END = "\u0001end"


def header_fields(line: str | None) -> list[str]:
    """Column names of a header line, stripped. All faults of a header are reported together."""
    names = [n.strip() for n in next(csv.reader([(line or "").removeprefix("\ufeff")]), [])]
    tally = Counter(filter(None, names))
    twice = sorted(n for n in tally if tally[n] > 1)
    blank = not any(names) and len(names) <= 1
    faults = {
        "The file is empty.": line is None,
        "The file has no header row.": line is not None and blank,
        "The header has an empty column name.": not blank and "" in names,
        f"The header repeats column names: {', '.join(twice)}.": bool(twice),
    }
    if any(faults.values()):
        raise IngestError(" ".join(message for message, holds in faults.items() if holds))
    return names


@dataclass(frozen=True)
class _Look:
    """What one pass over the lines of all files tells."""

    names: list[str]
    spanning: bool  # quotes that are closed on a later line


def _look(text: DataFrame) -> _Look:
    """Checks encoding and headers: every file must have the same columns in the same order."""
    start = F.col("_metadata.file_block_start") == 0
    lines = text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        # Inside a file's first block, numbers grow with the lines.
        F.when(start, F.monotonically_increasing_id()).alias("at"),
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )
    files = lines.groupBy("file").agg(
        F.min_by("value", "at").alias("head"),
        F.count_if(~F.is_valid_utf8("value")).alias("invalid"),
        F.count_if(F.col("quotes") % 2 == 1).alias("odd"),
        (F.sum("quotes") % 2 == 1).alias("unclosed"),
    )
    heads = files.groupBy("head").agg(
        F.sum("invalid").alias("invalid"), F.sum("odd").alias("odd"), F.max("unclosed").alias("unclosed")
    )
    found = heads.orderBy("head").limit(_SPELLINGS + 1).collect()
    if sum(r["invalid"] for r in found):
        raise IngestError("The file is not valid UTF-8.")
    spelled = [header_fields(r["head"]) for r in found] or [header_fields(None)]
    if len(found) > _SPELLINGS or any(names != spelled[0] for names in spelled):
        raise IngestError("The files' headers differ.")
    return _Look(spelled[0], any(r["odd"] for r in found) and not any(r["unclosed"] for r in found))


def audit_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """Parse raw lines (column ``value``) into one struct and say how each one fits.

    Adds ``state``: ok, short (missing fields count as missing values), overlong, or broken
    (quotes that do not close, bytes that are not UTF-8); ``fields`` holds the texts.
    """
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names) + 1)])
    ended = F.concat(F.col("value"), F.lit("," + _END))
    parsed = F.from_csv(ended, schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
    rows = lines.where(F.trim("value") != "").withColumn("fields", parsed)
    fields = [F.col(f"fields.f{i}") for i in range(len(names))]
    short = reduce(lambda a, b: a | b, [F.coalesce(f == _END, F.lit(False)) for f in fields])
    fits = F.coalesce(F.col(f"fields.f{len(names)}") == _END, F.lit(False))
    swallowed = reduce(
        lambda a, b: a | b,
        [F.coalesce(f.endswith("," + _END), F.lit(False)) for f in [*fields, F.col(f"fields.f{len(names)}")]],
    )
    state = (
        F.when(~F.is_valid_utf8("value") | swallowed | F.col("value").contains(_END), "broken")
        .when(fits, "ok")
        .when(short, "short")
        .otherwise("overlong")
    )
    return rows.withColumn("state", state)


def text_columns(audited: DataFrame, names: list[str]) -> DataFrame:
    """String columns of audited lines; missing markers and absent fields become NULL."""

    def value(i: int) -> Column:
        field = F.col(f"fields.f{i}")
        return F.when(~field.isin([*MISSING, _END]), field)

    return audited.select(*[value(i).alias(name) for i, name in enumerate(names)])


def infer_schema(texts: DataFrame) -> DataFrame:
    """(ordinal, column, inferred_type, kind) of string columns, from one aggregate pass.

    The narrowest type every present value fits: bigint, double, boolean, else string. A column
    without values is double.
    """
    aggs, cells = [], []
    for i, name in enumerate(texts.columns):
        v = col(name)
        whole = v.rlike(INTEGER) & F.expr(f"try_cast(`{name.replace('`', '``')}` as bigint)").isNotNull()
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNotNull() & ~whole).alias(f"i{i}"),
            F.count_if(~(v.rlike(REAL) | v.rlike(INFINITE))).alias(f"r{i}"),
            F.count_if(~v.isin([*TRUE_WORDS, *FALSE_WORDS])).alias(f"b{i}"),
        ]
        kept = (
            F.when(F.col(f"n{i}") == 0, "double")
            .when(F.col(f"i{i}") == 0, "bigint")
            .when(F.col(f"r{i}") == 0, "double")
            .when(F.col(f"b{i}") == 0, "boolean")
            .otherwise("string")
        )
        cells += [F.lit(i), F.lit(name), kept]
    table = texts.agg(*aggs).select(
        F.stack(F.lit(len(texts.columns)), *cells).alias("ordinal", "column", "inferred_type")
    )
    numeric = F.col("inferred_type").isin("bigint", "double")
    return table.withColumn("kind", F.when(numeric, "numeric").otherwise("categorical"))


def apply_types(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    def typed(name: str) -> Column:
        value, dtype = col(name), types[name]
        if dtype == "boolean":
            return F.when(value.isNotNull(), value.isin(TRUE_WORDS)).alias(name)
        return value.cast(dtype).alias(name)

    return texts.select(*[typed(n) for n in texts.columns])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool | None = None
) -> DataFrame:
    """A checked, typed table from comma-separated UTF-8 text with a header in every file.

    Rows with too many fields, unclosed quotes or invalid bytes reject the input, and so do files whose
    headers differ; short rows are padded with missing values. ``schema`` replaces the inferred types.
    Files are split into many tasks, also where there are line breaks inside quotes, which take one more pass.
    ``multiline`` says whether there are, instead of a look at the quotes. Such a break counts as one line feed.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise IngestError("Only .csv files can be read as CSV.")
    # Only the text source hands on bytes as they are.
    look = _look(spark.read.text(path))
    names = look.names
    # Every line in one column, without the header of each file. A line that holds the separator is
    # malformed to the reader, which then hands it on whole.
    raw = (
        spark.read.option("header", True)
        .option("sep", "\u0002")
        .option("quote", "")
        .option("multiLine", False)
        .option("columnNameOfCorruptRecord", "_bad")
        .schema("value string, _bad string")
    )
    if look.spanning if multiline is None else multiline:
        lines = _records(spark, path)
    else:
        lines = raw.csv(path).select(F.coalesce("_bad", "value").alias("value"))
    audited = audit_lines(lines, names)
    counts = audited.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("state").isin("overlong", "broken")).alias("bad"),
    ).first()
    if counts["bad"]:
        raise IngestError(
            f"{counts['bad']} rows cannot be parsed: too many fields or unclosed quotes."
        )
    if not counts["rows"]:
        raise IngestError("The file has no data rows.")
    texts = text_columns(audited, names)
    if schema is not None:
        types = {n: schema[n].dataType.simpleString() for n in names}
    else:
        types = {r["column"]: r["inferred_type"] for r in infer_schema(texts).collect()}
    return apply_types(texts, types)


# Complete fields, then a quote that opens a field and is not closed up to the end of the line.
_OPEN = r'^(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+,|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+$'


def _ends(opened: np.ndarray, stayed: np.ndarray, start: bool) -> np.ndarray:
    """Whether each of a block's lines ends inside quotes, if the block begins inside (``start``) or outside.

    ``opened`` and ``stayed`` say how a line ends that begins outside or inside. Lines for which both agree settle the
    question; behind the last of them, each line that turns one into the other counts.
    """
    settled = np.flatnonzero(opened == stayed)
    turns = np.cumsum(opened & ~stayed)
    last = np.searchsorted(settled, np.arange(len(opened)), side="right") - 1
    known = last >= 0
    at = settled[np.maximum(last, 0)] if len(settled) else np.zeros(len(opened), np.int64)
    begun = np.where(known, opened[at], start)
    return begun ^ ((turns - np.where(known, turns[at], 0)) % 2 == 1)


def _blocks_of(batches):
    """(file, block, columns of all its lines): what a task reads of one block lies together."""
    held, rows = None, []
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        edges = [0, *[i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])], len(files)]
        for start, end in zip(edges, edges[1:]):
            if end == start:
                continue
            if held is not None and held != (files[start], blocks[start]):
                yield *held, pa.Table.from_batches(rows)
                rows = []
            held = (files[start], blocks[start])
            rows.append(batch.slice(start, end - start))
    if held is not None:
        yield *held, pa.Table.from_batches(rows)


def _flags(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(n).to_numpy().astype(bool) for n in ("opened", "stayed"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records, quoted line breaks included, without the header of each file; read in blocks.

    A first pass sums up every block: how it ends, and whether a record begins in it, for both ways it can begin. From
    these, one row per block as Spark's own list of splits, follows how each does begin. The second pass puts
    the lines of a record together; only records that reach over the end of a block are exchanged.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.col("value").rlike(_OPEN).alias("opened"),
        F.concat(F.lit('"'), "value").rlike(_OPEN).alias("stayed"),
    )

    def sums(batches):
        for file, block, table in _blocks_of(batches):
            outside, inside = (_ends(*_flags(table), start) for start in (False, True))
            begins = bool((~inside[:-1]).any())
            yield pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "outside": [bool(outside[-1])], "inside": [bool(inside[-1])], "begins": [begins]}
            )

    shape = "file string, block bigint, outside boolean, inside boolean, begins boolean"
    found = lines.drop("value").mapInArrow(sums, shape).orderBy("file", "block").collect()
    # (how the block begins, the block in which the record that is open there has begun)
    known: dict[tuple[str, int], tuple[bool, int]] = {}
    file, open_, owner = None, False, 0
    for r in found:
        if r["file"] != file:
            file, open_, owner = r["file"], False, r["block"]
        known[r["file"], r["block"]] = (open_, owner)
        if not open_ or r["begins"]:
            owner = r["block"]
        open_ = r["inside"] if open_ else r["outside"]
    states = spark.sparkContext.broadcast(known)

    def records(batches):
        for file, block, table in _blocks_of(batches):
            start, owner = states.value[file, block]
            after = _ends(*_flags(table), start)
            before = np.concatenate([[start], after[:-1]])
            # Places of the lines that begin a record; what comes before the first belongs to an earlier block's.
            firsts = np.flatnonzero(~before).tolist()
            texts = table.column("value").to_pylist()
            edges = [*([0] if start else []), *firsts, len(texts)]
            parts = ["\n".join(texts[i:j]) for i, j in zip(edges, edges[1:])]
            owners, whole = [block] * len(parts), [True] * len(parts)
            if start:
                owners[0], whole[0] = owner, False
            if after[-1]:
                whole[-1] = False
            if block == 0:
                # The header.
                parts, owners, whole = parts[1:], owners[1:], whole[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(parts), pa.string()), pa.array(owners, pa.int64()),
                 pa.array([block] * len(parts), pa.int64()), pa.array(whole, pa.bool_()), pa.array(parts, pa.string())],
                names=["file", "owner", "block", "whole", "value"],
            )

    made = lines.mapInArrow(records, "file string, owner bigint, block bigint, whole boolean, value string")
    listed = F.sort_array(F.collect_list(F.struct("block", "value")))
    torn = made.where(~F.col("whole")).groupBy("file", "owner").agg(listed.alias("parts"))
    joined = torn.select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return made.where("whole").select("value").unionByName(joined)


def summary(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Per column of a table: kind, physical type, distinct values; table shape on every row."""
    return profile.select(
        "ordinal",
        "column",
        "kind",
        "physical_type",
        "unique_count",
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def preview(df: DataFrame, key: list[str], rows: int = 50) -> DataFrame:
    """The first ``rows`` rows by ``key``; dates and times as ISO text."""

    def shown(field: T.StructField) -> Column:
        value = col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(value, "yyyy-MM-dd").alias(field.name)
        kind(field.dataType)
        return value

    return df.orderBy(*[col(k) for k in key]).limit(rows).select(*[shown(f) for f in df.schema.fields])
