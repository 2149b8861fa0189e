"""Line deduplication by winnowing over line hashes.

The lines of a document that are not blank are its sequence. Of every window of lines the least k-gram hash is a
fingerprint, so any run of ``RUN`` lines that occurs twice has a fingerprint at the same place in both. Documents
are joined on fingerprints that occur more than once; around those, a match is extended over all windows of RUN
lines that hold the fingerprint, whose lines are compared by 128-bit digests. Windows that overlap join into
the whole repeated run, and all but its first occurrence are deleted. Where repeats of fewer lines count by their
words, a line or a pair of lines with that many words is a window and a fingerprint of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column, maybe_broadcast, pieces, written

#: Lines of a k-gram, k-grams of a window, and the run of lines that is certain to be found.
K, WINDOW = 2, 2
RUN = K + WINDOW - 1
#: Fingerprints up to which their counted table is broadcast.
BROADCAST_ROWS = 1_000_000

_SPACE = b" \t\n\x0b\x0c\r"
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def _sequence(text: str) -> tuple[list[str], list[int], list[bytes]]:
    """All lines, the places of those that are not blank, and these without white space at the ends."""
    lines = text.split("\n")
    bare = [line.encode().strip(_SPACE) for line in lines]
    places = [i for i, line in enumerate(bare) if line]
    return lines, places, [bare[i] for i in places]


def winnowed(lines: list[bytes], words: int | None = None) -> list[tuple[int, int, int, bytes]]:
    """(fingerprint, first line, lines, digest) of every window of RUN lines, and of ``words`` words in fewer lines."""
    digests = [xxhash.xxh3_128_digest(line) for line in lines]
    found = []
    if words is not None:
        sizes = [len(_WORD.findall(line)) for line in lines]
        for n in range(1, RUN):
            for at in range(len(lines) - n + 1):
                if sum(sizes[at : at + n]) >= words:
                    digest = xxhash.xxh3_128_digest(b"".join(digests[at : at + n]))
                    found.append((int.from_bytes(digest[:8], "big", signed=True), at, n, digest))
    if len(lines) < RUN:
        return found
    grams = np.array(
        [xxhash.xxh3_64_intdigest(b"".join(digests[i : i + K])) for i in range(len(lines) - K + 1)], np.uint64
    )
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(1).view(np.int64).tolist()
    return found + [
        (gram, at, RUN, xxhash.xxh3_128_digest(b"".join(digests[at : at + RUN]))) for at, gram in enumerate(least)
    ]


def drop_repeated_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int | None = None
) -> DataFrame:
    """Every row of ``df`` with all its columns, ``text`` without repeated runs of lines, and two more columns:
    n_lines (not blank) and n_removed.

    A line is removed if it lies in a run of RUN lines that occurs before: in a document with a smaller id, or
    further up in the same one. Lines are compared without white space at their ends; blank lines are no part
    of runs, and stay unless the last line that is not blank goes, which leaves an empty text.

    With ``words``, a run of fewer lines is removed too if it occurs before and has at least that many words
    (stretches without white space): one long line is enough, a short one that recurs by chance stays.

    A null text stays null and has no lines. Null ids come first; documents that share an id are in order of a
    hash of their texts, and rows that repeat both id and text share their fate. An empty table stays empty.
    Columns that are called n_lines or n_removed before are replaced.
    """
    rows = df.select(column(doc_id).alias("d"), column(text).cast("string").alias("t"))
    rows = rows.where(F.col("t").isNotNull()).select("d", F.xxhash64("t").alias("h"), "t")
    kind = rows.schema["d"].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                found, owner = [], []
                for n, value in enumerate(piece.column("t").to_pylist()):
                    made = winnowed(_sequence(value)[2], words)
                    found += made
                    owner += [n] * len(made)
                at = pa.array(owner, pa.int64())
                gram, first, size, digest = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("d").take(at),
                        piece.column("h").take(at),
                        pa.array(gram, pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array(size, pa.int8()),
                        pa.array(digest, pa.binary()),
                    ],
                    names=["d", "h", "g", "i", "n", "w"],
                )

    # One row per line (with ``words`` up to RUN), without texts.
    windows = written(
        rows.mapInArrow(prints, f"d {kind}, h bigint, g bigint, i int, n tinyint, w binary"), "line-windows"
    ).distinct()
    place = F.struct("d", "h", "i")
    # Join on fingerprints that occur at more than one place ...
    often = windows.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("g")
    near = windows.join(maybe_broadcast(written(often, "line-prints"), BROADCAST_ROWS), "g", "left_semi")
    near = written(near.select("d", "h", "i", "n", "w"), "line-matches")
    # ... and extend over the windows around them.
    first = near.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    later = near.join(first.select("w", "first"), "w").where(place != F.col("first"))
    runs = later.groupBy("d", "h").agg(F.collect_list(F.struct("i", "n")).alias("runs"))

    others = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    base = df.select(
        *[(column(c).cast("string") if c == text else column(c)).alias(f"c{i}") for i, c in enumerate(others)],
        column(doc_id).alias("d"),
        F.xxhash64(column(text).cast("string")).alias("h"),
    )
    same = F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.h") == F.col("y.h"))
    joined = base.alias("x").join(runs.alias("y"), same, "left").select("x.*", "runs")
    joined = joined.drop("d", "h")
    text_at = f"c{others.index(text)}"
    names = [*joined.columns[:-1], "n_lines", "n_removed"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, text_at):
                texts, sizes, removed = [], [], []
                for value, starts in zip(piece.column(text_at).to_pylist(), piece.column("runs").to_pylist()):
                    lines, places, _ = _sequence(value) if value is not None else ([], [], [])
                    gone = {places[run["i"] + j] for run in starts or () for j in range(run["n"])}
                    if gone and len(gone) == len(places):
                        value = ""
                    elif gone:
                        value = "\n".join(line for i, line in enumerate(lines) if i not in gone)
                    texts.append(value)
                    sizes.append(len(places))
                    removed.append(len(gone))
                columns = [
                    pa.array(texts, pa.string()) if n == text_at else piece.column(n) for n in names[:-2]
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=names
                )

    return joined.mapInArrow(cut, f"{schema}, n_lines bigint, n_removed bigint").toDF(
        *others, "n_lines", "n_removed"
    )
