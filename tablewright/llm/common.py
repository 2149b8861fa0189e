"""What the operators of this subpackage share: batches of texts, words, written tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.storage import scratch_path

#: Bytes of text a Python task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

#: Bytes that are no part of a licence or benchmark word become blanks, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

#: A-Z become a-z; nothing else changes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about PIECE_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    turns = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    added: T.StructType,
    work: Callable[[list], Sequence],
) -> DataFrame:
    """Columns ``keep`` of every row, unchanged, beside what ``work`` makes of the row's text.

    ``work`` gets a list of texts (None where null) and returns one sequence per added field. Only the
    named columns are read, so further columns of whatever name do not matter.
    """
    chosen = df.select(
        *[column(k).alias(f"k{i}") for i, k in enumerate(keep)],
        column(text).cast("string").alias("t"),
    )
    names = [f"k{i}" for i in range(len(keep))]
    fields = [T.StructField(n, chosen.schema[n].dataType) for n in names]
    schema = T.StructType([*fields, *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields))])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    labels = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                made = work(piece.column("t").to_pylist())
                made = [
                    m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, kind)
                    for m, kind in zip(made, kinds)
                ]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *made], names=labels)

    return chosen.mapInArrow(run, schema).toDF(*keep, *(f.name for f in added.fields))


def from_text(text: Column, added: T.StructType, work: Callable[[list], Sequence]) -> Column:
    """A struct of what ``work`` makes of the text, one field per added one.

    ``work`` is as in ``map_texts``. Only the text goes to the Python worker and only the struct comes back; the
    row's other columns stay where they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in added.fields]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for piece in pieces(pa.RecordBatch.from_arrays([batch], names=["t"]), "t"):
                made = work(piece.column("t").to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(m, k) for m, k in zip(made, kinds)], names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, kinds))))

    return F.arrow_udf(run, added)(text.cast("string"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: it is computed once and outlives executors.

    Spark drops the shuffle files of finished steps when the driver collects garbage, so this asks for it:
    otherwise those of a whole plan of many steps stay on the disks until its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hashes of words; a task remembers those of up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, split: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words behind each other, and the number of words of each text."""
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = map(self.__getitem__, itertools.chain.from_iterable(split))
        return np.fromiter(words, np.uint64, int(sizes.sum())), sizes


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """The (written) table, marked for broadcast if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df
