"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each holding whole documents as little-endian unsigned 32-bit
ids, then a skippable frame with the document index, then the public seek table (a skippable frame with sizes
and a checksum for every frame). A reader takes the tail of a file, looks up the documents it wants and reads
and decompresses their frames only.

Task side files are written under a name of their own and then moved to their final name, so a task that runs
twice leaves the same file once.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.storage import join_small
from tablewright.llm.common import column, pieces, written
from tablewright.types import TablewrightError

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Ids a frame holds before the next one begins (a longer document has a frame of its own).
FRAME_IDS = 32_768
#: Compressed bytes a file holds before the next one begins.
FILE_BYTES = 64 << 20
#: Words whose ids a Python worker remembers: the first it meets, so the frequent ones.
REMEMBERED_WORDS = 700_000

#: One mark between a letter and white space is a piece of its own for every tokenizer that splits at letters.
#: (Letters here: a-z, and those of U+00C0 to U+00FF. The mark comes first, which is what the search looks for.)
_LOOSE = re.compile(rb"([.,])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \t-\r])")


def splits_words(tokenizer) -> bool:
    """Whether a text's ids are those of its lower-cased words, one after the other.

    So it is if the normalizer lower-cases, the pre-tokenizer leaves white space out, and words end in a mark, by
    which they are told apart.
    """
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    if not getattr(tokenizer.model, "end_of_word_suffix", None):
        return False
    if tokenizer.normalizer.normalize_str("ABCXYZ\u00c9 a") != "abcxyz\u00e9 a":
        return False
    spaced = "one  two\tthree\n\nfour \x0b\x0c\r five"
    found = [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(spaced)]
    return found == spaced.split()


class WordEncoder:
    """Encodes texts with a tokenizer file, remembering the ids of words.

    That takes a tokenizer that drops white space, so that nothing reaches across it, and lower-cases. Whether the
    file's is one is found out from the file; any other gets whole texts. ``split_words=False`` hands whole texts
    over in any case.
    """

    def __init__(self, path: str, split_words: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        able = splits_words(self.tokenizer)
        if split_words and not able:
            raise TablewrightError(f"The tokenizer of {path} cannot be given words one by one.")
        self.split_words = able if split_words is None else split_words
        self.known: dict[bytes, bytes] = {}
        # Ids that end a word, where the vocabulary marks them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.split_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self._plain([t or "" for t in texts])]
        split = [self._units(t) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys()
        self._learn(new)
        found = [b"".join(map(self.known.__getitem__, s)) for s in split]
        if len(self.known) > REMEMBERED_WORDS:
            for unit in new:
                del self.known[unit]
        return found

    def _plain(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    @staticmethod
    def _units(text: str) -> list[bytes]:
        data = text.encode()
        return data.split() if b"<|" in data else _LOOSE.sub(rb" \1", data.lower()).split()

    def _learn(self, units: set[bytes]) -> None:
        words, others = [], []
        for unit in units:
            one_word = unit.isalpha() or unicodedata.normalize("NFC", unit.decode()).lower().isalpha()
            (words if one_word else others).append(unit)
        blocks = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for block, encoded in zip(blocks, self._plain([b" ".join(b).decode() for b in blocks])):
            ids = np.array(encoded.ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) == len(block) + 1 and cuts[-1] == len(ids):
                data = ids.tobytes()
                self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(block, cuts, cuts[1:]))
            else:
                others += block
        for start in range(0, len(others), 1000):
            block = others[start : start + 1000]
            for unit, encoded in zip(block, self._plain([u.decode() for u in block])):
                self.known[unit] = np.array(encoded.ids, "<u4").tobytes()


def worker_encoder(path: str, split_words: bool | None) -> WordEncoder:
    """The encoder that this Python worker keeps from task to task."""
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    key = f"{path} {split_words}"
    if key not in kept:
        kept[key] = WordEncoder(path, split_words)
    return kept[key]


class FrameWriter:
    """Writes documents, as frames, to anything with ``write``."""

    def __init__(self, sink, level: int = 3):
        self.sink = sink
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, frame, first id in the frame, ids
        self.open: list[bytes] = []
        self.open_ids = 0
        self.total_ids = 0
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // 4
        if self.open_ids and self.open_ids + count > FRAME_IDS:
            self._end_frame()
        self.docs.append((doc_id, len(self.frames), self.open_ids, count))
        self.open.append(ids)
        self.open_ids += count
        self.total_ids += count

    def _end_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.compressor.compress(raw)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.sink.write(packed)
        self.bytes += len(packed)
        self.open, self.open_ids = [], 0

    def finish(self) -> None:
        if self.open_ids:
            self._end_frame()
        ids = np.array([d or 0 for d, *_ in self.docs], "<i8")
        missing = np.array([d is None for d, *_ in self.docs], "u1")
        places = np.array([d[1:] for d in self.docs], "<u8").reshape(-1, 3)
        index = struct.pack("<Q", len(self.docs)) + ids.tobytes() + missing.tobytes() + places.tobytes()
        index = struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index
        entries = [*self.frames, (len(index), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        table += struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(index + struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)


class SeekableFile:
    """Reads a file through ``read(offset, size)``; only the tail and the frames asked for are read."""

    def __init__(self, read, size: int):
        self.read = read
        count, flag, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        table_at = size - 9 - 12 * count
        entries = np.frombuffer(read(table_at, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.entries = entries
        index = read(int(self.offsets[count - 1]), int(entries[-1, 0]))
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != entries[-1, 2]:
            raise ValueError("document index does not match its checksum")
        (docs,) = struct.unpack_from("<Q", index, 8)
        ids = np.frombuffer(index, "<i8", docs, 16)
        missing = np.frombuffer(index, "u1", docs, 16 + 8 * docs)
        places = np.frombuffer(index, "<u8", 3 * docs, 16 + 9 * docs).reshape(-1, 3).astype(np.int64)
        self.doc_ids = [None if m else int(i) for i, m in zip(ids, missing)]
        self.places = places

    def frame(self, number: int) -> bytes:
        packed_size, raw_size, checksum = self.entries[number].tolist()
        packed = self.read(int(self.offsets[number]), packed_size)
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=raw_size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids of the file before it, its ids) in file order; each frame is decompressed once."""
        open_number, raw = -1, b""
        before = 0
        for doc_id, (number, first, count) in zip(self.doc_ids, self.places.tolist()):
            if wanted is None or doc_id in wanted:
                if count and number != open_number:
                    open_number, raw = number, self.frame(number)
                yield doc_id, before, raw[4 * first : 4 * (first + count)] if count else b""
            before += count


def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a shared folder, local or remote, and the folder's path on it."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(folder) if "://" in folder else (arrow_fs.LocalFileSystem(), folder)


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    split_words: bool | None = None,
) -> DataFrame:
    """Encodes every whole text and writes the ids, in ascending order of ``doc_id``, below ``folder``.

    ``tokenizer`` is the path of a vocabulary file that every worker has; ``split_words`` is as in WordEncoder.
    Returns the manifest: file, n_docs,
    n_ids, start (ids in all files before it). Documents are range-partitioned by id, so file names sort as
    their documents do; a file ends at FILE_BYTES.

    A null text counts as empty: only the end id is written (nothing at all if that is None). Null ids come
    first; equal ids are all written, in order of their texts. An empty table gives no files and an empty
    manifest. Other columns are not looked at.
    """
    spark = df.sparkSession
    chosen = df.select(
        column(doc_id).cast("bigint").alias("d"), F.coalesce(column(text).cast("string"), F.lit("")).alias("t")
    )
    ordered = chosen.repartitionByRange("d").sortWithinPartitions("d", "t")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        encoder = worker_encoder(tokenizer, split_words)
        done, writer, own = [], None, ""

        def close():
            name = f"part-{part:06d}-{len(done):04d}.zst"
            writer.finish()
            writer.sink.close()
            system.move(own, f"{base}/{name}")
            done.append((name, len(writer.docs), writer.total_ids))

        for batch in batches:
            for piece in pieces(batch, "t"):
                for number, ids in zip(piece.column("d").to_pylist(), encoder.encode(piece.column("t").to_pylist())):
                    if writer and writer.bytes >= FILE_BYTES:
                        close()
                        writer = None
                    if not writer:
                        own = f"{base}/.{uuid.uuid4().hex}"
                        writer = FrameWriter(system.open_output_stream(own))
                    writer.add(number, ids + end)
        if writer:
            close()
        names, docs, ids = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(ids, pa.int64())],
            names=["file", "n_docs", "n_ids"],
        )

    made = written(ordered.mapInArrow(run, "file string, n_docs bigint, n_ids bigint"), "token-manifest")
    # One row per file: the running sum is over files, not documents.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (bytes).

    Checksums of all frames are verified. The manifest names the files; with an empty one the result is empty.
    """
    schema = "file string, doc_id bigint, before bigint, n_tokens bigint, ids binary"
    system_files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    files = system_files.option("pathGlobFilter", "part-*.zst").load(folder)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_buffer()
                view = memoryview(data)
                found = SeekableFile(lambda at, size: bytes(view[at : at + size]), len(view))
                rows, held = [], 0
                for row in found.documents():
                    rows.append(row)
                    held += len(row[2])
                    if held > 16 << 20:
                        yield _rows(path, rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(path, rows)

    found = files.select("path", "content").mapInArrow(run, schema)
    starts = manifest.select("file", F.col("start").alias("file_start"))
    return join_small(found, starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def _rows(path: str, rows: list) -> pa.RecordBatch:
    ids = [r[2] for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path.rsplit("/", 1)[-1]] * len(rows), pa.string()),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        names=["file", "doc_id", "before", "n_tokens", "ids"],
    )


def lookup(folder: str, file: str, wanted: Sequence[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file, by reading its tail and their frames only."""
    system, base = file_system(folder)
    with system.open_input_file(f"{base}/{file}") as source:
        size = source.size()
        found = SeekableFile(lambda at, count: source.read_at(count, at), size)
        return {d: np.frombuffer(ids, "<u4") for d, _, ids in found.documents(set(wanted))}


def ids_crc32(df: DataFrame) -> DataFrame:
    """Column ids replaced by ids_crc32, the unsigned CRC-32 of its bytes."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

