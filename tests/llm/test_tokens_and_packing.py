import io
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import by_id, documents, texts, words

from tablewright.functions.storage import scratch_path
from tablewright.llm import QUERIES, tokens
from tablewright.llm.packing import optimal_boundaries, pack
from tablewright.llm.tokens import FrameWriter, SeekableFile, WordEncoder, lookup, read_token_files, write_token_files
from tablewright.types import TablewrightError

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
ENCODER = WordEncoder(VOCABULARY)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


AWKWARD = [
    "", " ", "Don't. stop... it's e.g. a.b. I'LL x'", "<|endoftext|>Hi <|ENDOFTEXT|> there.", "É é É. İstanbul ΣΑΣ. K",
    "a b c\x0b\x0cd\x1ce", "end. \n. ,x ,", "12.5 1,000. x1. 1x,", "́ start ́", "ß. ñ, ñ. über.", "😀. 👩‍👩‍👧 .", "A" * 5000 + ".",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_words_remembered_give_the_same_ids(text):
    assert [ids(x) for x in ENCODER.encode([text, text])] == [plain(text)] * 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'<|>aAzZéÉ́ßİ1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_remembered_give_the_same_ids_for_any_text(text):
    assert ids(ENCODER.encode([text])[0]) == plain(text)


def test_frames_are_read_alone_and_checked(monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_IDS", 10)
    docs = [(1, 3), (2, 8), (None, 0), (5, 25), (6, 1), (6, 2)]
    sink = io.BytesIO()
    writer, data = FrameWriter(sink), {}
    for i, (doc, count) in enumerate(docs):
        data[i] = np.arange(count, dtype="<u4").tobytes()
        writer.add(doc, data[i])
    writer.finish()
    packed = sink.getvalue()
    reads = []

    def read(at, size):
        reads.append((at, size))
        return packed[at : at + size]

    found = SeekableFile(read, len(packed))
    assert [(d, before, x) for d, before, x in found.documents()] == [
        (d, sum(c for _, c in docs[:i]), data[i]) for i, (d, _) in enumerate(docs)
    ]
    reads.clear()
    assert [x for _, _, x in found.documents({5})] == [data[3]] and len(reads) == 1
    broken = bytearray(packed)
    broken[int(found.offsets[1]) + 8] ^= 255
    with pytest.raises(Exception):
        list(SeekableFile(lambda at, size: bytes(broken[at : at + size]), len(broken)).documents())
    # Any reader of the format passes over the index and the seek table.
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True).read() == b"".join(data.values())


def test_files_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_BYTES", 200)
    rows = [(5, "five words are in here"), (None, "null id"), (2, None), (3, ""), (3, "b"), (3, "a"), (9, "long text. " * 5000), (3, "a")]
    folder = scratch_path(spark, "token-test")
    manifest = write_token_files(documents(spark, rows), folder, VOCABULARY)
    got = sorted(read_token_files(spark, folder, manifest).collect(), key=lambda r: r["start"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = [(d, plain(t) + [1]) for d, t in ordered]
    assert [(r["doc_id"], ids(r["ids"])) for r in got] == expected
    starts = [0, *itertools.accumulate(len(x) for _, x in expected)][:-1]
    assert [r["start"] for r in got] == starts
    file = next(r["file"] for r in manifest.collect() if 9 in lookup(folder, r["file"], [9]))
    assert lookup(folder, file, [9])[9].tolist() == plain("long text. " * 5000) + [1]


def test_files_of_an_empty_table(spark):
    folder = scratch_path(spark, "token-test")
    manifest = write_token_files(documents(spark, []), folder, VOCABULARY)
    assert read_token_files(spark, folder, manifest).count() == 0


def test_token_query_round_trip(spark, sf):
    at = 0
    got = by_id(QUERIES["op6_token_files"](spark, sf))
    for d, text in sorted(texts(spark, sf).items()):
        own = plain(text) + [1]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(own), crc)
        at += len(own)


def padding(histogram, bounds):
    return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in histogram.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 20), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_waste_least(histogram, buckets):
    bounds = optimal_boundaries(histogram, buckets)
    assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == max(histogram)
    rest = [n for n in histogram if n != max(histogram)]
    best = min(
        padding(histogram, sorted([*c, max(histogram)])) for k in range(buckets) for c in itertools.combinations(rest, k)
    )
    assert padding(histogram, bounds) == best


def pack_by_hand(rows, max_len, buckets, budget):
    pieces = []
    for d, text in rows:
        n = len(words(text)) + 1
        pieces += [(d, n, p, min(max_len, n - p * max_len)) for p in range(-(-n // max_len))]
    histogram = {}
    for *_, size in pieces:
        histogram[size] = histogram.get(size, 0) + 1
    bounds = optimal_boundaries(histogram, buckets)
    out, filled = [], {}
    for d, _, p, size in sorted(pieces, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        bucket = next(b for b in bounds if b >= size)
        rank = filled[bucket] = filled.get(bucket, -1) + 1
        capacity = max(1, budget // bucket)
        out.append((d, p, p * max_len, size, bucket, rank // capacity, rank % capacity))
    return sorted(out, key=str)


def test_packing_like_by_hand(spark, sf, monkeypatch):
    from tablewright.llm import packing

    monkeypatch.setattr(packing, "RANGE_ROWS", 37)
    rows = sorted(texts(spark, sf).items()) + [(None, "x y"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "w " * 1000), (7, "w"), (7, "w")]
    got = pack(documents(spark, rows), max_len=100, buckets=5, batch_tokens=450)
    assert sorted((tuple(r) for r in got.collect()), key=str) == pack_by_hand(rows, 100, 5, 450)


def test_packing_of_empty_tables(spark):
    assert pack(documents(spark, [])).count() == 0
    assert pack(documents(spark, [(1, "a")]), length=F.lit(0)).count() == 0


def test_packing_query(spark, sf):
    got = QUERIES["op8_packing"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == pack_by_hand(texts(spark, sf).items(), 2048, 16, 65_536)


def test_any_tokenizer_gets_its_own_ids(spark, tmp_path):
    """What is passed word by word is decided from the tokenizer's file."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    given = ["Hello World. A  b", "", "tab\tand\n\nlines \u00c9\u00e9", "MiXeD   CaSe"]
    rows = [(i, t) for i, t in enumerate(given)]
    own = Tokenizer.from_file(file)
    assert not WordEncoder(file).split_words and WordEncoder(VOCABULARY).split_words
    expected = [own.encode(t, add_special_tokens=False).ids for t in given]
    assert [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(file).encode(given)] == expected
    manifest = write_token_files(documents(spark, rows), f"{tmp_path}/files", file, end_id=None)
    read = by_id(read_token_files(spark, f"{tmp_path}/files", manifest))
    assert [np.frombuffer(read[i]["ids"], "<u4").tolist() for i in range(len(given))] == expected
    with pytest.raises(TablewrightError, match="one by one"):
        WordEncoder(file, split_words=True)
