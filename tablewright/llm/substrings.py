"""Substring deduplication by recompression.

Recompression replaces, round by round, runs of one symbol and then pairs of adjacent symbols by new names. A
pair is named if its first symbol falls into the left half of the alphabet and its second into the right one,
so what becomes of a symbol depends on its nearest neighbours only, and equal substrings get equal symbols except
near their ends. Names are 64-bit hashes of what they stand for: they agree over the whole corpus without a
table of names, and a round needs no exchange.

For every symbol of the last round its context is known, the words that decided how it came about. A window of
``window`` words holds some symbols together with their contexts, and these are the same wherever the window
occurs; the one with the least hash is the window's anchor. (A window without one takes a symbol of the first
round, or failing that, as in a long run of one word, itself.) Thus

* a window can be repeated in another document only if its anchor is: anchors that lie in one document are
  dropped, by far the most;
* neighbouring windows with one anchor are a span; a span that occurs in an earlier document repeats in whole;
* only where one anchor has different spans, at the ends of repeats, are windows compared one by one.

What is compared is two 64-bit hashes of the words (name and content), never a hash of a hash of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WordHashes, column, maybe_broadcast, pieces, written

#: Rounds of pairs after the first round, of runs.
ROUNDS = 2
#: Words a task compresses at once; longer stretches are cut so that they overlap by a window.
STRETCH = 1 << 19
#: Anchors up to which their counted table is broadcast.
BROADCAST_ROWS = 2_000_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ENDS = mix(np.array([1, 2], np.uint64))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without the characters U+0009 to U+000D and U+0020."""
    return [] if text is None else text.encode().split()


class Content:
    """Hashes of passages of a word sequence."""

    def __init__(self, words: np.ndarray, base: int):
        powers = np.full(len(words) + 1, base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.upto = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.upto[end] - self.upto[start]) * self.inverse[start] + size)


def name_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First round: symbol, context start and context end of every run of equal words."""
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    ends = np.append(starts[1:], len(words))
    count = (ends - starts).astype(np.uint64)
    symbols = np.where(count > 1, mix(words[starts] + count * np.uint64(_BASES[0])), words[starts])
    # A run ends where a different word is seen.
    return symbols, np.maximum(starts - 1, 0), np.minimum(ends + 1, len(words))


def name_pairs(symbols, first, last, turn: int):
    """One round of pairs: symbols and contexts after it."""
    left = (mix(symbols + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
    pair = left[:-1] & ~left[1:]
    head, tail = np.append(pair, False), np.append(False, pair)
    # A left symbol looks at the next one, a right symbol at the one before.
    ahead = np.append(left[:-1], False)
    behind = np.append(False, ~left[1:])
    nearest_first = np.where(behind, np.append(first[:1], np.minimum(first[:-1], first[1:])), first)
    nearest_last = np.where(ahead, np.append(np.maximum(last[:-1], last[1:]), last[-1:]), last)
    named = symbols.copy()
    at = np.flatnonzero(head)
    named[at] = mix(symbols[at] * np.uint64(3) + mix(symbols[at + 1]))
    nearest_first[at] = np.minimum(nearest_first[at], first[at + 1])
    nearest_last[at] = np.maximum(nearest_last[at], last[at + 1])
    return named[~tail], nearest_first[~tail], nearest_last[~tail]


def _least_anchor(names: np.ndarray, key: np.ndarray, first, last, window: int, open_: np.ndarray) -> None:
    """Writes into ``names`` (0: none yet), where ``open_``, the name of the least anchor inside each window."""
    total = np.concatenate([[0], np.cumsum(open_)])
    count = len(open_)
    size = last - first
    near = total[np.minimum(first + 1, count)] - total[np.clip(last - window, 0, count)] > 0
    fit = (size <= window) & near
    key, first, size = key[fit], first[fit], size[fit]
    if not len(key):
        return
    order = np.lexsort((~key, first))  # of equal starts the least key is written last
    key, first, size = key[order], first[order], size[order]
    best = np.full(count, _MOST, np.uint64)
    for back in range(window - int(size.min()) + 1):
        use = size <= window - back
        key, first, size = key[use], first[use], size[use]
        at = first - back
        here = (at >= 0) & (at < count)
        at, own = at[here], key[here]
        better = own < best[at]
        best[at[better]] = own[better]
    found = open_ & (best != _MOST)
    names[found] = best[found]


def anchor_names(words: np.ndarray, window: int, content: Content) -> np.ndarray:
    """The name of the anchor of every window: a hash of the anchor's words with its context."""
    count = len(words) - window + 1
    symbols, first, last = name_runs(words)
    runs = first, last
    for turn in range(ROUNDS):
        symbols, first, last = name_pairs(symbols, first, last, turn)
    names = np.zeros(count, np.uint64)
    for first, last in ((first, last), runs):
        open_ = names == 0
        if open_.any():
            _least_anchor(names, content.of(first, last), first, last, window, open_)
    at = np.flatnonzero(names == 0)
    names[at] = content.of(at, at + window)
    return names


def spans_of(hashes: np.ndarray, sizes: np.ndarray, window: int):
    """Spans of all windows of a batch: (name, content, text number, first window, windows), and the windows' hashes.

    ``hashes`` are the words of all texts behind each other, ``sizes`` the texts' word counts.
    """
    # A word of its own ends each text.
    total = len(hashes) + len(sizes)
    ends = np.cumsum(sizes + 1)
    words = np.empty(total, np.uint64)
    is_end = np.zeros(total, bool)
    is_end[ends - 1] = True
    words[~is_end] = hashes
    words[is_end] = mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(_BASES[1]))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    starts = ends - sizes - 1
    closed = np.concatenate([[0], np.cumsum(is_end)])
    out = []
    for begin in range(0, max(total - window + 1, 0), STRETCH):
        part = words[begin : begin + STRETCH + window - 1]
        # A strange word at each end keeps symbols there from looking complete.
        closed_part = np.concatenate([_ENDS[:1], part, _ENDS[1:]])
        names = anchor_names(closed_part, window, Content(closed_part, _BASES[0]))[1:-1]
        checking = Content(part, _BASES[1])
        at = np.arange(begin, begin + len(names))
        inside = closed[at + window] == closed[at]
        first = inside & np.concatenate([[True], (names[1:] != names[:-1]) | ~inside[:-1]])
        heads = np.flatnonzero(first)
        if not len(heads):
            continue
        # A span goes on to the next head, or to the end of its text.
        following = np.append(heads[1:], len(names))
        upto = np.concatenate([[0], np.cumsum(inside)])
        count = upto[following] - upto[heads]
        text = owner[heads + begin]
        local = np.arange(len(names))
        each = checking.of(local, local + window)
        out.append(
            (
                names[heads],
                checking.of(heads, heads + count + window - 1),
                text,
                heads + begin - starts[text],
                count,
                [each[h : h + c].tobytes() for h, c in zip(heads.tolist(), count.tolist())],
            )
        )
    return out


def drop_repeated_passages(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, text (kept words, joined by one blank).

    A word is removed if it lies in a window of ``window`` consecutive words that also starts in a document with
    a smaller id. All windows are judged on the texts as they came in.

    A null or empty text has no words and gives an empty text. Ids are compared as whole numbers; a null id is
    smaller than all others, and rows that share an id never count as smaller than each other. Rows that repeat
    both id and text share their fate. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = df.select(column(doc_id).alias("d"), column(text).cast("string").alias("t")).select(
        "d",
        # The id to compare, and with a short hash of the text the key of a row.
        F.coalesce(F.col("d").cast("bigint"), F.lit(-(2**63))).alias("o"),
        F.hash("t").alias("h"),
        "t",
    )
    some = rows.where(F.col("t").isNotNull()).select("o", "h", "t")

    # A text that an earlier document has as a whole needs no further look.
    keys = written(some.select("o", "h", F.unhex(F.md5("t")).alias("x")), "passage-texts")
    firsts = keys.groupBy("x").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("x", "a")
    copies = written(keys.join(firsts, "x").where("o > a").select("o", "h").distinct(), "passage-copies")
    some = some.join(maybe_broadcast(copies, BROADCAST_ROWS), ["o", "h"], "left_anti")

    def names(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, "t"):
                found = spans_of(*hashes.of(list(map(words_of, piece.column("t").to_pylist()))), window)
                ids = piece.column("o").to_numpy()
                for name, _, owner, *_ in found:
                    # The smallest and largest id of each name in the batch.
                    value = ids[owner]
                    order = np.lexsort((value, name))
                    name, value = name[order], value[order]
                    head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(name[head].view(np.int64)),
                            pa.array(value[head]),
                            pa.array(value[np.append(head[1:], len(name)) - 1]),
                        ],
                        names=["g", "a", "b"],
                    )

    shared = (
        some.mapInArrow(names, "g bigint, a bigint, b bigint")
        .groupBy("g")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .where("a < b")
        .select("g")
    )
    shared = maybe_broadcast(written(shared, "passage-anchors"), BROADCAST_ROWS)

    def spans(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, "t"):
                for name, content, owner, first, count, each in spans_of(
                    *hashes.of(list(map(words_of, piece.column("t").to_pylist()))), window
                ):
                    at = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(name.view(np.int64)),
                            pa.array(content.view(np.int64)),
                            piece.column("o").take(at),
                            piece.column("h").take(at),
                            pa.array(first.astype(np.int32)),
                            pa.array(count.astype(np.int32)),
                            pa.array(each, pa.binary()),
                        ],
                        names=["g", "s", "o", "h", "i", "m", "w"],
                    )

    schema = "g bigint, s bigint, o bigint, h int, i int, m int, w binary"
    found = some.mapInArrow(spans, schema).join(shared, "g", "left_semi")
    found = written(found.select("g", "s", "o", "h", "i", "m", "w"), "passage-spans")

    # A span in a later document than its first goes in whole. (The content's hash covers the length.)
    kinds = written(found.groupBy("g", "s").agg(F.min("o").alias("first")), "passage-kinds")
    placed = found.drop("w").join(kinds, ["g", "s"])
    whole = placed.where("o > first").select("o", "h", "i", "m", F.lit(None).cast("array<int>").alias("at"))

    # Anchors with several kinds of spans: compare their windows.
    mixed = kinds.groupBy("g").count().where("count > 1").select("g")
    mixed = maybe_broadcast(written(mixed, "passage-mixed"), BROADCAST_ROWS)
    several = found.join(mixed, "g", "left_semi").groupBy("g", "s").agg(
        F.min("o").alias("first"), F.first("w").alias("w")
    )

    def windows(batches):
        for batch in batches:
            blobs = batch.column("w").to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], np.int64)
            at = pa.array(np.repeat(np.arange(len(blobs)), sizes))
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("g", "s", "first")),
                    pa.array(np.frombuffer(b"".join(blobs), np.int64)),
                    pa.array((np.arange(int(sizes.sum())) - starts).astype(np.int32)),
                ],
                names=["g", "s", "first", "v", "k"],
            )

    single = written(
        several.select("g", "s", "first", "w").mapInArrow(
            windows, "g bigint, s bigint, first bigint, v bigint, k int"
        ),
        "passage-windows",
    )
    earliest = single.groupBy("g", "v").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    earliest = earliest.where("least < most").select("g", "v", "least")
    parts = single.join(earliest, ["g", "v"]).where("least < first")
    parts = written(parts.groupBy("g", "s").agg(F.collect_list("k").alias("at")), "passage-parts")
    partial = placed.where("o = first").join(parts, ["g", "s"]).select("o", "h", "i", "m", "at")
    entire = copies.select("o", "h", F.lit(-1).alias("i"), F.lit(0).alias("m"), F.lit(None).cast("array<int>").alias("at"))
    whole = whole.unionByName(entire)

    gone = whole.unionByName(partial).groupBy("o", "h").agg(F.collect_list(F.struct("i", "m", "at")).alias("gone"))
    kind = rows.schema["d"].dataType.simpleString()
    joined = rows.join(gone, ["o", "h"], "left").select("d", "t", "gone")

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                texts, sizes, removed = [], [], []
                for value, spans in zip(piece.column("t").to_pylist(), piece.column("gone").to_pylist()):
                    words = words_of(value)
                    sizes.append(len(words))
                    if spans and spans[0]["i"] < 0:  # an earlier document has the same text
                        words = words if len(words) < window else []
                    elif spans:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for span in spans:
                            starts = [(span["i"], span["m"])] if span["at"] is None else [
                                (span["i"] + k, 1) for k in span["at"]
                            ]
                            for at, count in starts:
                                edges[at] += 1
                                edges[at + count + window - 1] -= 1
                        keep = np.cumsum(edges[:-1]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    texts.append(b" ".join(words))
                    removed.append(sizes[-1] - len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("d"),
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")
