"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Every shingle gives one random number and one slot per round, its slots being a permutation; the least (round,
number) is kept per slot. A document is finished when all its slots are filled, as later rounds can only bring
larger values. Bands of slots are hashed into buckets.

Documents with equal shingle sets are one class. First, each bucket's classes are compared with its least one,
and linked classes become components. Then, in buckets that still hold several components, members of
different components are compared, in blocks of bounded size; members of one component never are. A
comparison looks at the signatures first; pairs that these do not rule out are verified on whole shingle sets.
Only links leave a comparison, so what it writes does not grow with the pairs it looks at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LOWER_BYTES, WordHashes, column, maybe_broadcast, pieces, written
from tablewright.llm.substrings import mix
from tablewright.operators.components import connected_components

#: Slots of a signature; a prime, so that multiples of a step visit every slot.
SLOTS = 127
#: Largest chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-6
#: A pair is ruled out if its signatures agree in so much less than the threshold (over five deviations).
SLACK = 0.18
#: Members of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 1024
#: Ids up to which a counted table of them is broadcast.
BROADCAST_ROWS = 1_000_000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list, width: int, hashes: WordHashes) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; none for a text without words."""
    split = [[] if t is None else t.encode().translate(LOWER_BYTES).split() for t in texts]
    flat, sizes = hashes.of(split)
    out, start = [], 0
    for size in sizes.tolist():
        words = flat[start : start + size]
        start += size
        count = size - width + 1 if size >= width else min(size, 1)
        span = min(width, size)
        made = np.full(count, span, np.uint64)
        for i in range(span):
            made = mix(made * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
        out.append(np.unique(made))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, one row of SLOTS numbers per set; empty sets have no meaningful one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    step = (mix(elements + np.uint64(1)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    slot = (mix(elements + np.uint64(2)) % np.uint64(SLOTS)).astype(np.int64)
    least = np.full(len(sets) * SLOTS, _NONE, np.uint64)
    for turn in range(SLOTS):
        value = (np.uint64(turn) << np.uint64(56)) | (mix(elements + np.uint64(turn + 3)) >> np.uint64(8))
        np.minimum.at(least, owner * SLOTS + slot, value)
        waiting = (least.reshape(-1, SLOTS) == _NONE).any(1)
        go_on = waiting[owner]
        if not go_on.any():
            break
        elements, owner, step, slot = elements[go_on], owner[go_on], step[go_on], slot[go_on]
        slot = (slot + step) % SLOTS
    return least.reshape(-1, SLOTS)


def band_rows(threshold: float) -> int:
    """Most slots of a band for which bands of them all find a pair at the threshold, but for MISS."""
    fits = [r for r in range(1, SLOTS + 1) if (1 - threshold**r) ** (SLOTS // r) <= MISS]
    return max(fits, default=1)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """Bucket numbers, one column per band."""
    count = SLOTS // rows
    out = np.empty((len(signature), count), np.uint64)
    for band in range(count):
        key = np.full(len(signature), band, np.uint64)
        for i in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * rows + i])
        out[:, band] = key
    return out


_SKETCH = "o bigint, h bigint, n bigint, s binary, bands array<bigint>, sig binary"


def _sketched(rows: DataFrame, width: int, rows_per_band: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, "t"):
                sets = shingle_sets(piece.column("t").to_pylist(), width, hashes)
                signature = signatures(sets)
                bands = bands_of(signature, rows_per_band)
                bands = [b.tolist() if len(s) else [] for b, s in zip(bands.view(np.int64), sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("o"),
                        piece.column("h"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        # One byte per slot is enough to rule pairs out.
                        pa.array([r.tobytes() for r in signature.astype(np.uint8)], pa.binary()),
                    ],
                    names=["o", "h", "n", "s", "bands", "sig"],
                )

    return rows.select("o", "h", "t").mapInArrow(run, _SKETCH)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of class representatives whose whole sets are similar."""
    ids = written(pairs.select(F.col("u").alias("o")).union(pairs.select("v")).distinct(), "near-ids")
    chosen = texts.join(maybe_broadcast(ids, BROADCAST_ROWS), "o", "left_semi").select("o", "t")
    with_v = pairs.join(chosen.withColumnsRenamed({"o": "v", "t": "tv"}), "v")
    both = with_v.join(chosen.withColumnsRenamed({"o": "u", "t": "tu"}), "u").select("u", "v", "tu", "tv")

    def run(batches):
        held, held_set, hashes = None, None, WordHashes()
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                u = batch.column("u")[row].as_py()
                if u != held:
                    held, (held_set,) = u, shingle_sets([batch.column("tu")[row].as_py()], width, hashes)
                (other,) = shingle_sets([batch.column("tv")[row].as_py()], width, hashes)
                common = len(np.intersect1d(held_set, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held_set) + len(other) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u bigint, v bigint")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that their sizes and signatures do not rule out."""
    sketch = classes.select("v", "n", "sig")
    both = pairs.join(sketch, "v").join(sketch.select(F.col("v").alias("u"), F.col("n").alias("m"), F.col("sig").alias("z")), "u")
    least = SLOTS * (percent / 100 - SLACK)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agree = (_bytes(batch.column("sig")) == _bytes(batch.column("z"))).sum(1)
                yield batch.select(["u", "v"]).filter(pa.array(agree >= least))

    sized = both.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sized.select("u", "v", "sig", "z").mapInArrow(run, "u bigint, v bigint")


def _whole_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(v, n, sig, z): size, signature and whole shingle set of the texts with these ids."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, "t"):
                sets = shingle_sets(piece.column("t").to_pylist(), width, hashes)
                signature = signatures(sets).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("o"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([r.tobytes() for r in signature], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["v", "n", "sig", "z"],
                )

    chosen = texts.join(maybe_broadcast(ids, BROADCAST_ROWS), "o", "left_semi").select("o", "t")
    return chosen.mapInArrow(run, "v bigint, n bigint, sig binary, z binary").where("n > 0")


def _links_between(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) of components that a link of two members of one bucket connects.

    ``members`` has k (bucket), v and r (component). A bucket's largest component is split into blocks, and so
    is the rest; blocks of the rest meet each other and those of the largest component.
    """
    counted = members.groupBy("k", "r").agg(F.count(F.lit(1)).alias("c"))
    stats = counted.groupBy("k").agg(
        F.max(F.struct("c", "r")).alias("main"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("parts")
    )
    stats = stats.where("parts > 1").select(
        "k",
        F.col("main.r").alias("main"),
        F.ceil(F.col("main.c") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("total") - F.col("main.c")) / BLOCK).cast("int").alias("rests"),
        (F.col("total") <= BLOCK).alias("small"),
    )
    placed = written(members.join(stats, "k"), "near-crowds")
    ids = written(placed.select(F.col("v").alias("o")).distinct(), "near-ids")
    placed = placed.join(written(_whole_sets(texts, ids, width), "near-sets"), "v")
    in_main = F.col("r") == F.col("main")
    block = F.pmod(F.xxhash64("v"), F.when(in_main, F.col("mains")).otherwise(F.col("rests")))

    def task(x, y, with_main):
        return F.struct(F.lit(with_main).alias("p"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    def counting(upto):
        return F.sequence(F.lit(0), F.col(upto) - 1)

    mine = F.col("b")
    tasks = (
        F.when(F.col("small"), F.array(task(F.lit(0), F.lit(0), False)))
        .when(F.col("main") == F.col("r"), F.transform(counting("rests"), lambda x: task(x, mine, True)))
        .otherwise(
            F.concat(
                F.transform(counting("mains"), lambda y: task(mine, y, True)),
                F.transform(counting("rests"), lambda y: task(F.least(mine, y), F.greatest(mine, y), False)),
            )
        )
    )
    dealt = placed.withColumn("b", block).select("k", "v", "r", "n", "sig", "z", F.explode(tasks).alias("q"))
    dealt = dealt.select("k", "q.*", "v", "r", "n", "sig", "z").repartition("k", "p", "x", "y")
    dealt = dealt.sortWithinPartitions("k", "p", "x", "y", "v")
    least = SLOTS * (percent / 100 - SLACK)

    def compare(v, r, n, sig, whole):
        """Components of all linked members of a group."""
        linked = set()
        for start in range(0, len(v), 64):
            rows = slice(start, start + 64)
            fit = (v[rows, None] < v) & (r[rows, None] != r)
            fit &= 100 * np.minimum(n[rows, None], n) >= percent * np.maximum(n[rows, None], n)
            for at, others in enumerate(fit, start):
                others = np.flatnonzero(others)
                others = others[(sig[others] == sig[at]).sum(1) >= least]
                if not len(others):
                    continue
                own = np.frombuffer(whole[at], np.uint64)
                sets = [np.frombuffer(whole[o], np.uint64) for o in others.tolist()]
                flat = np.concatenate(sets)
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)
                good = others[100 * common >= percent * (n[at] + n[others] - common)]
                linked.update((min(r[at], x), max(r[at], x)) for x in r[good].tolist())
        return linked

    def run(batches):
        held = None
        names = ["k", "p", "x", "y"]

        def groups(table, last, found):
            """Compares the table's groups; returns the last one if it may go on in the next batch."""
            keys = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
            v, r, n = (table.column(c).to_numpy() for c in ("v", "r", "n"))
            sig, whole = _bytes(table.column("sig")), table.column("z").to_pylist()
            for a, b in zip(edges, edges[1:]):
                if b == table.num_rows and not last:
                    return table.slice(a)
                found |= compare(v[a:b], r[a:b], n[a:b], sig[a:b], whole[a:b])
            return None

        def out(found):
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            found = set()
            held = groups(batch, False, found)
            yield out(found)
        if held is not None:
            found = set()
            groups(held, True, found)
            yield out(found)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (least id that can be reached), kept.

    A document's set are its distinct shingles of ``width`` words (A-Z lower-cased, no white space); a shorter
    document has one shingle, all its words. Two documents are linked if their sets have 100 times as many common
    as ``percent`` times all shingles; every link counts, not those to the kept document only.

    A null text, or one without words, has no shingles and is linked with nothing. Ids are whole numbers, a null
    id is the least; rows that share an id are one vertex, linked by any of their texts. An empty table gives an
    empty result. Other columns are not looked at.
    """
    kind = "bigint"
    nothing = -(2**63)
    rows = df.select(
        F.coalesce(column(doc_id).cast(kind), F.lit(nothing)).alias("o"), column(text).cast("string").alias("t")
    ).withColumn("h", F.xxhash64("t"))
    sketches = written(_sketched(rows, width, band_rows(percent / 100)), "near-sketches")
    classes = (
        sketches.where("n > 0")
        .groupBy("s")
        .agg(F.min("o").alias("v"), *[F.first(c).alias(c) for c in ("n", "bands", "sig")])
    )
    classes = written(classes, "near-classes")
    owner = written(sketches.join(classes.select("s", "v"), "s", "left").select("o", "n", "v"), "near-owners")
    # Rows that share an id but not a set: their classes belong together.
    shared = owner.where("v IS NOT NULL").groupBy("o").agg(F.min("v").alias("u"), F.max("v").alias("w"))
    shared = shared.where("u < w").select("o", "u")
    given = owner.join(shared, "o").where("u < v").select("u", "v").distinct()
    # Two classes of one id are one vertex only if it is the least of both, which needs no edge.
    buckets = classes.select("v", F.explode(F.array_distinct("bands")).alias("k"))
    crowded = written(
        buckets.groupBy("k").agg(F.min("v").alias("u"), F.max("v").alias("w")).where("u < w").select("k", "u"),
        "near-buckets",
    )
    members = written(buckets.join(crowded, "k"), "near-members")
    texts = rows.select("o", "t")
    stars = written(members.where("u < v").select("u", "v").distinct(), "near-stars")
    links = written(_verified(_alike(stars, classes, percent), texts, width, percent).union(given), "near-links")
    roots = written(connected_components(_ends(links), links), "near-roots")
    placed = members.select("k", "v").join(roots, "v", "left").select("k", "v", F.coalesce("root", "v").alias("r"))
    more = written(_links_between(written(placed, "near-placed"), texts, width, percent), "near-more")
    found = owner.join(roots, "v", "left").select("o", "n", F.coalesce("root", "v").alias("r"))
    if not more.isEmpty():  # components of components
        joined = connected_components(_ends(more), more).select(F.col("v").alias("r"), "root")
        found = found.join(written(joined, "near-roots"), "r", "left").select(
            "o", "n", F.coalesce("root", "r").alias("r")
        )
    # Without shingles a document is alone.
    found = found.select("o", "n", F.coalesce("r", "o").alias("c"))

    def back(c):
        return F.when(F.col(c) != nothing, F.col(c))

    return found.select(
        back("o").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back("c").alias("component_id"),
        (F.col("o") == F.col("c")).alias("kept"),
    )


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("u").alias("v")).union(links.select("v")).distinct()
