"""Vector codes, the Merkle manifest and URL filters."""

import hashlib
import itertools
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import FOLD, documents
from tablewright.llm import ORACLES, QUERIES
from tablewright.llm.merkle import build_manifest, folded, leaf_hash, lowered, proof_digest
from tablewright.llm.queries_structured import URL_RULES
from tablewright.llm.urls import StatedRule, best_rules, filter_urls, host, mine_rules, path, tokens
from tablewright.llm.veccodes import Codebooks, compress_vectors, nearest
from tablewright.types import TablewrightError

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from check_oracles import connect, rows_by_name  # noqa: E402


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_manifest", "op13_url_filter"])
def test_query_matches_sql(spark, sf, name):
    found = QUERIES[name](spark, sf)
    cursor = connect(sf).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_by_name(found.columns, found.collect()) == rows_by_name(names, cursor.fetchall())


# --- vector codes -----------------------------------------------------------------------------


def brute(leaves, entries):
    d = ((leaves[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    number = [min(range(len(entries)), key=lambda e: (row[e], e)) for row in d]
    return number, [row[e] for row, e in zip(d, number)]


@pytest.mark.parametrize("reach,rows,width", [(3, 700, 4), (900, 600, 16), (1 << 26, 300, 16), (5, 1, 1)])
def test_walk_finds_the_nearest_entry(reach, rows, width):
    rng = np.random.default_rng(reach)
    leaves = rng.integers(-reach, reach + 1, (rows, width))
    leaves = np.concatenate([leaves, leaves[: rows // 2]])
    entries = rng.integers(-reach, reach + 1, (40, width))
    entries[7] = entries[3]
    for given in (leaves, leaves[np.lexsort(leaves.T[::-1])]):
        number, distance = nearest(given, entries)
        expected = brute(given, entries)
        assert (number.tolist(), distance.tolist()) == (expected[0], [int(d) for d in expected[1]])


def codes_by_hand(rows, rounds=4):
    """(vec_id, code, error) of rows (vec_id, vector), sorted, and the codebooks."""
    whole = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in whole]
    width = -(-max((len(v) for _, v in q), default=0) // 4)
    q = [(i, v + [0] * (4 * width - len(v))) for i, v in q]
    q.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    books = [[v[p * width : (p + 1) * width] for _, v in q[:256]] for p in range(4)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v in q:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(near(p, part)[1], []).append(part)
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v in q:
        best = [near(p, v[p * width : (p + 1) * width]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist(), i % 3 or None) for i in range(10, 330)]
    rows += [(i, [0.5] * 8, 7) for i in range(400, 440)] + [(3, [0.25] * 8, 7)] * 2 + [(3, [-0.25] * 8, 7)]
    rows += [(1, None, 1), (2, [nan] * 8, 1), (4, [inf] + [0.0] * 7, 1), (5, [None] + [0.0] * 7, 1), (None, [1.0] * 8, None)]
    rows += [(6, [1.0, 2.0, 3.0], 2), (7, [], 2), (8, [-0.0001] * 8, 2)]
    shape = "vec_id bigint, embedding array<double>, label int"
    df = spark.createDataFrame(rows, shape)
    for extra in ("q", "id", "p", "n", "e", "code", "error", "a.b"):
        df = df.withColumn(extra, F.lit("x"))
    found, books = compress_vectors(df)
    expected, entries = codes_by_hand([r[:2] for r in rows])
    got = sorted(((r["vec_id"], r["code"], r["error"]) for r in found.collect()), key=str)
    assert got == sorted(expected, key=str)
    assert books.entries.tolist() == entries
    labels = {}
    for r in found.collect():
        labels.setdefault(r["label"], set()).add(r["label_error"])
    sums = {}
    for r in found.collect():
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert labels == {k: {v} for k, v in sums.items()}
    assert books.decoded("00" * 4) == [v for part in entries for v in part[0]]


def test_codes_without_vectors(spark):
    shape = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        found, books = compress_vectors(spark.createDataFrame(rows, shape))
        assert found.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    found, books = compress_vectors(spark.createDataFrame([(1, [], 1), (2, [], None)], shape))
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    with pytest.raises(TablewrightError, match="beyond"):
        compress_vectors(spark.createDataFrame([(1, [1e30] * 4, 1)], shape))


def test_more_rounds_lower_the_error(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    totals = [compress_vectors(df, rounds=r)[0].agg(F.sum("error")).first()[0] for r in (0, 4)]
    assert totals[1] < totals[0]
    assert isinstance(compress_vectors(df, label=None)[1], Codebooks)


# --- manifest ---------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def raised_by_hand(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def proof_by_hand(nodes, place):
    out = []
    while len(nodes) > 1:
        first = place - place % 8
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])))
        nodes, place = raised_by_hand(nodes), place // 8
    return out


def root_by_hand(nodes):
    while len(nodes) > 1:
        nodes = raised_by_hand(nodes)
    return nodes[0]


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text); one tuple of the contract's columns each, sorted as text."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_by_hand(row), row))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for tree in trees.values():
        tree.sort(key=lambda t: t[:3])
    tops = [root_by_hand([t[2] for t in trees[k]]) for k in names]
    root = root_by_hand(tops) if tops else None
    out = []
    for at, name in enumerate(names):
        nodes = [t[2] for t in trees[name]]
        for place, (_, _, leaf, row) in enumerate(trees[name]):
            proof = proof_by_hand(nodes, place) + proof_by_hand(tops, at)
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                start = leaf_by_hand((*row[:4], row[4].translate(FOLD) if row[4] is not None else None))
            for before, after in proof:
                start = sha(before + start + after)
            out.append((row[0], leaf, tops[at], root, sha("".join(b + a for b, a in proof)), start, start == root))
    return sorted(out, key=str)


def manifest_of(df):
    changed = leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [lowered(F.col("text"))])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = build_manifest(df, changed=F.when(third, changed))
    found = manifest.proofs()
    end = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), end, end == F.col("root"))
    return sorted(map(tuple, found.collect()), key=str)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def test_manifest_like_by_hand(spark):
    """Trees of every shape: one leaf, one run, and ends of runs and of stored rows on all levels."""
    rows, sizes = [], [1, 2, 8, 9, 64, 65, 511, 512, 513, 1100, 5]
    for tree, size in enumerate(sizes):
        name = None if tree == 4 else "" if tree == 5 else f"ä{tree}"
        rows += [(len(rows) + j, None, name, j, f"Tëxt {j}" if j % 7 else None) for j in range(size)]
    rows += [(None, "s", "ä1", None, "A"), (None, None, "ä1", None, ""), (3, "x", "ä1", 1, "A"), (3, "x", "ä1", 1, "A")]
    rows += [(10**6, "x", "long", 1, "Word " * 200_000)]
    df = spark.createDataFrame(rows, DOCS)
    for extra in ("tree", "h", "i", "m", "nodes", "at", "part", "a.b"):
        df = df.withColumn(extra, F.lit("x"))
    found = manifest_of(df)
    assert found == manifest_by_hand(rows)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("rows", [[], [(7, None, None, None, None)], [(7, "s", "en", 1, "A"), (7, "s", "en", 1, "A")]])
def test_small_manifests(spark, rows):
    assert manifest_of(spark.createDataFrame(rows, DOCS)) == manifest_by_hand(rows)


def test_only_every_third_level_is_stored(spark):
    df = spark.range(4097).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "'t' as text")
    manifest = build_manifest(df)
    assert [level.count() for level in manifest.documents.stored] == [9, 1]
    proof = manifest.proofs().where("doc_id = 4096").first()["proof"]
    assert [len(s["before"] + s["after"]) // 64 for s in proof] == [0, 0, 0, 0, 1]
    assert max(len(r["nodes"]) for r in manifest.documents.stored[0].collect()) == 512


# --- URL filters ------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme/x", "http://", "http://Ex.ORG", "http://ex.org/", "HTTP://a.example.org/es/1?x=/en/#f",
    "https://example.org/en/12", "https://example.org/en/21", "https://notexample.org/es/", "http://x.com/fr/a://b/c",
    "http://com/de/", "http://xcom/de/", "http://x.com?/de/", "http://x.com#/fr/", "ftp://x.com/de/é/ß-ü", "a://" + "w/" * 100_000,
    "http://Ünï.net/Ä\n/b?c\nd",
]


def parts_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    name = re.match(r"[^/?#]*", rest).group()
    return name.translate(FOLD), re.match(r"[^?#]*", rest[len(name) :]).group(), rest


def rule_by_hand(name, way):
    fits = [r for r in URL_RULES if (name == r.host or name.endswith("." + r.host)) and way.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def tokens_by_hand(url):
    name, way, rest = parts_by_hand(url)
    query = rest[len(name) + len(way) :].translate(FOLD)
    found = set()
    for mark, text in (("h:", name), ("p:", way.translate(FOLD)), ("q:", query)):
        for word in re.findall("[0-9a-z\x80-\U0010ffff]+", text):
            found.add(mark + ("#" if re.fullmatch("[0-9]+", word) else word))
    return sorted(found)


def test_parts_of_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r[0]: tuple(r)[1:] for r in df.select("url", host(F.col("url")), path(F.col("url")), tokens(F.col("url"))).collect()}
    assert got == {u: (*parts_by_hand(u)[:2], tokens_by_hand(u)) for u in URLS}


def test_stated_rules_and_awkward_pages(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[6], "x"), (3, URLS[3], "x"), (3, URLS[3], "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for extra in ("host", "path", "words", "stated", "example", "label", "verdict", "a.b"):
        df = df.withColumn(extra, F.lit("x"))
    got = sorted((tuple(r)[:4] for r in filter_urls(df, URL_RULES).collect()), key=str)
    expected = [(i, *parts_by_hand(u)[:2], rule_by_hand(*parts_by_hand(u)[:2])[0]) for i, u, _ in rows]
    assert got == sorted(expected, key=str)
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
    judged = filter_urls(df, []).collect()
    assert {r["verdict"] for r in judged} == {"allow"} and {r["rule"] for r in judged} == {None}


def rules_by_hand(examples, support, confidence, most):
    """{(tokens, verdict): (hits, seen)} before shorter rules of the same worth are preferred."""
    least = math.ceil(support * len(examples))
    where = {}
    for i, (words, _) in enumerate(examples):
        for w in words:
            where.setdefault(w, set()).add(i)
    known = {}
    for w in sorted(where):
        if least <= len(where[w]) < len(examples):
            known.setdefault(frozenset(where[w]), w)
    kept = set(known.values())
    seen, hits = {}, {}
    for words, verdict in examples:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(kept & set(words)), n):
                seen[c] = seen.get(c, 0) + 1
                hits[c, verdict] = hits.get((c, verdict), 0) + 1
    return {k: (h, seen[k[0]]) for k, h in hits.items() if h >= least and 100 * h >= confidence * seen[k[0]]}


def test_mined_rules_like_by_hand(spark):
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(9)]
    examples = []
    for _ in range(300):
        words = sorted({names[int(i)] for i in rng.integers(0, 9, 4)} | {"always"})
        if "w1" in words:
            words += ["w1-twin"]
        bad = {"w1", "w2"} <= set(words) or ("w5" in words and rng.random() < 0.95)
        examples.append((sorted(words), "block" if bad else "allow"))
    df = spark.createDataFrame(examples + [(["w1"], None)], "words array<string>, verdict string")
    mined = mine_rules(df, min_support=0.02, min_confidence=90)
    got = {(tuple(r["tokens"]), r["verdict"]): (r["hits"], r["seen"]) for r in mined.collect()}
    every = rules_by_hand(examples, 0.02, 90, 3)
    beaten = {
        (t, v)
        for (t, v), (h, s) in every.items()
        for w in t
        if (p := every.get((tuple(x for x in t if x != w), v))) and p[0] * s >= h * p[1]
    }
    assert got == {k: v for k, v in every.items() if k not in beaten}
    assert (("w1", "w2"), "block") in got and all(r["anchor"] in r["tokens"] for r in mined.collect())
    sets = spark.createDataFrame([(list(c),) for n in (1, 2, 3) for c in itertools.combinations(names, n)], "words array<string>")
    found = {tuple(r["words"]): r["verdict"] for r in best_rules(sets, mined).collect()}
    for (words,) in sets.collect():
        fits = [(-h / s, -h, len(t), " ".join(t), v) for (t, v), (h, s) in every.items() if set(t) <= set(words)]
        assert found.get(tuple(words)) == (min(fits)[4] if fits else None)


def test_labels_of_ones_own(spark):
    rows = [(i, f"http://h{i % 5}.net/{'pills' if i % 2 else 'news'}/{i}", "block" if i % 2 else "allow") for i in range(60)]
    rows += [(100, "http://other.net/pills/x", None), (101, "http://other.net/news/x", None), (102, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, known string")
    got = {r["page_id"]: (r["verdict"], r["learned"]) for r in filter_urls(df, [StatedRule.parse("block", "h1.net/")], label="known").collect()}
    assert got[100] == ("block", "p:pills") and got[101] == ("allow", "p:news") and got[102] == ("allow", None)
    assert got[1] == ("block", None)
