import random

import numpy as np
import pytest

from helpers import FOLD, by_id, documents, texts, words

import corpus_pipeline
from tablewright.llm import QUERIES, neardup
from tablewright.llm.neardup import SLOTS, band_rows, near_duplicates, signatures
from tablewright.llm.substrings import mix


def near_by_hand(rows, width, percent):
    nothing = -(2**63)
    sets = []
    for d, t in rows:
        w = words((t or "").translate(FOLD))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.append((nothing if d is None else d, s))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            common = len(s & r)
            if common and 100 * common >= percent * len(s | r):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    out = []
    for (d, s), (given, _) in zip(sets, rows):
        c = find(d)
        out.append((given, len(s), None if c == nothing else c, d == c))
    return sorted(out, key=str)


def family(seed, size, edits):
    """Copies of one text, each with some words changed."""
    pick = random.Random(seed)
    base = [f"w{pick.randint(0, 999)}" for _ in range(90)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(pick.randint(0, edits)):
            own[pick.randrange(90)] = f"x{pick.randint(0, 9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_like_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    pool = family(1, 40, 3) + family(2, 25, 6) + family(3, 12, 1) + family(4, 20, 12)
    random.Random(0).shuffle(pool)
    rows = list(enumerate(pool, 10)) + [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c"), (6, "a b c d"), (7, " \n"), (None, pool[0])]
    rows += [(8, "same words here again"), (8, "same words here again"), (9, "SAME words here again")]
    got = near_duplicates(documents(spark, rows), width=3, percent=85)
    assert sorted((tuple(r) for r in got.collect()), key=str) == near_by_hand(rows, 3, 85)


def test_rows_that_share_an_id_are_one_vertex(spark):
    one, two = family(5, 1, 0)[0], family(6, 1, 0)[0]
    rows = [(5, one), (7, one), (7, two), (9, two), (11, "other words only in here")]
    got = near_duplicates(documents(spark, rows), width=3, percent=85)
    assert sorted((tuple(r) for r in got.collect()), key=str) == near_by_hand(rows, 3, 85)


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(0)
    error = []
    for size in (3, 10, 50, 400, 3000):
        for share in (0.2, 0.5, 0.85):
            common = int(size * share)
            pool = mix(pick.integers(0, 2**63, 2 * size - common).astype(np.uint64))
            a, b = np.sort(pool[:size]), np.sort(pool[size - common :])
            x, y = signatures([a, b])
            assert (x != 0xFFFFFFFFFFFFFFFF).all()
            error.append((x == y).mean() - common / (2 * size - common))
    assert np.abs(error).max() < 0.2 and abs(np.mean(error)) < 0.04


def test_bands_find_a_pair_at_the_threshold():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        rows = band_rows(threshold)
        assert (1 - threshold**rows) ** (SLOTS // rows) <= neardup.MISS
    assert band_rows(0.8) == 4 and band_rows(0.85) == 5


def test_near_query_like_by_hand(spark, sf):
    got = QUERIES["op10_near_duplicates"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == near_by_hand(sorted(texts(spark, sf).items()), 3, 85)


@pytest.fixture(scope="module")
def stages(spark, sf):
    from tablewright.llm.common import written

    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def test_stages_return_documents(stages):
    for one in stages[1:-1]:
        assert one.dtypes == stages[0].dtypes


def test_language_stage_keeps_clean_documents(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert all(any(c.isalpha() for c in r["text"]) for r in after.values())
    lost = [r for d, r in before.items() if d not in after]
    assert len(lost) <= 0.01 * len(before) or all(not any(c.isalpha() for c in r["text"]) for r in lost)


def test_line_stage_like_by_hand(stages):
    from test_exact_and_lines import long_lines_by_hand

    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    expected = {d: text for d, text in long_lines_by_hand(rows, 50).items() if text}
    after = by_id(stages[2])
    assert {d: r["text"] for d, r in after.items()} == expected
    changed = [d for d, t in rows if d in expected and expected[d] != t]
    assert all(after[d]["n_chars"] == len(after[d]["text"]) for d in changed)


def test_near_stage_like_by_hand(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    expected = {r[0] for r in near_by_hand(rows, 5, 80) if r[3]}
    assert set(by_id(stages[3])) == expected


def test_decontamination_stage_like_by_hand(spark, sf, stages):
    from test_passages import leaks_by_hand

    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    items = texts(spark, sf, "benchmark", "item_id")
    expected = {r[0] for r in leaks_by_hand(rows, items.items(), 10) if not r[5]}
    assert set(by_id(stages[4])) == expected and len(expected) < len(rows)


def test_last_stage_like_by_hand(stages):
    from test_tokens_and_packing import pack_by_hand

    rows = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    assert sorted((tuple(r) for r in stages[5].collect()), key=str) == pack_by_hand(rows, 2048, 16, 65_536)


def test_run_is_all_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "the cat sat on a mat"), (3, "the cat sat on a mat"), (3, "the cat sat on a mat")]])
def test_stages_with_awkward_rows(spark, sf, rows):
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.dtypes == docs.dtypes
        docs = spark.createDataFrame(after.collect(), docs.schema)
    left = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(left) == (1 if rows else 0)
