import random

import numpy as np
import pytest

from helpers import ascii_words, by_id, documents, texts, words

from tablewright.llm import substrings
from tablewright.llm.decontaminate import find_contamination
from tablewright.llm.substrings import Content, anchor_names, drop_repeated_passages, mix


def passages_by_hand(rows, window):
    first = {}
    split = [(d, words(t)) for d, t in rows]
    order = {None: -(2**63)}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 2**63), order.get(d, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order.get(d, d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def awkward(seed=0):
    pick = random.Random(seed)
    word = lambda: pick.choice(["a", "b", "ab", "ba", "c"])
    base = [word() for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base[10:60])), (3, "x " * 40), (4, "y " + "x " * 60 + "y"), (5, None), (6, "")]
    for d in range(7, 40):
        a, b = sorted(pick.sample(range(120), 2))
        rows.append((d, " ".join([word() for _ in range(pick.randint(0, 20))] + base[a:b] + [word()] * pick.randint(0, 30))))
    rows += [(40, " ".join(base)), (40, "other " + " ".join(base)), (41, "ab\tba\nc " * 30), (41, "ab\tba\nc " * 30)]
    rows += [(None, "z " + " ".join(base[:20])), (50, " ".join(["ab ba c"] * 30))]
    return rows


@pytest.mark.parametrize("stretch", [1 << 19, 40])
def test_passages_like_by_hand(spark, monkeypatch, stretch):
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    rows = awkward()
    got = drop_repeated_passages(documents(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == passages_by_hand(rows, 13)


def test_passages_of_an_empty_table_and_short_texts(spark):
    assert drop_repeated_passages(documents(spark, [])).count() == 0
    got = by_id(drop_repeated_passages(documents(spark, [(1, "a b c"), (2, "a b  c")])))
    assert got[2]["text"] == "a b c" and got[2]["n_removed"] == 0


def test_anchors_depend_on_the_window_only():
    pick = np.random.default_rng(1)
    window = 13
    inner = mix(pick.integers(0, 4, 200).astype(np.uint64))
    names = []
    for _ in range(5):
        text = np.concatenate([mix(pick.integers(0, 4, 30).astype(np.uint64)), inner, mix(pick.integers(0, 4, 30).astype(np.uint64))])
        names.append(anchor_names(text, window, Content(text, 0x9E3779B97F4A7C15))[30 : 30 + 200 - window + 1])
    assert all((n == names[0]).all() for n in names)


def leaks_by_hand(docs, items, window):
    wins = []
    for item, text in items:
        w = ascii_words(text)
        size = min(len(w), window)
        wins += [(str(item), tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    by_size = {}
    for item, key in wins:
        by_size.setdefault(len(key), {}).setdefault(key, set()).add(item)
    out = set()
    for d, text in docs:
        w = ascii_words(text)
        hit, found = set(), set()
        for size, keys in by_size.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in keys:
                    hit |= set(range(i, i + size))
                    found |= keys[tuple(w[i : i + size])]
        out.add((d, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return out


def test_leaks_like_by_hand(spark):
    pick = random.Random(3)
    vocabulary = ["a", "B", "c1", "Éa", "ΑΣ", "ας"]
    item = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 11, 30, 30])] + [(11, None), (12, ""), (13, "--")]
    items.append((14, items[9][1]))
    items[0] = (0, "unique")
    items[1] = (1, "two words")
    docs = [(d, "; ".join([item(pick.randint(0, 15)), pick.choice(items)[1] or "", item(3)])) for d in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, items[9][1].upper() + ".ΑΣ.Β"), (104, "x" + items[9][1]), (105, "unique"),
             (None, items[10][1]), (106, "two-words"), (106, "two words more"), (107, "ΑΣ.Β " + items[9][1])]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, w string")
    got = {
        (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"])
        for r in find_contamination(documents(spark, docs), bench).collect()
    }
    assert got == leaks_by_hand(docs, items, 10)


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = by_id(find_contamination(docs, bench))
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["contaminated"]) for i in (1, 2)] == [(2, 0, False), (0, 0, False)]
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert find_contamination(documents(spark, []), bench).count() == 0


def test_leaks_of_the_given_tables(spark, sf):
    docs, items = texts(spark, sf), texts(spark, sf, "benchmark", "item_id")
    found = find_contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    got = {(r[0], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in found.collect()}
    assert got == leaks_by_hand(docs.items(), items.items(), 10)
    assert any(r[5] for r in got)
