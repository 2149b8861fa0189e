import hashlib
import re

import pytest

from helpers import by_id, documents, texts

from tablewright.llm import QUERIES, exact
from tablewright.llm.exact import find_exact_copies
from tablewright.llm.lines import RUN, drop_repeated_lines


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_copies_of_awkward_rows(spark):
    long = "wörd " * 3000
    df = documents(
        spark,
        [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long + "\t"), (9, long + "x"),
         (None, "a  b"), (10, "dup"), (10, "dup"), (11, "du p")],
    )
    got = sorted(
        (tuple(r)[:4] for r in find_exact_copies(df).collect()), key=lambda r: (r[0] is None, r[0] or 0)
    )
    assert got == [
        (1, None, 4, False), (2, None, 4, False), (3, None, 4, False), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True),
        (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True), (10, 11, 3, False), (10, 11, 3, False), (11, 11, 3, True),
        (None, None, 4, True),
    ]


def test_copies_of_an_empty_table(spark):
    assert find_exact_copies(documents(spark, [])).count() == 0


def test_names_tell_texts_apart_that_differ_inside_only(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", 8)
    monkeypatch.setattr(exact, "OUTER", 2)
    base = "ab" + "0123456789" * 5 + "yz"
    other = base[:30] + "#" + base[31:]
    got = by_id(find_exact_copies(documents(spark, [(1, base), (2, other), (3, base), (4, other), (5, base[:40])])))
    assert [got[i]["keep_id"] for i in range(1, 6)] == [1, 2, 1, 2, 5]


def lines_by_hand(rows):
    """Removed and kept lines, windows compared as they are."""
    sequences = {}
    for d, text in rows:
        lines = (text or "").split("\n")
        sequences[d] = [(i, s) for i, line in enumerate(lines) if (s := line.strip(" \t\n\x0b\x0c\r"))]
    seen, gone = set(), {d: set() for d, _ in rows}
    for d in sorted(sequences):
        seq = sequences[d]
        for i in range(len(seq) - RUN + 1):
            key = tuple(s for _, s in seq[i : i + RUN])
            if key in seen:
                gone[d] |= {at for at, _ in seq[i : i + RUN]}
            seen.add(key)
    out = {}
    for d, text in rows:
        lines = (text or "").split("\n")
        everything = gone[d] and len(gone[d]) == len(sequences[d])
        kept = "" if everything else "\n".join(s for i, s in enumerate(lines) if i not in gone[d])
        out[d] = (len(sequences[d]), len(gone[d]), kept)
    return out


def test_lines_like_by_hand(spark, sf):
    rows = sorted(texts(spark, sf).items())
    run = "one\n two \n\nthree\nfour"
    rows += [(10**6, run), (10**6 + 1, "start\none\ntwo\nthree\nfour\nend"), (10**6 + 2, "x\n" * 50), (10**6 + 3, run)]
    got = by_id(drop_repeated_lines(documents(spark, rows)))
    expected = lines_by_hand(rows)
    assert {d: (r["n_lines"], r["n_removed"], r["text"]) for d, r in got.items()} == expected
    assert expected[10**6 + 3][2] == "" and expected[10**6 + 1][2] == "start\nend"


def test_lines_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "a\nb\nc"), (4, "a\nb\nc"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\nd")]
    df = documents(spark, rows)
    found = drop_repeated_lines(df)
    assert found.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()), key=str)
    assert got == sorted(
        [(1, None, 0, 0), (2, "", 0, 0), (3, "\n \n", 0, 0), (None, "a\nb\nc", 3, 0), (4, "", 3, 3), (5, "d", 4, 3), (5, "d", 4, 3)],
        key=str,
    )
    assert drop_repeated_lines(documents(spark, [])).count() == 0


def long_lines_by_hand(rows, words):
    """Kept text of every document if repeats of RUN lines, or of fewer with ``words`` words, go."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        seq = [(i, s) for i, line in enumerate(lines) if (s := line.strip(" \t\n\x0b\x0c\r"))]
        gone = set()
        for n in range(1, RUN + 1):
            for i in range(len(seq) - n + 1):
                key = tuple(s for _, s in seq[i : i + n])
                if n == RUN or sum(len(re.findall(r"[^\x20\x09-\x0D]+", s)) for s in key) >= words:
                    gone |= {at for at, _ in seq[i : i + n]} if key in seen else set()
                    seen.add(key)
        everything = gone and len(gone) == len(seq)
        out[d] = "" if everything else "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def test_long_repeats_of_fewer_lines(spark, sf):
    long, half = "wörd " * 50, "half " * 25
    added = [long, f"a\n{long}\nb", "Les.\nb", f"{half}\n\n {half}x\nc", f"d\n{half}\n{half}x", f"{half}\ne", "Les."]
    rows = sorted(texts(spark, sf).items()) + [(10**6 + i, text) for i, text in enumerate(added)]
    got = by_id(drop_repeated_lines(documents(spark, rows), words=50))
    assert {d: r["text"] for d, r in got.items()} == long_lines_by_hand(rows, 50)
    assert [got[10**6 + i]["text"] for i in range(7)] == [long, "a\nb", "Les.\nb", added[3], "d", added[5], "Les."]
    assert got[10**6 + 1]["n_removed"] == 1 and got[10**6 + 4]["n_removed"] == 2


@pytest.mark.parametrize("name", ["op1_repeated_lines", "op7_exact_copies"])
def test_queries_keep_every_document(spark, sf, name):
    ids = sorted(texts(spark, sf))
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").collect()) == ids


def test_digest_of_copies(spark, sf):
    given = texts(spark, sf)
    for d, row in by_id(QUERIES["op7_exact_copies"](spark, sf)).items():
        assert row["text_sha256"] == hashlib.sha256(squeezed(given[d]).encode()).hexdigest()
