"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For every bit, a binary n-gram classifier (naive Bayes over hashed
byte trigrams) tells the languages with +1 from those with -1. A text's predicted bits are compared with all
codewords: each bit's logistic loss is weighted by how well that bit separates in training, and the language
with the least weighted loss wins. If the second is nearly as close, the text is ambiguous.

Training counts trigrams over all labelled texts (a sum of counts per language, nothing is sampled). What
reaches the driver is one count per language and bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import column, from_text, pieces

#: Buckets of the hashed trigrams.
BUCKETS = 1 << 15
#: Up to so many languages all possible bits are used; beyond, random codewords.
EXHAUSTIVE_LANGUAGES = 6
#: Sharpness of the bits' logistic loss per trigram, and of the final score.
BIT_SCALE, SCORE_SCALE = 2.0, 2.0
#: Below this difference of the best two scores a text is ambiguous.
AMBIGUOUS = 0.05

_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def trigrams(data: bytes) -> np.ndarray:
    """Buckets of all byte trigrams."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def padded(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language; the rows differ in many places, no bit is constant."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE_LANGUAGES:
        rows = [c for c in itertools.product([1, -1], repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(rows, float).T
    bits = 10 * int(np.ceil(np.log2(languages)))
    best, best_distance = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([1.0, -1.0], (languages, bits))
        agree = code @ code.T - 2 * bits * np.eye(languages)
        distance = bits - agree.max()
        if distance > best_distance and (np.abs(code.sum(0)) < languages).all():
            best, best_distance = code, distance
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    bit_weights: np.ndarray  # bits
    weights: np.ndarray  # bits x buckets

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Texts x languages, each row adding up to 1: softmin of the weighted losses."""
        datas = [padded(t) for t in texts]
        sizes = np.array([len(d) - 2 for d in datas])
        grams = np.concatenate([trigrams(d) for d in datas])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        margins = np.stack([np.add.reduceat(w[grams], starts, dtype=np.float64) for w in self.weights], 1)
        margins = BIT_SCALE * margins / sizes[:, None]
        # Loss of bit b for language c: log(1 + exp(-code * margin)).
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.bit_weights
        close = np.exp(-SCORE_SCALE * (loss - loss.min(1, keepdims=True)))
        return close / close.sum(1, keepdims=True)


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> LanguageModel:
    """Learns from every row with a text and a language (and ``where``, if given).

    Rows without either are left out; an empty training set gives a model of no languages, which answers
    ``und`` to everything.
    """
    rows = df if where is None else df.where(where)
    chosen = rows.select(column(lang).cast("string").alias("l"), column(text).cast("string").alias("t")).where(
        F.col("l").isNotNull() & F.col("t").isNotNull()
    )

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "t"):
                grouped: dict[str, list[bytes]] = {}
                for name, value in zip(piece.column("l").to_pylist(), piece.column("t").to_pylist()):
                    grouped.setdefault(name, []).append(padded(value))
                for name, parts in grouped.items():
                    found = np.bincount(trigrams(b"".join(parts)), minlength=BUCKETS)
                    totals[name] = totals.get(name, 0) + found
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["l", "g", "n"]
            )

    counts = chosen.mapInArrow(run, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    # Bounded by languages x BUCKETS, whatever the size of the table.
    found = counts.toPandas()
    languages = sorted(found["l"].unique().tolist())
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.ones(1), np.zeros((1, BUCKETS), np.float32))
    table = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    table[found["l"].map(place).to_numpy(), found["g"].to_numpy()] = found["n"].to_numpy()
    share = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    plus, minus = (codes > 0).T @ share, (codes < 0).T @ share
    plus /= np.maximum(1, (codes > 0).sum(0))[:, None]
    minus /= np.maximum(1, (codes < 0).sum(0))[:, None]
    if len(languages) == 1:
        minus = plus
    weights = np.log(plus / minus)
    # A bit counts as much as its two sides differ (symmetric divergence per trigram).
    apart = ((plus - minus) * weights).sum(1)
    total = apart.sum()
    bit_weights = apart / total if total > 0 else np.full(len(apart), 1 / len(apart))
    return LanguageModel(languages, codes, bit_weights, weights.astype(np.float32))


def predict_language(
    df: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred, score (0 to 1) and ambiguous.

    Whole texts are used. A null text, one without any letter, or a model without languages gives ``und``,
    score 0, not ambiguous. Equal scores go to the first language in order of name. Repeated rows are predicted
    alike; an empty table gives an empty result. Other columns are not looked at; those in ``keep`` do not pass
    through Python.
    """
    added = T._parse_datatype_string("lang_pred string, score double, ambiguous boolean")

    def work(texts):
        names, scores, doubts = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
        if known:
            found = model.scores([texts[i] for i in known])
            best = found.argmax(1)
            ordered = np.sort(found, 1)
            gap = ordered[:, -1] - (ordered[:, -2] if ordered.shape[1] > 1 else 0)
            for i, b, row, g in zip(known, best.tolist(), found, gap.tolist()):
                names[i], scores[i], doubts[i] = model.languages[b], float(row[b]), g < AMBIGUOUS
        return names, scores, doubts

    kept = [column(k).alias(f"k{i}") for i, k in enumerate(keep)]
    found = df.select(*kept, from_text(column(text), added, work).alias("v"))
    return found.select(*[f"k{i}" for i in range(len(kept))], "v.*").toDF(*keep, *added.names)
