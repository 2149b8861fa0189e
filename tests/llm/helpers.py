"""Awkward rows and plain re-statements that several tests use."""

import re

FOLD = {i: i + 32 for i in range(65, 91)}
ASCII_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names operators could be tempted to use themselves.
EXTRA = ["t", "h", "o", "d", "n", "k0", "c0", "words", "a.b", "count", "name", "n_lines", "score", "lang_pred"]


def documents(spark, rows, extra=True):
    """Documents of (doc_id, text) with the usual columns and, if wanted, clashing further ones."""
    names = EXTRA if extra else []
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(
        f", `{n}` string" for n in names
    )
    full = [(d, t, "en", None, len(t) if t else None, *["x"] * len(names)) for d, t in rows]
    return spark.createDataFrame(full, columns)


def ascii_words(text):
    return ASCII_WORDS.findall((text or "").translate(FOLD))


def words(text):
    return WORDS.findall(text or "")


def texts(spark, sf, table="documents", key="doc_id"):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key, "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
