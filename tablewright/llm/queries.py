"""One query per operator, over the whole table it is meant for, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.storage import scratch_path
from tablewright.llm.decontaminate import find_contamination
from tablewright.llm.exact import find_exact_copies
from tablewright.llm.language import fit_languages, predict_language
from tablewright.llm.licenses import scan_licenses
from tablewright.llm.lines import drop_repeated_lines
from tablewright.llm.neardup import near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.registry import query, table
from tablewright.llm.secrets import counted, find_secrets, listed, train_secret_models
from tablewright.llm.substrings import drop_repeated_passages
from tablewright.llm.tokens import ids_crc32, read_token_files, write_token_files


def joined(column):
    return F.array_join(column, ",")


#: A repeat of one or two lines counts from so many words on.
REPEATED_WORDS = 50

LINES_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM line
), full_line AS (
  SELECT doc_id, pos, bare, len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM bare WHERE bare != ''
), win AS (
  SELECT doc_id, r, 3 AS n, bare || chr(10) || lead(bare, 1) OVER d || chr(10) || lead(bare, 2) OVER d AS p
  FROM full_line WINDOW d AS (PARTITION BY doc_id ORDER BY r)
  UNION ALL SELECT doc_id, r, 1, bare FROM full_line WHERE words >= 50
  UNION ALL SELECT doc_id, r, 2, p FROM (
    SELECT doc_id, r, bare || chr(10) || lead(bare) OVER d AS p, words + lead(words) OVER d AS words
    FROM full_line WINDOW d AS (PARTITION BY doc_id ORDER BY r)) WHERE words >= 50
), later AS (
  SELECT doc_id, r, n FROM win WHERE p IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY n, p ORDER BY doc_id, r) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(r, r + n - 1)) AS r FROM later
), kept AS (
  SELECT b.doc_id, count(f.r) AS n_lines, count(g.r) AS n_removed,
         string_agg(CASE WHEN g.r IS NULL THEN line END, chr(10) ORDER BY b.pos) AS text
  FROM bare b LEFT JOIN full_line f USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.r = f.r
  GROUP BY b.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query("op1_repeated_lines", LINES_SQL)
def op1_repeated_lines(spark, sf_dir):
    found = drop_repeated_lines(table(spark, sf_dir, "documents"), words=REPEATED_WORDS)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


PASSAGES_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS p
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM doc)
), first AS (
  SELECT p, min(doc_id) AS f FROM win GROUP BY p
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM win JOIN first USING (p) WHERE f < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM doc
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text
  FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


@query("op3_repeated_passages", PASSAGES_SQL)
def op3_repeated_passages(spark, sf_dir):
    found = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_WORDS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS_SQL = f"""
WITH item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w
  FROM (SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0
), passage AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item)
), doc AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), place AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS p
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM doc, (SELECT DISTINCT size FROM passage))
), hit AS (
  SELECT DISTINCT doc_id, i, size, item FROM place JOIN passage USING (size, p)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_benchmark_leaks", LEAKS_SQL)
def op2_benchmark_leaks(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(joined("items"), 256).alias("items_sha256"), "contaminated"
    )


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_languages(docs, where=~held)
    return predict_language(docs, model).withColumn("held_out", held)


LICENSE_WORDS_SQL = _WORDS.format(text="coalesce(text, '')")


@query("op5_licenses")
def op5_licenses(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"),
        joined("labels").alias("labels"), "score",
    )


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary)
    return ids_crc32(read_token_files(spark, folder, manifest))


COPIES_SQL = """
WITH doc AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS p FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY p) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(p) AS text_sha256
FROM doc WINDOW best AS (PARTITION BY p ORDER BY size DESC, doc_id)
"""


@query("op7_exact_copies", COPIES_SQL)
def op7_exact_copies(spark, sf_dir):
    return find_exact_copies(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, train_secret_models(docs))
    return found.select(
        "doc_id",
        counted("base", "assign").alias("n_assign"),
        counted("base", "access").alias("n_access"),
        counted("base", "hex").alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@query("op10_near_duplicates")
def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
