"""The queries over vectors, the manifest of documents and the URLs of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.llm.merkle import build_manifest, folded, leaf_hash, lowered, proof_digest
from tablewright.llm.registry import query, table
from tablewright.llm.urls import ALLOW, BLOCK, MAX_TOKENS, MIN_CONFIDENCE, MIN_SUPPORT, StatedRule, filter_urls
from tablewright.llm.veccodes import ENTRIES, PARTS, ROUNDS, SCALE, compress_vectors

_ROUND = """
, apart{k} AS (
  SELECT d.p, d.v, any_value(n) AS n,
         min({{'d': list_inner_product(d.v, d.v) - 2 * list_inner_product(d.v, b.v) + list_inner_product(b.v, b.v), 'e': b.e}}) AS best
  FROM piece d JOIN book{k} b USING (p) GROUP BY d.p, d.v
), sums{k} AS (
  SELECT p, best.e AS e, i, floor(sum(n * x) / sum(n)) AS x
  FROM (SELECT p, best, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM apart{k}) GROUP BY ALL
), book{next} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.v, b.v) AS v
  FROM book{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM sums{k} GROUP BY p, e) s USING (p, e)
)"""

CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT r, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS v FROM kept, range({PARTS}) t(p)
), piece AS MATERIALIZED (
  SELECT p, v, count(*) AS n FROM part GROUP BY p, v
), book0 AS (
  SELECT p, r AS e, v FROM part WHERE r < {ENTRIES}
){"".join(_ROUND.format(k=k, next=k + 1) for k in range(ROUNDS + 1))}
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part.p) AS code, sum(best.d)::BIGINT AS error
  FROM part JOIN kept USING (r) JOIN apart{ROUNDS} a ON a.p = part.p AND a.v = part.v GROUP BY r, vec_id, label
), digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, digest
"""


@query("op11_vector_codes", CODES_SQL)
def op11_vector_codes(spark, sf_dir):
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: Levels that the SQL states: enough for 8^8 leaves.
_LEVELS = 8


def _tree_sql(name: str, leaves: str) -> str:
    """Levels ``name0`` ... of the trees over ``leaves`` (tree, i, m, h), and ``name_run``, all runs that are folded."""
    parts = [f", {name}0 AS MATERIALIZED ({leaves})"]
    for k in range(_LEVELS):
        parts.append(
            f""", {name}{k + 1} AS MATERIALIZED (
  SELECT tree, i // 8 AS i, (any_value(m) + 7) // 8 AS m, sha256(string_agg(h, '' ORDER BY i)) AS h
  FROM (SELECT tree, i, m, h FROM {name}{k}) AS below WHERE m > 1 GROUP BY tree, below.i // 8
  UNION ALL SELECT tree, i, m, h FROM {name}{k} WHERE m = 1
)"""
        )
    runs = " UNION ALL ".join(f"SELECT {k} AS k, tree, i, h FROM {name}{k} WHERE m > 1" for k in range(_LEVELS))
    return "\n".join(parts) + f"\n, {name}_run AS MATERIALIZED ({runs})\n"


def _fold_sql(name: str, start: str, key: str) -> str:
    """``name_fold``: per row of ``start`` (key, tree, i, f), the digest after folding it into the runs of its tree."""
    parts = [f", {name}_fold0 AS ({start})"]
    for k in range(_LEVELS):
        parts.append(
            f""", {name}_fold{k + 1} AS MATERIALIZED (
  SELECT {key}, f.tree, f.i // 8 AS i,
         coalesce(sha256(string_agg(CASE WHEN r.i = f.i THEN f ELSE r.h END, '' ORDER BY r.i)), any_value(f)) AS f
  FROM {name}_fold{k} f LEFT JOIN {name}_run r ON r.k = {k} AND r.tree = f.tree AND r.i // 8 = f.i // 8
  GROUP BY {key}, f.tree, f.i
)"""
        )
    return "\n".join(parts)


def _siblings_sql(name: str, start: str, key: str) -> str:
    return f"""SELECT {key}, string_agg(r.h, '' ORDER BY k, r.i) AS hs
  FROM (SELECT {key}, tree, k, i // (8::BIGINT ** k)::BIGINT AS i FROM {start}, range({_LEVELS}) t(k)) f
  JOIN {name}_run r USING (k, tree) WHERE r.i // 8 = f.i // 8 AND r.i != f.i GROUP BY {key}"""


_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, crcs[xor(a % 256, b) + 1])))"""

MANIFEST_SQL = f"""
WITH crc AS MATERIALIZED (
  SELECT {_CRC_TABLE} AS crcs
), doc AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(text="text")} AS h,
         {_LEAF.format(text=_LOWER)} AS low, coalesce({_CRC} % 3 = 0, false) AS tampered FROM documents, crc
), leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, id) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS m FROM doc
)
{_tree_sql("doc", "SELECT tree, i, m, h FROM leaf")}
, sub AS (SELECT tree AS lang_tree, h FROM doc{_LEVELS})
, sub_leaf AS MATERIALIZED (
  SELECT lang_tree, '' AS tree, row_number() OVER (ORDER BY lang_tree) - 1 AS i, count(*) OVER () AS m, h FROM sub
)
{_tree_sql("lang", "SELECT tree, i, m, h FROM sub_leaf")}
{_fold_sql("doc", "SELECT id, tree, i, CASE WHEN tampered THEN low ELSE h END AS f FROM leaf", "id")}
, half AS (
  SELECT d.id, '' AS tree, s.i, d.f FROM doc_fold{_LEVELS} d JOIN sub_leaf s ON s.lang_tree = d.tree
)
{_fold_sql("lang", "SELECT id, tree, i, f FROM half", "id")}
, near AS ({_siblings_sql("doc", "leaf", "id")})
, far AS ({_siblings_sql("lang", "sub_leaf", "lang_tree")})
SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, top.h AS root,
       sha256(coalesce(near.hs, '') || coalesce(far.hs, '')) AS proof_sha256, end_.f AS folded_root,
       end_.f = top.h AS verified
FROM leaf JOIN sub ON sub.lang_tree = leaf.tree JOIN lang{_LEVELS} top ON true JOIN lang_fold{_LEVELS} end_ ON end_.id = leaf.id
LEFT JOIN near ON near.id = leaf.id LEFT JOIN far ON far.lang_tree = leaf.tree
"""


@query("op12_manifest", MANIFEST_SQL)
def op12_manifest(spark, sf_dir):
    changed = leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [lowered(F.col("text"))])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = build_manifest(table(spark, sf_dir, "documents"), changed=F.when(third, changed))
    end = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    found = manifest.proofs().select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), end.alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# The rules that the query states.
URL_RULES = [
    StatedRule.parse(ALLOW, "org/"),
    StatedRule.parse(BLOCK, "example.org/es/"),
    StatedRule.parse(BLOCK, "example.org/en/1"),
    StatedRule.parse(ALLOW, "com/fr/"),
    StatedRule.parse(BLOCK, "com/de/"),
]

_FITS = "\n".join(
    f"    WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.text}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.text))
)
_WORDS = "list_transform(regexp_extract_all({0}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: '{1}:' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN '#' ELSE w END)"
_COMBINATIONS = " UNION ALL ".join(
    f"SELECT x0.id, [{', '.join(f'x{j}.token' for j in range(n))}] AS tokens FROM "
    + " JOIN ".join(f"item x{j}" + (f" ON x{j}.id = x0.id AND x{j}.token > x{j - 1}.token" if j else "") for j in range(n))
    for n in range(1, MAX_TOKENS + 1)
)

URLS_SQL = f"""
WITH cut AS (
  SELECT *, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), page AS (
  SELECT row_number() OVER () AS id, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM cut
), judged AS MATERIALIZED (
  SELECT *, list_distinct(list_concat(
    {_WORDS.format("regexp_extract(low, '^([^/?#]*)', 1)", "h")},
    {_WORDS.format("regexp_extract(low, '^[^/?#]*([^?#]*)', 1)", "p")},
    {_WORDS.format("regexp_extract(low, '(?s)^[^?#]*(.*)$', 1)", "q")})) AS words, CASE
{_FITS} END AS stated FROM page
), example AS MATERIALIZED (
  SELECT id, words, split_part(stated, ' ', 1) AS verdict FROM judged WHERE stated IS NOT NULL
), least AS (
  SELECT count(*) AS total, ceil({MIN_SUPPORT}::DOUBLE * count(*)) AS n FROM example
), kept AS (
  SELECT token, once.n FROM (
    SELECT token, n, row_number() OVER (PARTITION BY ids ORDER BY token) AS r
    FROM (SELECT token, count(*) AS n, list(id ORDER BY id) AS ids FROM (SELECT id, unnest(words) AS token FROM example) GROUP BY token)
  ) AS once, least WHERE r = 1 AND once.n >= least.n AND once.n < total
), item AS MATERIALIZED (
  SELECT id, token FROM (SELECT id, unnest(words) AS token FROM example) SEMI JOIN kept USING (token)
), seen AS (
  SELECT tokens, count(*) AS seen, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block
  FROM ({_COMBINATIONS}) JOIN example USING (id) GROUP BY tokens
), rule AS MATERIALIZED (
  SELECT tokens, says, hits, seen
  FROM (SELECT tokens, seen, unnest(['allow', 'block']) AS says, unnest([allow, block]) AS hits FROM seen), least
  WHERE hits >= n AND hits * 100 >= seen * {MIN_CONFIDENCE}
), fits AS (
  SELECT j.id, first({{'says': says, 'learned': array_to_string(tokens, ' ')}}
    ORDER BY hits / seen DESC, hits DESC, len(tokens), array_to_string(tokens, ' '), says) AS best
  FROM judged j JOIN rule ON list_has_all(j.words, rule.tokens) WHERE stated IS NULL GROUP BY j.id
)
SELECT page_id, host, path, nullif(split_part(stated, ' ', 2), '') AS rule,
       coalesce(split_part(stated, ' ', 1), best.says, '{ALLOW}') AS verdict, best.learned AS learned
FROM judged LEFT JOIN fits USING (id)
"""


@query("op13_url_filter", URLS_SQL)
def op13_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
