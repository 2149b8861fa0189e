"""URL filters: stated rules first, association rules for the rest.

A URL is a set of tokens: the words of its host, path and query. Pages whose verdict is known are examples; FP-growth
mines the token combinations that are frequent among them, with and without the verdict. What predicts a verdict
often enough (support) and reliably enough (confidence), and better than any part of it, becomes a rule. Rules stand
in an inverted index under their rarest token: the distinct token sets of the pages to judge look up only the rules
whose rarest token they have, and the best of those that fit decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column, written

ALLOW, BLOCK = "allow", "block"

#: Share of the examples that have a rule's tokens and its verdict, at least.
MIN_SUPPORT = 0.01
#: Of the examples with a rule's tokens, the percentage that has its verdict, at least.
MIN_CONFIDENCE = 90
#: Tokens of a rule.
MAX_TOKENS = 3

#: Equal examples that are written out as rows in one piece.
PIECE_ROWS = 1000

#: Marks the verdict among a transaction's tokens; no token begins with it.
_MARK = "="
_WORD = "[0-9a-z\\x80-\\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct words of a URL, sorted: ``h:`` before those of the host, ``p:`` of the path, ``q:`` of the rest.

    Words are maximal runs of ASCII letters and digits and other characters beyond ASCII, A-Z lower-cased; numbers
    count alike, as ``#``. A URL without ``://`` has none.
    """
    rest = F.translate(_rest(url), _UPPER, _LOWER)
    spots = [("h:", "^([^/?#]*)"), ("p:", "^[^/?#]*([^?#]*)"), ("q:", "^[^?#]*(.*)$")]

    def marked(mark: str, pattern: str) -> Column:
        words = F.regexp_extract_all(F.regexp_extract(rest, "(?s)" + pattern, 1), F.lit(_WORD), 0)
        return F.transform(words, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))

    return F.array_sort(F.array_distinct(F.concat(*[marked(*spot) for spot in spots])))


@dataclass(frozen=True)
class StatedRule:
    """``verdict`` for the URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> StatedRule:
        name, slash, rest = text.partition("/")
        return cls(verdict, name, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def stated(rules: Sequence[StatedRule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long ones the first by name."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict), reverse=True):
        mine = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), mine).otherwise(found)
    return found


def informative(examples: DataFrame) -> DataFrame:
    """(token, n): the tokens that tell examples apart, of those that never occur apart the first by name.

    Tokens of all examples say nothing; tokens that share all their examples make the same rules, and only blow
    up the number of combinations. ``examples`` has distinct token sets ``words`` and their numbers ``n``.
    """
    each = examples.select(F.explode("words").alias("token"), "n", F.xxhash64("words").alias("a"), F.hash("words", F.lit(7)).alias("b"))
    seen = each.groupBy("token").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")
    )
    total = examples.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return seen.where(F.col("n") < total).groupBy("n", "sets", "a", "b").agg(F.min("token").alias("token")).select("token", "n")


def mine_rules(
    df: DataFrame,
    words: str = "words",
    verdict: str = "verdict",
    min_support: float = MIN_SUPPORT,
    min_confidence: int = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """(tokens, verdict, hits, seen, anchor): association rules from token sets to verdicts.

    A rule has at most ``max_tokens`` tokens; ``hits`` of the ``seen`` examples with its tokens have its verdict:
    at least ``min_support`` of all examples, and ``min_confidence`` per cent of ``seen``. A rule goes if one with one token
    less and the same verdict has at least its confidence. ``anchor`` is its rarest token. Rows without a
    verdict are no examples; without examples there are no rules.
    """
    examples = df.where(column(verdict).isNotNull()).select(column(words).alias("words"), column(verdict).alias("verdict"))
    examples = written(examples.groupBy("words", "verdict").agg(F.count(F.lit(1)).alias("n")), "url-examples")
    total = examples.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    session, shape = df.sparkSession, "tokens array<string>, verdict string, hits bigint, seen bigint, anchor string"
    if not total:
        return session.createDataFrame([], shape)
    least = math.ceil(min_support * total)
    sets = examples.groupBy("words").agg(F.sum("n").alias("n"))
    # Frequent tokens only: at most 1 / min_support for each token that a URL has on average.
    kept = written(informative(sets).where(F.col("n") >= least), "url-tokens")
    each = examples.select("*", F.explode_outer("words").alias("token"))
    known = each.join(kept.select("token", F.lit(True).alias("known")), "token", "left")
    pruned = known.groupBy("words", "verdict").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("known"), F.col("token")))).alias("tokens")
    )
    # Token sets that have become equal are counted together, then stand in as many rows as there are examples: in
    # pieces first, which are dealt out, so that no task writes all rows of a frequent one.
    pruned = pruned.groupBy("tokens", "verdict").agg(F.sum("n").alias("n"))
    items = F.concat("tokens", F.array(F.concat(F.lit(_MARK), F.col("verdict")))).alias("items")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE_ROWS).cast("bigint"))
    dealt = pruned.select(items, "n", F.explode(cuts).alias("at")).repartition("items", "at")
    copies = F.array_repeat(F.lit(0), F.least(F.lit(PIECE_ROWS).cast("bigint"), F.col("n") - F.col("at")).cast("int"))
    bag = dealt.select("items", F.explode(copies)).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(bag)
    frequent = model.freqItemsets.where(F.size("items") <= max_tokens + 1)
    marked = lambda x: x.startswith(_MARK)
    frequent = frequent.select(
        F.array_sort(F.filter("items", lambda x: ~marked(x))).alias("tokens"),
        F.filter("items", marked).alias("marks"),
        "freq",
    )
    frequent = written(frequent.where(F.size("tokens") > 0), "url-itemsets")
    base = frequent.where(F.size("marks") == 0).select("tokens", F.col("freq").alias("seen"))
    hits = frequent.where(F.size("marks") == 1).select(
        "tokens", F.substring(F.col("marks")[0], 2, 1 << 30).alias("verdict"), F.col("freq").alias("hits")
    )
    rules = hits.join(base, "tokens").where(F.col("hits") * 100 >= F.col("seen") * min_confidence)
    rules = written(rules, "url-rules")
    shorter = rules.select(
        F.col("tokens").alias("whole"), "verdict", "hits", "seen", F.explode("tokens").alias("without")
    ).withColumn("tokens", F.array_remove("whole", F.col("without")))
    parts = rules.select("tokens", "verdict", F.col("hits").alias("h"), F.col("seen").alias("s"))
    beaten = shorter.join(parts, ["tokens", "verdict"]).where(F.col("h") * F.col("seen") >= F.col("hits") * F.col("s"))
    beaten = beaten.select(F.col("whole").alias("tokens"), "verdict").distinct()
    rules = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    rarity = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(kept, "token")
    anchors = rarity.groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    return written(rules.join(anchors, ["tokens", "verdict"]).select("tokens", "verdict", "hits", "seen", "anchor"), "url-index")


def best_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(words, verdict, learned) of the distinct token sets ``words`` that a mined rule fits.

    The rule with the highest confidence decides; then more hits, fewer tokens, the name.
    """
    index = rules.withColumnRenamed("verdict", "says")
    each = sets.select("words", F.explode("words").alias("anchor"))
    found = each.join(index, "anchor").where(F.size(F.array_except("tokens", "words")) == 0)
    name = F.array_join("tokens", " ")
    order = F.struct(-F.col("hits") / F.col("seen"), -F.col("hits"), F.size("tokens"), name, "says")
    best = found.groupBy("words").agg(F.min(F.struct(order.alias("order"), "says", name.alias("learned"))).alias("best"))
    return best.select("words", F.col("best.says").alias("verdict"), F.col("best.learned").alias("learned"))


def filter_urls(
    df: DataFrame,
    rules: Sequence[StatedRule],
    page_id: str = "page_id",
    url: str = "url",
    label: str | None = None,
    otherwise: str = ALLOW,
    **options,
) -> DataFrame:
    """page_id, host, path, rule, verdict and learned of every row.

    ``rule`` is the longest stated rule that fits and gives the verdict; else ``learned`` names the mined rule that
    does, and without one the verdict is ``otherwise``. Examples for the mining (its ``options``) are the rows with a
    verdict in column ``label``, or, without that, those that a stated rule judges.

    A null URL and one without ``://`` have an empty host and path, and no tokens. Repeated rows are examples each
    and are judged alike; null ids stay. An empty table gives an empty result. Other columns are not looked at.
    """
    value = column(url).cast("string")
    pages = df.select(
        column(page_id).alias("page_id"),
        host(value).alias("host"),
        path(value).alias("path"),
        tokens(value).alias("words"),
        (column(label).cast("string") if label else F.lit(None).cast("string")).alias("label"),
    )
    pages = pages.withColumn("stated", stated(rules, F.col("host"), F.col("path")))
    pages = written(pages.select("*", F.coalesce("label", F.lit(None) if label else "stated.verdict").alias("example")), "url-pages")
    mined = mine_rules(pages, "words", "example", **options)
    open_ = pages.where(F.col("stated").isNull())
    found = written(best_rules(open_.select("words").distinct(), mined), "url-verdicts")
    judged = pages.join(found.toDF("of", "says", "learned"), (F.col("words") == F.col("of")) & F.col("stated").isNull(), "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        "stated.rule",
        F.coalesce("stated.verdict", "says", F.lit(otherwise)).alias("verdict"),
        "learned",
    )
