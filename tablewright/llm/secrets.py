"""Secret scan: rules for well-known forms, and character Markov models for the rest.

Two first-order Markov models over the characters of a token, one of random strings and one of ordinary
identifiers, give every long token a log-likelihood ratio; tokens that are much more likely random are spans.
The models are trained on labelled samples of the table itself: what the rules find is labelled random, other
tokens of texts are labelled ordinary.

Everything is DataFrame functions. Positions are code points; the end is exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column

# The rules. (kind, pattern, group that is the secret, its least length, length of the whole)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: before the first character
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"

#: Bounds of the labelled samples: values found by the rules, and texts whose other tokens are ordinary.
SAMPLE_SECRETS, SAMPLE_TEXTS = 5_000, 2_000
#: A token is a secret if random is e**MIN_RATIO times as likely, and by so much per character.
MIN_RATIO, MIN_RATIO_PER_CHAR = 16.0, 0.8

#: Numbers whose running sums are appended to one array.
BLOCK = 256

_PLACES = "array<struct<a:int,b:int,v:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, join: Callable[[Column, Column], Column], least: int) -> Column:
    """For each of an array's numbers, the ``join`` (a sum, a maximum) of all before it; ``least`` where there are none.

    What is found is appended to arrays of BLOCK numbers, and the blocks' own totals to another, so that no long
    array is copied for every number.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(least).cast("bigint")

    def appended(numbers: Column) -> Column:
        start = F.struct(zero.alias("upto"), none.alias("out"))
        return F.aggregate(
            numbers,
            start,
            lambda s, n: F.struct(join(s["upto"], n).alias("upto"), F.concat(s["out"], F.array(s["upto"])).alias("out")),
        )

    def blocks(numbers: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda at: appended(F.slice(numbers, at, BLOCK)))

    def joined(parts: Column) -> Column:
        before = appended(F.transform(parts, lambda p: p["upto"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda v: join(v, b))))

    return _let(values, lambda numbers: _let(blocks(numbers), joined))


def _places(text: Column, pattern: str, group: int, found: Column) -> Column:
    """Start, end and group of every match; nothing is computed for texts without one (``found`` false)."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def located(steps: Column) -> Column:
        sizes = F.transform(steps, lambda s: (s["gap"] + s["n"]).cast("bigint"))
        return F.zip_with(
            steps,
            _running(sizes, lambda x, y: x + y, 0),
            lambda s, at: F.struct(
                (at + s["gap"]).cast("int").alias("a"), (at + s["gap"] + s["n"]).cast("int").alias("b"), s["v"].alias("v")
            ),
        )

    # The last gap has no match behind it.
    gaps = F.slice(between, 1, F.size(whole))
    steps = F.zip_with(
        F.zip_with(whole, value, lambda n, v: F.struct(n.alias("n"), v.alias("v"))),
        gaps,
        lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["v"].alias("v")),
    )
    return F.when(found, _let(steps, located)).otherwise(F.array().cast(_PLACES))


def _rules(text: Column) -> dict[str, Column]:
    assign = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN)
    return {
        "assign": F.filter(_places(text, ASSIGN, 2, assign), lambda p: F.length(p["v"]) >= 6),
        "access": F.filter(_places(text, ACCESS, 0, text.contains("AKIA")), lambda p: p["b"] - p["a"] >= 20),
        # Runs that are too short are passed over by the pattern itself: runs never touch.
        "hex": _places(text, HEX.replace("+", "{24,}"), 0, text.rlike("[0-9a-f]{24}")),
    }


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratios of all transitions, row by row."""

    ratios: list[float]

    def ratio(self, token: Column) -> Column:
        # An unquoted list of numbers, which becomes one array.
        table = F.split(F.lit(",".join(repr(r) for r in self.ratios)), ",").cast("array<double>")

        # The characters are cut apart once, so a long token costs no more a character than a short one.
        states = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))

        def total(after: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(after, 1, F.size(after) - 1))
            places = F.zip_with(before, after, lambda x, y: x * STATES + y + 1)
            return _let(
                table, lambda known: F.aggregate(places, F.lit(0.0), lambda s, at: s + F.element_at(known, at))
            )

        return _let(states, total)


def _counts(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Transitions of column v: (state before, state after) -> number; at most STATES * STATES rows."""
    characters = tokens.select(F.split("v", "").alias("c"))
    pairs = F.zip_with(
        F.concat(F.array(F.lit("")), F.slice("c", 1, F.size("c") - 1)),
        F.col("c"),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    shifted = characters.select(F.explode(pairs).alias("s"))
    rows = shifted.groupBy("s.x", "s.y").count().collect()
    place = {c: i for i, c in enumerate(ALPHABET, 1)} | {"": 0}
    return {(place[x], place[y]): n for x, y, n in rows if x in place and y in place}


def train_secret_models(df: DataFrame, text: str = "text") -> MarkovModels:
    """Models from labelled samples of the table.

    Random: up to SAMPLE_SECRETS distinct values that the rules find, least hashes first. Ordinary: the other
    tokens of up to SAMPLE_TEXTS distinct texts, least hashes first. Both are smoothed (half a count per
    transition for random, a tenth for ordinary), so a table without either still gives models.
    """
    texts = df.select(column(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    t = F.col("t")
    found = texts.select(*[places.alias(kind) for kind, places in _rules(t).items()])
    values = found.select(F.explode(F.concat("assign", "access", "hex")).alias("p")).select(F.col("p.v").alias("v"))
    values = values.where(F.length("v") >= 8).distinct()
    secret = values.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_SECRETS)

    order = F.xxhash64(t)
    least = texts.select(order.alias("h")).distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    ordinary = texts.where(order <= F.lit(least if least is not None else 0)).groupBy(order.alias("h")).agg(
        F.min("t").alias("t")
    )
    bare = t
    for pattern in (ASSIGN, ACCESS, HEX.replace("+", "{16,}")):
        bare = F.regexp_replace(bare, pattern, " ")
    words = ordinary.select(F.explode(F.regexp_extract_all(bare, F.lit(ORDINARY), F.lit(0))).alias("v"))

    random, plain = _counts(secret), _counts(words)
    ratios = []
    for before in range(STATES):
        total_random = sum(random.get((before, after), 0) for after in range(STATES))
        total_plain = sum(plain.get((before, after), 0) for after in range(STATES))
        for after in range(STATES):
            p = (random.get((before, after), 0) + 0.5) / (total_random + 0.5 * STATES)
            q = (plain.get((before, after), 0) + 0.1) / (total_plain + 0.1 * STATES)
            ratios.append(round(math.log(p / q), 6))
    return MarkovModels(ratios)


def find_secrets(
    df: DataFrame, models: MarkovModels, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of every row; base: spans of the rules; spans: those and the models'.

    Both are arrays of (start, rank of the kind, end, kind), in that order. A span of the models does not
    overlap one of the rules.

    A null or empty text has no spans. Repeated rows are scanned each; nulls in ``keep`` stay; an empty table
    gives an empty result. Other columns are not looked at.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(
        *[column(k).alias(n) for k, n in zip(keep, names)],
        F.coalesce(column(text).cast("string"), F.lit("")).alias("t"),
    )
    t = F.col("t")
    rows = rows.select(
        *names,
        *[places.alias(kind) for kind, places in _rules(t).items()],
        _places(t, TOKEN, 0, t.rlike(TOKEN)).alias("tokens"),
    )

    def spans(kind: str, places: str) -> Column:
        return F.transform(
            places,
            lambda p: F.struct(
                p["a"].alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                p["b"].alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    def random(p: Column) -> Column:
        ratio = models.ratio(p["v"])
        return ratio >= F.greatest(F.lit(MIN_RATIO), MIN_RATIO_PER_CHAR * F.length(p["v"]))

    rows = rows.select(
        *names,
        F.array_sort(F.concat(spans("assign", "assign"), spans("access", "access"), spans("hex", "hex"))).alias("base"),
        F.filter("tokens", random).alias("tokens"),
    )
    found = F.array_sort(F.concat("base", spans("markov", "tokens")))
    return rows.select(
        *names, "base", F.when(F.size("tokens") > 0, _let(found, _clear)).otherwise(F.col("base")).alias("spans")
    ).toDF(*keep, "base", "spans")


def _clear(spans: Column) -> Column:
    """Sorted spans without those of the models that overlap one of the rules."""
    rank, far = KINDS.index("markov"), 1 << 40

    def own(value: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda s: F.when(s["rank"] < rank, value(s).cast("bigint")).otherwise(F.lit(-far))

    # Up to where the rules' spans before one reach, and where the next one begins (as a negative number).
    reach = _running(F.transform(spans, own(lambda s: s["end"])), F.greatest, -far)
    following = F.reverse(_running(F.transform(F.reverse(spans), own(lambda s: -s["start"])), F.greatest, -far))
    around = F.zip_with(reach, following, lambda r, n: F.struct(r.alias("reach"), (-n).alias("next")))
    both = F.zip_with(spans, around, lambda s, a: F.struct(s.alias("span"), a.alias("near")))
    free = F.filter(
        both,
        lambda e: (e["span"]["rank"] < rank)
        | ((e["near"]["reach"] <= e["span"]["start"]) & (e["near"]["next"] >= e["span"]["end"])),
    )
    return F.transform(free, lambda e: e["span"])


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
