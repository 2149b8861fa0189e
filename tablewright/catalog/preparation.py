"""Cleaning, configuration, scaling, encoding and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.profiling import LABELLED_SQL, labelled_documents
from tablewright.catalog.registry import query, rounded, table
from tablewright.operators.levels import encode, fit_slots
from tablewright.operators.clean import clean, row_accounting, target_issues
from tablewright.operators.prepare import scaled, wide_features
from tablewright.operators.splits import folds, holdout, holdout_by_threshold
from tablewright.plans.preview import final_features, prep_preview
from tablewright.types import TaskConfig

QUALITY = TaskConfig("classification", "quality", ["lang", "source", "n_chars"])
QUALITY_KEPT = TaskConfig("classification", "quality", ["lang", "source", "n_chars"], False)
FLAGS = TaskConfig("regression", "l_quantity", ["l_discount", "l_returnflag"])
COMPLETE = f"""(select lang, source, n_chars, quality from {LABELLED_SQL}
  where lang is not null and source is not null and n_chars is not null and quality is not null)"""
DISTINCT = f"(select distinct * from {COMPLETE})"


@query("clean_rows", f"select * from {COMPLETE}")
def _(spark, folder):
    return clean(labelled_documents(spark, folder), QUALITY_KEPT)


@query("clean_rows_dedup", "select distinct l_discount, l_returnflag, l_quantity from lineitem")
def _(spark, folder):
    return clean(table(spark, folder, "lineitem"), FLAGS)


def accounting_sql(whole: str, complete: str, distinct: str) -> str:
    return f"""select (select count(*) from {whole})::bigint as original_rows,
    ((select count(*) from {whole}) - (select count(*) from {complete}))::bigint as removed_missing_rows,
    ((select count(*) from {complete}) - (select count(*) from {distinct}))::bigint as removed_duplicate_rows,
    (select count(*) from {distinct})::bigint as final_rows"""


@query("row_accounting", accounting_sql(LABELLED_SQL, COMPLETE, DISTINCT))
def _(spark, folder):
    return row_accounting(labelled_documents(spark, folder), QUALITY)


@query(
    "row_accounting_duplicates",
    accounting_sql(
        "lineitem", "lineitem", "(select distinct l_quantity, l_discount, l_returnflag from lineitem)"
    ),
)
def _(spark, folder):
    return row_accounting(table(spark, folder, "lineitem"), FLAGS)


FEATURES_SQL = f"""select 0 as position, null as level, 'n_chars' as name
  union all select distinct 1, lang, 'lang_' || lang from {COMPLETE}
  union all select distinct 2, source, 'source_' || source from {COMPLETE}"""


@query("final_features", FEATURES_SQL)
def _(spark, folder):
    return final_features(labelled_documents(spark, folder), QUALITY)


@query(
    "prep_preview",
    f"""with a as ({accounting_sql(LABELLED_SQL, COMPLETE, DISTINCT)}),
    c as (select count(*) as classes, count(*) filter (n < 6) as small from
      (select quality, count(*) as n from {DISTINCT} group by 1)),
    f as (select string_agg(name, ',' order by position, level) as names, count(*) as k from ({FEATURES_SQL}))
    select 'classification' as task, 'quality' as target, original_rows, removed_missing_rows,
    removed_duplicate_rows, final_rows, f.k::bigint as feature_count, f.names as final_feature_columns,
    final_rows >= 30 and classes between 2 and 20 and small = 0 as ready_to_train,
    case when (original_rows - final_rows) * 1.0 / original_rows > 0.3 then
      'Cleaning removes ' || (original_rows - final_rows) || ' of ' || original_rows || ' rows (' ||
      round_even((original_rows - final_rows) * 100.0 / original_rows, 0)::int || '%).' else '' end as warnings
    from a, c, f""",
)
def _(spark, folder):
    preview = prep_preview(labelled_documents(spark, folder), QUALITY)
    return preview.drop("features").withColumn(
        "final_feature_columns", F.array_join("final_feature_columns", ",")
    ).withColumn("warnings", F.array_join("warnings", " | "))


@query(
    "target_issues",
    """select 'p_brand' as target, case when n > 20 then 'The target has ' || n || ' distinct values, '
      || 'too many for classification (at most 20); it looks like a continuous measurement, so try '
      || 'regression or another target.' else '' end as issues
      from (select count(distinct p_brand) as n from part)
    union all select 'event_type', case when min(n) >= 6 and count(*) between 2 and 20 then '' end
      from (select event_type, count(*) as n from
        (select distinct event_type, user_id, value from events) group by 1)
    union all select 'l_returnflag', case when count(*) > 0 then
      'Regression needs a numeric target, and ''l_returnflag'' is categorical; try classification '
      || 'or another target.' end from lineitem""",
)
def _(spark, folder):
    cases = [
        ("part", TaskConfig("classification", "p_brand", ["p_size", "p_retailprice"])),
        ("events", TaskConfig("classification", "event_type", ["user_id", "value"])),
        ("lineitem", TaskConfig("regression", "l_returnflag", ["l_tax"])),
    ]
    rows = [
        (config.target, " ".join(target_issues(table(spark, folder, name), config)))
        for name, config in cases
    ]
    return spark.createDataFrame(rows, "target string, issues string")


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def scale_sql(value) -> str:
    return (
        "select l_orderkey, l_linenumber, "
        + ", ".join(f"round({value(n)}, 8) as {n}" for n in SCALED)
        + " from lineitem, (select "
        + ", ".join(
            f"avg({n}) as avg_{n}, stddev_pop({n}) as sd_{n}, min({n}) as min_{n}, max({n}) as max_{n}"
            for n in SCALED
        )
        + " from lineitem)"
    )


def _scaled(spark, folder, scaler):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    numbers = scaled(lines, SCALED, scaler)
    return rounded(numbers, 8)


@query("scale_standard", scale_sql(lambda n: f"({n} - avg_{n}) / sd_{n}"))
def _(spark, folder):
    return _scaled(spark, folder, "standard")


@query("scale_minmax", scale_sql(lambda n: f"({n} - min_{n}) / (max_{n} - min_{n})"))
def _(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("scale_none", scale_sql(lambda n: n))
def _(spark, folder):
    return _scaled(spark, folder, "none")


# The categories of the given orders and customers tables.
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def hot_sql(name: str, levels: list[str]) -> str:
    return ", ".join(f"({name} = '{v}')::int::double as \"{name}_{v}\"" for v in levels)


@query(
    "one_hot_wide",
    f"""select o_orderkey, {hot_sql("o_orderstatus", STATUSES)},
    {hot_sql("o_orderpriority", PRIORITIES)} from orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return wide_features(orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], "none")


@query(
    "feature_vector",
    f"""select c_custkey, round((c_acctbal - m) / s, 8) as c_acctbal, {hot_sql("c_mktsegment", SEGMENTS)}
    from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)""",
)
def _(spark, folder):
    customers = table(spark, folder, "customer")
    wide = wide_features(customers, ["c_custkey"], ["c_mktsegment", "c_acctbal"], "standard")
    return rounded(wide, 8)


DIGEST = "md5(concat_ws('|', '42', o_orderkey::varchar))"
N = "(select count(*) from orders)"


@query(
    "split_holdout",
    f"""select o_orderkey, rk <= ceil(round(0.2 * {N}, 9)) as is_test
    from (select o_orderkey, row_number() over (order by {DIGEST}) as rk from orders)""",
)
def _(spark, folder):
    return holdout(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query(
    "split_threshold",
    f"""select o_orderkey, ('0x' || substr({DIGEST}, 1, 8))::bigint < 0.2::double * 4294967296::double as is_test
    from orders""",
)
def _(spark, folder):
    split = holdout_by_threshold(table(spark, folder, "orders"), ["o_orderkey"])
    return split.select("o_orderkey", "is_test")


@query(
    "split_stratified",
    f"""with sizes as (select o_orderpriority as g, count(*) as n from orders group by 1),
    total as (select ceil(round(0.2 * sum(n), 9))::bigint as t, sum(n)::bigint as n from sizes),
    quota as (select g, t * sizes.n // total.n as q, t * sizes.n % total.n as r, t from sizes, total),
    given as (select g, q + (row_number() over (order by r desc, g) <= t - sum(q) over ())::int as q from quota)
    select o_orderkey, o_orderpriority, rk <= q as is_test from (select o_orderkey, o_orderpriority,
      row_number() over (partition by o_orderpriority order by {DIGEST}) as rk from orders)
      join given on g = o_orderpriority""",
)
def _(spark, folder):
    split = holdout(table(spark, folder, "orders"), ["o_orderkey"], by="o_orderpriority")
    return split.select("o_orderkey", "o_orderpriority", "is_test")


@query(
    "folds",
    f"""with t as (select {N}::bigint as n), r as (select o_orderkey,
      row_number() over (order by {DIGEST}) as rk from orders)
    select o_orderkey, case when rk <= n // 3 + (n % 3 >= 1)::int then 0
      when rk <= 2 * (n // 3) + least(n % 3, 2) then 1 else 2 end::int as fold from r, t""",
)
def _(spark, folder):
    return folds(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


@query(
    "folds_stratified",
    f"""with sizes as (select o_orderpriority as g, count(*) as n from orders group by 1),
    turns as (select g, n, coalesce(sum(n % 3) over (order by g rows between unbounded preceding
      and 1 preceding), 0)::bigint % 3 as t from sizes),
    lengths as (select g, n, {", ".join(f"n // 3 + (({f} - t + 3) % 3 < n % 3)::int as l{f}" for f in range(3))}
      from turns)
    select o_orderkey, o_orderpriority, case when rk <= l0 then 0 when rk <= l0 + l1 then 1 else 2 end::int
      as fold from (select o_orderkey, o_orderpriority,
      row_number() over (partition by o_orderpriority order by {DIGEST}) as rk from orders)
      join lengths on g = o_orderpriority""",
)
def _(spark, folder):
    split = folds(table(spark, folder, "orders"), ["o_orderkey"], by="o_orderpriority")
    return split.select("o_orderkey", "o_orderpriority", "fold")


@query(
    "split_copies",
    """with n as (select count(*) as n, ceil(round(0.2 * count(*), 9)) as t from orders),
    g as (select o_orderstatus, count(*) as c, md5(concat_ws('|', '42', o_orderstatus)) as h
      from orders group by 1),
    s as (select *, sum(c) over (order by h) - c as before from g)
    select * from (
      select o_orderstatus, true as is_test, least(c, greatest(t - before, 0))::bigint as rows from s, n
      union all
      select o_orderstatus, false, (c - least(c, greatest(t - before, 0)))::bigint from s, n)
    where rows > 0""",
)
def _(spark, folder):
    split = holdout(table(spark, folder, "orders").select("o_orderstatus"))
    return split.groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("rows"))


# One class per customer: as many classes as a table has keys.


@query(
    "split_many_classes",
    f"""with sizes as (select o_custkey as g, count(*) as n from orders group by 1),
    total as (select ceil(round(0.2 * sum(n), 9))::bigint as t, sum(n)::bigint as n from sizes),
    quota as (select g, t * sizes.n // total.n as q, t * sizes.n % total.n as r, t from sizes, total),
    given as (select g, q + (row_number() over (order by r desc, g) <= t - sum(q) over ())::int as q from quota)
    select o_orderkey, o_custkey, rk <= q as is_test from (select o_orderkey, o_custkey,
      row_number() over (partition by o_custkey order by {DIGEST}) as rk from orders)
      join given on g = o_custkey""",
)
def _(spark, folder):
    split = holdout(table(spark, folder, "orders"), ["o_orderkey"], by="o_custkey")
    return split.select("o_orderkey", "o_custkey", "is_test")


@query(
    "folds_many_classes",
    f"""with sizes as (select o_custkey as g, count(*) as n from orders group by 1),
    turns as (select g, n, coalesce(sum(n % 3) over (order by g rows between unbounded preceding
      and 1 preceding), 0)::bigint % 3 as t from sizes),
    lengths as (select g, n, {", ".join(f"n // 3 + (({f} - t + 3) % 3 < n % 3)::int as l{f}" for f in range(3))}
      from turns)
    select o_orderkey, o_custkey, case when rk <= l0 then 0 when rk <= l0 + l1 then 1 else 2 end::int
      as fold from (select o_orderkey, o_custkey,
      row_number() over (partition by o_custkey order by {DIGEST}) as rk from orders)
      join lengths on g = o_custkey""",
)
def _(spark, folder):
    split = folds(table(spark, folder, "orders"), ["o_orderkey"], by="o_custkey")
    return split.select("o_orderkey", "o_custkey", "fold")


_SLOTS = """levels as (select 0 as c, o_orderstatus as level from orders union select 1, o_custkey::varchar from orders),
    placed as (select *, row_number() over (order by c, level) as slot from levels)"""


@query(
    "one_hot_slots",
    f"""with {_SLOTS}, m as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)
    select o_orderkey, (select count(*) from placed) + 1 as size, concat_ws(',', 0, a.slot, b.slot) as indices,
      round((o_totalprice - m) / s, 8) as price
    from orders, m, placed a, placed b where a.c = 0 and a.level = o_orderstatus and b.c = 1 and b.level = o_custkey::varchar""",
)
def _(spark, folder):
    """Sparse entries where one column has a level per customer."""
    orders = table(spark, folder, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    slots = fit_slots(orders, ["o_orderstatus", "o_totalprice", "o_custkey"], "standard")
    found = encode(orders, slots, ["o_orderkey"])
    indices = F.array_join(F.transform("indices", lambda i: i.cast("string")), ",")
    return rounded(found.select("o_orderkey", "size", indices.alias("indices"), F.col("values")[0].alias("price")), 8)


@query(
    "one_hot_names",
    f"""with {_SLOTS} select 0::bigint as slot, 'o_totalprice' as name from (select count(*) from orders)
    union all select slot, case c when 0 then 'o_orderstatus_' else 'o_custkey_' end || level from placed""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return fit_slots(orders, ["o_orderstatus", "o_totalprice", "o_custkey"]).names()
