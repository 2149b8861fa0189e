"""Ingest and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded, table
from tablewright.functions.expressions import bin_label, normalize, safe_stem
from tablewright.functions.storage import scratch_path
from tablewright.operators import profile as ops
from tablewright.operators.clean import clean
from tablewright.plans.profile import feature_distributions, profile, target_distribution
from tablewright.sources.csv import (
    apply_types,
    audit_lines,
    infer_schema,
    preview,
    read_csv,
    summary,
    text_columns,
)
from tablewright.types import TaskConfig

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
LABELLED = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
    "n_chars": "bigint", "quality": "int", "toxic": "int",
}
PART = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
    "p_size": "int", "p_retailprice": "double",
}
LABELLED_SQL = (
    "(select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "from documents d left join labels l on d.doc_id = l.doc_id)"
)


def labelled_documents(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = documents.join(labels, "doc_id", "left")
    return joined.select(*LABELLED)


def kind_of(physical: str) -> str:
    return "numeric" if physical in ("bigint", "int", "double") else "categorical"


def union(parts) -> str:
    return "\nunion all\n".join(parts)


def column_profile_sql(source: str, columns: dict[str, str]) -> str:
    return union(
        f"""select {i}::int as ordinal, '{name}' as "column", '{kind_of(t)}' as kind,
        '{t}' as physical_type, count(*)::bigint as row_count,
        (count(*) - count({name}))::bigint as missing_count,
        coalesce(round_even((count(*) - count({name})) * 100.0::double / nullif(count(*), 0), 2), 0.0)
          as missing_percentage,
        count(distinct {name})::bigint as unique_count from {source}"""
        for i, (name, t) in enumerate(columns.items())
    )


@query("column_profile", column_profile_sql("lineitem", LINEITEM))
def _(spark, folder):
    return ops.column_profile(table(spark, folder, "lineitem"))


@query("column_profile_missing", column_profile_sql(LABELLED_SQL, LABELLED))
def _(spark, folder):
    return ops.column_profile(labelled_documents(spark, folder))


@query("column_profile_approx")
def _(spark, folder):
    return ops.column_profile(table(spark, folder, "lineitem"), approx=True)


@query(
    "dataset_summary",
    f"""select ordinal, "column", kind, physical_type, unique_count, row_count,
    {len(ORDERS)}::bigint as column_count from ({column_profile_sql("orders", ORDERS)})""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return summary(orders, ops.column_profile(orders))


@query(
    "preview_top50",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') as o_orderdate, o_orderpriority
    from orders order by o_orderkey limit 50""",
)
def _(spark, folder):
    return preview(table(spark, folder, "orders"), ["o_orderkey"])


@query(
    "dataset_dims",
    f"""select count(*)::bigint as row_count, {len(LABELLED)}::bigint as column_count,
    ({" + ".join(f"(count(*) - count({n}))" for n in LABELLED)})::bigint as missing_cells
    from {LABELLED_SQL}""",
)
def _(spark, folder):
    return ops.dataset_dims(labelled_documents(spark, folder))


@query(
    "duplicate_rows",
    """with g as (select count(*) as n from lineitem group by l_quantity, l_discount, l_returnflag)
    select sum(n)::bigint as row_count, count(*)::bigint as distinct_rows,
    (sum(n) - count(*))::bigint as duplicate_row_count from g""",
)
def _(spark, folder):
    narrow = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag")
    return ops.duplicate_rows(narrow)


@query(
    "duplicate_texts",
    f"""with g as (select count(*) as n from {LABELLED_SQL} group by text, lang, quality)
    select sum(n)::bigint as row_count, count(*)::bigint as distinct_rows,
    (sum(n) - count(*))::bigint as duplicate_row_count from g""",
)
def _(spark, folder):
    return ops.duplicate_rows(labelled_documents(spark, folder), ["text", "lang", "quality"])


def numeric_summary_sql(source: str, names: list[str], digits: int) -> str:
    def r(expression: str, alias: str) -> str:
        return f"round(({expression})::double, {digits}) as {alias}"

    return union(
        f"""select '{n}' as "column", count({n})::bigint as count,
        {r(f"avg({n}::double)", "mean")}, {r(f"stddev_samp({n}::double)", "std")},
        {r(f"min({n})", "min")}, {r(f"quantile_cont({n}::double, 0.25)", "q25")},
        {r(f"quantile_cont({n}::double, 0.5)", "median")},
        {r(f"quantile_cont({n}::double, 0.75)", "q75")}, {r(f"max({n})", "max")}
        from {source} having count({n}) > 0"""
        for n in names
    )


def numeric(columns: dict[str, str]) -> list[str]:
    return [n for n, t in columns.items() if kind_of(t) == "numeric"]


@query("numeric_summary", numeric_summary_sql("lineitem", numeric(LINEITEM), 6))
def _(spark, folder):
    return rounded(ops.numeric_summary(table(spark, folder, "lineitem")), 6)


@query("numeric_summary_missing", numeric_summary_sql(LABELLED_SQL, numeric(LABELLED), 6))
def _(spark, folder):
    return rounded(ops.numeric_summary(labelled_documents(spark, folder)), 6)


@query("numeric_summary_approx")
def _(spark, folder):
    return ops.numeric_summary(table(spark, folder, "lineitem"), approx=True)


def discrete_sql(source: str, names: list[str]) -> str:
    return union(
        f"""select '{n}' as "column", row_number() over (order by v)::int as bin, v as bin_start,
        v as bin_end, c::bigint as count from (select {n}::double as v, count(*) as c from {source}
        where {n} is not null group by 1)"""
        for n in names
    )


def equal_width_sql(source: str, names: list[str]) -> str:
    return union(
        f"""select '{n}' as "column", b::int as bin, lo + (b - 1) * step as bin_start,
        case when b = 10 then hi else lo + b * step end as bin_end,
        (select count(*) from {source} where {n} is not null
          and ({n} >= lo + (b - 1) * step) and (b = 10 or {n} < lo + b * step))::bigint as count
        from (select min({n})::double as lo, max({n})::double as hi,
          (max({n}) - min({n}))::double / 10 as step from {source}),
        (select unnest(generate_series(1, 10)) as b)"""
        for n in names
    )


DISCRETE = ["l_linenumber", "l_discount", "l_tax"]
MEASURED = ["l_quantity", "l_extendedprice"]


@query("histogram_discrete", discrete_sql("lineitem", DISCRETE))
def _(spark, folder):
    return ops.histograms(table(spark, folder, "lineitem").select(*DISCRETE))


@query("histogram_equal_width", equal_width_sql("lineitem", MEASURED))
def _(spark, folder):
    return ops.histograms(table(spark, folder, "lineitem").select(*MEASURED))


SPARSE_SQL = "(select case when l_linenumber <> 3 then l_extendedprice end as price from lineitem)"


@query("histogram_missing", equal_width_sql(SPARSE_SQL, ["price"]))
def _(spark, folder):
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    return ops.histograms(table(spark, folder, "lineitem").select(price.alias("price")))


@query(
    "bin_labels",
    f"""select "column", bin, case when bin_start = bin_end then a else a || '–' || b end as label,
    count from (select *, case when bin_start = floor(bin_start) then bin_start::bigint::varchar
      else printf('%.1f', bin_start) end as a,
      case when bin_end = floor(bin_end) then bin_end::bigint::varchar
      else printf('%.1f', bin_end) end as b from (
    {union([discrete_sql("lineitem", ["l_linenumber"]), equal_width_sql("lineitem", ["l_quantity"])])}))""",
)
def _(spark, folder):
    bins = ops.histograms(table(spark, folder, "lineitem").select("l_linenumber", "l_quantity"))
    label = bin_label(F.col("bin_start"), F.col("bin_end"))
    return bins.select("column", "bin", label.alias("label"), "count")


def frequency_sql(source: str, names: list[str], top: int = 20) -> str:
    return union(
        f"""select '{n}' as "column", least(rk, {top + 1})::int as rank,
        case when rk > {top} then 'Other' else v end as value, sum(c)::bigint as count,
        rk > {top} as is_other, any_value(uniq) > {top} as truncated
        from (select *, row_number() over (order by c desc, v) as rk, count(*) over () as uniq
          from (select {n} as v, count(*) as c from {source} where {n} is not null group by 1))
        where uniq * 1.0 / (select count(*) from {source}) <= 0.5
        group by least(rk, {top + 1}), case when rk > {top} then 'Other' else v end, rk > {top}"""
        for n in names
    )


@query("categorical_frequency", frequency_sql("part", ["p_name", "p_brand", "p_type"]))
def _(spark, folder):
    return ops.category_frequencies(table(spark, folder, "part"))


@query(
    "identifier_columns",
    f"""select "column" from ({column_profile_sql("customer", CUSTOMER)}
    union all {column_profile_sql(LABELLED_SQL, LABELLED)})
    where kind = 'categorical' and unique_count * 1.0 / row_count > 0.5""",
)
def _(spark, folder):
    customers = ops.column_profile(table(spark, folder, "customer"))
    documents = ops.column_profile(labelled_documents(spark, folder))
    return ops.identifier_columns(customers.unionByName(documents)).select("column")


@query(
    "default_features",
    f"""select 'regression' as task, ordinal, "column" from (
      {column_profile_sql("customer", CUSTOMER)}) where "column" <> 'c_acctbal'
      and not (kind = 'categorical' and unique_count * 1.0 / row_count > 0.5)
    union all select 'clustering' as task, ordinal, "column" from (
      {column_profile_sql("customer", CUSTOMER)}) where kind = 'numeric'""",
)
def _(spark, folder):
    profiled = ops.column_profile(table(spark, folder, "customer"))
    regression = ops.default_features(profiled, "regression", "c_acctbal")
    clustering = ops.default_features(profiled, "clustering", None)
    return regression.select(F.lit("regression").alias("task"), "*").unionByName(
        clustering.select(F.lit("clustering").alias("task"), "*")
    )


def correlation_sql(source: str, names: list[str], digits: int) -> str:
    return union(
        f"""select '{a}' as column_x, '{b}' as column_y,
        round(corr({a}::double, {b}::double), {digits}) as r from {source}"""
        for a in names
        for b in names
    )


@query("correlation_matrix", correlation_sql("lineitem", numeric(LINEITEM), 8))
def _(spark, folder):
    return rounded(ops.correlation(table(spark, folder, "lineitem")), 8)


@query("correlation_missing", correlation_sql(LABELLED_SQL, numeric(LABELLED), 8))
def _(spark, folder):
    return rounded(ops.correlation(labelled_documents(spark, folder)), 8)


PRICES = ["p_size", "p_retailprice", "p_partkey"]


@query(
    "covariance_matrix",
    union(
        f"""select '{a}' as column_x, '{b}' as column_y,
        round(covar_samp({a}::double, {b}::double), 4) as covariance from part"""
        for a in PRICES
        for b in PRICES
    ),
)
def _(spark, folder):
    return rounded(ops.covariance(table(spark, folder, "part"), PRICES), 4)


QUALITY = TaskConfig("classification", "quality", ["lang", "n_chars"])


@query(
    "target_distribution",
    f"""select row_number() over (order by c desc, v)::int as bin, v as label, c::bigint as count
    from (select quality::varchar as v, count(*) as c from (select distinct lang, n_chars, quality
    from {LABELLED_SQL} where lang is not null and n_chars is not null and quality is not null)
    group by 1)""",
)
def _(spark, folder):
    return target_distribution(clean(labelled_documents(spark, folder), QUALITY), QUALITY)


CLEAN_QUALITY_SQL = f"(select distinct lang, n_chars, quality from {LABELLED_SQL} where quality is not null)"


@query(
    "feature_distributions",
    f"""select 'category' as section, "column", rank as bin, value as label, count
    from ({frequency_sql(CLEAN_QUALITY_SQL, ["lang"])})
    union all select 'bin', "column", bin, round(bin_start, 6)::varchar, count
    from ({equal_width_sql(CLEAN_QUALITY_SQL, ["n_chars"])})""",
)
def _(spark, folder):
    bins, categories = feature_distributions(clean(labelled_documents(spark, folder), QUALITY), QUALITY)
    return categories.select(
        F.lit("category").alias("section"), "column", F.col("rank").alias("bin"), F.col("value").alias("label"), "count"
    ).unionByName(
        bins.select(
            F.lit("bin").alias("section"), "column", "bin",
            F.round("bin_start", 6).cast("string").alias("label"), "count",
        )
    )


def profile_long_sql(source: str, columns: dict[str, str], measured: list[str], charted: list[str]) -> str:
    names = numeric(columns)
    stats = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    shape = ["missing_count", "missing_percentage", "unique_count"]
    profiled = column_profile_sql(source, columns)
    summed = numeric_summary_sql(source, names, 6)
    all_columns = ", ".join(columns)
    dims = f"""with g as (select count(*) as n from {source} group by {all_columns})
      select sum(n) as row_count, {len(columns)} as column_count,
      (select sum(missing_count) from ({profiled})) as missing_cells,
      sum(n) - count(*) as duplicate_row_count from g"""
    parts = [
        f"select 'overview' as section, '' as \"column\", '{d}' as item, {d}::double as value from ({dims})"
        for d in ("row_count", "column_count", "missing_cells", "duplicate_row_count")
    ]
    parts += [f"select 'column', \"column\", '{s}', {s}::double from ({profiled})" for s in shape]
    parts += [f"select 'numeric', \"column\", '{s}', {s}::double from ({summed})" for s in stats]
    parts.append(
        f"select 'bin', \"column\", bin::varchar, count::double from ({equal_width_sql(source, measured)})"
    )
    parts.append(
        f"""select 'category', "column", case when is_other then '(rest)' else value end,
        count::double from ({frequency_sql(source, charted)})"""
    )
    parts.append(
        f"select 'correlation', column_x, column_y, round(r, 6) from ({correlation_sql(source, names, 6)})"
    )
    return union(parts)


@query(
    "profile_long",
    profile_long_sql("customer", CUSTOMER, ["c_custkey", "c_nationkey", "c_acctbal"], ["c_mktsegment"]),
)
def _(spark, folder):
    return rounded(profile(table(spark, folder, "customer")).long(), 6)


@query(
    "profile_written",
    f"""select "column", kind, missing_count, unique_count from ({column_profile_sql("part", PART)})""",
)
def _(spark, folder):
    path = scratch_path(spark, "profile")
    profile(table(spark, folder, "part")).write(path)
    return spark.read.parquet(f"{path}/columns").select(
        "column", "kind", "missing_count", "unique_count"
    )


def customer_lines(spark, folder):
    """Customers as CSV lines; some lose their last field, some gain one, some break a quote."""
    customers = table(spark, folder, "customer")
    line = F.to_csv(F.struct(*[F.col(c) for c in CUSTOMER]))
    key = F.col("c_custkey")
    short = F.regexp_replace(line, ",[^,]*$", "")
    ragged = (
        F.when(key % 7 == 0, short)
        .when(key % 11 == 0, F.concat(line, F.lit(",extra")))
        .when(key % 13 == 0, F.concat(line, F.lit(',"open')))
        .otherwise(line)
    )
    return customers.select(key, ragged.alias("value"))


@query(
    "ingest_row_audit",
    """select case when c_custkey % 7 = 0 then 'short' when c_custkey % 11 = 0 then 'overlong'
    when c_custkey % 13 = 0 then 'broken' else 'ok' end as state, count(*)::bigint as rows,
    sum(c_custkey)::bigint as keys from customer group by 1""",
)
def _(spark, folder):
    audited = audit_lines(customer_lines(spark, folder), list(CUSTOMER))
    return audited.groupBy("state").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys")
    )


@query(
    "ingest_padded_rows",
    """select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal,
    case when c_custkey % 7 <> 0 then c_mktsegment end as c_mktsegment from customer
    where c_custkey % 7 = 0 or (c_custkey % 11 <> 0 and c_custkey % 13 <> 0)""",
)
def _(spark, folder):
    audited = audit_lines(customer_lines(spark, folder), list(CUSTOMER))
    texts = text_columns(audited.where(F.col("state").isin("ok", "short")), list(CUSTOMER))
    types = {r["column"]: r["inferred_type"] for r in infer_schema(texts).collect()}
    return apply_types(texts, types)


def _texts(spark, folder):
    """Order columns as text, with marks for missing values and mixed columns mixed in."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.cast("string").alias("key"),
        F.when(key % 5 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 2 == 0, "True").otherwise("false").alias("flag"),
        F.when(key % 3 == 0, "yes").otherwise("no").alias("word"),
        F.when(key == F.lit(1), "1.5").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.when(key % 4 == 0, "").otherwise("null").alias("void"),
    )


@query(
    "infer_schema",
    """select * from (values
    (0, 'key', (select case when count(*) filter (not regexp_full_match(o_orderkey::varchar, '[+-]?[0-9]+')) = 0
       then 'bigint' else 'string' end from orders), 'numeric'),
    (1, 'price', (select case when count(*) filter (not regexp_full_match(o_totalprice::varchar,
       '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?')) = 0 then 'double' else 'string' end from orders
       where o_orderkey % 5 <> 0), 'numeric'),
    (2, 'flag', (select case when count(*) = 0 then 'double' else 'boolean' end from orders), 'categorical'),
    (3, 'word', (select case when count(*) = 0 then 'double' else 'string' end from orders), 'categorical'),
    (4, 'mixed', (select case when count(*) filter (o_orderkey = 1) > 0 then 'double' else 'bigint' end
       from orders), 'numeric'),
    (5, 'void', (select case when count(*) >= 0 then 'double' end from orders), 'numeric')
    ) as t(ordinal, "column", inferred_type, kind)""",
)
def _(spark, folder):
    raw = _texts(spark, folder)
    fields = raw.select(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(raw.columns)]).alias("fields"))
    return infer_schema(text_columns(fields, raw.columns))


@query(
    "csv_round_trip",
    """select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment
    from customer""",
)
def _(spark, folder):
    path = scratch_path(spark, "customers") + ".csv"
    table(spark, folder, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query(
    "missing_markers",
    """select count(*)::bigint as rows, count(*) filter (l.quality is null)::bigint as missing
    from documents d left join labels l on d.doc_id = l.doc_id""",
)
def _(spark, folder):
    marked = labelled_documents(spark, folder).select(
        F.struct(
            F.when(F.col("quality").isNull(), F.element_at(F.array(F.lit("n/a"), F.lit("#N/A"), F.lit("NULL")), (F.col("doc_id") % 3 + 1).cast("int")))
            .otherwise(F.col("quality").cast("string")).alias("f0")
        ).alias("fields")
    )
    return text_columns(marked, ["quality"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality").isNull()).alias("missing")
    )


@query(
    "nan_as_missing",
    """select count(*)::bigint as rows, count(*) filter (l_linenumber = 3)::bigint as missing
    from lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_tax")).alias("tax")
    )
    return normalize(lines).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tax").isNull()).alias("missing")
    )


@query(
    "safe_stems",
    r"""select stem, count(*)::bigint as pages from (select case when s = '' then 'dataset' else s end
    as stem from (select regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\]', ''),
    '^(.+)\.[^.]*$', '\1'), '[^A-Za-z0-9_.-]', '_', 'g') as s from pages)) group by 1""",
)
def _(spark, folder):
    stems = table(spark, folder, "pages").select(safe_stem(F.col("url")).alias("stem"))
    return stems.groupBy("stem").agg(F.count(F.lit(1)).alias("pages"))
