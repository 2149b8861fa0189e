import random

import numpy as np
import pytest

from tablewright.operators.values import columns_frame
from tablewright.sources.csv import MISSING, _ends, _records, preview, read_csv
from tablewright.types import IngestError


@pytest.fixture
def write(tmp_path):
    def put(text, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return put


@pytest.mark.parametrize(
    ("text", "name", "message"),
    [
        ("a\n1\n", "t.txt", "Only .csv"),
        ("", "t.csv", "is empty"),
        (b"a,b\n\xff\xfe,1\n", "t.csv", "UTF-8"),
        ("  \n1\n", "t.csv", "no header"),
        ("a,,b\n1,2,3\n", "t.csv", "empty column name"),
        ("b,a, b,a\n1,2,3,4\n", "t.csv", "repeats column names: a, b"),
        ("a,b,c\n1,2,3\n1,2,3,4,5\n", "t.csv", "1 rows cannot be parsed"),
        ("a,b,c\n1,2,3\n1,2,3,\n", "t.csv", "1 rows cannot be parsed"),
        ('a,b\n1,"open\n', "t.csv", "1 rows cannot be parsed"),
        ("a,b\n\n", "t.csv", "no data rows"),
    ],
)
def test_rejected_files(spark, write, text, name, message):
    with pytest.raises(IngestError, match=message):
        read_csv(spark, write(text, name))


def test_missing_cell_short_row_and_quotes(spark, write):
    df = read_csv(spark, write('﻿a , b\n1,\n2\n3,"x, ""y"""\n', "T.CSV"))
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, None), (2, None), (3, 'x, "y"')]


def test_every_marker_is_missing(spark, write):
    lines = "".join(f"{m},1\n" for m in MISSING if m != "")
    df = read_csv(spark, write("a,b\n" + lines + "7,2\n"))
    assert df.where("a is null").count() == len(MISSING) - 1
    assert df.dtypes[0] == ("a", "bigint")


@pytest.mark.parametrize(
    ("values", "dtype"),
    [
        (["1", "-2", "NA"], "bigint"), (["1", "2.5"], "double"), (["1e3", "inf"], "double"),
        (["1d", "2"], "string"), (["True", "false"], "boolean"), (["yes", "no"], "string"),
        (["99999999999999999999", "1"], "double"), (["", "NA"], "double"), (["2020-01-01"] * 2, "string"),
    ],
)
def test_inference(spark, write, values, dtype):
    text = "a,b\n" + "".join(f"{v},x\n" for v in values)
    assert read_csv(spark, write(text)).dtypes[0] == ("a", dtype)


def test_given_schema_and_line_breaks_in_quotes(spark, write):
    from pyspark.sql import types as T

    path = write('a,b\n1,"two\nlines"\n2,z\n')
    df = read_csv(spark, path, multiline=True)
    assert [r["b"] for r in df.orderBy("a").collect()] == ["two\nlines", "z"]
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert read_csv(spark, path, schema=schema, multiline=True).dtypes[0] == ("a", "string")


def test_header_of_every_part_is_skipped(spark, tmp_path):
    path = f"{tmp_path}/parts.csv"
    spark.range(100).selectExpr("id", "id * 0.5 as half").repartition(4).write.option("header", True).csv(path)
    df = read_csv(spark, path)
    assert df.count() == 100 and df.dtypes == [("id", "bigint"), ("half", "double")]


def test_preview_and_column_table(spark):
    df = spark.sql("select explode(sequence(1, 80)) as id, timestamp_ntz'2024-01-02 03:04:05.678' as t, date'2024-01-02' as d")
    rows = preview(df, ["id"]).collect()
    assert len(rows) == 50 and rows[0]["t"] == "2024-01-02T03:04:05.678" and rows[0]["d"] == "2024-01-02"
    assert [r["kind"] for r in columns_frame(df).orderBy("ordinal").collect()] == ["numeric", "categorical", "categorical"]


def test_files_must_agree_on_their_columns(spark, write, tmp_path):
    (tmp_path / "same.csv").mkdir()
    write("a, b\n1,2\n", "same.csv/x.csv")
    write("\ufeffa,b\n20,10\n", "same.csv/y.csv")
    got = read_csv(spark, str(tmp_path / "same.csv"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (20, 10)]
    (tmp_path / "other.csv").mkdir()
    write("a,b\n1,2\n", "other.csv/x.csv")
    write("b,a\n20,10\n", "other.csv/y.csv")
    with pytest.raises(IngestError, match="headers differ"):
        read_csv(spark, str(tmp_path / "other.csv"))


def test_control_characters_stay_in_their_cells(spark, write):
    got = read_csv(spark, write("a,b\nfoo\x02bar,1\nx,2\n")).orderBy("b").collect()
    assert [tuple(r) for r in got] == [("foo\x02bar", 1), ("x", 2)]
    with pytest.raises(IngestError, match="1 rows cannot be parsed"):
        read_csv(spark, write("a,b\nx,\x01end\n", "u.csv"))


def test_line_breaks_inside_quotes_need_no_option(spark, write):
    got = read_csv(spark, write('a,b\n"one\ntwo",1\nx,2\n')).orderBy("b").collect()
    assert [tuple(r) for r in got] == [("one\ntwo", 1), ("x", 2)]


def test_a_header_reports_all_its_faults(spark, write):
    with pytest.raises(IngestError, match="empty column name.*repeats column names: a"):
        read_csv(spark, write("a,,a\n1,2,3\n"))


def quoted_rows(rng, n):
    pieces = ["a", "b,c", 'say ""hi""', "line\nbreak", "\n\n", '""', ",", "", "é", "x\n\"\"y\"\",\nz"]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 6)))
        rows.append([str(i), text, rng.choice(["plain", "5\" pipe", ""])])
    return rows


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_quoted_line_breaks_are_read_in_blocks(spark, tmp_path, block):
    """However the blocks fall, also inside of records and with many blocks to a record."""
    rng = random.Random(block)
    rows = quoted_rows(rng, 400)
    rows[200][1] = "long\n" * 300 + "end"
    body = [f'{i},"{text}",{tail}' for i, text, tail in rows]
    (tmp_path / "many.csv").mkdir()
    for part in range(2):
        text = "\n".join(["id,text,tail", *body[part * 200 : part * 200 + 200]]) + "\n"
        (tmp_path / "many.csv" / f"{part}.csv").write_text(text, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        records = _records(spark, str(tmp_path / "many.csv"))
        found = sorted(r["value"] for r in records.collect())
        df = read_csv(spark, str(tmp_path / "many.csv"), multiline=True)
        typed = {r["id"]: (r["text"], r["tail"]) for r in df.collect()}
        tasks = spark.read.text(str(tmp_path / "many.csv")).rdd.getNumPartitions()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert found == sorted(body)
    assert block > 1000 or tasks > 8
    assert typed == {
        int(i): (text.replace('""', '"') or None, tail or None) for i, text, tail in rows
    }


@pytest.mark.parametrize("start", [False, True])
def test_quotes_of_a_block_from_both_starts(start):
    rng = np.random.default_rng(int(start))
    for n in range(1, 30):
        opened, stayed = rng.random(n) < 0.4, rng.random(n) < 0.6
        state, expected = start, []
        for o, s in zip(opened, stayed):
            state = bool(s if state else o)
            expected.append(state)
        assert _ends(opened, stayed, start).tolist() == expected
