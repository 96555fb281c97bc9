"""Equal, constant and renamed columns are found without naming them."""

import datetime as dt

from cohortlens.operators.columns import column_profiles, constant_columns, equal_columns, renamed_columns


def test_planted_copies_and_constants(spark):
    rows = [(i, f"n{i % 7}", None if i % 5 == 0 else i % 3, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, v long, w long").selectExpr(
        "id", "name", "v", "w", "name AS label", "v AS v2", "if(id = 77, 'other', name) AS almost", "cast(v AS string) AS text_v",
        "'x' AS fixed", "cast(null AS int) AS nothing", "if(id < 100, 'x', null) AS half", "v AS v3")
    got = {(r.column, r.duplicate_of) for r in equal_columns(df.repartition(5)).collect()}
    assert got == {("label", "name"), ("v2", "v"), ("v3", "v")}
    kept = {(r.column, r.duplicate_of) for r in equal_columns(df, keep=["v3", "label"]).collect()}
    assert kept == {("name", "label"), ("v", "v3"), ("v2", "v3")}
    assert {r.column for r in constant_columns(df).collect()} == {"fixed", "nothing", "half"}


def test_rows_that_repeat_do_not_cancel(spark):
    """Every row twice: the xor of a pair is zero, the sum is not."""
    rows = [(i, i % 3, (i + i // 50) % 3) for i in range(100)] * 2
    df = spark.createDataFrame(rows, "id long, a long, b long")
    assert equal_columns(df).collect() == []


def test_one_scan_for_all_columns(spark):
    df = spark.range(10).selectExpr("id", "id AS b", "id % 2 AS c")
    assert column_profiles(df)._jdf.queryExecution().optimizedPlan().toString().count("Range (0") == 1


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([(1, 1, "a")], "a long, b long, c string")
    assert constant_columns(df).collect() == [] and constant_columns(df.limit(0)).collect() == []
    assert equal_columns(df.limit(0)).collect() == []
    assert {tuple(r) for r in equal_columns(df).collect()} == {("b", "a")}


def test_renames_by_look_and_name(spark):
    day = dt.datetime(2024, 1, 1, 8)
    old = spark.createDataFrame([(i, f"u{i}@x.org", day, f"G-{i % 4}", "en") for i in range(50)],
                                "id long, mail string, datetime timestamp_ntz, grp string, extra string")
    new = spark.createDataFrame([(i, f"u{i}@x.org", day + dt.timedelta(days=40), f"G-{i % 4}", 5) for i in range(60)],
                                "id long, mail_address string, session_datetime timestamp_ntz, grp_code string, other long")
    got = {(r.old_name, r.new_name) for r in renamed_columns(old, new).collect()}
    assert got == {("mail", "mail_address"), ("datetime", "session_datetime"), ("grp", "grp_code")}
    assert renamed_columns(old, old).collect() == [] and renamed_columns(old.limit(0), new.limit(0)).count() >= 0
