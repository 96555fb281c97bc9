"""Rule functions: one clean and one dirty row each; fixed output; idempotence."""

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.plans import quality as q

D = dt.datetime


def test_keep_known_splits_rows(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "student_id long, v string")
    known = spark.createDataFrame([(1,)], "student_id long")
    kept, rejected = q.keep_known(facts, known, "student_id")
    assert [r.student_id for r in kept.collect()] == [1]
    assert [r.student_id for r in rejected.collect()] == [2]
    assert kept.count() + rejected.count() == facts.count()


def test_flag_missing_keeps_all_rows(spark):
    subs = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 1))], "sid long, d date")
    grades = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "sid long, d date")
    out = {r.sid: r.orphaned for r in q.flag_missing(subs, grades, [("sid", "sid"), ("d", "d")], "orphaned").collect()}
    assert out == {1: False, 2: True}


def test_dedupe_by_key_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 2), "late"), (1, D(2024, 1, 1), "first"), (2, D(2024, 1, 1), "only")],
                               "sid long, ts timestamp_ntz, v string")
    once = q.dedupe_by_key(df, ["sid"], order=["ts"])
    assert {r.sid: r.v for r in once.collect()} == {1: "first", 2: "only"}
    assert once.columns == df.columns
    assert q.duplicate_keys(once, ["sid"]).count() == 0


def test_redundant_and_static_columns(spark):
    df = spark.createDataFrame([("A", "A", True, 1), ("B", "B", True, 2)], "name string, id string, active boolean, n int")
    red = q.redundant_columns(df, [("name", "id"), ("name", "n")]).collect()
    assert {(r.column, r.redundant) for r in red} == {("id", True), ("n", False)}
    st = {r.column: r.static for r in q.static_columns(df).collect()}
    assert st == {"name": False, "id": False, "active": True, "n": False}


def test_canonical_status(spark):
    df = spark.createDataFrame([("ATTENDED ",), ("Absent",), ("other",)], "s string")
    assert [r.c for r in df.select(q.canonical(F.col("s")).alias("c")).collect()] == ["Attended", "Absent", "other"]


def test_fix_scores_rescale_and_clamp(spark):
    df = spark.createDataFrame([(8.0, 10.0), (140.0, 100.0), (-5.0, 100.0), (None, 100.0), (55.0, 100.0)],
                               "s double, m double")
    got = [r.f for r in df.select(q.fix_scores(F.col("s"), F.col("m")).alias("f")).collect()]
    assert got == [80.0, 100.0, 0.0, None, 55.0]
    again = df.select(q.fix_scores(q.fix_scores(F.col("s"), F.col("m"))).alias("f")).collect()
    assert [r.f for r in again] == got


def test_nearest_scheduled_day(spark):
    df = spark.createDataFrame([(D(2025, 3, 8, 9),), (D(2025, 3, 9, 9),), (D(2025, 3, 10, 9),)], "ts timestamp_ntz")
    got = [r.f for r in df.select(q.nearest_scheduled_day(F.col("ts")).alias("f")).collect()]
    assert got == [D(2025, 3, 7, 9), D(2025, 3, 7, 9), D(2025, 3, 10, 9)]


def test_unify_batches(spark):
    old = spark.createDataFrame([(1, D(1997, 5, 1))], "record_id long, datetime timestamp_ntz")
    new = spark.createDataFrame([(2, D(1999, 5, 1))], "record_id long, session_datetime timestamp_ntz")
    u = q.unify_batches(old, new, {"session_datetime": "datetime"})
    assert u.columns == ["record_id", "session_datetime"]
    assert {r.record_id: r.session_datetime for r in u.collect()} == {1: D(1997, 5, 1), 2: D(1999, 5, 1)}


def test_parse_with_fallbacks(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("05/01/2024",), ("garbage",)], "s string")
    got = df.select(q.parse_with_fallbacks(F.col("s"), ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy")).alias("t")).collect()
    assert [r.t is None for r in got] == [False, False, True]


def test_every_rule_is_registered_once():
    assert [r.rule_id for r in q.RULES] == list(range(1, 34))
    assert {r.disposition for r in q.RULES} == {"dropped", "fixed", "flagged"}
