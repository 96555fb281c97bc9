"""Hand-built edge fixtures (FIXTURES.md §3): a few rows each, exact expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.exprs import (hours_between, is_attended, rate_pct, title_case, week_ending_monday,
                                        week_start_monday, whole_days_between)
from cohortlens.operators.joins import asof_backward, nearest_other, null_safe_anti
from cohortlens.operators.stats import impact, min_max_scale, ols_columns, quantile_bins, scalar_quantiles

D = dt.datetime


def test_null_status_counts_in_denominator(spark):
    df = spark.createDataFrame([("Attended",), (None,), ("absent",)], "status string")
    assert df.agg(rate_pct(is_attended("status")).alias("r")).first().r == pytest.approx(100 / 3)


def test_null_record_id_denominators(spark):
    df = spark.createDataFrame([(1, "s", "attended"), (None, "s", "attended")], "record_id long, sid string, status string")
    per = df.groupBy("sid").agg(F.count("record_id").alias("den")).first().den
    platform = df.agg(F.count(F.lit(1)).alias("den")).first().den
    assert (per, platform) == (1, 2)


def test_week_rules(spark):
    ts = [D(2025, 3, 2, 10), D(2025, 3, 3, 0), D(2025, 3, 3, 23, 59), D(2025, 3, 4, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    r = df.select(week_ending_monday("ts").alias("e"), week_start_monday("ts").alias("s")).collect()
    assert [x.e for x in r] == [dt.date(2025, 3, 3)] * 3 + [dt.date(2025, 3, 10)]
    assert [x.s for x in r] == [dt.date(2025, 2, 24)] + [dt.date(2025, 3, 3)] * 3


def test_asof_backward_exact_and_unmatched(spark):
    sessions = spark.createDataFrame([(1, D(2025, 3, 1)), (1, D(2025, 3, 4, 12))], "student_id long, session_datetime timestamp_ntz")
    items = spark.createDataFrame([(10, 1, D(2025, 3, 1)), (11, 1, D(2025, 3, 5)), (12, 2, D(2025, 3, 5))],
                                  "item long, student_id long, date timestamp_ntz")
    m = asof_backward(items, sessions, "student_id", "date", "session_datetime")
    m = m.withColumn("days", whole_days_between("session_datetime", "date"))
    got = {r.item: (r.session_datetime, r.days) for r in m.collect()}
    assert got == {10: (D(2025, 3, 1), 0), 11: (D(2025, 3, 4, 12), 0), 12: (None, None)}


def test_asof_backward_uses_earlier_buckets(spark):
    sessions = spark.createDataFrame([(1, D(2025, 1, 1, 8)), (1, D(2025, 2, 1, 9)), (1, D(2025, 2, 10, 9))],
                                     "student_id long, session_datetime timestamp_ntz")
    items = spark.createDataFrame([(1, 1, D(2025, 2, 5)), (2, 1, D(2025, 2, 10, 8)), (3, 1, D(2024, 12, 31))],
                                  "item long, student_id long, date timestamp_ntz")
    got = {r.item: r.session_datetime for r in
           asof_backward(items, sessions, "student_id", "date", "session_datetime").collect()}
    assert got == {1: D(2025, 2, 1, 9), 2: D(2025, 2, 1, 9), 3: None}


def test_quantile_bins_even(spark):
    df = spark.createDataFrame([(float(a),) for a in range(18, 26)] + [(None,)], "age double")
    b = quantile_bins(df, "age").groupBy("bracket_lower", "bracket_upper").count().orderBy("bracket_lower").collect()
    assert [(r.bracket_lower, r.bracket_upper, r["count"]) for r in b] == [
        (18.0, 19.75, 2), (19.75, 21.5, 2), (21.5, 23.25, 2), (23.25, 25.0, 2)]


def test_quantile_bins_duplicate_edges(spark):
    df = spark.createDataFrame([(float(a),) for a in (20, 20, 20, 20, 20, 21, 30, 41, 22)], "age double")
    b = quantile_bins(df, "age").groupBy("bracket_lower", "bracket_upper").count().orderBy("bracket_lower").collect()
    assert [(r.bracket_lower, r.bracket_upper, r["count"]) for r in b] == [(20.0, 22.0, 7), (22.0, 41.0, 2)]


def test_p98_linear(spark):
    df = spark.createDataFrame([(x,) for x in (18.0, 19.0, 20.0, 25.0)], "x double")
    assert df.select(scalar_quantiles(df, "x", {"p98": 0.98})["p98"].alias("q")).first().q == pytest.approx(24.7)


def test_slope_and_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "x double, y double")
    r = df.agg(*ols_columns("y", "x"), impact("y", "x", 1.0).alias("imp")).first()
    assert (r.slope, round(r.intercept, 4), round(r.r2, 4), r.imp) == (2.0, -1.3333, 0.9231, 2.0)
    const = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "x double, y double")
    assert const.agg(impact("y", "x", 1.0).alias("i")).first().i is None
    one = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    assert one.agg(impact("y", "x", 1.0).alias("i")).first().i == 0.0


def test_constant_min_max_is_zero(spark):
    df = spark.createDataFrame([(5,), (5,), (5,)], "v long")
    assert [r.s for r in min_max_scale(df, "v", "s").collect()] == [0.0, 0.0, 0.0]


def test_null_safe_anti_on_days(spark):
    subs = spark.createDataFrame([("b", None), ("c", None)], "sid string, d date")
    ev = spark.createDataFrame([("b", None)], "sid string, d date")
    ghosts = null_safe_anti(subs, ev, [("sid", "sid"), ("d", "d")], null_safe=("d",)).collect()
    assert [r.sid for r in ghosts] == ["c"]


def test_hours_between(spark):
    df = spark.createDataFrame([(D(2025, 3, 1), D(2025, 3, 2, 6))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(hours_between("a", "b").alias("h")).first().h == 30.0


def test_title_case_splits_on_non_letters(spark):
    df = spark.createDataFrame([("mid-term",), ("QUIZ",), ("final exam",), (None,)], "t string")
    assert [r.x for r in df.select(title_case("t").alias("x")).collect()] == ["Mid-Term", "Quiz", "Final Exam", None]


def test_nearest_other_excludes_self_and_breaks_ties(spark):
    cands = spark.createDataFrame([("A", 10.0), ("B", 12.0), ("C", 8.0), ("D", 30.0), ("E", 30.0)], "g string, m double")
    tgts = spark.createDataFrame([("A", 10.0), ("D", 30.0), ("Z", 0.0), ("Y", 20.0)], "g string, m double")
    got = {r.g: (r.nearest_key, r.nearest_value) for r in nearest_other(tgts, cands, "g", "m").collect()}
    # A: B and C both at distance 2 -> smaller key B; D: E at distance 0; Z: C nearest;
    # Y: 12 (B) at 8 vs 30 (D, E) at 10 -> B
    assert got == {"A": ("B", 12.0), "D": ("E", 30.0), "Z": ("C", 8.0), "Y": ("B", 12.0)}


def test_nearest_other_without_candidates(spark):
    cands = spark.createDataFrame([("A", 10.0)], "g string, m double")
    tgts = spark.createDataFrame([("A", 10.0)], "g string, m double")
    r = nearest_other(tgts, cands, "g", "m").first()
    assert (r.nearest_key, r.nearest_value) == (None, None)
