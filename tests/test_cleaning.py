"""Cleaning jobs over sf0.001: re-running each rule's check on the output finds nothing."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortlens.plans import cleaning, quality as q
from cohortlens.sources.tables import Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF_SMALL)


def test_clean_roster(t):
    r = cleaning.clean_roster(t)
    assert "course_id" not in r.columns and "is_active" not in r.columns      # rules 13, 14
    assert r.where(F.col("group_id").isin(list(q.DUMMY_GROUPS))).count() == 0  # 17
    assert r.where((F.col("age") < 0) | (F.col("age") > q.MAX_AGE)).count() == 0  # 21, 22
    assert r.where(F.col("email").isNotNull() & ~F.col("email").rlike(q.EMAIL_PATTERN)).count() == 0  # 24
    assert r.where(F.trim("full_name") == "").count() == 0                     # 23


def test_clean_assessments(t):
    a = cleaning.clean_assessments(t)
    assert a.where(F.col("submitted_at").isNull()).count() == 0                # 26
    assert a.where((F.col("score") < 0) | (F.col("score") > 100)).count() == 0  # 31
    assert a.where(F.col("max_score") != 100).count() == 0                     # 30
    assert a.where(F.col("is_late") != (F.col("submitted_at") > F.col("deadline"))).count() == 0  # 27


def test_clean_attendance(t):
    a = cleaning.clean_attendance(t)
    assert {r.status for r in a.select("status").distinct().collect()} <= {"Attended", "Absent"}  # 20
    assert a.where(F.dayofweek("session_datetime").isin(1, 7)).count() == 0   # 8
    assert a.where(F.col("after_course_end")).count() > 0                      # 9 flagged, kept


def test_clean_events(t):
    e = cleaning.clean_events(t)
    assert e.where((F.col("duration_seconds") < 0) | (F.col("duration_seconds") > q.MAX_WATCH_SECONDS)).count() == 0
    assert e.where(F.col("event_datetime") < F.lit(q.TERM[0]).cast("timestamp_ntz")).count() == 0  # 32
    assert e.where(F.col("student_id") % 50 == 0).count() == 0                # 1


def test_clean_concepts_and_documents(t):
    assert cleaning.clean_concepts(t).where(~F.col("record_id").rlike(q.TEST_ID_PATTERN)).count() == 0
    d = cleaning.clean_documents(t)
    assert q.duplicate_keys(d.drop("doc_id"), ["text", "lang", "source", "n_chars"]).count() == 0


def test_cleaners_lose_no_genuine_row(t):
    raw = t.view("attendance")
    again = raw.count() - raw.select("student_id", F.date_trunc("second", "session_datetime")).distinct().count()
    assert cleaning.clean_attendance(t).count() == raw.count() - again
    docs = t.read("documents")
    assert cleaning.clean_documents(t).count() == docs.drop("doc_id").distinct().count()
    kept = t.view("roster_core").where(~F.col("group_id").isin(list(q.DUMMY_GROUPS)) | F.col("group_id").isNull())
    assert cleaning.clean_roster(t).count() == kept.count()


def test_namesakes_do_not_multiply(spark, tables):
    from cohortlens.sources import dirty
    customers = spark.createDataFrame([(1, "Ann"), (3, "Ann"), (5, "Ann"), (2, "Bo"), (7, "Bo")], "c_custkey long, c_name string")
    tables.read = lambda name: customers
    assert [tuple(r) for r in dirty.name_gender_lookup(tables).collect()] == [("Ann", 1)]


def test_report_leaves_the_views_alone(t):
    before = dict(t._views)
    q.dq_report(t)
    assert all(t._views[k] is v for k, v in before.items()) and not any(k.startswith("shared_") for k in t._views)


def test_lines_are_dealt_into_parts_of_their_own(t, spark):
    """The lines' sorts share a task, so AQE must not merge their parts (it would: all rows of sf0.001 in one)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_part = cleaning.judge(t, cleaning.Job("lines", cleaning.dirty.raw_lines, cleaning.lines_job().steps[:1])) \
        .groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert len(by_part) == parts > 1
    assert sum(r.n for r in by_part) == t.read("lineitem").select("l_orderkey", "l_linenumber").distinct().count()


def test_findings_run_in_small_parts(t, spark, monkeypatch):
    """All jobs run under the small part size, and the session's own size comes back."""
    key, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before, whole = spark.conf.get(key), cleaning.materialize
    monkeypatch.setattr(cleaning, "materialize", lambda df, name: seen.append((spark.conf.get(key), name)) or whole(df, name))
    rows = cleaning.cleaning_findings(t).collect()
    assert seen == [(cleaning.SMALL_PARTS[key], "findings")] and before != seen[0][0]
    assert spark.conf.get(key) == before and {r.source_table for r in rows} == set(cleaning.JOBS)
