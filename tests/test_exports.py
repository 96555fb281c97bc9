"""Exports: checked loading, quarantine, versioned tables, and the analytics on loaded exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortlens.registry import QUERIES
from cohortlens.session import scratch_path
from cohortlens.sources import catalogue, snapshots
from cohortlens.sources.tables import Tables


@pytest.fixture(scope="module")
def base(spark):
    return Tables(spark, SF_SMALL)


@pytest.fixture(scope="module")
def loaded(spark, base):
    exports = catalogue.export(base, scratch_path(spark, "exports"))
    return catalogue.load(spark, exports, scratch_path(spark, "loaded"))


def test_declared_schemas_are_the_views(base):
    for name, schema in catalogue.DOMAIN.items():
        got = {f.name: f.dataType for f in base.view(name).schema.fields}
        assert got == {f.name: f.dataType for f in schema.fields}, name


def test_loaded_rows_are_the_views(base, loaded):
    assert loaded.rejects().count() == 0
    for name, schema in catalogue.DOMAIN.items():
        a, b = base.view(name).select(*schema.names), loaded.view(name).select(*schema.names)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


# Every plan over domain views (the rules and cleaners read dirtied driver tables).
ANALYTICS = sorted(n for n in QUERIES if not n.startswith(("dq_", "clean", "rejected", "session_time", "export")))


def _rows(df):
    out = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ANALYTICS)
def test_analytics_on_exports(base, loaded, name):
    assert _rows(QUERIES[name](loaded)) == _rows(QUERIES[name](base))


# ------------------------------------------------------------------ quarantine
def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_malformed_rows_go_to_the_rejects(spark, tmp_path):
    ex = tmp_path / "ex"
    _write(ex / "attendance.csv" / "a.csv", "record_id,student_id,status,session_datetime\n"
           "1,7,Attended,2024-01-02 10:00:00\nx,7,Attended,2024-01-02 10:00:00\n2,7,Absent,2024-02-30 10:00:00\n3,8,Absent\n"
           "4,8,Absent,2024-01-03 10:00:00,extra\n,8,Absent,2024-01-03 10:00:00\n5,,,\n")
    _write(ex / "attendance.csv" / "b.csv", "﻿datetime,status,record_id,student_id,note\n2024-01-04 09:00:00,Attended,6,9,hello\n")
    _write(ex / "attendance.csv" / "c.csv", "status,session_datetime\nAttended,2024-01-05 09:00:00\nAbsent,2024-01-05 09:00:00\n")
    _write(ex / "attendance.csv" / "d.csv", "")
    _write(ex / "concepts.csv", 'record_id,student_id,concept_name,score_pct,mastery_status,timestamp\n'
           'CP1,1,"two\nlines, a ""quote""",50,Passed,2024-01-01 00:00:00\nCP2,2,plain,60.5,Failed,2024-01-01 00:00:00\n')
    t = catalogue.load(spark, str(ex), str(tmp_path / "out"))
    got = {r.record_id: (r.student_id, r.status, r.session_datetime) for r in t.view("attendance").collect()}
    assert got == {1: (7, "Attended", dt.datetime(2024, 1, 2, 10)), 5: (None, None, None), 6: (9, "Attended", dt.datetime(2024, 1, 4, 9))}
    bad = sorted((r.file.rsplit("/", 1)[1], r.reason, r.record) for r in t.rejects().collect())
    assert [(f, why) for f, why, _ in bad] == [
        ("a.csv", "fields do not match the header"), ("a.csv", "fields do not match the header"), ("a.csv", "no record_id"),
        ("a.csv", "no value of the type: record_id"), ("a.csv", "no value of the type: session_datetime"),
        ("c.csv", "the header lacks record_id"), ("c.csv", "the header lacks record_id")]
    assert {rec for _, _, rec in bad} >= {"3,8,Absent", "x,7,Attended,2024-01-02 10:00:00"}
    names = {r.concept_name: r.score_pct for r in t.view("raw_concepts").collect()}
    assert names == {'two\nlines, a "quote"': 50.0, "plain": 60.5}
    report = {r.source_table: (r.accepted, r.rejected) for r in t.load_report().collect()}
    assert report["attendance"] == (3, 7) and report["concepts"] == (2, 0) and report["roster"] == (0, 0)


def test_only_files_that_need_it_are_read_whole(spark, tmp_path):
    _write(tmp_path / "x.csv" / "a.csv", 'h,k\n"1,2",3\n')
    _write(tmp_path / "x.csv" / "b.csv", 'h,k\n"1\n2",3\n')
    got = {f["file"].rsplit("/", 1)[1]: (f["first"], f["odd"]) for f in catalogue.inspect(spark, str(tmp_path / "x.csv"))}
    assert got == {"a.csv": ("h,k", 0), "b.csv": ("h,k", 2)}


def test_grades_as_lines_and_arrays(spark, tmp_path):
    docs = ['{"student_id": 1, "grades": [{"type": "quiz", "date": "2024-01-01 10:00:00", "score": 5}, {"type": "quiz", "score": "bad"}]}',
            '{"student_id": 2}', '{"student_id": 3, "grades": [{"type": "exam", "date": null, "score": 7.5}]}']
    _write(tmp_path / "raw_quiz_grades.json" / "lines.json", "\n".join([*docs, '{"student_id": 4, "grades": [']) + "\n")
    _write(tmp_path / "raw_quiz_grades.json" / "array.json", "[\n" + ",\n".join(docs) + "\n]")
    t = catalogue.load(spark, str(tmp_path), str(tmp_path / "out"))
    rows = sorted((r.student_id, r.type, r.score) for r in t.view("raw_quiz_grades").collect())
    assert rows == [(1, "quiz", 5.0)] * 2 + [(3, "exam", 7.5)] * 2
    assert sorted(r.reason for r in t.rejects().collect()) == ["fields do not match the header"] + ["no value of the type: score"] * 2
    assert t.view("roster_core").count() == 0  # absent files are empty tables


# ------------------------------------------------------------------ versions
def test_a_failed_write_leaves_the_old_rows(spark):
    table = scratch_path(spark, "versions")
    with pytest.raises(snapshots.NoVersion):
        snapshots.read(spark, table)
    snapshots.publish(spark.range(100), table)
    boom = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(boom, table)
    assert snapshots.read(spark, table).count() == 100 and len(snapshots.versions(spark, table)) == 1


def test_readers_keep_their_version(spark):
    table = scratch_path(spark, "versions")
    snapshots.publish(spark.range(3), table)
    before = snapshots.read(spark, table)
    snapshots.publish(spark.range(5), table)
    assert before.count() == 3 and snapshots.read(spark, table).count() == 5
    assert snapshots.read(spark, table, 1).count() == 3


def test_an_empty_publish_is_an_empty_version(spark):
    table = scratch_path(spark, "versions")
    snapshots.publish(spark.range(3), table)
    snapshots.publish(spark.range(0).selectExpr("id", "'x' AS name"), table)
    got = snapshots.read(spark, table)
    assert got.count() == 0 and got.columns == ["id", "name"]


def test_two_publishers_do_not_take_one_number(spark, monkeypatch):
    table = scratch_path(spark, "versions")
    snapshots.publish(spark.range(1), table)
    numbers = snapshots._numbers
    stale = [[1]]  # the second publisher read the list before the first one committed

    def late(s, t):
        return stale.pop() if stale else numbers(s, t)

    snapshots.publish(spark.range(2), table)
    monkeypatch.setattr(snapshots, "_numbers", late)
    v = snapshots.publish(spark.range(3), table)
    assert v.number == 3 and [x.number for x in snapshots.versions(spark, table)] == [1, 2, 3]


def test_older_versions_are_dropped_on_request(spark):
    table = scratch_path(spark, "versions")
    for n in (1, 2, 3):
        snapshots.publish(spark.range(n), table)
    assert snapshots.drop_older(spark, table, keep=1) == [1, 2]
    assert snapshots.read(spark, table).count() == 3 and [v.number for v in snapshots.versions(spark, table)] == [3]


def test_bucketed_versions_join_without_a_shuffle(spark):
    rows = spark.range(2000).selectExpr("id % 50 AS student_id", "id AS v", "cast(id % 3 AS int) AS month")
    a, b = scratch_path(spark, "buckets"), scratch_path(spark, "buckets")
    snapshots.publish(rows, a, buckets=("student_id", 8), partition_by=("month",))
    snapshots.publish(rows.select("student_id", (F.col("v") * 2).alias("w")), b, buckets=("student_id", 8))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one, two = snapshots.read(spark, a), snapshots.read(spark, b)
        joined = one.groupBy("student_id").agg(F.sum("v").alias("v")).join(two.groupBy("student_id").agg(F.sum("w").alias("w")), "student_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("w <> 2 * v").count() == 0 and joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_colocated_facts_plan_without_a_shuffle(spark, base):
    from cohortlens.plans import cleaning
    t = catalogue.colocate(base, scratch_path(spark, "colocated"), 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        grades = t.view("assessments").groupBy("student_id").agg(F.avg("score").alias("grade"))
        plans = {"ghosts": QUERIES["audit_ghost_submissions"](t), "submissions": cleaning.clean_submissions(t),
                 "grades": t.view("roster").join(grades, "student_id", "left")}
        for name, df in plans.items():
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
    finally:
        for k in settings:
            spark.conf.unset(k)
    for name in ("student_profile", "engagement_profile", "audit_ghost_submissions", "clean_submissions", "march_absence_effect"):
        assert _rows(QUERIES[name](t)) == _rows(QUERIES[name](base)), name


def test_tables_load_side_by_side(spark, tmp_path, monkeypatch):
    """No table's load waits for another's to end, and an error of one is the load's."""
    import threading
    meet, publish = threading.Barrier(len(catalogue.DOMAIN), timeout=60), snapshots.publish

    def meeting(df, table, **options):
        if not table.endswith("rejects"):
            meet.wait()
        return publish(df, table, **options)

    monkeypatch.setattr(catalogue.snapshots, "publish", meeting)
    got = catalogue.load(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert all(got.view(name).count() == 0 for name in catalogue.DOMAIN) and got.rejects().count() == 0

    def failing(df, table, **options):
        if table.endswith("attendance"):
            raise OSError("no space")
        return publish(df, table, **options)

    monkeypatch.setattr(catalogue.snapshots, "publish", failing)
    with pytest.raises(OSError, match="no space"):
        catalogue.load(spark, str(tmp_path / "none"), str(tmp_path / "out2"))
