"""Sources and sinks: CSV with a declared schema, optional tables, nested JSON, publish,
ingest, and the course/group scope."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from cohortlens.operators.scope import Scope
from cohortlens.plans import cleaning, cohorts, grades
from cohortlens.session import scratch_path
from cohortlens.sources import nested, snapshots
from cohortlens.sources.tables import Tables, read_csv


def test_csv_declared_schema_round_trip(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id long, name string, x double") \
        .write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("x", T.DoubleType())])
    got = sorted((r.id, r.name, r.x) for r in read_csv(spark, path, schema).collect())
    assert got == [(1, "a", 2.5), (2, "b", None)]


def test_optional_table_missing_reads_empty(spark):
    t = Tables(spark, "/nonexistent")
    assert t.read("labels").count() == 0


def test_nested_grades_flatten_outer_id_wins(spark):
    docs = spark.createDataFrame(
        [(7, [("quiz", "2024-01-02T10:00:00", 8.0, 10.0), ("exam", "bad", None, None)]), (8, None)],
        nested.GRADES_DOC)
    flat = nested.flatten_grades(docs).collect()
    assert [(r.student_id, r.type) for r in flat] == [(7, "quiz"), (7, "exam")]
    assert flat[1].date is None                       # unparsable date → NULL


def test_ingest_publishes_every_table(spark):
    t = Tables(spark, SF_SMALL)
    out = scratch_path(spark, "ingest")
    paths = cleaning.ingest(t, out)
    assert set(paths) == set(cleaning.CLEANERS) | {"dq_report", "rule_findings"}
    assert snapshots.read(spark, paths["dq_report"]).count() == 33
    seen = {(r.source_table, r.rule_id): r.findings for r in snapshots.read(spark, paths["rule_findings"]).collect()}
    want = {(r.source_table, r.rule_id): r.findings for r in cleaning.cleaning_findings(t).collect()
            if r.source_table in cleaning.CLEANERS}
    assert seen == want
    assert all(os.path.isdir(p) for p in paths.values())


def test_scope_filters_roster_and_assessments(spark):
    t = Tables(spark, SF_SMALL)
    g = grades.students_per_group(t, Scope(course="BUILDING")).collect()
    assert g and all(r.group_id.startswith("BUILDING-") for r in g)
    m = cohorts.monthly_group_scores(t, Scope(course="BUILDING")).select("group_id").distinct().collect()
    assert m and all(r.group_id.startswith("BUILDING-") for r in m)
    one = grades.students_per_group(t, Scope(group=g[0].group_id)).collect()
    assert [r.group_id for r in one] == [g[0].group_id]


def test_nested_documents_per_student_and_day(spark):
    import datetime as dt
    df = spark.range(2500).select((F.col("id") % 2).alias("student_id"), F.lit("quiz").alias("type"),
                                  F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("date"),
                                  F.col("id").cast("double").alias("score"))
    docs = nested.nest_grades(df)
    assert sorted(r.n for r in docs.select(F.size("grades").alias("n")).collect()) == [1250, 1250]
    assert nested.flatten_grades(docs).count() == 2500


def test_json_array_and_lines_read_alike(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text('{"student_id": 1, "grades": [{"type": "quiz", "score": 3.0}]}\n{"student_id": 2, "grades": []}\n')
    array = tmp_path / "array.json"
    array.write_text("[" + ",\n ".join(lines.read_text().splitlines()) + "]")
    a = nested.read_nested_grades(spark, str(lines)).orderBy("student_id").collect()
    assert a == nested.read_nested_grades(spark, str(array), array_file=True).orderBy("student_id").collect()
    assert [r.student_id for r in a] == [1, 2]


def test_optional_table_by_uri(spark, tmp_path):
    assert Tables(spark, "file://" + SF_SMALL).read("labels").count() == Tables(spark, SF_SMALL).read("labels").count() > 0
    assert Tables(spark, f"file://{tmp_path}").read("labels").count() == 0
    with pytest.raises(AnalysisException):
        Tables(spark, f"file://{tmp_path}").read("customer")


def test_csv_by_header(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    path = tmp_path / "a.csv"
    path.write_text('name,id\n"two\nlines, ""quoted""",7\nplain,8\n')
    got = read_csv(spark, str(path), schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(7, 'two\nlines, "quoted"'), (8, "plain")]
    path.write_text("name,number\na,1\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(path), schema)
    path.write_text("name,id\na,notanumber\n")
    with pytest.raises(Exception):
        read_csv(spark, str(path), schema).collect()
