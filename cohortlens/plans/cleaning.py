"""

Every job but the documents' is a set of steps of the rule interface (``rulebook``), which orders them,
judges all rows in one pass and gives cleaned rows, rejected rows and findings. ``ingest`` publishes
every cleaned table with the findings counted by the writes.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import floor_ntz
from cohortlens.operators.columns import constant_columns, equal_columns, renamed_columns
from cohortlens.operators.formats import batch_formats, canonical_label, parse_by_batch
from cohortlens.operators.joins import effective_at
from cohortlens.plans import quality as q
from cohortlens.plans.rulebook import Job, Step, clean, in_reference, judge, publish_job, rejected, written_findings
from cohortlens.session import materialize, scratch_path, settings, used_up
from cohortlens.sources import catalogue, dirty, snapshots

PLACEHOLDER_NAME = "Unknown"
SPOILT_ONE_IN = 500
# Shuffled bytes that AQE merges into one task. The jobs sort the same rows several times in a task (joins and merges),
# which takes about 14 times the bytes read.
SMALL_PARTS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
GENDERS = {"male": ("m", "male", "1"), "female": ("f", "female", "0")}


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _not(c: Column) -> Column:
    """Holds unless the condition does (null: it does not)."""
    return ~F.coalesce(c, F.lit(False))


# ------------------------------------------------------------------ roster
def _useful_columns(t) -> DataFrame:
    """13, 14: the raw roster without the columns found redundant or static (one verdict row per column)."""
    r = dirty.raw_roster(t)
    drop = q.drop_columns_if(q.redundant_columns(r, [("course_name", "course_id")]), "redundant")
    return r.drop(*drop, *q.drop_columns_if(q.static_columns(r, ["is_active"]), "static"))


def _with_true_gender(t, df: DataFrame) -> DataFrame:
    look = dirty.name_gender_lookup(t)
    return df.join(look.where(F.col("full_name") != PLACEHOLDER_NAME), "full_name", "left")


def _blank(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def roster_job(dummy_groups=q.DUMMY_GROUPS, max_age: int = q.MAX_AGE) -> Job:
    return Job("roster", _useful_columns, (
        Step(17, "drop", lambda: F.col("group_id").isin(list(dummy_groups))),
        Step(21, "fix", lambda: F.col("age") < 0, {"age": lambda: F.abs(F.col("age"))}),
        Step(22, "fix", lambda: F.col("age") > max_age, {"age": lambda: F.when(F.col("age") <= max_age, F.col("age"))}),
        Step(23, "fix", lambda: _blank("full_name").isNull() | _blank("email").isNull(),
             {"full_name": lambda: F.coalesce(_blank("full_name"), F.lit(PLACEHOLDER_NAME)), "email": lambda: _blank("email")}),
        Step(24, "fix", lambda: ~F.col("email").rlike(q.EMAIL_PATTERN),
             {"email": lambda: F.when(F.col("email").rlike(q.EMAIL_PATTERN), F.col("email"))}, after=(23,)),
        Step(25, "fix", lambda: F.col("gender") != F.col("true_gender"),
             {"gender": lambda: F.coalesce("true_gender", "gender")}, attach=_with_true_gender,
             ends=("true_gender",), after=(23,)),
    ))


# ------------------------------------------------------------------ assessments
def assessments_job() -> Job:
    late = lambda: F.col("submitted_at") > F.col("deadline")
    enrolled = in_reference("enrolled", lambda t: t.view("roster_core"), [("student_id", "student_id"), ("course_id", "course_id")])
    return Job("assessments", dirty.raw_assessments, (
        Step(26, "drop", lambda: F.col("submitted_at").isNull()),
        Step(27, "fix", lambda: F.col("is_late") != late(), {"is_late": late}),
        Step(30, "fix", lambda: F.col("max_score") != 100,
             {"score": lambda: F.when(F.col("max_score") > 0, F.col("score") * 100.0 / F.col("max_score")).otherwise(F.col("score")),
              "max_score": lambda: F.lit(100.0)}),
        Step(31, "fix", lambda: F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 100),
             {"score": lambda: q.fix_scores(F.col("score"))}, after=(30,)),
        Step(7, "drop", lambda: _not(F.col("id_prefix") == F.substring("course_id", 1, 2)), ends=("id_prefix",)),
        Step(5, "drop", lambda: ~F.col("enrolled"), attach=enrolled, ends=("enrolled",), after=(7,)),
    ))


# ------------------------------------------------------------------ attendance
def _unified_batches(t) -> DataFrame:
    old, new = dirty.raw_attendance_batches(t)
    return q.unify_batches(old.withColumn("from_renamed", F.lit(True)), new.withColumn("from_renamed", F.lit(False)),
                           {"session_datetime": "datetime"})


def _graded_days(t, df: DataFrame) -> DataFrame:
    days = in_reference("graded", lambda t: t.view("assessments").select("student_id", F.to_date("date").alias("day")),
                        [("student_id", "student_id"), ("_day", "day")])
    return days(t, df.withColumn("_day", F.to_date("session_datetime")))


def _attendance_steps(moved: Callable[[], Column], end: Callable[[], Column], attach_days=(), attach_end=(),
                      ends_days: tuple = (), ends_end: tuple = ()) -> tuple[Step, ...]:
    session = lambda: F.col("session_datetime")
    return (
        Step(19, "fix", lambda: F.col("from_renamed"), ends=("from_renamed",)),
        Step(20, "fix", lambda: F.col("status") != q.canonical(F.col("status")), {"status": lambda: q.canonical(F.col("status"))}),
        # one record per student and original second (the lowest record id), before rule 8 moves
        # sessions: rows that only the move makes equal are both genuine
        Step(10, "dedupe", keys=("student_id", "_sec"), order=("record_id",), ends=("_sec",),
             attach=lambda t, df: df.withColumn("_sec", floor_ntz("session_datetime", "second"))),
        Step(8, "fix", lambda: session() != moved(), {"session_datetime": lambda: F.coalesce(moved(), session())},
             attach=attach_days, ends=ends_days, after=(10,)),
        Step(9, "flag", lambda: session() > end(), flag="after_course_end", attach=attach_end, ends=ends_end, after=(8,)),
        Step(12, "flag", lambda: (F.col("status") == "Absent") & F.col("graded"), flag="graded_while_absent",
             attach=_graded_days, ends=("graded", "_day"), after=(8, 20)),
    )


ATTENDANCE_COLUMNS = ("record_id", "student_id", "status", "session_datetime", "after_course_end", "graded_while_absent")


def attendance_job(days=q.SCHEDULE_DAYS) -> Job:
    """One schedule and one end date for all groups."""
    steps = _attendance_steps(lambda: q.nearest_scheduled_day(F.col("session_datetime"), days), lambda: _ntz(q.COURSE_END))
    return Job("attendance", _unified_batches, steps, ATTENDANCE_COLUMNS, wide=True)


def with_group(t, df: DataFrame) -> DataFrame:
    """A student's group and course beside each row (null for students the roster does not have)."""
    of = t.view("roster_core").select(F.col("student_id").alias("_s"), F.col("group_id").alias("_group"), F.col("course_id").alias("_course"))
    return df.join(of, df["student_id"] == of["_s"], "left").drop("_s")


def days_of_group(t, df: DataFrame) -> DataFrame:
    """``_days``: the weekdays (bit 0: Sunday) on which ``_group`` meets at the time of the session."""
    plan = dirty.group_schedules(t).select(F.col("group_id").alias("_group"), "valid_from", F.col("days").alias("_days"))
    return effective_at(df, plan, "_group", "session_datetime", "valid_from")


def with_schedule(t, df: DataFrame) -> DataFrame:
    return days_of_group(t, with_group(t, df))


def with_course_end(t, df: DataFrame) -> DataFrame:
    ends = dirty.course_ends(t).select(F.col("course_id").alias("_course"), F.col("course_end").alias("_end"))
    return df.join(ends, "_course", "left")


def attendance_by_group_job() -> Job:
    """Rules 8 and 9 by each group's own schedule, which changes over time, and each course's own end."""
    steps = _attendance_steps(
        lambda: q.nearest_day_of(F.col("session_datetime"), F.col("_days")), lambda: F.col("_end"),
        attach_days=(with_group, days_of_group), ends_days=("_days", "_group"), attach_end=with_course_end, ends_end=("_end", "_course"))
    return Job("attendance_by_group", _unified_batches, steps, ATTENDANCE_COLUMNS, wide=True)


# ------------------------------------------------------------------ events, concepts
def events_job(term=q.TERM, cap: int = q.MAX_WATCH_SECONDS) -> Job:
    low, high = map(_ntz, term)
    seconds = lambda: F.col("duration_seconds")
    return Job("events", dirty.raw_events, (
        Step(32, "drop", lambda: _not((F.col("event_datetime") >= low) & (F.col("event_datetime") < high))),
        Step(28, "fix", lambda: seconds() < 0, {"duration_seconds": lambda: F.abs(seconds())}),
        Step(29, "fix", lambda: seconds() > cap,
             {"duration_seconds": lambda: F.when(seconds() > cap, F.lit(float(cap))).otherwise(seconds())}, after=(28,)),
        Step(1, "drop", lambda: ~F.col("known"), attach=in_reference("known", dirty.known_students, [("student_id", "student_id")]),
             ends=("known",)),
    ))


def _garbled(t) -> DataFrame:
    return dirty.concepts_garbled(t).withColumn("concept_name", F.col("raw_concept_name")).drop("raw_concept_name")


def concepts_job() -> Job:
    return Job("concepts", _garbled, (
        Step(18, "drop", lambda: _not(F.col("record_id").rlike(q.TEST_ID_PATTERN))),
        Step(33, "drop", lambda: F.col("concept_name").rlike(q.GARBLED_CLASS)),
    ))


# ------------------------------------------------------------------ submissions, grades, lines
def _on_day(flag: str, column: str, reference: Callable, ref_column: str) -> Callable:
    """An ``attach``: does the reference have a row of the same student on the same day?"""
    day = in_reference(flag, lambda t: reference(t).select("student_id", F.to_date(ref_column).alias("day")),
                       [("student_id", "student_id"), ("_day", "day")])
    return lambda t, df: day(t, df.withColumn("_day", F.to_date(column)))


def _logins(t) -> DataFrame:
    return t.view("learn_events").where(F.col("event_type") == "login")


def _activity(t) -> DataFrame:
    return t.view("learn_events").where(F.col("event_type").isin(list(q.ACTIVITY_TYPES)))


def submissions_job() -> Job:
    graded = _on_day("has_grade", "submitted_at", lambda t: t.view("raw_quiz_grades"), "date")
    active = _on_day("has_login", "submitted_at", _logins, "event_datetime")
    return Job("submissions", lambda t: t.view("raw_submissions"), (
        Step(2, "flag", lambda: ~F.col("has_grade"), flag="no_grade", attach=graded, ends=("has_grade", "_day")),
        Step(4, "flag", lambda: ~F.col("has_login"), flag="no_login", attach=active, ends=("has_login", "_day")),
    ))


def grades_job() -> Job:
    active = _on_day("has_activity", "date", _activity, "event_datetime")
    return Job("grades", lambda t: t.view("raw_quiz_grades"), (
        Step(31, "fix", lambda: F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 100),
             {"score": lambda: q.fix_scores(F.col("score"))}),
        Step(3, "flag", lambda: ~F.col("has_activity"), flag="no_activity", attach=active, ends=("has_activity", "_day")),
    ))


def lines_job() -> Job:
    own = in_reference("own_course", lambda t: t.read("part").select("p_partkey", "p_type"),
                       [("l_partkey", "p_partkey"), ("logged_course", "p_type")])
    return Job("lines", dirty.raw_lines, (
        Step(15, "dedupe", keys=("l_orderkey", "l_linenumber"), order=("l_partkey",)),
        Step(6, "drop", lambda: ~F.col("own_course"), attach=own, ends=("own_course",)),
        Step(11, "dedupe", keys=("student_id", "l_partkey"), order=("l_orderkey", "l_linenumber"), after=(6,)),
    ))


JOBS: dict[str, Callable[[], Job]] = {
    "roster": roster_job, "assessments": assessments_job, "attendance": attendance_job,
    "attendance_by_group": attendance_by_group_job, "events": events_job, "concepts": concepts_job,
    "submissions": submissions_job, "grades": grades_job, "lines": lines_job}


def clean_roster(t, dummy_groups=q.DUMMY_GROUPS, max_age: int = q.MAX_AGE) -> DataFrame:
    return clean(t, roster_job(dummy_groups, max_age))


def clean_assessments(t) -> DataFrame:
    return clean(t, assessments_job())


def clean_attendance(t, days=q.SCHEDULE_DAYS) -> DataFrame:
    return clean(t, attendance_job(days))


def clean_attendance_by_group(t) -> DataFrame:
    return clean(t, attendance_by_group_job())


def clean_events(t, term=q.TERM, cap: int = q.MAX_WATCH_SECONDS) -> DataFrame:
    return clean(t, events_job(term, cap))


def clean_concepts(t) -> DataFrame:
    return clean(t, concepts_job())


def clean_submissions(t) -> DataFrame:
    return clean(t, submissions_job())


def clean_grades(t) -> DataFrame:
    return clean(t, grades_job())


def clean_lines(t) -> DataFrame:
    return clean(t, lines_job())


def clean_documents(t) -> DataFrame:
    d = t.read("documents")
    # 16: full-row copies (ignoring the id) keep the lowest id; the texts themselves stay in place
    first = d.groupBy(*q.document_key(d)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return d.join(first, "doc_id", "left_semi").select("doc_id", "text", "lang", "source", "n_chars")


def cleaning_findings(t) -> DataFrame:
    """``source_table, rule_id, disposition, findings`` of all jobs: what each rule met in its place of the order. Building
    the plan runs the jobs one after the other, wide ones step by step, so that only one job's or step's shuffles are on disk, in
    parts whose size does not grow with the tables."""
    with settings(t.spark, SMALL_PARTS), used_up() as keep:
        found = [written_findings(t, make()) for make in JOBS.values()]
        return keep(materialize(reduce(DataFrame.unionByName, found), "findings"))


def rejected_lines(t) -> DataFrame:
    """The lines that a rule dropped, with the rule (merged copies are counted, not listed)."""
    job = lines_job()
    return rejected(judge(t, job), job)


# ------------------------------------------------------------------ rules 8, 9 and 20 on their own
def off_group_schedule(t) -> DataFrame:
    """Rule 8: sessions on a weekday on which the student's group does not meet at that time."""
    a = with_schedule(t, t.view("attendance"))
    moved = q.nearest_day_of(F.col("session_datetime"), F.col("_days"))
    return a.where(F.col("session_datetime") != moved).select("record_id", "student_id", "session_datetime", moved.alias("scheduled"))


def after_own_course_end(t) -> DataFrame:
    """Rule 9: sessions after the end of the student's own course."""
    a = with_course_end(t, with_group(t, t.view("attendance")))
    return a.where(F.col("session_datetime") > F.col("_end")).select("record_id", "student_id", "session_datetime", F.col("_end").alias("course_end"))


def session_time_formats(t) -> DataFrame:
    """Rule 20: the time format of every monthly batch, inferred from its values."""
    return batch_formats(dirty.raw_session_texts(t), "batch", "session_text")


def clean_session_times(t) -> DataFrame:
    """Rule 20: session times read in their batch's own format."""
    return (parse_by_batch(dirty.raw_session_texts(t), "batch", "session_text", "session_datetime")
            .select("record_id", "batch", "time_format", "ambiguous", "session_datetime"))


def clean_gender_labels(t) -> DataFrame:
    """Rule 20: gender spellings to two labels; unknown spellings become null."""
    return dirty.raw_gender_labels(t).select("student_id", canonical_label(F.col("gender_text"), GENDERS).alias("gender"))


# ------------------------------------------------------------------ rules 13, 14 and 19 by inspection
def found_redundant_columns(t) -> DataFrame:
    """Rule 13: the columns of the raw roster that repeat another, found without naming any."""
    return equal_columns(dirty.raw_roster(t))


def found_constant_columns(t) -> DataFrame:
    """Rule 14: the columns of the raw roster that hold one value."""
    return constant_columns(dirty.raw_roster(t))


def found_renamed_columns(t) -> DataFrame:
    """Rule 19: the columns that the two generations of the attendance export name differently."""
    old, new = dirty.raw_attendance_batches(t)
    return renamed_columns(old, new).select("old_name", "new_name")


CLEANERS = {"roster": clean_roster, "assessments": clean_assessments, "attendance": clean_attendance,
            "events": clean_events, "concepts": clean_concepts, "documents": clean_documents,
            "submissions": clean_submissions, "grades": clean_grades, "lines": clean_lines}


def ingest(t, out_dir: str) -> dict[str, str]:
    """Publish a new version of every cleaned table and of the findings under ``out_dir``; returns
    table → path (read with ``snapshots.read``). Row rules are counted by the write of their table (``rule_findings``)."""
    paths, counted = {}, []
    for name, fn in CLEANERS.items():
        paths[name] = os.path.join(out_dir, name)
        if name in JOBS:
            seen = publish_job(t, JOBS[name](), lambda df, name=name: snapshots.publish(df, paths[name]))
            counted += [(name, rule, n) for rule, n in seen.items()]
        else:
            snapshots.publish(fn(t), paths[name])
    rows = t.spark.createDataFrame(counted, "source_table string, rule_id int, findings long")
    for name, df in (("rule_findings", rows), ("dq_report", q.dq_report(t))):
        paths[name] = os.path.join(out_dir, name)
        snapshots.publish(df, paths[name])
    return paths


def export_load_report(t, spoilt_one_in: int = SPOILT_ONE_IN) -> DataFrame:
    """The domain tables written as a school's exports, with every 500th student's rows spoilt, and loaded:
    ``source_table, accepted, rejected`` (building the plan writes and loads the files)."""
    exports = catalogue.export(t, scratch_path(t.spark, "exports"), spoilt_one_in)
    return catalogue.load(t.spark, exports, scratch_path(t.spark, "loaded")).load_report()
