"""The rule interface, effective-dated schedules and batch formats on small fixtures."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortlens.operators import formats
from cohortlens.operators.joins import effective_at, periods
from cohortlens.plans import cleaning, quality, rulebook
from cohortlens.plans.rulebook import Job, Step
from cohortlens.session import checkpoint_dir, scratch_path
from cohortlens.sources.tables import Tables


def ts(text):
    return dt.datetime.fromisoformat(text)


# ------------------------------------------------------------------ order
def test_steps_go_by_rank_and_declared_needs():
    steps = [Step(5, "drop", after=(7,)), Step(7, "drop"), Step(31, "fix"), Step(26, "drop"), Step(20, "fix"), Step(19, "fix")]
    assert [s.rule for s in rulebook.in_order(steps)] == [19, 20, 26, 31, 7, 5]


def test_a_need_goes_before_the_rank():
    assert [s.rule for s in rulebook.in_order([Step(17, "drop", after=(25,)), Step(25, "fix"), Step(18, "drop")])] == [18, 25, 17]


@pytest.mark.parametrize("steps", [
    [Step(1, "drop", after=(2,)), Step(2, "drop", after=(1,))],   # a cycle
    [Step(1, "drop", after=(3,))],                                # a rule the job does not have
    [Step(1, "drop"), Step(1, "flag")],                           # a rule twice
])
def test_bad_jobs_are_refused(steps):
    with pytest.raises(ValueError):
        rulebook.in_order(steps)


# ------------------------------------------------------------------ step by step
def test_written_steps_change_nothing_and_keep_one_table(spark):
    ref = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "r int, kind2 string")
    known = rulebook.in_reference("known", lambda t: ref, [("k", "r")])
    job = Job("things", lambda t: _frame(spark), (*_job(None).steps, Step(5, "drop", lambda: ~F.col("known"), after=(9, 10), ends=("known", "kind2"), attach=(
        known, lambda t, df: df.join(ref.withColumnRenamed("r", "k"), "k", "left")))))
    folder = os.path.join(checkpoint_dir(spark), "tables")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    whole, stepped = rulebook.judge(None, job), rulebook.judge(None, job, rulebook.written_steps())
    assert sorted(map(str, stepped.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["step"]  # three were written


def test_findings_run_job_by_job_and_leave_one_table(spark, monkeypatch):
    """Every job's findings are written by a query of its own, and nothing but their union is left on disk."""
    folder, names, whole = os.path.join(checkpoint_dir(spark), "tables"), [], rulebook.materialize
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    monkeypatch.setattr(rulebook, "materialize", lambda df, name, **o: names.append(name) or whole(df, name, **o))
    assert cleaning.cleaning_findings(Tables(spark, SF_SMALL)).count() == sum(len(make().steps) for make in cleaning.JOBS.values())
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["findings"]
    assert names.count("found") == len(cleaning.JOBS) and names.count("step") > 2


# ------------------------------------------------------------------ one pass
def _job(raw):
    return Job("things", raw, (
        Step(17, "drop", lambda: F.col("kind") == "dummy"),
        Step(21, "fix", lambda: F.col("v") < 0, {"v": lambda: F.abs("v")}),
        Step(10, "dedupe", keys=("k",), order=("v",)),
        Step(9, "flag", lambda: F.col("v") > 10, flag="large", after=(10,)),
    ))


ROWS = [(1, "a", 5), (1, "a", -3), (1, "a", -3), (2, "dummy", 7), (2, "dummy", 7), (2, "b", 20), (None, "a", None), (3, None, -30)]


def _frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k int, kind string, v int")


def test_kept_rejected_and_findings_come_from_one_frame(spark):
    job = _job(lambda t: _frame(spark))
    judged = rulebook.judge(None, job)
    rows = rulebook.kept(judged, job).select("k", "kind", "v", "large").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(1, "a", 3, False), (2, "b", 20, True), (None, "a", None, False), (3, None, 30, True)], key=str)
    assert {(r.k, r.kind, r.dropped_by) for r in rulebook.rejected(judged, job).collect()} == {(2, "dummy", 17)}
    # dropped rows are seen by no later rule, copies count for the rules they met before the merge
    assert {r.rule_id: r.findings for r in rulebook.findings(judged, job).collect()} == {17: 2, 21: 3, 10: 2, 9: 2}
    mask = {r.k: r.rule_hits for r in judged.where("dropped_by is null").collect()}
    assert mask == {1: 1 << 21 | 1 << 10, 2: 1 << 9, None: 0, 3: 1 << 21 | 1 << 9}


def test_the_write_counts_the_findings(spark):
    job = _job(lambda t: _frame(spark))
    path = scratch_path(spark, "kept")
    seen = rulebook.publish_job(None, job, lambda df: df.write.parquet(path))
    assert seen == {17: 2, 21: 3, 10: 2, 9: 2} and spark.read.parquet(path).count() == 4


def test_empty_input_has_zero_findings(spark):
    job = _job(lambda t: _frame(spark, []))
    judged = rulebook.judge(None, job)
    assert rulebook.kept(judged, job).collect() == []
    assert {r.findings for r in rulebook.findings(judged, job).collect()} == {0}


@pytest.mark.parametrize("name", sorted(cleaning.JOBS))
def test_every_row_is_kept_rejected_or_merged(spark, name):
    t = Tables(spark, SF_SMALL)
    job = cleaning.JOBS[name]()
    judged = rulebook.judge(t, job)
    merged = sum(r.findings for r in rulebook.findings(judged, job).collect() if r.disposition == "dedupe")
    gone = rulebook.rejected(judged, job)
    dropped = judged.where("dropped_by is not null").agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    assert gone.count() <= dropped
    assert rulebook.kept(judged, job).count() + dropped + merged == job.raw(t).count()


def test_one_scan_of_the_raw_table(spark):
    """Cleaning and counting read the events once: one scan in the plan of the judged rows."""
    t = Tables(spark, SF_SMALL)
    job = cleaning.events_job()
    plan = rulebook.findings(rulebook.judge(t, job), job)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id#") >= 0 and plan.count("Relation [event_id") == 1


# ------------------------------------------------------------------ effective-dated schedules
def test_effective_at_equals_brute_force(spark):
    rnd = random.Random(2)
    start = ts("2020-01-01 00:00:00")
    dim = [(rnd.choice("abc"), start + dt.timedelta(days=rnd.randrange(900), hours=rnd.randrange(24)), rnd.randrange(9)) for _ in range(25)]
    dim += [("d", None, 1), ("a", start + dt.timedelta(days=4000), 5)]
    facts = [(i, rnd.choice(["a", "b", "c", "d", "e", None]), start + dt.timedelta(days=rnd.randrange(1000), minutes=rnd.randrange(1440)))
             for i in range(400)] + [(999, "a", None)]
    facts += [(1000 + i, g, v) for i, (g, v, _) in enumerate(dim) if v]  # exactly at a start
    d = spark.createDataFrame(dim, "g string, since timestamp_ntz, days int")
    f = spark.createDataFrame(facts, "id int, grp string, at timestamp_ntz")
    for width in (7, 64, 5000):
        got = {r.id: r.days for r in effective_at(f, d.withColumnRenamed("g", "grp"), "grp", "at", "since", width).collect()}
        want = {}
        for i, g, at in facts:
            best = [(v, k) for h, v, k in dim if h == g and v and at and v <= at]
            want[i] = max(best)[1] if best else None
        assert got == want


def test_periods_end_where_the_next_begins(spark):
    d = spark.createDataFrame([("a", ts("2020-01-01"), 1), ("a", ts("2020-02-01"), 2), ("a", ts("2020-02-01"), 3)],
                              "g string, since timestamp_ntz, days int")
    got = [(r.since, r.days, r.valid_to) for r in periods(d, "g", "since").orderBy("since").collect()]
    assert got == [(ts("2020-01-01"), 1, ts("2020-02-01")), (ts("2020-02-01"), 3, None)]


def test_nearest_scheduled_day_of_every_mask(spark):
    """All 128 weekday sets on all weekdays against a plain search backwards."""
    rows = [(m, ts("2024-03-03 09:30:00") + dt.timedelta(days=d)) for m in range(128) for d in range(7)]
    df = spark.createDataFrame(rows, "days int, at timestamp_ntz")
    got = df.select("days", "at", quality.nearest_day_of(F.col("at"), F.col("days")).alias("to")).collect()
    for r in got:
        want = next((r["at"] - dt.timedelta(days=b) for b in range(7)
                     if r.days >> ((r["at"] - dt.timedelta(days=b)).isoweekday() % 7) & 1), None)
        assert r["to"] == want, r


def test_two_groups_with_changing_schedules(spark, tables):
    """Group A meets on Mondays, from March on Tuesdays; B on Wednesdays throughout."""
    roster = [(1, "A", "x"), (2, "B", "y")]
    tables._views["roster_core"] = spark.createDataFrame(roster, "student_id long, group_id string, course_id string")
    tables._views["attendance"] = spark.createDataFrame(
        [(1, 1, "Attended", ts("2024-02-05 10:00:00")), (2, 1, "Attended", ts("2024-03-05 10:00:00")),
         (3, 1, "Attended", ts("2024-03-04 10:00:00")), (4, 2, "Attended", ts("2024-03-07 10:00:00")),
         (5, 3, "Attended", ts("2024-03-07 10:00:00"))], "record_id long, student_id long, status string, session_datetime timestamp_ntz")
    plans = spark.createDataFrame([("A", ts("2024-01-01"), 0b10), ("A", ts("2024-03-01"), 0b100), ("B", ts("2024-01-01"), 0b1000)],
                                  "group_id string, valid_from timestamp_ntz, days int")
    ends = spark.createDataFrame([("x", ts("2024-03-04 12:00:00"))], "course_id string, course_end timestamp_ntz")
    old = cleaning.dirty.group_schedules, cleaning.dirty.course_ends
    cleaning.dirty.group_schedules, cleaning.dirty.course_ends = (lambda t: plans), (lambda t: ends)
    try:
        off = {r.record_id: r.scheduled for r in cleaning.off_group_schedule(tables).collect()}
        late = {r.record_id for r in cleaning.after_own_course_end(tables).collect()}
    finally:
        cleaning.dirty.group_schedules, cleaning.dirty.course_ends = old
    assert off == {3: ts("2024-02-27 10:00:00"), 4: ts("2024-03-06 10:00:00")}
    assert late == {2}


# ------------------------------------------------------------------ formats
def test_formats_are_chosen_per_batch(spark):
    rows = [("d", "03/04/2024 10:00:00"), ("d", "25/04/2024 11:00:00"), ("d", "nonsense"), ("d", None),
            ("m", "03/04/2024 10:00:00"), ("m", "04/25/2024 11:00:00"),
            ("t", "03/04/2024 10:00:00"), ("t", "31/31/2024 10:00:00"),
            ("i", "2024-04-03 10:00:00.5"), ("i", " 2024-04-03T10:00:00 "), ("n", "never"), (None, "2024-02-30 10:00:00"),
            (None, "2024-02-29 10:00:00")]
    df = spark.createDataFrame(rows, "batch string, text string")
    verdict = {r.batch: (r.n_values, r.time_format, r.n_parsed, r.ambiguous) for r in formats.batch_formats(df, "batch", "text").collect()}
    assert verdict == {"d": (3, "day first", 2, False), "m": (2, "month first", 2, False), "t": (2, "day first", 1, True),
                       "i": (2, "iso", 2, False), "n": (1, None, 0, False), None: (2, "iso", 1, False)}
    got = [(r.batch, r.at) for r in formats.parse_by_batch(df, "batch", "text", "at").collect() if r.at]
    assert sorted(got, key=str) == sorted([
        ("d", ts("2024-04-03 10:00:00")), ("d", ts("2024-04-25 11:00:00")), ("m", ts("2024-03-04 10:00:00")),
        ("m", ts("2024-04-25 11:00:00")), ("t", ts("2024-04-03 10:00:00")), ("i", ts("2024-04-03 10:00:00.500")),
        ("i", ts("2024-04-03 10:00:00")), (None, ts("2024-02-29 10:00:00"))], key=str)


def test_times_read_by_batch_are_the_sessions(spark):
    t = Tables(spark, SF_SMALL)
    want = t.view("attendance").select("record_id", F.date_trunc("second", "session_datetime").cast("timestamp_ntz").alias("w"))
    got = cleaning.clean_session_times(t)
    clear = got.where("not ambiguous").select("record_id", "session_datetime")
    assert clear.exceptAll(want).count() == 0
    assert 0.99 * want.count() < clear.count() <= got.count() == want.count()  # the short last batch has no day over 12


def test_gender_spellings(spark):
    df = spark.createDataFrame([(" M ",), ("FEMALE",), ("0",), ("x",), (None,)], "g string")
    got = [r[0] for r in df.select(formats.canonical_label(F.col("g"), cleaning.GENDERS)).collect()]
    assert got == ["male", "female", "female", None, None]
