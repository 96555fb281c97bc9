"""Composite plans over tiny hand-built views (FIXTURES.md §3) and invariants."""

import datetime as dt

import pytest

from cohortlens.plans import cohorts, concepts, growth, segments

D = dt.datetime
ROSTER = ("student_id long, full_name string, email string, age long, course_id string, course_name string, "
          "group_id string, instructor string, stated_num_students int")
ASSESS = ("assessment_id long, student_id long, course_id string, group_id string, type string, score double, "
          "date timestamp_ntz, deadline timestamp_ntz, submitted_at timestamp_ntz")
ATT = "record_id long, student_id long, status string, session_datetime timestamp_ntz"
EV = ("event_id long, student_id long, event_type string, duration_seconds double, event_datetime timestamp_ntz, "
      "device string")
CON = ("record_id string, student_id long, concept_name string, score_pct double, mastery_status string, "
       "timestamp timestamp_ntz")


def _views(t, roster=(), assess=(), att=(), ev=(), con=(), enrol=None):
    s = t.spark
    r = s.createDataFrame(list(roster), ROSTER)
    t._views["roster_core"] = r
    if enrol is not None:
        t._views["roster"] = s.createDataFrame(list(enrol), ROSTER + ", enrollment_date timestamp_ntz")
    t._views["assessments"] = s.createDataFrame(list(assess), ASSESS)
    t._views["attendance"] = s.createDataFrame(list(att), ATT)
    t._views["learn_events"] = s.createDataFrame(list(ev), EV)
    t._views["concepts"] = s.createDataFrame(list(con), CON)


def _student(i, email, group="G1", course="C1"):
    return (i, f"n{i}", email, 20, course, course, group, "I", 10)


def test_duplicate_and_null_emails_are_blanked(tables):
    roster = [_student(1, None), _student(2, None), _student(3, "x"), _student(4, "x"), _student(5, "y")]
    _views(tables, roster=roster)
    got = {r.student_id: r.contact_email for r in segments.at_risk_top10(tables).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "", 5: "y"}


def test_segment_boundary_is_high_achiever(tables):
    roster = [_student(i, f"e{i}") for i in (1, 2, 3)]
    assess = [(i, i, "C1", "G1", "quiz", float(s), None, None, None) for i, s in ((1, 50), (2, 60), (3, 70))]
    att = [(i, i, "Attended", D(2024, 1, 1)) for i in (1, 2, 3)]
    _views(tables, roster=roster, assess=assess, att=att)
    seg = {r.student_id: r.segment for r in segments.student_segments(tables).collect()}
    assert seg[2] == "High Achievers"            # grade = median, effort = median
    shares = segments.segment_shares(tables).collect()
    assert sum(r.share_pct for r in shares) == pytest.approx(100.0)


def test_risk_is_within_bounds(tables):
    roster = [_student(i, f"e{i}") for i in (1, 2)]
    assess = [(1, 1, "C1", "G1", "quiz", 100.0, None, None, None)]
    att = [(1, 1, "Attended", D(2024, 1, 1)), (2, 2, "Absent", D(2024, 1, 1))]
    _views(tables, roster=roster, assess=assess, att=att)
    r = {x.student_id: x.risk_score for x in segments.risk_scores(tables).collect()}
    assert r[1] == pytest.approx(0.0) and r[2] == pytest.approx(5500.0)
    assert all(0 <= v <= 10000 for v in r.values())


def test_group_focus_mode_tie_takes_smallest_group(tables):
    roster = [_student(1, "a", "b"), _student(2, "b", "a"), _student(3, "c", "a"), _student(4, "d", "b")]
    _views(tables, roster=roster)
    r = segments.at_risk_group_focus(tables).collect()
    assert {x.mode_group for x in r} == {"a"} and {x.branch for x in r} == {"effort"}


def test_trajectory_boundaries(tables):
    rows, aid = [], 0
    for g, (a, b) in {"down": (50.0, 49.0), "up": (50.0, 51.0), "flat": (50.0, 50.99)}.items():
        for m, s in ((1, a), (2, b)):
            aid += 1
            rows.append((aid, 1, "C", g, "quiz", s, D(2024, m, 5), None, None))
    rows.append((99, 1, "C", "single", "quiz", 70.0, D(2024, 3, 5), None, None))
    _views(tables, assess=rows)
    got = {r.group_id: (r.trend_status, r.total_shift) for r in cohorts.cohort_trajectories(tables).collect()}
    assert got["down"][0] == "Sliding Down" and got["up"][0] == "Trending Up"
    assert got["flat"][0] == "Stable" and got["single"] == ("Stable", 0.0)


def test_concept_minimum_attempts(tables):
    roster = [_student(1, "a")]
    con = ([(f"CP{i}", 1, "five", 50.0, "Failed", D(2024, 1, 1)) for i in range(5)]
           + [(f"CP{i}", 1, "six", 50.0, "failed", D(2024, 1, 1)) for i in range(6)])
    _views(tables, roster=roster, con=con)
    got = {r.concept_name: r.fail_rate for r in concepts.concept_failure_rates(tables).collect()}
    assert got == {"six": 100.0}
    st = concepts.concept_trend_status(tables).first()
    assert (st.concept_name, st.trend_status) == ("six", "not enough data")


def test_forecast_velocity_and_invariants(tables):
    base = [(i, f"n{i}", "e", 20, "C", "C", "G", "I", 10, D(2024, 1, 1 + 4 * i)) for i in range(3)]
    _views(tables, enrol=base, ev=[(1, 0, "login", 1.0, D(2024, 1, 11), "web")])
    v = growth.enrollment_velocity(tables).first()
    assert v.days_elapsed == 30 and v.months_elapsed == pytest.approx(30 / 30.44)
    hist = [r.cumulative for r in growth.enrollment_history(tables).orderBy("month").collect()]
    assert hist == sorted(hist) and hist[-1] == 3
    f = growth.enrollment_forecast(tables).orderBy("step").collect()
    assert f[0].cumulative == hist[-1] and f[-1].month == dt.date(2030, 12, 1)
