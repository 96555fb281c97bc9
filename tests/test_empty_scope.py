"""An empty scope (no matching course) yields empty or neutral results, never an error."""

import pytest

from conftest import SF_SMALL
from cohortlens.operators.scope import Scope
from cohortlens.plans import cohorts, concepts, engagement, grades, growth, segments, trends
from cohortlens.sources.tables import Tables

NONE = Scope(course="NO-SUCH-COURSE")
PLANS = [grades.students_per_course, grades.course_grade_stats, grades.course_grade_spread,
         grades.assessment_volatility, engagement.group_attendance, engagement.engagement_impact,
         trends.age_bracket_outcomes, concepts.concept_failure_rates, concepts.concept_trend_status,
         segments.student_segments, segments.segment_shares, segments.at_risk_top10,
         segments.at_risk_group_focus, cohorts.merge_candidates, cohorts.cohort_trajectories,
         growth.enrollment_velocity, growth.enrollment_forecast, growth.course_forecast]


@pytest.mark.parametrize("plan", PLANS, ids=lambda f: f.__name__)
def test_empty_scope(spark, plan):
    t = Tables(spark, SF_SMALL)
    rows = plan(t, NONE).collect()
    if plan is engagement.engagement_impact:
        assert all(r.n == 0 for r in rows)          # fits over no rows: n = 0, impact 0
    else:
        assert rows == []


def test_empty_scope_kpis_are_neutral(spark):
    r = grades.platform_kpis(Tables(spark, SF_SMALL), NONE).first()
    assert (r.n_students, r.video_hours_per_student) == (0, 0.0)
