"""cohortlens: learning analytics and data-quality rules as Spark DataFrame jobs.

Layout
------
sources/    table reads with declared schemas, the crosswalk views, nested JSON, sinks
functions/  column-expression helpers (rates, week rules, time deltas, parsing)
operators/  reusable relational operators (scope, statistics, as-of / anti / nearest joins)
plans/      the composite questions (grades, engagement, trends, concepts, segments,
            cohorts, growth, integrity audit) and the 33 data-quality rules
"""

from cohortlens.session import build_session, checkpoint_dir  # noqa: F401
from cohortlens.sources.tables import Tables  # noqa: F401
from cohortlens.operators.scope import Scope  # noqa: F401
