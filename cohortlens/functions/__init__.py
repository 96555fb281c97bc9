"""Column-expression helpers; everything stays JVM-side and inside whole-stage codegen."""

from cohortlens.functions.exprs import *  # noqa: F401,F403
