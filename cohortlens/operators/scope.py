
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    course: str | None = None
    group: str | None = None

    @property
    def is_all(self) -> bool:
        return self.course is None and self.group is None

    def apply(self, df: DataFrame, course_col: str | None = "course_name",
              group_col: str | None = "group_id") -> DataFrame:
        """Equality filters ANDed; a column set to None is not filtered."""
        if self.course is not None and course_col is not None:
            df = df.where(F.col(course_col) == F.lit(self.course))
        if self.group is not None and group_col is not None:
            df = df.where(F.col(group_col) == F.lit(self.group))
        return df


ALL = Scope()
