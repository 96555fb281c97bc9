"""Table catalog: one ``read`` per input table with a declared schema.

Schemas are declared, not inferred, so a scan never samples files and a drifted file fails
loudly. Parquet gives column pruning and filter pushdown for free: every plan selects only
the columns it uses and Catalyst pushes them into ``ReadSchema`` / ``PushedFilters``.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                      ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
}

# Tables a plan may run without (S5): an absent file reads as an empty relation.
OPTIONAL = frozenset({"labels"})


@dataclass
class Tables:
    """Handle on one data directory; ``t.read(name)`` is a lazy, schema-checked scan."""

    spark: SparkSession
    root: str
    _views: dict = field(default_factory=dict, repr=False)

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as e:  # Spark looks the path up, whatever file system it is on
            if name in OPTIONAL and e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def __post_init__(self) -> None:
        from cohortlens.session import checkpoint_dir
        checkpoint_dir(self.spark)

    def materialize(self, key: str, build) -> DataFrame:
        """Build once per handle and cut the lineage with a table written in the shared
        checkpoint folder (``spark.checkpoint.dir``; see ``session.materialize``).

        Used for intermediates that a plan reads several times (the per-student measures
        and profile): without it every branch re-derives them from the fact tables.
        """
        if key not in self._views:
            from cohortlens.session import materialize
            self._views[key] = materialize(build(), re.sub(r"[^A-Za-z0-9_-]+", "_", key))
        return self._views[key]

    def view(self, name: str) -> DataFrame:
        """Crosswalk view (roster, assessments, ...); built once per handle, still lazy."""
        if name not in self._views:
            from cohortlens.sources import crosswalk
            self._views[name] = getattr(crosswalk, name)(self)
        return self._views[name]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: header CSV with a declared schema (no inference pass over the data).

    Columns are matched by the header's names, in any order; a header with other names than
    the schema's raises. Quoted fields may hold newlines and doubled quotes. A malformed row
    fails the job rather than turning into NULLs.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"the header of {path} is {header}, not {schema.names}")
    as_written = T.StructType([schema[name] for name in header])
    return spark.read.options(**options).schema(as_written).csv(path).select(*schema.names)
