"""Domain tables from a school's own exports: declared files, checked rows, quarantine.

``load`` reads one export directory into published tables (``snapshots``) and returns a ``Tables`` handle whose
views are those tables, so every analytics plan runs on them as it does on the crosswalk.

* Files are CSV with a header (``<name>.csv``, a file or a folder of them) or JSON documents for the
  nested grades (``raw_quiz_grades.json``, one per line or a top-level array per file).
* One scan of the text tells, per file, its header and whether quoted fields hold line breaks; only
  such files are read as a whole (``multiLine``), the others are split. Files may have different headers:
  columns are matched by name, renamed columns by ``RENAMED``, absent ones are null.
* Every field is read as text and cast; a row with a wrong number of fields or a value that does not
  fit its column's type goes to the reject table with its file, the offset of its block, the reason and the record, in place
  of failing the job. A file whose header lacks a key column is rejected as a whole, row by row.
* An absent file is an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialize
from cohortlens.sources import snapshots
from cohortlens.sources.nested import nest_grades
from cohortlens.sources.tables import Tables, _schema

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

DOMAIN: Mapping[str, T.StructType] = {
    "roster": _schema(("student_id", L), ("full_name", S), ("email", S), ("age", L), ("course_id", S), ("course_name", S),
                      ("group_id", S), ("instructor", S), ("stated_num_students", I), ("enrollment_date", TS)),
    "assessments": _schema(("assessment_id", L), ("student_id", L), ("course_id", S), ("group_id", S), ("type", S), ("score", D),
                           ("date", TS), ("deadline", TS), ("submitted_at", TS)),
    "attendance": _schema(("record_id", L), ("student_id", L), ("status", S), ("session_datetime", TS)),
    "concepts": _schema(("record_id", S), ("student_id", L), ("concept_name", S), ("score_pct", D), ("mastery_status", S),
                        ("timestamp", TS)),
    "learn_events": _schema(("event_id", L), ("student_id", L), ("event_type", S), ("duration_seconds", D), ("event_datetime", TS),
                            ("device", S)),
    "raw_submissions": _schema(("student_id", L), ("submitted_at", TS)),
    "raw_quiz_grades": _schema(("student_id", L), ("type", S), ("date", TS), ("score", D)),
}
NESTED = ("raw_quiz_grades",)
KEYS: Mapping[str, str] = {"roster": "student_id", "assessments": "assessment_id", "attendance": "record_id", "concepts": "record_id",
                           "learn_events": "event_id", "raw_submissions": "student_id"}
RENAMED: Mapping[str, Mapping[str, str]] = {"attendance": {"datetime": "session_datetime"}}
# Views that are another table's rows.
SAME_AS = {"raw_concepts": "concepts", "raw_events": "learn_events"}
REJECTS = _schema(("source_table", S), ("file", S), ("block_offset", L), ("reason", S), ("record", S))
CSV = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


@dataclass
class ExportTables(Tables):
    """``Tables`` whose views are published domain tables under ``root``; the driver's tables do not exist here."""

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            if name == "roster_core":
                self._views[name] = self.view("roster").drop("enrollment_date")
            else:
                source = SAME_AS.get(name, name)
                if source not in DOMAIN:
                    raise KeyError(f"{name} is not a domain table")
                self._views[name] = snapshots.read(self.spark, os.path.join(self.root, source))
        return self._views[name]

    def rejects(self) -> DataFrame:
        return snapshots.read(self.spark, os.path.join(self.root, "rejects"))

    def load_report(self) -> DataFrame:
        """``source_table, accepted, rejected`` of all domain tables."""
        bad = self.rejects().groupBy("source_table").agg(F.count("*").alias("rejected"))
        counts = None
        for name in DOMAIN:
            one = self.view(name).agg(F.count("*").alias("accepted")).select(F.lit(name).alias("source_table"), "accepted")
            counts = one if counts is None else counts.unionByName(one)
        return counts.join(bad, "source_table", "left").select(
            "source_table", "accepted", F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def _exists(spark: SparkSession, path: str) -> bool:
    _, p, system = snapshots._hadoop(spark, path)
    return system.exists(p)


def inspect(spark: SparkSession, path: str) -> list[dict]:
    """Per file: ``file``, ``first`` (its first line) and ``odd`` (lines with an odd number of quotes). One scan of the
    text; one row per file comes to the driver."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("i"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return [r.asDict() for r in lines.groupBy(F.col("file_path").alias("file")).agg(
        F.min_by(F.when(F.col("start") == 0, F.col("value")), F.when(F.col("start") == 0, F.col("i"))).alias("first"),
        F.count_if(quotes % 2 == 1).alias("odd")).collect()]


def _header(line: str | None) -> list[str]:
    import csv
    return next(csv.reader([(line or "").lstrip("\ufeff")]), [])


def _no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    extra = _schema(("_file", S), ("_start", L), ("_reason", S), ("_record", S)).fields
    return spark.createDataFrame([], T.StructType([*schema.fields, *extra]))


def _checked(df: DataFrame, name: str, schema: T.StructType, present: Mapping[str, str], corrupt: Column) -> DataFrame:
    """Text columns to typed ones, with ``_reason`` (null: accepted) and the record as it was read."""
    texts = {f.name: F.col(present[f.name]) if f.name in present else F.lit(None).cast("string") for f in schema.fields}
    typed = {f.name: texts[f.name].try_cast(f.dataType) for f in schema.fields}
    misfits = F.concat_ws(", ", *[F.when(texts[c].isNotNull() & typed[c].isNull(), F.lit(c)) for c in schema.names])
    key = KEYS.get(name)
    reason = F.when(corrupt.isNotNull(), F.lit("fields do not match the header")) \
        .when(misfits != "", F.concat(F.lit("no value of the type: "), misfits))
    if key:
        reason = reason.when(texts[key].isNull(), F.lit(f"no {key}"))
    record = F.coalesce(corrupt, F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns
                                                   if c not in ("_corrupt", "_file", "_start")]))
    return df.select(*[typed[c].alias(c) for c in schema.names], "_file", "_start", reason.alias("_reason"),
                     F.when(reason.isNotNull(), record).alias("_record"))


def read_csv_checked(spark: SparkSession, path: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of a CSV export, typed, with ``_file, _start, _reason, _record``."""
    schema = schema or DOMAIN[name]
    renamed = RENAMED.get(name, {})
    groups: dict[tuple, list[str]] = {}
    for f in inspect(spark, path):
        header = _header(f["first"])
        if header:  # an empty file has no rows
            groups.setdefault((tuple(header), f["odd"] > 0), []).append(f["file"])
    out = None
    for (header, whole), files in sorted(groups.items()):
        columns = [f"c{i}" for i in range(len(header))]
        as_text = T.StructType([T.StructField(c, S) for c in [*columns, "_corrupt"]])
        rows = (spark.read.options(**CSV, multiLine=whole).schema(as_text).csv(files)
                .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
        present = {renamed.get(h, h): c for h, c in zip(header, columns)}
        one = _checked(rows, name, schema, present, F.col("_corrupt"))
        key = KEYS.get(name)
        if key and key not in present:
            one = one.withColumns({"_reason": F.lit(f"the header lacks {key}"), "_record": F.coalesce("_record", F.lit(""))})
        out = one if out is None else out.unionByName(one)
    return _no_rows(spark, schema) if out is None else out


def read_grades_checked(spark: SparkSession, path: str) -> DataFrame:
    """The nested grades, flattened, with ``_file, _start, _reason, _record``; a document that is no JSON is one
    rejected row. Files that hold one array are read as a whole, the others by line."""
    texts = T.ArrayType(_schema(("type", S), ("date", S), ("score", S)))
    doc = T.StructType([T.StructField("student_id", S), T.StructField("grades", texts), T.StructField("_corrupt", S)])
    files = inspect(spark, path)
    arrays = [f["file"] for f in files if (f["first"] or "").lstrip("\ufeff \t").startswith("[")]
    lines = [f["file"] for f in files if f["file"] not in set(arrays) and f["first"]]
    out = None
    for group, whole in ((lines, False), (arrays, True)):
        if group:
            docs = (spark.read.schema(doc).option("multiLine", whole).option("columnNameOfCorruptRecord", "_corrupt").json(group)
                    .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
            flat = docs.select(F.col("student_id").alias("c0"), "_corrupt", "_file", "_start", F.explode_outer("grades").alias("g"))
            flat = flat.where("_corrupt is not null or g is not null").select(
                "c0", F.col("g.type").alias("c1"), F.col("g.date").alias("c2"), F.col("g.score").alias("c3"), "_corrupt", "_file", "_start")
            one = _checked(flat, "raw_quiz_grades", DOMAIN["raw_quiz_grades"],
                           {"student_id": "c0", "type": "c1", "date": "c2", "score": "c3"}, F.col("_corrupt"))
            out = one if out is None else out.unionByName(one)
    return _no_rows(spark, DOMAIN["raw_quiz_grades"]) if out is None else out


def _at_once(spark: SparkSession, do: Callable[[str], object], names: Iterable[str]) -> list:
    """``do(name)`` of every table, results in order. The tables' jobs are submitted side by side, so that one table's last
    tasks and the work between its jobs leave no cores idle; an error of one is raised when all have ended."""
    names = list(names)
    with ThreadPoolExecutor(len(names)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(do), name) for name in names]
    return [r.result() for r in running]


def load(spark: SparkSession, exports: str, out: str) -> ExportTables:
    """Reads every declared table of ``exports``, publishes the accepted rows under ``out`` and the others as
    ``out/rejects``; returns the handle on them. Each file's records are parsed once."""

    def one(name: str) -> DataFrame:
        schema = DOMAIN[name]
        path = os.path.join(exports, f"{name}.{'json' if name in NESTED else 'csv'}")
        if not _exists(spark, path):
            rows = _no_rows(spark, schema)
        else:
            rows = read_grades_checked(spark, path) if name in NESTED else read_csv_checked(spark, path, name)
            rows = materialize(rows, f"checked_{name}")
        snapshots.publish(rows.where("_reason is null").select(*schema.names), os.path.join(out, name))
        return rows.where("_reason is not null").select(
            F.lit(name).alias("source_table"), F.col("_file").alias("file"), F.col("_start").alias("block_offset"),
            F.col("_reason").alias("reason"), F.col("_record").alias("record"))

    rejects = spark.createDataFrame([], REJECTS)
    for bad in _at_once(spark, one, DOMAIN):
        rejects = rejects.unionByName(bad)
    snapshots.publish(rejects, os.path.join(out, "rejects"))
    return ExportTables(spark, out)


def colocate(t: Tables, out: str, buckets: int) -> ExportTables:
    """Publishes all domain tables of ``t`` bucketed and sorted by student, and returns the handle on them.

    Aggregates, joins and windows by student then shuffle no fact; the per-student measures, a union of four facts,
    still exchange one partial row per student and table. Joins on the student and something else
    (a day, say) use the buckets, too, where the session allows a subset of the keys
    (``spark.sql.requireAllClusterKeysForCoPartition`` false). A bucket holds whole students: choose ``buckets`` so
    that the largest student fits one task, or stay with plain tables, whose partial aggregates spread a hot student.
    """
    for name, schema in DOMAIN.items():
        snapshots.publish(t.view(name).select(*schema.names), os.path.join(out, name), buckets=("student_id", buckets))
    snapshots.publish(t.spark.createDataFrame([], REJECTS), os.path.join(out, "rejects"))
    return ExportTables(t.spark, out)


def export(t: Tables, out: str, spoilt_one_in: int = 0) -> str:
    """Writes the domain views of ``t`` as exports (CSV with quoted text, grades as JSON Lines). With
    ``spoilt_one_in`` k, each table's rows whose student_id k divides have ``n/a`` in its place."""

    def one(name: str) -> None:
        rows = t.view(name)
        sid = F.col("student_id")
        text = F.when(sid % spoilt_one_in == 0, F.lit("n/a")).otherwise(sid.cast("string")) if spoilt_one_in else sid.cast("string")
        if name in NESTED:
            docs = nest_grades(rows).select(text.alias("student_id"), "grades")
            docs.write.json(os.path.join(out, f"{name}.json"))
        else:
            cells = [text.alias(c) if c == "student_id" else F.col(c).cast("string").alias(c) for c in DOMAIN[name].names]
            rows.select(*cells).write.options(header=True, quote='"', escape='"').csv(os.path.join(out, f"{name}.csv"))

    _at_once(t.spark, one, DOMAIN)
    return out
