"""Nested grade documents (S4 read, S7 flatten) and a plain overwriting sink.

The raw grade export is one JSON document per student holding a list of grade objects.
We write JSON *Lines* (splittable); the reader also takes a file that holds one top-level
array. The writer nests per (student, day) rather than per student, so no document grows
with a student's whole history; the reader and flattener accept any document grain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_path

GRADE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("max_score", T.DoubleType()),
])
GRADES_DOC = T.StructType([
    T.StructField("student_id", T.LongType()),
    T.StructField("grades", T.ArrayType(GRADE)),
])


def nest_grades(flat: DataFrame) -> DataFrame:
    """(student_id, type, date, score[, max_score]) → documents (student_id, grades[]), one
    document per student and day."""
    ms = F.col("max_score") if "max_score" in flat.columns else F.lit(None).cast("double")
    g = flat.select("student_id", F.to_date("date").alias("_day"),
                    F.struct(F.col("type").cast("string").alias("type"), F.col("date").cast("string").alias("date"),
                             F.col("score").cast("double").alias("score"), ms.alias("max_score")).alias("_g"))
    return g.groupBy("student_id", "_day").agg(F.collect_list("_g").alias("grades")).drop("_day")


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Writes a folder anew: Spark deletes the old rows first, so a failed write leaves nothing. For
    scratch folders that nobody else reads; tables that others read go through ``snapshots.publish`` (S6)."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_nested_grades(spark: SparkSession, flat: DataFrame) -> str:
    """Write the nested documents as JSON Lines under the shared checkpoint folder."""
    return publish(nest_grades(flat), scratch_path(spark, "raw_grades"), "json")


def read_nested_grades(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Declared-schema JSON read (no inference pass). ``array_file``: each file holds one
    top-level array of documents instead of a document per line."""
    return spark.read.schema(GRADES_DOC).option("multiLine", array_file).json(path)


def flatten_grades(docs: DataFrame) -> DataFrame:
    """One row per grade; the outer ``student_id`` wins over any inner one; a missing
    list yields no rows. Dates are parsed leniently (bad text → NULL)."""
    inner = [f.name for f in docs.schema["grades"].dataType.elementType.fields if f.name != "student_id"]
    g = docs.select("student_id", F.explode("grades").alias("_g"))
    return g.select("student_id", *[F.col(f"_g.{n}").alias(n) for n in inner]) \
            .withColumn("date", F.col("date").try_cast("timestamp_ntz"))
