"""Versioned tables: replace-publish that never leaves a table half written.

A publish writes its rows into a fresh folder and then commits one numbered manifest that names it:

    <table>/data-<uuid>/...            the rows of a version
    <table>/_manifests/<number>.json   {"number", "data", "schema", "buckets"}

Readers take the manifest with the greatest number, so they see the old rows until the commit and the new ones after it. A
write that fails, or a driver that is lost before the commit, leaves an unnamed folder and the old version
in force. The commit is a rename that refuses an existing name, so of two publishers one takes the next
number. All file access goes through Hadoop's file systems: any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    schema: T.StructType
    buckets: tuple[str, int] | None = None


class NoVersion(LookupError):
    """The table has no committed version."""


def _hadoop(spark: SparkSession, path: str):
    """The JVM's file classes, the path and its file system."""
    fs = spark._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    return fs, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, table: str) -> list[int]:
    fs, p, system = _hadoop(spark, f"{table}/{MANIFESTS}")
    if not system.exists(p):
        return []
    names = [s.getPath().getName() for s in system.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read_text(spark: SparkSession, path: str) -> str:
    _, p, system = _hadoop(spark, path)
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit(spark: SparkSession, table: str, number: int, body: str) -> bool:
    """Creates the manifest of that number; False if another publisher has it."""
    fs, tmp, system = _hadoop(spark, f"{table}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = system.create(tmp, False)
    out.write(bytearray(body, "utf-8"))
    out.close()
    files = fs.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        files.rename(tmp, fs.Path(f"{table}/{MANIFESTS}/{number:020d}.json"), options)
        return True
    except Exception as e:  # py4j wraps the JVM's exception
        system.delete(tmp, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def versions(spark: SparkSession, table: str) -> list[Version]:
    """All committed versions, oldest first."""
    out = []
    for n in _numbers(spark, table):
        m = json.loads(_read_text(spark, f"{table}/{MANIFESTS}/{n:020d}.json"))
        buckets = tuple(m["buckets"]) if m.get("buckets") else None
        out.append(Version(n, f"{table}/{m['data']}", T.StructType.fromJson(m["schema"]), buckets))
    return out


def current(spark: SparkSession, table: str) -> Version:
    numbers = _numbers(spark, table)
    if not numbers:
        raise NoVersion(f"{table} has no committed version")
    n = numbers[-1]
    m = json.loads(_read_text(spark, f"{table}/{MANIFESTS}/{n:020d}.json"))
    return Version(n, f"{table}/{m['data']}", T.StructType.fromJson(m["schema"]), tuple(m["buckets"]) if m.get("buckets") else None)


def publish(df: DataFrame, table: str, buckets: tuple[str, int] | None = None, partition_by: tuple[str, ...] = ()) -> Version:
    """Replaces the table's rows: writes them to a fresh folder, then commits. An empty input is a version
    without rows (its schema is in the manifest). ``buckets`` (column, number) writes hash buckets sorted by
    the column, which ``read`` gives to the planner; ``partition_by`` are folder columns."""
    spark = df.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    if buckets:
        column, n = buckets
        scratch = f"publish_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(n, column).sortBy(column).option("path", f"{table}/{name}")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        try:
            writer.format("parquet").saveAsTable(scratch)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {scratch}")  # the name only: the folder is external
        columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
        schema = df.select(*columns).schema
    else:
        df.write.partitionBy(*partition_by).parquet(f"{table}/{name}") if partition_by else df.write.parquet(f"{table}/{name}")
        schema = df.schema
    while True:
        number = (_numbers(spark, table) or [0])[-1] + 1
        body = json.dumps({"number": number, "data": name, "schema": schema.jsonValue(),
                           "buckets": list(buckets) if buckets else None, "partition_by": list(partition_by)})
        if _commit(spark, table, number, body):
            return Version(number, f"{table}/{name}", schema, buckets)


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The rows of the current version (or of an earlier one, by number)."""
    if number is None:
        v = current(spark, table)
    else:
        v = next((x for x in versions(spark, table) if x.number == number), None)
        if v is None:
            raise NoVersion(f"{table} has no version {number}")
    if v.buckets:
        return _bucketed(spark, table, v)
    return spark.read.schema(v.schema).parquet(v.data)


def _bucketed(spark: SparkSession, table: str, v: Version) -> DataFrame:
    """A version with buckets, named in the session's catalog so that the planner knows its layout."""
    name = "snapshot_" + v.data.rsplit("data-", 1)[1]
    if not spark.catalog.tableExists(name):
        m = json.loads(_read_text(spark, f"{table}/{MANIFESTS}/{v.number:020d}.json"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields)
        parts = f"PARTITIONED BY ({', '.join(m['partition_by'])}) " if m["partition_by"] else ""
        column, n = v.buckets
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts}CLUSTERED BY ({column}) SORTED BY ({column}) INTO {n} BUCKETS "
                  f"LOCATION '{v.data}'")
        if m["partition_by"]:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def drop_older(spark: SparkSession, table: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest ``keep`` versions (manifest first, then rows); returns their numbers.
    Readers that resolved an older version before must have finished."""
    gone = []
    for v in versions(spark, table)[:-keep] if keep > 0 else []:
        _, manifest, system = _hadoop(spark, f"{table}/{MANIFESTS}/{v.number:020d}.json")
        system.delete(manifest, False)
        system.delete(_hadoop(spark, v.data)[1], True)
        gone.append(v.number)
    return gone
