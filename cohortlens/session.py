"""Spark session defaults for the library and its tests."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cluster_settings(total_cores: int, input_bytes: int) -> dict[str, str]:
    """Partition sizing for a cluster run, from the core count and the input volume.

    Scans: ~512 MiB splits (100 TB → ~200k scan tasks, many waves, each fits in memory).
    Shuffles: start at 4× the cores (at least one partition per 2 GiB of input) and let
    AQE coalesce toward 256 MiB partitions; skewed partitions above 5× the median and
    1 GiB are split. Broadcasts stay behind AQE's runtime size check (64 MiB).
    """
    shuffle = max(4 * total_cores, input_bytes // (2 << 30), 200)
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cohortlens", extra: dict[str, str] | None = None,
                  total_cores: int | None = None, input_bytes: int = 0) -> SparkSession:
    """Return (or create) a session with the settings every plan assumes.

    With ``total_cores`` the partition sizes of ``cluster_settings`` apply. UTC session time
    zone (timestamps are wall-clock NTZ in the inputs), ANSI on (Spark 4
    default; all rates go through ``try_divide``), AQE with partition coalescing and
    skew-join splitting, and no UI server.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    sized = cluster_settings(total_cores, input_bytes) if total_cores else {}
    for k, v in (sized | (extra or {})).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the cluster names it in ``spark.checkpoint.dir``.

    Only a single-machine session (master ``local``/``local[n]``) that leaves it unset gets a
    fresh folder of its own; a cluster session without the setting is an error, since other
    machines could not read what one of them wrote.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    """SQL settings for the queries that run inside; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Queries run inside drop their shuffle files as they end, not when the driver happens to collect its garbage. For
    results that are whole by then: tables written and rows sent to the driver."""
    return settings(spark, {FREE_SHUFFLES: "true"})


def materialize(df, name: str = "cut", **options: str):
    """Cut the lineage by writing ``df`` as a Parquet table in the shared checkpoint folder
    and reading it back (lazily).

    One compute pass (an eager ``checkpoint()`` of an uncached plan computes it twice:
    once to count, once to write). Task retries and the job commit protocol make the write
    safe under executor loss; the table lives in ``spark.checkpoint.dir``, never in a
    machine-local folder. ``options`` go to the Parquet writer (``compression="zstd"``).
    The write's own shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    out = spark.read.parquet(path)
    out._scratch = path
    if scopes := getattr(_scopes, "made", None):
        scopes[-1].append(out)
    return out


_scopes = threading.local()


@contextmanager
def used_up() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are discarded at the end, but those given to the function that is yielded
    (which returns them). What is read from the others must be written by then."""
    scopes = _scopes.__dict__.setdefault("made", [])
    scopes.append([])
    kept = []
    try:
        yield lambda df: kept.append(df) or df
    finally:
        made = scopes.pop()
        discard(*[df for df in made if not any(df is k for k in kept)])
        if scopes:
            scopes[-1].extend(kept)


def discard(*tables) -> None:
    """Deletes tables that ``materialize`` returned, when whatever was read from them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
