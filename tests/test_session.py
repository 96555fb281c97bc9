"""Session helpers: the shared checkpoint folder is read from the session, and cluster
partition sizing follows cores and volume."""

import os
import time

import pytest

from cohortlens import session
from cohortlens.session import checkpoint_dir, cluster_settings, materialize, scratch_path


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = checkpoint_dir(spark)
    assert d and d == checkpoint_dir(spark)
    assert scratch_path(spark, "x").startswith(d)


def test_materialize_writes_under_the_checkpoint_dir(spark):
    df = materialize(spark.range(10).selectExpr("id", "id * 2 AS v"), "probe")
    assert df.count() == 10
    assert any(checkpoint_dir(spark).rstrip("/") in p for p in df.inputFiles())


def test_cluster_settings_scale_with_cores_and_volume():
    small = cluster_settings(16, 10 << 30)
    big = cluster_settings(8000, 100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 51200
    assert big["spark.sql.files.maxPartitionBytes"] == str(512 << 20)


def test_a_cluster_must_name_the_shared_folder():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/folder"
    assert checkpoint_dir(Session()) == "hdfs://shared/folder"
    assert "spark.checkpoint.dir" not in Conf({"spark.master": "local-cluster[2,1,1024]"})
    Session.conf = Conf({"spark.master": "local-cluster[2,1,1024]"})
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def _shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(session.FREE_SHUFFLES)
    out = session.materialize(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 7 and spark.conf.get(session.FREE_SHUFFLES) == setting


def test_discarded_tables_are_gone(spark):
    one, other = (session.materialize(spark.range(5), n) for n in ("one", "other"))
    session.discard(one)
    assert not os.path.exists(one._scratch) and other.count() == 5
