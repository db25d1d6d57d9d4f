"""The shared work folder."""

from types import SimpleNamespace

import pytest

from pollgauge.session import materialise, release, shared_dir


def session(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_gets_its_own_folder(master):
    assert shared_dir(session(master))


def test_release_removes_written_tables(spark):
    table = materialise(spark.range(5), "kept")
    path = table.inputFiles()[0].rpartition("/")[0]
    assert table.count() == 5
    assert release(spark) >= 1
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
