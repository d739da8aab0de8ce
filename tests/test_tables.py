"""The folder of stored rounds."""

from types import SimpleNamespace

import pytest

from arcwarden import tables


def session(master, folder=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(session(master))
    assert tables.shared_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_may_do_without(master):
    own = session(master)
    assert tables.shared_dir(own).startswith("file:///") and tables.shared_dir(own) == tables.shared_dir(own)
