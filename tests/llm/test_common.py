import os
from types import SimpleNamespace

import pytest

from folioflow.llm import common


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=conf.get)),
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__),
    )


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "s3a://bucket/x/")) == "s3a://bucket/x"
    assert common.shared_dir(session("local[4]")).startswith("file://")


def test_forgotten_tables_leave_no_files(spark):
    table = common.materialize(spark.range(10).repartition(3), "test-forget")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert table.count() == 10 and os.path.isdir(folder)
    common.forget(table)
    assert not os.path.exists(folder)
