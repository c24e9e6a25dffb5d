"""The folder of a run on a cluster whose disks Spark cannot tell apart by their path."""

from types import SimpleNamespace

import pytest

from votemill import runtime


class Cluster:
    """The test session under the master and the settings of a cluster; ``kept`` says which of the written rows come back."""

    def __init__(self, spark, name, settings, kept="true"):
        self.spark, self.kept = spark, kept
        self.sparkContext = SimpleNamespace(master="spark://one:7077", applicationId=name, defaultParallelism=2)
        self.conf = SimpleNamespace(get=lambda key, *default: settings.get(key, *default))

    def range(self, *args):
        return self.spark.range(*args).where(self.kept)

    def __getattr__(self, name):
        return getattr(self.spark, name)


@pytest.mark.parametrize("setting", ["spark.checkpoint.dir", "spark.sql.warehouse.dir"])
@pytest.mark.parametrize("scheme", ["", "file:"])
def test_shared_folder_is_used_whichever_way_it_is_named(spark, tmp_path, setting, scheme):
    cluster = Cluster(spark, f"app-{setting}-{scheme}", {"spark.sql.warehouse.dir": "/nowhere", setting: f"{scheme}{tmp_path}/"})
    path = runtime.fresh_path(cluster, "ranges")
    assert path.startswith(f"{scheme}{tmp_path}/votemill-app-") and runtime.saved(spark.range(5), path).count() == 5
    assert runtime.fresh_path(cluster, "ranges").rpartition("/")[0] == path.rpartition("/")[0]
    runtime.clean(cluster.sparkContext.applicationId)
    assert not list(tmp_path.iterdir())


def test_folder_that_loses_rows_is_an_error(spark, tmp_path):
    """As where each machine writes to a disk of its own and the driver finds what its own executors wrote."""
    cluster = Cluster(spark, "app-lost", {"spark.checkpoint.dir": f"file:{tmp_path}"}, kept="id % 3 = 0")
    with pytest.raises(RuntimeError, match="3 of 8 rows"):
        runtime.fresh_path(cluster, "ranges")
    assert not list(tmp_path.iterdir())
