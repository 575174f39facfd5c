"""Where work tables go, by the kind of session and its settings."""

import os
from types import SimpleNamespace

import pytest

from itemnorm.session import cut, work_folder


class Session:
    """A session as a cluster would show it: another master, no checkpoint folder but the given one."""

    def __init__(self, spark, master, folder=None, context_folder=None, warehouse=None, seen=None):
        conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": warehouse}
        self.spark, self.seen = spark, seen
        self.conf = SimpleNamespace(get=lambda key, *default: conf[key])
        real = spark.sparkContext
        self.sparkContext = SimpleNamespace(
            master=master, applicationId=f"{real.applicationId}-{warehouse}", defaultParallelism=3, _jvm=real._jvm, _jsc=real._jsc,
            getCheckpointDir=lambda: context_folder,
        )

    def range(self, *args):
        return self.spark.range(*args)

    @property
    def read(self):
        if self.seen is None:
            return self.spark.read
        frame = SimpleNamespace(count=lambda: self.seen)
        return SimpleNamespace(schema=lambda schema: SimpleNamespace(parquet=lambda path: frame))


CLUSTERS = ["spark://host:7077", "yarn", "k8s://https://host:443", "local-cluster[2,1,1024]"]


@pytest.mark.parametrize("master", CLUSTERS)
def test_shared_folder_without_a_scheme(spark, tmp_path, master):
    base = f"{tmp_path}/shared"
    folder = work_folder(Session(spark, master, base))
    assert folder.startswith(f"{base}/itemnorm-") and folder != work_folder(Session(spark, master, base))
    assert os.listdir(base) == [], "what was tried is removed"
    assert cut(spark.range(5), folder, "t").count() == 5


@pytest.mark.parametrize("master", CLUSTERS)
def test_folder_of_one_machine_is_refused(spark, tmp_path, master):
    with pytest.raises(RuntimeError, match="folder of one machine"):
        work_folder(Session(spark, master, f"{tmp_path}/own", seen=1))
    (tmp_path / "file").write_text("")
    with pytest.raises(RuntimeError, match="cannot write"):
        work_folder(Session(spark, master, f"{tmp_path}/file"))


@pytest.mark.parametrize("master", CLUSTERS)
def test_cluster_without_a_checkpoint_folder(spark, tmp_path, master):
    of_context = f"file:{tmp_path}/context"
    assert work_folder(Session(spark, master, context_folder=of_context)).startswith(of_context)
    folder = work_folder(Session(spark, master, warehouse=f"file:{tmp_path}/warehouse"))
    assert folder.startswith(f"file:{tmp_path}/warehouse/itemnorm-")
    assert cut(spark.range(5), folder, "t").count() == 5


class OwnFolder(Session):
    """Of what tasks write into ``own``, the driver sees one file."""

    def __init__(self, *args, own, **kwargs):
        super().__init__(*args, **kwargs)
        self.own, self.tried = own, []

    @property
    def read(self):
        def parquet(path):
            self.tried.append(path)
            return SimpleNamespace(count=lambda: 1) if path.startswith(self.own) else self.spark.read.parquet(path)

        return SimpleNamespace(schema=lambda schema: SimpleNamespace(parquet=parquet))


@pytest.mark.parametrize("master", CLUSTERS)
def test_warehouse_takes_the_place_of_a_folder_that_is_not_shared(spark, tmp_path, master):
    own, warehouse = f"{tmp_path}/own", f"file:{tmp_path}/warehouse"
    session = OwnFolder(spark, master, own, warehouse=warehouse, own=own)
    folder = work_folder(session)
    assert folder.startswith(f"{warehouse}/itemnorm-") and folder != work_folder(session)
    assert len(session.tried) == 2, "each folder is tried once"
    assert cut(spark.range(5), folder, "t").count() == 5
    (tmp_path / "file").write_text("")
    unwritable = Session(spark, master, f"{tmp_path}/file", warehouse=f"file:{tmp_path}/warehouse2")
    assert work_folder(unwritable).startswith(f"file:{tmp_path}/warehouse2/itemnorm-")
    of_context = Session(spark, master, context_folder=f"file:{tmp_path}/file", warehouse=f"file:{tmp_path}/warehouse3")
    assert work_folder(of_context).startswith(f"file:{tmp_path}/warehouse3/itemnorm-")


def test_named_scheme_and_local_session_are_not_tried(spark, tmp_path):
    assert work_folder(Session(spark, "yarn", "hdfs://name/folder", seen=0)).startswith("hdfs://name/folder/itemnorm-")
    assert work_folder(Session(spark, "local[2]", f"{tmp_path}/x", seen=0)).startswith(f"{tmp_path}/x/itemnorm-")
    assert os.path.isdir(os.path.dirname(work_folder(Session(spark, "local[2]"))))
