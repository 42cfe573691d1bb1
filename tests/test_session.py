"""Where scratch data goes."""

from types import SimpleNamespace

import pytest

from propensity.session import scratch_path, shared_folder


class FakeContext:
    def __init__(self, master, folder=None):
        self.master = master
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"{folder}/application"


def fake(master, folder=None, **conf):
    settings = {name.replace("__", "."): value for name, value in conf.items()}
    return SimpleNamespace(sparkContext=FakeContext(master, folder), conf=settings)


def test_the_named_folder_is_used():
    assert shared_folder(fake("yarn", "hdfs:/set")) == "hdfs:/set"
    assert shared_folder(fake("yarn", spark__checkpoint__dir="hdfs:/named")) == "hdfs:/named/application"


def test_a_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://host:7077"))


def test_a_local_session_gets_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    assert shared_folder(fake("local[4]")).startswith(str(tmp_path))


def test_paths_are_new(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_scope_leaves_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor
    from contextvars import copy_context
    from pathlib import Path

    from propensity.session import scratch
    from propensity.sources import stage

    def files():
        return set(Path(shared_folder(spark).removeprefix("file:")).rglob("*"))

    before = files()
    with pytest.raises(KeyError):
        with scratch(spark) as folder:
            assert stage(spark.range(3), "inside").count() == 3
            with ThreadPoolExecutor(1) as pool:
                path = pool.submit(copy_context().run, scratch_path, spark, "thread").result()
            assert path.startswith(folder) and files() != before
            raise KeyError
    assert files() == before
    assert not scratch_path(spark, "after").startswith(folder)
