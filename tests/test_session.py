"""Checkpoint folder rule: the session's setting, a local fallback only in local mode."""

import pytest

from regsight import session as S


class _Ctx:
    def __init__(self, master, current=None):
        self.master, self._dir = master, current

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, path):
        self._dir = path


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Session:
    def __init__(self, master, configured=None, current=None):
        self.sparkContext, self.conf = _Ctx(master, current), _Conf(configured)


def test_existing_checkpoint_dir_is_kept():
    assert S.ensure_checkpoint_dir(_Session("yarn", current="hdfs://nn/ckpt")) == "hdfs://nn/ckpt"


def test_configured_folder_is_used():
    assert S.ensure_checkpoint_dir(_Session("yarn", configured="s3a://b/ckpt")) == "s3a://b/ckpt"


def test_local_mode_falls_back_to_a_local_folder():
    assert S.ensure_checkpoint_dir(_Session("local[4]")).startswith("/tmp/")


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(_Session("spark://master:7077"))


def test_scratch_paths_are_unique(spark):
    assert S.scratch_path(spark, "x") != S.scratch_path(spark, "x")
