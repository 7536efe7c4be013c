from __future__ import annotations

from types import SimpleNamespace

import pytest

from dunning.llm.common import checkpoint_folder


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, **conf):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.split(".")[1], d)))


def test_the_named_folder_is_used_anywhere():
    for master in ("local[2]", "yarn", "local-cluster[3,2,1024]"):
        assert checkpoint_folder(session(master, checkpoint="hdfs://shared/x")) == "hdfs://shared/x"


def test_without_a_name_only_a_local_session_has_a_folder():
    assert checkpoint_folder(session("local[*]", sql="file:/w/")) == "file:/w/checkpoints"
    assert checkpoint_folder(session("local", sql="file:/w")) == "file:/w/checkpoints"
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            checkpoint_folder(session(master, sql="file:/w"))
