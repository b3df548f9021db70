"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from textassay.llm.common import discard, shared_dir, written


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_only_a_local_session_may_leave_it_unset():
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "/shared/x/")) == "/shared/x"
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(shared_dir(session(master)))


def test_scratch_tables_can_be_dropped(spark):
    path, df = written(spark.range(3), "t")
    assert df.count() == 3 and path.startswith(shared_dir(spark))
    discard(spark, path)
    assert not os.path.exists(path)
