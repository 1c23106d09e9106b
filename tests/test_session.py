"""Choice of the shared folder, on stand-ins for sessions of a cluster."""

from types import SimpleNamespace

import pytest

from changeflow.session import CHECKPOINT_SETTING, shared_folder, work_path


def session(master, session_conf=None, context_conf=None):
    session_conf, context_conf = session_conf or {}, context_conf or {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: session_conf.get(k, d), set=session_conf.__setitem__),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: context_conf.get(k))))


def test_named_folder_is_used():
    assert shared_folder(session("yarn", {CHECKPOINT_SETTING: "hdfs://nn/ck/"})) == "hdfs://nn/ck"
    assert shared_folder(session("yarn", None, {CHECKPOINT_SETTING: "s3a://b/ck"})) == "s3a://b/ck"
    assert work_path(session("yarn", {CHECKPOINT_SETTING: "hdfs://nn/ck"}), "x").startswith("hdfs://nn/ck/x-")


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))


def test_local_session_keeps_its_folder():
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)
