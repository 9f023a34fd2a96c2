from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from glyphmill.plans import corpus


def _session(master, folder):
    """What ``work_dir`` asks a session for."""
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: folder))


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]", "yarn"])
def test_files_lie_where_all_executors_see_them(master, tmp_path):
    shared = tmp_path / "a b"
    for folder in (f"file://{tmp_path}/a%20b", str(shared)):
        root = corpus.work_dir(_session(master, folder))
        assert os.path.dirname(root) == str(shared) and os.stat(root).st_mode & 0o055 == 0o055
        corpus.lay_out(root, [("src/a.sol", "contract A {}")])
        assert corpus.out_dir(_session(master, folder)).startswith(folder)


def test_a_cluster_without_such_a_folder_is_refused():
    for folder in (None, "hdfs://host/shared"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            corpus.work_dir(_session("spark://host:7077", folder))
    assert corpus.out_dir(_session("spark://host:7077", "hdfs://host/shared")).startswith("hdfs://host/shared/")
