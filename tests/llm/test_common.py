import types

import pytest

from lumenfold.llm import _common


def test_clusters_need_a_shared_folder(tmp_path, monkeypatch):
    def session(master, conf=None, context=None):
        held = types.SimpleNamespace(master=master, getCheckpointDir=lambda: context, setCheckpointDir=lambda at: None)
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: conf), sparkContext=held)

    monkeypatch.setattr(_common.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    for master in ("local", "local[4]", "local[*]", "local[2, 3]"):
        assert _common.shared_dir(session(master)) == str(tmp_path)
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://https://host"):
        with pytest.raises(ValueError):
            _common.shared_dir(session(master))
        assert _common.shared_dir(session(master, "file:///shared/")) == "file:///shared"
