"""The driver's module without the optional folders, and the shared folder's rule."""

import os
import shutil
import subprocess
import sys

import pytest

from edictum.sources import shared

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_subpackage(tmp_path, pipeline):
    shutil.copytree(f"{ROOT}/edictum", tmp_path / "edictum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}") and (pipeline or name[0] == "_"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    found, optional = map(int, done.stdout.split())
    assert found > 50 and optional == 0


def test_a_cluster_must_name_the_shared_folder():
    class Named:
        def __init__(self, master):
            self.conf = {}
            self.sparkContext = self
            self.master, self._jsc = master, self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Named(master))
