"""The driver contract holds before any session exists, and with the optional subpackage or without."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o), sum(k.startswith('p') and k[1].isdigit() for k in q))"


def _say(folder: str) -> list[int]:
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return list(map(int, done.stdout.split()))


def test_entry_without_a_session(tmp_path):
    whole = _say(ROOT)
    assert whole[0] > 100 and whole[1] > 90
    shutil.copytree(os.path.join(ROOT, "quillstone"), tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    core = _say(str(tmp_path))
    assert core[2] == 0 and core[0] == whole[0] - whole[2]
