"""The driver's entry points can be read before there is a session, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), *sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


def said(at) -> list[str]:
    got = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})
    assert got.returncode == 0, got.stderr[-800:]
    return got.stdout.split()


def test_import_without_a_session(tmp_path):
    for name in ("quern", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    whole = said(tmp_path)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    rest = said(tmp_path)
    assert len(rest) == 1 and int(rest[0]) == int(whole[0]) - len(whole) + 1
