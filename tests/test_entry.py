import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), set(s) <= set(q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_part(tmp_path, pipeline):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skip)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    n, corpus, known = done.stdout.split()
    assert int(n) >= 157 and corpus == "0" and known == "True"
