"""The entry works without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def entry_of(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_without_the_operators_folder(tmp_path):
    for with_pipeline in (True, False):
        copy = tmp_path / f"copy{with_pipeline}"
        shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__") or (n == "corpus_pipeline.py" and not with_pipeline)])
        every, training, matched = entry_of(copy)
        assert int(every) > 100 and int(training) == 0 and matched == "True"
