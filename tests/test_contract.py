"""The contract module on copies of the repository."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_other_queries_stay_without_the_document_operators(tmp_path):
    for name in ("contract", "twinloom"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    found = names(tmp_path)
    assert "synthesize" in found and "bootstrap_scores" in found
    assert not [n for n in found if n.startswith("op") or n == "pipeline"]
    assert set(found) <= set(names(ROOT))
