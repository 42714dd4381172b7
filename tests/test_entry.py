"""The entry point has to work where the optional subpackage and its tests are absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for keep_pipeline in (True, False):
        home = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, home, ignore=skip)
        if not keep_pipeline:
            (home / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; names = e.queries(); assert 'kmer_filter' in names and not any(n.startswith('op1_') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= set(names)"
        subprocess.run([sys.executable, "-c", code], cwd=home, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
