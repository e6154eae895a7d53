"""The driver's entry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s), sum(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q)"


def said(folder):
    done = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_the_rest_stands_alone(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "alone", ignore=skip)
    n, m, ops, pipeline = said(tmp_path / "alone")
    assert (ops, pipeline) == ("0", "False") and int(m) > 75 and int(n) >= int(m)


def test_a_missing_library_is_told(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "whole", ignore=skip)
    if not (tmp_path / "whole" / "quire" / "llm").exists():
        return
    (tmp_path / "whole" / "xxhash.py").write_text("raise ModuleNotFoundError('gone', name='xxhash')")
    (tmp_path / "whole" / "regex.py").write_text("raise ModuleNotFoundError('gone', name='regex')")
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "whole", capture_output=True, text=True, timeout=120)
    assert done.returncode and "regex" in done.stderr
