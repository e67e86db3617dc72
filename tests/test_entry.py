"""The driver contract stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import __spark_entry__ as e
names = e.queries()
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= set(names)
"""


def test_queries_are_listed_without_the_optional_folders(tmp_path):
    for name in ("meshwork", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    # a folder that is left with nothing but compiled files counts as deleted
    (tmp_path / "meshwork" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, check=True, timeout=120)


def test_queries_are_listed_without_what_the_operators_need(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not installed', name='ahocorasick')\n")
    subprocess.run([sys.executable, "-W", "ignore", "-c", f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]\n{SCRIPT}"], cwd=tmp_path, check=True, timeout=120)
