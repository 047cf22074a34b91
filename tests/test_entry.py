import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["path", "track_id", "bpm", "standard", "camelot"]


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'track_catalogue' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_the_rest_works_when_only_the_folders_are_gone(tmp_path):
    """With corpus_pipeline.py in place: neither it nor what it imports is asked for."""
    shutil.copytree(ROOT / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'track_catalogue' in q and 'pipeline' not in q; assert e.oracle_sql() and set(e.oracle_sql()) <= set(q)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    (tmp_path / "cadenza" / "llm" / "__pycache__").mkdir(parents=True)  # a folder that holds no modules is no subpackage
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
