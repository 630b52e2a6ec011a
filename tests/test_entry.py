import json
import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_runs_without_the_llm_folder(tmp_path):
    """The rest imports and lists its queries where the subpackage is gone."""
    import os
    import shutil

    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "corpusforge"), tmp_path / "corpusforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    run = "import json, __spark_entry__ as e; from corpusforge.runtime import session; s = session('local[2]', 2); assert e.entry(s).count() > 0; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.strip().splitlines()[-1])
    assert "p6_found" in names and "p1_found" not in names and "corpus_stats_rareness" in names
