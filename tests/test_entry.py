"""The driver's contract."""

import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["decision", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_subpackage(tmp_path):
    """The entry imports, and everything else is there, where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "palisade", tmp_path / "palisade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'decisions' in n and not [x for x in n if x.startswith('op')] and 'pipeline' not in n; print(len(n))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 30, done.stderr
