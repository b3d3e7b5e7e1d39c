"""The driver's contract holds with and without the optional part."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    from shutil import copy, copytree, ignore_patterns

    copytree(f"{HERE}/tidemill", tmp_path / "tidemill", ignore=ignore_patterns("llm", "__pycache__"))
    copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pricing_summary' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
