import os
import subprocess
import sys

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(*e.queries())"
    got = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-800:]
    assert set(got.stdout.split()) == set(entry.queries())
