"""The driver's entry, with and without the optional operators."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT

from tidewheel import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_engine_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_operators():
    code = """
import sys
sys.modules["tidewheel.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert "asof" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ)
