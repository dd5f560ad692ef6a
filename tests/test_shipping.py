"""The package reaches workers that do not have it on their path."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
print('ROWS', e.queries()['subdoc_counter'](spark, sys.argv[1]).count())
"""


def test_from_another_folder(tmp_path, sf, monkeypatch):
    monkeypatch.delenv("PYTHONPATH", raising=False)
    run = subprocess.run([sys.executable, "-c", CODE, sf], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 1000" in run.stdout or "ROWS" in run.stdout, run.stderr[-2000:]
