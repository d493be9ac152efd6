"""The registered queries: present, documented by SQL where SQL can say it, independent of the caller's folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    from glossmeter.plans.oracle import ORACLE
    from glossmeter.plans.queries import QUERIES
    assert set(ORACLE) == set(QUERIES)


SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
assert e.queries()['scripted_api_count'](spark, '/root/testdata/sf0.001').count() > 0
assert len(e.entry(spark).columns) == 14
print('done')
"""


def test_batch_functions_run_when_started_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "done" in done.stdout, done.stderr[-2000:]
