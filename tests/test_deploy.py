"""Driver entry points make the package importable by Python workers."""

import os
import subprocess
import sys

from feedlens import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_ship_package_once_per_application(spark):
    session.ship_package(spark)
    before = set(session._SHIPPED)
    session.ship_package(spark)
    assert session._SHIPPED == before and spark.sparkContext.applicationId in before


def test_udf_query_runs_from_another_directory(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "rows = E.queries()['spearman'](s, '/root/testdata/sf0.001').collect()\n"
        "print('ROWS', len(rows), rows[0].p_value is not None)\n" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 1 True" in out.stdout, out.stderr[-2000:]
