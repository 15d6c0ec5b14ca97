"""The shared folder of sessions that name one, and of those that do not."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

PLAIN = """
import os, sys
import __spark_entry__ as entry
from telespark.functions import lineage
from telespark.plans.session import build_session
spark = build_session("2", partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in ("span_tree", "load_logs"):
    assert entry.queries()[name](spark, sys.argv[1]).count() > 0, name
folder = lineage.shared_folder(spark)
assert folder == lineage.shared_folder(spark) and os.listdir(folder)
print(folder)
spark.stop()
"""


def test_a_plain_session_gets_a_folder_that_goes_with_it(tmp_path):
    run = subprocess.run([sys.executable, "-c", PLAIN, SF], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not os.path.exists(run.stdout.split()[-1])


def test_a_named_folder_is_used_and_a_cluster_needs_one(tmp_path):
    code = """
import sys
from telespark.functions import lineage
from telespark.plans.session import build_session
spark = build_session("1", **{"spark.checkpoint.dir": sys.argv[1]})
assert lineage.shared_folder(spark) == sys.argv[1]
lineage.written(spark.range(3), "three")
spark.stop()
"""
    run = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("three")]


def test_a_cluster_without_a_folder_is_refused():
    from telespark.functions import lineage

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

    with pytest.raises(ValueError):
        lineage.shared_folder(Session)
