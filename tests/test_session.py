"""Where scratch tables go, and code on the executors."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from forumlens.session import scratch_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError):
        scratch_folder(session(master), "x")
    assert scratch_folder(session(master, "hdfs://n/shared"), "x").startswith("hdfs://n/shared/x-")


def test_queries_run_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as entry\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', entry.queries()['retrieve_topk'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50" in done.stdout, done.stderr[-2000:]


def test_other_queries_do_without_the_libraries_of_some():
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "for name in ('duckdb', 'public_tokenizers', 'numpy.nothing'):\n"
        "    sys.modules[name] = None\n"
        "import __spark_entry__ as entry\n"
        "print('dashboard_charts' in entry.queries(), 'op2_byte_bpe' in entry.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "True False" in done.stdout and "public_tokenizers" in done.stderr, done.stderr[-2000:]
