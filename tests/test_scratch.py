import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

from residua.sinks import scratch

ROOT = Path(__file__).resolve().parent.parent


def run(code: str, **settings: str) -> str:
    env = os.environ | {"PYTHONPATH": str(ROOT)} | settings
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert not done.returncode, done.stderr[-2000:]
    return done.stdout


def test_a_session_without_a_shared_folder(tmp_path):
    out = run(
        """
        import os
        from pyspark.sql import SparkSession
        from residua.sinks import scratch
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        @scratch.tidied
        def doubled(n):
            return scratch.settle(spark.range(n), "step").selectExpr("id * 2 AS x")
        assert doubled(4).agg({"x": "sum"}).first()[0] == 12
        at = scratch.shared_dir(spark)
        assert [x.split("-")[0] for x in os.listdir(at)] == ["doubled"]
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        print(at)
        spark.stop()
        """,
        SPARK_CONF_DIR=str(tmp_path),
    )
    assert not os.path.exists(out.strip())


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_the_entry_file_without_the_subpackage_or_its_libraries():
    for block in ("residua.llm", "ahocorasick", "corpus_pipeline"):
        out = run(f"""
            import sys
            sys.modules[{block!r}] = None
            import __spark_entry__ as e
            names = e.queries()
            assert set(e.oracle_sql()) <= set(names)
            print(len(names), "pipeline" in names, any(n.startswith("op") for n in names))
        """)
        n, pipeline, ops = out.split()
        assert int(n) > 100 and pipeline == "False" and ops == str(block == "corpus_pipeline")
