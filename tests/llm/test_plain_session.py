"""Operators in a session without any setting of the library: what a user's own session sees."""
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from opinio.llm.registry import QUERIES
SF = "/root/testdata/sf0.001"
quality = QUERIES["op5_quality"](spark, SF)
assert quality.count() == 200 and quality.where("kept").count() > 0
centroids = QUERIES["op13_centroids"](spark, SF)
assert centroids.count() == 500 and centroids.where("centroid_sha256 IS NULL").count() == 0
lines = QUERIES["op3_line_dedup"](spark, SF)
assert lines.count() == 200 and lines.where("n_dropped > 0").count() > 0
"""


def test_operators(tmp_path):
    code = SCRIPT.format(here=HERE, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900, cwd=tmp_path,
                          env=os.environ | {"PYTHONPATH": HERE})                # the workers import the library, too
    assert done.returncode == 0, done.stderr[-3000:]
