"""Results and plans in a session without any setting of the library: what a user's own session sees."""
import os
import subprocess
import sys
import textwrap

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false") == "false"
from opinio.operators.sentiment import fixture_word_info, score_sentiment
from opinio.plans.catalog import QUERIES
from opinio.plans.enrich import add_features, cleaned
SF = "/root/testdata/sf0.001"
words = {{r.token: r for r in fixture_word_info(spark).collect()}}
assert words["was"].valence == -1.5 and words["was"].boost is None and words["was"].neg is False
assert words["of"].valence is None and words["of"].boost == 0.293 and words["in"].neg is True
df = score_sentiment(add_features(cleaned(spark, SF)), fixture_word_info(spark)).select("review_key", "Sentiment_Score")
df.write.format("noop").mode("overwrite").save()
plan = df._jdf.queryExecution().executedPlan().toString()
assert plan.count("Exchange hashpartitioning") == 2, plan      # reviews and tokens by the review's key, no token rows
shares = {{r.Polarity: r["count"] for r in QUERIES["agg11_polarity_share"](spark, SF).collect()}}
assert len(shares) == 3, shares
print("SHARES", sorted(shares.items()))
"""


def run(script, tmp_path):
    code = textwrap.dedent(script).format(here=HERE, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_sentiment(tmp_path):
    assert "SHARES [('Negative', 40), ('Neutral', 20), ('Positive', 125)]" in run(SCRIPT, tmp_path)


CLEAN_UP = """
import os, sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
from opinio.sources.sinks import written
df = written(spark.range(5), "some")
assert df.count() == 5 and [x for x in os.listdir({folder!r}) if x.startswith("some-")]
spark.stop()
"""


def test_scratch_tables_go_with_the_driver(tmp_path):
    import time
    run(CLEAN_UP, tmp_path)
    for _ in range(50):                                       # the driver's process ends a little later
        if not [x for x in (tmp_path / "shared").iterdir() if x.name.startswith("some-")]:
            break
        time.sleep(0.2)
    assert not [x for x in (tmp_path / "shared").iterdir() if x.name.startswith("some-")]
