import os
import tempfile

from opinio.streaming.ingest import ingest_raw_reviews


def test_append_ingest_resumes(spark):
    root = tempfile.mkdtemp(prefix="opinio-stream-")
    src, table, ckpt = (os.path.join(root, d) for d in ("in", "table", "ckpt"))
    os.makedirs(src)
    row = 'M,C,4.5 out of 5,"1,234 global ratings",T,ann,5.0 out of 5 stars,"body, with comma",0\n'
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(row * 3)
    q = ingest_raw_reviews(spark, src, table, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    # a second run picks up only the new file (the checkpoint remembers the first)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(row * 2)
    q = ingest_raw_reviews(spark, src, table, ckpt)
    q.awaitTermination(120)
    df = spark.read.parquet(table)
    assert df.count() == 5
    assert df.select("Review").distinct().collect()[0][0] == "body, with comma"
