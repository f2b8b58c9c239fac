"""What written tables leave on disk, and how large the batches are that workers get."""

import time

from quern.llm import arrow


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    found, before = spark.conf.get(setting), files()
    table = arrow.cut(spark.range(1000).selectExpr("id", "id % 7 AS key").repartition(4, "key"))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 1000 and spark.conf.get(setting) == found


def test_batches_are_bounded(spark):
    df = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    arrow.map_rows(df, lambda rows: rows, "text string")

    def sizes(batches):
        for batch in batches:
            yield arrow.pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert df.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * arrow.BATCH_BYTES
