import time

from pyspark.sql import functions as F

from weftlink.lineage import _CLEAN, cut_lineage, cut_table


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before, mode = _shuffle_files(spark), spark.conf.get(_CLEAN, None)
    made = cut_lineage(spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count())
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(_CLEAN, None) == mode
    assert made.groupBy("count").count().collect() == [(100, 100)]


def test_a_table_is_smaller_than_its_texts(spark):
    texts = spark.range(0, 2_000, 1, 4).select("id", F.array(F.repeat(F.lit("some words of a page "), 50)).alias("texts"))
    made = cut_table(texts.groupBy("id").agg(F.first("texts").alias("texts")))
    size = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.inputFiles()[0]).getParent()
    size = size.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(size).getLength()
    assert size < 2_000 * 1_050 / 4 and made.count() == 2_000 and made.agg(F.sum(F.length(F.get("texts", F.lit(0))))).first()[0] == 2_000 * 1_050
    assert cut_table(made.where("id < 0")).count() == 0
