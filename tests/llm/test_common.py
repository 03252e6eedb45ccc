"""Files of queries side by side, and samples of rows that repeat."""

import threading

import pytest
from pyspark.sql import functions as F

from kymo.llm import common, exact_dedup, html_text
from kymo.session import remove_path


def exists(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"text {i // 3}") for i in range(60)], "doc_id long, text string")


def test_a_stage_leaves_other_queries_alone(spark, docs):
    """Another thread deduplicates while a stage runs; its files are read after the stage has ended."""
    inside, done, results = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        results.append(exact_dedup.exact_dedup(docs))
        done.set()

    def stage():
        out = exact_dedup.drop_duplicates(docs)
        inside.set()
        assert done.wait(120)
        return out

    thread = threading.Thread(target=other)
    thread.start()
    kept = common.finished(stage, "stage")
    thread.join()
    assert results[0].filter("kept").count() == 20 and kept.count() == 20


def test_stages_within_a_stage(spark, docs):
    inner = []

    def stage():
        inner.append(common.finished(lambda: exact_dedup.drop_duplicates(docs), "inner"))
        return inner[0].filter("doc_id > 3")

    out = common.finished(stage, "outer")
    assert exists(spark, out._kymo_path) and not exists(spark, inner[0]._kymo_path) and out.count() == 18
    after = common.finished(lambda: out.limit(2), "after", out)
    assert not exists(spark, out._kymo_path) and after.count() == 2


def test_a_stage_that_fails_removes_nothing_of_others(spark, docs):
    other = common.written(docs, "other")
    with pytest.raises(ZeroDivisionError):
        common.finished(lambda: 1 / 0, "broken")
    assert other.count() == 60


def test_temporary_files(spark, docs):
    with common.temporary(spark) as made:
        assert exact_dedup.exact_dedup(docs).filter("kept").count() == 20
        assert len(made) == 2 and all(exists(spark, p) for p in made)
        kept = made.pop()
    assert exists(spark, kept) and not any(exists(spark, p) for p in made)
    remove_path(spark, kept)


def test_lowest_of_repeated_rows(spark):
    df = spark.range(20_000).select(F.lit("the same").alias("text"))
    for seed in range(4):
        assert common.lowest(df, F.xxhash64("text", F.lit(seed)), 400).count() == 400
    mixed = df.limit(500).union(spark.range(3000).select(F.col("id").cast("string")))
    order = F.xxhash64("text")
    want = [r[0] for r in mixed.select(order.alias("o")).orderBy("o").limit(100).collect()]
    assert [r[0] for r in common.lowest(mixed, order, 100).select(order.alias("o")).orderBy("o").collect()] == want
    assert common.lowest(df.limit(3), order, 100).count() == 3 and common.lowest(df.limit(0), order, 100).count() == 0


def test_weights_from_one_page_many_times(spark):
    page = "<html><body><nav><a href='x'>menu</a></nav><article><p>Some words of the article itself.</p></article><footer>foot</footer></body></html>"
    once = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit(page).alias("html"))
    assert html_text.learn_weights(many) != html_text.learn_weights(many.limit(0))
    assert html_text.learn_weights(many.limit(400)) == html_text.learn_weights(many) and html_text.learn_weights(once) is not None


def test_partitions_follow_bytes(spark, monkeypatch):
    """Many buckets, few partitions: the groups are the same."""
    monkeypatch.setattr(exact_dedup, "PARTITION_BYTES", 1 << 30)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id") % 700).alias("text"))
    got = exact_dedup.exact_dedup(df, table_bytes=4000)
    assert got.filter("kept").count() == 700 and got.agg(F.max("group_size")).first()[0] == 5
