"""Row numbers of a scan stay when the number of cores changes between the jobs of a query."""

import collections
import random

import pytest

from pyspark.sql import functions as F

from kymo.llm import exact_dedup, shuffle, simhash, suffix_dedup, topk, warc
from kymo.llm.common import shared_dir

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def cores(spark):
    """Sets the number of cores that jobs are planned for; the session's own settings come back at the end."""
    conf, cost = spark.sparkContext._jsc.sc().conf(), spark.conf.get("spark.sql.files.openCostInBytes")
    pinned = spark.conf.get(PARALLELISM, None)
    spark.conf.unset(PARALLELISM)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: conf.set("spark.default.parallelism", str(n))
    conf.remove("spark.default.parallelism")
    spark.conf.set("spark.sql.files.openCostInBytes", cost)
    spark.conf.set(PARALLELISM, pinned) if pinned else spark.conf.unset(PARALLELISM)


@pytest.fixture
def docs(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(600)) for _ in range(1000)]
    path = f"{tmp_path}/documents.parquet"
    rows = [(i, texts[i % 1000]) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 60_000).parquet(path)
    return spark.read.parquet(path)


def test_exact_dedup(spark, cores, docs):
    cores(4)
    out = exact_dedup.exact_dedup(docs)  # members are written
    cores(3)
    kept = collections.Counter(r["text_sha256"] for r in out.collect() if r["kept"])
    assert len(kept) == 1000 and set(kept.values()) == {1}


def test_shuffle(spark, cores, docs):
    cores(4)
    out = shuffle.shuffle_shards(docs, 3)  # the deal is written
    cores(3)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(2000))


@pytest.fixture
def planned(spark):
    """Sets what scans are planned for by the session's own setting."""
    before = spark.conf.get(PARALLELISM, None)
    yield lambda n: spark.conf.set(PARALLELISM, str(n))
    spark.conf.set(PARALLELISM, before) if before else spark.conf.unset(PARALLELISM)


@pytest.fixture
def files(spark, tmp_path):
    """24 files of documents with groups of copies, passages that come again, and vectors."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randrange(40, 90))) + (" " + passage if i % 9 == 0 else "") for i in range(700)]
    rows = [(i, texts[rng.randrange(700)] if i % 3 else texts[0], [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1200)]
    path = f"{tmp_path}/many.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>").repartition(24).write.parquet(path)
    return spark.read.parquet(path)


def made(planned, query):
    """What a query gives where the scans of its first jobs are planned for 8 cores and those of its last for 3."""
    planned(8)
    out = query()
    planned(3)
    return sorted(map(tuple, out.collect()), key=repr)


QUERIES = {
    "shuffle": lambda df: shuffle.shuffle_shards(df.select("doc_id"), 5).select("doc_id"),
    "exact": lambda df: exact_dedup.exact_dedup(df),
    "drop_exact": lambda df: exact_dedup.drop_duplicates(df).select("doc_id"),
    "drop_near": lambda df: simhash.drop_near_duplicates(df).select("doc_id"),
    "suffix": lambda df: suffix_dedup.remove_repeats(df, digest=True),
    "topk": lambda df: topk.top_k(df.withColumnRenamed("doc_id", "vec_id"), F.col("vec_id") % 50 == 0),
    "warc": lambda df: warc.round_trip(df, "doc_id", "text", "text"),
}


@pytest.mark.parametrize("name", QUERIES)
def test_other_cores_between_jobs(planned, files, name):
    planned(8)
    want = sorted(map(tuple, QUERIES[name](files).collect()), key=repr)
    assert made(planned, lambda: QUERIES[name](files)) == want
    if name == "shuffle":
        assert sorted(want) == [(i,) for i in range(1200)]
    if name == "exact":
        assert sum(r[3] for r in want) == len({r[4] for r in want})


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
