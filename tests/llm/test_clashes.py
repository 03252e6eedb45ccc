"""Extra columns with the names that operators use inside, and keys that aren't whole numbers."""

import pytest
from pyspark.sql import functions as F

from kymo.llm import exact_dedup, simhash, shuffle, topk, warc

NAMES = ["_row_", "_ROW__", "row", "key", "text_", "digest", "bytes", "shard_", "component_id", "fp"]


@pytest.fixture
def docs(spark):
    rows = [(i, f"one two three four {i // 2}", *[f"{n}-{i}" for n in NAMES]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("drop", [exact_dedup.drop_duplicates, simhash.drop_near_duplicates])
def test_extra_columns_stay(docs, drop):
    got = drop(docs)
    assert got.columns == docs.columns
    assert [(r["doc_id"], r["_row_"], r["_ROW__"], r["digest"]) for r in got.orderBy("doc_id").collect()] == [(i, f"_row_-{i}", f"_ROW__-{i}", f"digest-{i}") for i in range(0, 40, 2)]


def test_shards_keep_extra_columns(docs):
    got = shuffle.shuffle_shards(docs, 3)
    assert got.columns == [*docs.columns, "shard", "slot"] and got.count() == 40
    assert got.filter(F.col("_row_") != F.concat(F.lit("_row_-"), "doc_id")).isEmpty()


def test_keys_of_other_types(docs):
    named = docs.select(F.concat(F.lit("d"), F.lpad("doc_id", 2, "0")).alias("doc_id"), "text")
    assert exact_dedup.drop_duplicates(named).count() == 20
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(named).collect()) == [f"d{i:02}" for i in range(0, 40, 2)]
    with pytest.raises(TypeError, match="whole numbers"):
        exact_dedup.exact_dedup(named)
    with pytest.raises(TypeError, match="whole numbers"):
        warc.captures(named, "doc_id", "text", "text")
    with pytest.raises(TypeError, match="whole numbers"):
        topk.top_k(named.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), F.col("vec_id") == "d00")
