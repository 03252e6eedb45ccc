"""Exact shuffles and mixes."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import mixing, shuffle


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema).repartition(5)


# ---- shuffle ----


@pytest.mark.parametrize("rows,shards", [(0, 4), (3, 7), (1003, 7), (40, 40)])
def test_sizes_and_slots(spark, rows, shards):
    df = frame(spark, [(i if i % 9 else None, "same" if i % 3 else None, "s") for i in range(rows)])
    got = shuffle.shuffle_shards(df, shards)
    assert got.columns == [*df.columns, "shard", "slot"]
    slots = collections.defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    sizes = sorted(len(v) for v in slots.values()) + [0] * 0
    assert sum(sizes) == rows and (not sizes or max(sizes) - (min(sizes) if len(sizes) == shards else 0) <= 1)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, map(tuple, df.collect())))


def test_reruns_agree_and_seeds_differ(spark, tmp_path):
    frame(spark, [(i, "t", "s") for i in range(300)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle.shuffle_shards(df, 6, seed).collect()}
    first = place(1)
    assert first == place(1) and first != place(2)
    assert place(3) != {}


def test_names_that_clash(spark):
    with pytest.raises(ValueError):
        shuffle.shuffle_shards(frame(spark, [(1, "t", "s")]).withColumnRenamed("source", "Shard"), 2)


def test_unstable_input_is_written_first(spark):
    df = frame(spark, [(i, "t", "s") for i in range(50)]).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert shuffle.shuffle_shards(df, 3).select("doc_id").distinct().count() == 50


def test_matrix_has_exact_margins():
    parts, sizes = [10, 0, 7, 30, 1], shuffle.shard_sizes(48, 5)
    m = shuffle.communication_matrix(parts, sizes, 3)
    assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_matrix_is_distributed_as_a_uniform_shuffle():
    """Chi-square of the first cell against the hypergeometric mass function."""
    counts = collections.Counter(int(shuffle.communication_matrix([6, 9], [5, 10], seed)[0, 0]) for seed in range(3000))
    mass = {k: math.comb(5, k) * math.comb(10, 6 - k) / math.comb(15, 6) for k in range(6)}
    chi = sum((counts[k] - 3000 * p) ** 2 / (3000 * p) for k, p in mass.items())
    assert chi < 20.5  # 5 degrees of freedom, p = 0.001


@pytest.mark.parametrize("good,bad,draws", [(3, 5, 4), (50, 30, 20), (0, 9, 4), (9, 0, 4), (4, 4, 8)])
def test_own_sampler_has_the_right_distribution(monkeypatch, good, bad, draws):
    monkeypatch.setattr(shuffle, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(5)
    n = 4000
    counts = collections.Counter(shuffle.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(max(0, draws - bad), min(good, draws) + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(counts[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1
    assert sum(counts.values()) == n


def test_own_sampler_takes_huge_populations():
    rng = np.random.default_rng(6)
    good, bad, draws = 3 * 10**11, 7 * 10**11, 10**7
    got = [shuffle.hypergeometric(rng, good, bad, draws) for _ in range(50)]
    sd = math.sqrt(draws * 0.3 * 0.7)
    assert abs(np.mean(got) - 0.3 * draws) < 5 * sd / math.sqrt(50) and 0.5 * sd < np.std(got) < 1.6 * sd


def test_shuffle_is_uniform_over_places(spark, tmp_path):
    """Each of four rows is about as often in each of four places."""
    frame(spark, [(i, "t", "s") for i in range(4)]).write.parquet(str(tmp_path / "u"))
    df = spark.read.parquet(str(tmp_path / "u"))
    n_partitions = df.rdd.getNumPartitions()
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    parts = [0] * n_partitions
    for r in sizes:
        parts[r["p"]] = r["count"]
    hits = np.zeros(2)
    for seed in range(400):
        hits += shuffle.communication_matrix(parts, [2, 2], seed)[0]
    if parts[0]:
        assert abs(hits[0] - hits[1]) < 5 * math.sqrt(400 * parts[0])


# ---- mixing ----


def water(sizes, weights, total, caps):
    """Targets by the rounds of the definition: clamp what is above, share the rest again."""
    clamped = {}
    while True:
        free = [s for s in sizes if s not in clamped]
        weight = sum(weights[s] for s in free)
        if not free:
            return clamped
        level = (total - sum(clamped.values())) / weight
        above = [s for s in free if level * weights[s] > caps[s] * (1 + 1e-12)]
        if not above:
            return {**clamped, **{s: level * weights[s] for s in free}}
        clamped.update({s: caps[s] for s in above})


def mix_rows():
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "a", None, "", "ß", "z", "hot", "hot", "hot", "hot"])
        words = rng.choice([0, 1, 5, 30])
        rows.append((i, rng.choice([None, " "]) if words == 0 else " \t".join("w" * rng.randint(1, 4) for _ in range(words)), source))
    return rows


def test_mix(spark):
    rows = mix_rows()
    got = {r["doc_id"]: r for r in mixing.mix(frame(spark, rows)).collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal = water(sizes, weights, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    taken = collections.Counter()
    for i, t, s in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (count(t), sizes[s]) and r["target"] == pytest.approx(goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows).repartition(2)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    other = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows), seed="other").collect()}
    assert other != again


@pytest.mark.parametrize("seed", range(6))
def test_water_level(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000]) for k in range(rng.randint(1, 12))}
    df = spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "_null boolean, _name string, source_size long")
    got = {r["_name"]: r["target"] for r in mixing.targets(df).collect()}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = water(sizes, weights, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    for s in sizes:
        assert got[s] == pytest.approx(want[s])


def test_rows_of_a_mix(spark):
    rows = mix_rows()
    df = frame(spark, [(i, t, s, "extra") for i, t, s in rows], "doc_id long, text string, source string, size string")
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and {r["size"] for r in mixed.collect()} == {"extra"}
    got = {r["doc_id"]: r for r in mixing.mix(frame(spark, rows), cut_last=False).collect()}
    assert all(times[i] * r["size"] == r["taken"] for i, r in got.items() if r["size"])
    by_source = collections.Counter()
    for i, _, s in rows:
        by_source[s] += got[i]["taken"]
    largest = max(r["size"] for r in got.values())
    assert all(abs(by_source[s] - next(got[i]["target"] for i, _, x in rows if x == s)) <= largest for s in by_source)


def test_mix_of_nothing_and_copies(spark):
    assert mixing.mix(frame(spark, [(1, "a", "s")]).limit(0)).count() == 0
    same = mixing.mix(frame(spark, [(None, "a b", "s")] * 8)).collect()
    assert sum(r["taken"] for r in same) == 24 and {r["source_size"] for r in same} == {16}
    empty = mixing.mix(frame(spark, [(1, None, "s"), (2, "", None)])).collect()
    assert {(r["target"], r["taken"]) for r in empty} == {(0.0, 0)}


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(frame(spark, mix_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
