"""Toxicity and the corpus pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest

from kymo.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def interactions(n, seed):
    """Texts that are toxic only where an insult and a group come together."""
    rng = random.Random(seed)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(12)] + ["scum"] * insult + ["folk"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    return texts, np.array(labels)


def test_pairs_are_learned():
    texts, y = interactions(1500, 1)
    of = toxicity.Terms()
    model = toxicity.fit([np.array(sorted(of.of(t)), np.int64) for t in texts], y.astype(float), np.ones(len(y)))
    known = toxicity.Terms(frozenset(model.index.tolist()))
    held, truth = interactions(500, 2)
    scores = np.array([model.score(known.of(t)) for t in held])
    assert ((scores >= 0.3) == (truth == 1)).mean() > 0.97
    alone = [model.score(known.of(t)) for t in ("scum", "folk")]
    assert model.score(known.of("scum folk")) > 0.5 > max(alone)


def test_pairs_whose_terms_say_nothing_alone():
    """Toxic where there is an insult or a group, but not both: neither is more frequent in one class."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]

    def made(n):
        out = []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            text = rng.sample(words, rng.randrange(5, 40)) + ["insult"] * a + ["group"] * b
            rng.shuffle(text)
            out.append((" ".join(text), a != b))
        return out

    of = toxicity.Terms()
    train, held = made(3000), made(1000)
    rows, y = [np.array(sorted(of.of(t)), np.int64) for t, _ in train], np.array([v for _, v in train], float)
    model = toxicity.fit(rows, y, np.ones(len(y)))
    known = toxicity.Terms(frozenset(model.index.tolist()))
    assert len(model.index) < 100
    assert auc(np.array([model.score(known.of(t)) for t, _ in held]), np.array([v for _, v in held], float)) > 0.9


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(0.1, np.array([3, 5, 9]), rng.normal(size=3), rng.normal(size=(3, 2)))
    x = 1 / np.sqrt(3)
    z = 0.1 + m.w.sum() + x * x * sum(m.v[i] @ m.v[j] for i in range(3) for j in range(i))
    assert m.score({9, 3, 5}) == pytest.approx(1 / (1 + np.exp(-z)))
    assert m.score(set()) == pytest.approx(1 / (1 + np.exp(-0.1)))


def test_terms():
    of = toxicity.Terms()
    assert of.of("Ab ab, AB!") == of.of("ab") and of.of(None) == of.of(" 12 ") == set()
    assert len(of.of("abcdefg")) == 3 and len(of.of("abcd")) == 1


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", toxicity.is_held_out().alias("h")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}, None: False}


def test_frames(spark):
    texts, y = interactions(400, 3)
    rows = [(i, t, "en", "s", 0, i) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0, 1), (901, "", "en", "s", 0, 1), (0, "x", "en", "s", 0, 1), (None, "scum folk", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(5, 1, None), (900, 1, 1), (None, 1, 1), (1, 1, int(y[1]))], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, usable=~toxicity.is_held_out())
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    by = {r["doc_id"]: r["score"] for r in scored if r["doc_id"] not in (0, None)}
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc(np.array([by[i] for i in held]), y[held]) > 0.95
    assert by[900] == by[901]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in left.collect()) == collections.Counter(r["doc_id"] for r in scored if r["score"] < toxicity.THRESHOLD)
    again = toxicity.train(docs.repartition(7), labels, usable=~toxicity.is_held_out())
    np.testing.assert_allclose(again.w, model.w)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {r["score"] < 1e-6 for r in toxicity.score(docs, model).collect()} == {True}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, one)).first()["score"] > 0.99
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    texts, y = interactions(300, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    seen = []
    inner = toxicity.fit
    toxicity.fit = lambda rows, labels, weights, **k: seen.append((len(rows), weights)) or inner(rows, labels, weights, **k)
    try:
        toxicity.train(docs, labels, max_per_class=20)
    finally:
        toxicity.fit = inner
    n, weights = seen[0]
    assert n == 40 and weights.sum() == pytest.approx(300)


def corpus(spark, folder):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        rows.append((i, text(60) + " scum" * bad, "en", f"src{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "src0", 1) for i in (1, 2, 3)]
    rows += [(300 + i, rows[i][1].rsplit(" ", 1)[0] + " other", "en", "src1", 1) for i in (4, 5)]
    rows += [(400, None, "en", None, 0), (401, "", "en", "src2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_pipeline_stages(spark, tmp_path):
    from .test_bpe import bpe
    from .test_dedup import exact_brute, near_brute

    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/stage{i}"))
        if i < 4:
            assert seen[-1].columns == columns
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in seen]
    clean = [i for i in ids[0] if not (i < 160 and i % 8 == 0)]
    assert ids[1] == clean
    texts = {i: rows[i][1] for i in clean}
    kept = sorted({keep for _, keep, _, _ in exact_brute(list(texts.items()))})
    assert ids[2] == kept
    apart = sorted({c for _, _, c in near_brute([(i, texts[i]) for i in kept])})
    assert ids[3] == apart
    times = collections.Counter(ids[4])
    assert set(times) <= set(apart) and max(times.values()) <= 2
    tokens = {r["doc_id"]: r["ids"] for r in seen[5].collect()}
    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    assert {i: codec.decode(bytes(x)) for i, x in tokens.items()} == {i: texts[i] or "" for i in times}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r["doc_id"] for r in whole.collect()) == times


def test_pipeline_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_leaves_one_result(spark, tmp_path):
    """Of what the stages write only the last stage's input stays."""
    from kymo.llm.common import _made, shared_dir

    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kymo")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName() for f in files.listStatus(folder)} if files.exists(folder) else set()
    corpus(spark, str(tmp_path))
    before, known = len(_made), names()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[1] for p in _made[before:]]
    assert len(left) == 1 and left[0].startswith("mixing") and out.count() > 0
    assert names() - known == set(left)
