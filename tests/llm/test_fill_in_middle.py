"""Fill-in-the-middle against a version with the token pattern."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kymo.llm import fill_in_middle as fim


def plainly(doc_id, text):
    """The contract word for word: pattern, draws, form, pieces."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@given(st.text(alphabet=st.sampled_from(list("abYZ@[`{ \n.1é中🙂ſK")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_token_ends(text):
    import numpy as np

    ends = [0]
    for t in re.findall("[A-Za-z]+|[^A-Za-z]", text):
        ends.append(ends[-1] + len(t))
    assert fim.token_ends(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist() == ends


ODD = [None, "", "a", " ", "<P>", "x<S>y", "a <M> b", "<", "<P", "P>", "<<>>", "a<b<P b>", "é🙂 naïve 中文 text", "\x00퟿￿\r\n", "word " * 60_000, "x" * 300_000, "1" * 100_000, "S>one<", "M>two<S"]


def test_odd_texts_and_round_trip(spark):
    rows = [(i * 1000 + j, t, "x") for i in range(40) for j, t in enumerate(ODD) if i < 3 or len(t or "") < 100] + [(None, "no key here", "x"), (7, "twice told", "x"), (7, "twice told", "x"), (-5, "a negative key", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.transform(df).withColumn("back", fim.restored()).collect()
    want = sorted(((k, *plainly(k, t), t or "") for k, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_shares_of_forms(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    counts = {r["form"]: r["count"] for r in fim.transform(df).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 2000) < 200 and abs(counts["spm"] - 3600) < 250
    other = {r["form"]: r["count"] for r in fim.transform(df, seed=2, plain_from=50, spm_below=100).groupBy("form").count().collect()}
    assert set(other) == {"plain", "spm"} and abs(other["plain"] - 10_000) < 400


def test_own_markers(spark):
    rows = [(i, t) for i, t in enumerate(["alpha beta", "«pre» left in", "with (parentheses) and |bars|", "ends in «"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    markers = ("«pre»", "«suf»", "«mid»")
    got = fim.transform(df, markers=markers).withColumn("back", fim.restored(markers=markers)).collect()
    assert sorted((r["doc_id"], r["back"]) for r in got) == sorted(rows)
    assert {r["form"] for r in got if "«pre»" in r["back"]} == {"plain"} and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aa", "bb", "cc")):
        with pytest.raises(ValueError, match="markers"):
            fim.transform(df, markers=bad)
    with pytest.raises(TypeError, match="whole numbers"):
        fim.transform(df.select(F.col("text").alias("doc_id"), "text"))


def test_query(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, prefix, middle, output = plainly(r["doc_id"], r["text"])
        want.append((r["doc_id"], n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = queries()["op13_fill_in_middle"](spark, sf).collect()
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)
